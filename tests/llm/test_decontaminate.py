import pytest

from llm import decontaminate


@pytest.mark.parametrize("block", [3, 1000])
def test_rows_that_repeat_an_id_stay_apart(spark, docs, block):
    items = spark.createDataFrame([(k, f"a{k} b{k} c{k} d{k}") for k in range(8)], "item_id long, text string")
    rows = [(1, "x a1 b1 c1 d1"), (1, "a5 b5 c5 d5 a6 b6 c6 d6 y z"), (1, "x a1 b1 c1 d1"), (None, "a7 b7 c7 d7"), (None, "q"), (None, None), (2, "a0 b0 c0 d0 a7 b7 c7 d7")]
    got = decontaminate.contaminated_spans(spark, docs(rows), items, block=block).collect()
    seen = sorted((str(r.doc_id), r.n_words, [(s.a, s.b) for s in r.spans], r["items"]) for r in got)
    assert seen == sorted([("1", 5, [(1, 5)], ["1"]), ("1", 10, [(0, 8)], ["5", "6"]), ("1", 5, [(1, 5)], ["1"]), ("None", 4, [(0, 4)], ["7"]), ("None", 1, [], []), ("None", 0, [], []), ("2", 8, [(0, 8)], ["0", "7"])])
