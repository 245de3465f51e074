import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(5)
    vocabulary = "river stone garden window morning letter market silver forest bridge summer winter paper candle mirror pocket village harbour ladder engine valley kitchen orchard shadow whisper thunder blanket compass lantern meadow saddle timber voyage anchor basket copper feather glacier hammer island".split()
    good = [f"this is a clean little document about {' '.join(r.sample(vocabulary, 14))}" for _ in range(10)]
    near = good[0] + " and one more closing line of many words that make it long enough to count as a near copy of something\n"
    item = "every benchmark question has some ten words or more inside its text"
    texts = good * 3 + [g.upper().replace(" ", "!! ") for g in good] + [near + good[1], f"leak {item} here", None, ""]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(not 30 <= i < 40), 0) for i in range(42)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, rows, str(tmp_path))
        assert out.columns == rows.columns
        rows = spark.createDataFrame(out.collect(), out.schema)
        sizes.append({r.doc_id for r in rows.collect()})
    assert not sizes[0] & set(range(30, 40)) and set(range(30)) <= sizes[0]
    assert set(range(10)) <= sizes[1] and not sizes[1] & set(range(10, 30))
    assert 41 in sizes[2] and 41 not in sizes[3] and set(range(10)) <= sizes[3]
    final = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert final == sizes[3]
