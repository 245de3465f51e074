import hashlib

import numpy as np
import pytest

from llm import ann, quality, toxicity, warc


def rows(spark, pairs, schema):
    return spark.createDataFrame(pairs, schema)


def test_quality(spark):
    r = np.random.default_rng(1)
    words = ["ab", "cde", "fgh", "ij", "klmno"]
    good = [" ".join(r.choice(words, 40)) + ". And so on." for _ in range(60)]
    bad = [" ".join(w.upper() + "!!" for w in r.choice(words, 40)) for _ in range(60)]
    docs = rows(spark, [*enumerate(good + bad), (None, "x"), (500, None), (501, "")], "doc_id long, text string")
    labels = rows(spark, [*[(i, int(i < 60)) for i in range(0, 120, 2)], (None, 1), (3, None), (4, 1)], "doc_id long, label int")
    model = quality.train(spark, docs, labels)
    got = {x.doc_id: x.score for x in quality.score(spark, docs, model, ("doc_id",)).collect()}
    assert all((got[i] >= 0.7) == (i < 60) for i in range(120)) and got[500] == pytest.approx(got[501])
    kept = quality.keep_good(spark, docs, model)
    assert kept.columns == ["doc_id", "text"] and {x.doc_id for x in kept.collect()} >= set(range(60))
    assert quality.train(spark, docs, labels.limit(0)).constant == 0.5


def test_toxicity(spark):
    r = np.random.default_rng(2)
    words = ["ab", "cde", "fgh", "ij", "klmno", "the", "of"]
    clean = [" ".join(r.choice(words, 30)) for _ in range(150)]
    bad = [" ".join(np.insert(r.choice(words, 30), [3, 9, 20], r.choice(["zorkish", "idiot", "blargful"], 3))) for _ in range(150)]
    docs = rows(spark, [*enumerate(clean + bad), (900, None), (901, "")], "doc_id long, text string")
    labels = rows(spark, [(i, int(i >= 150)) for i in range(0, 300) if i % 3], "doc_id long, label int")
    model = toxicity.train(spark, docs, labels)
    got = {x.doc_id: x.score for x in toxicity.score(spark, docs, model, ("doc_id",)).collect()}
    assert all((got[i] >= 0.5) == (i >= 150) for i in range(300)) and got[900] == pytest.approx(got[901]) and got[900] < 0.5


def test_grammar():
    one = lambda *tags: toxicity.clause_weight([(t, 1.0, 0) for t in tags])
    assert one("N", "I") < one("I") < one("T", "I") and one("R", "I") < one("I")
    assert toxicity.clause_weight([("N", 1.0, 0), ("I", 1.0, 5)]) == one("I")
    assert one("T", "H") > one("H") and one("T") == 0


def test_nearest_neighbours(spark):
    r = np.random.default_rng(3)
    v = r.normal(size=(600, 16)).astype(np.float32)
    v[50:150] = v[7]
    given = [(i, [float(x) for x in v[i]]) for i in range(600)] + [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] + [1.0] * 15), (1004, [1.0]), (None, [1.0] * 16), (3, [float(x) for x in v[3]])]
    valid = ann.valid(rows(spark, given, "vec_id long, embedding array<float>"))
    books, lists = ann.build(spark, valid)
    got = {}
    for x in ann.search(spark, books, lists, valid.where("vec_id % 50 = 0"), share=0.6, least=300).collect():
        got.setdefault(x.query_id, []).append((x.rank, x.vec_id, x.score))
    assert set(got) == set(range(0, 600, 50))
    u = v.astype(np.float64)
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == [1, 2, 3, 4, 5] and [h[2] for h in hits] == sorted((h[2] for h in hits), reverse=True)
        cos = (u @ u[q]) / (np.linalg.norm(u, axis=1) * np.linalg.norm(u[q]))
        cos[q] = -9
        found += sum(h[2] >= np.sort(cos)[-5] - 1e-12 for h in hits)
        assert all(abs(cos[h[1]] - h[2]) < 1e-12 for h in hits)
    assert found >= 0.9 * 5 * len(got)
    assert [h[1] for h in got[50]] == [7, 51, 52, 53, 54]  # copies: ties to the smaller id
    none = valid.where("false")
    assert ann.search(spark, *ann.build(spark, none), none).count() == 0


def test_searches_send_queries_once(spark):
    """A query is sent once, not to each of its cells; many copies are found by their smallest ids."""
    r = np.random.default_rng(4)
    v = r.normal(size=(3000, 16)).astype(np.float32)
    v[::3] = v[0]
    given = rows(spark, [(i, [float(x) for x in v[i]]) for i in range(3000)], "vec_id long, embedding array<float>")
    valid = ann.valid(given)
    books, lists = ann.build(spark, valid, centroids=32)
    queries = valid.where("vec_id % 50 = 0")
    sent = ann.asked(spark, books, queries, 1650).selectExpr("sum(length(q_ids) + length(q_cells) + length(q_vectors)) as n").first().n
    assert sent <= 60 * (8 + 32 * 32 // 8 + 16 * 4)
    held = lists.selectExpr("sum(length(ids)) as ids", "sum(length(vectors)) as vectors").first()
    assert held.ids == 3000 * 8 and held.vectors <= 2100 * 16 * 4
    got = {}
    for x in ann.search(spark, books, lists, queries, share=0.55, least=300).orderBy("query_id", "rank").collect():
        got.setdefault(x.query_id, []).append((x.vec_id, x.score))
    assert set(got) == set(range(0, 3000, 50)) and [i for i, _ in got[0]] == [3, 6, 9, 12, 15] and [i for i, _ in got[150]] == [0, 3, 6, 9, 12]
    u = v / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    found = 0
    for q, hits in got.items():
        cos = u @ u[q]
        cos[q] = -9
        found += sum(s >= np.sort(cos)[-5] - 1e-6 for _, s in hits)
    assert found >= 0.9 * 5 * len(got)


PAGES = "page_id long, url string, html string"


def test_archives(spark, tmp_path):
    same, other = "<p>é</p>" * 300, "\r\n\r\nWARC/1.1\r\n" * 200
    pages = [(1, "http://a/x", same), (2, None, same), (3, "u v", "short"), (4, "u", "short"), (5, "u", None), (6, "", other), (7, "u", same), (None, "u", "x")]
    path = str(tmp_path / "archives")
    warc.write_archives(spark, rows(spark, pages, PAGES), path, classes=((1000, 4), (1 << 62, 3)))
    got = {}
    for x in warc.assemble(warc.read_archives(spark, path)).collect():
        page = int(x.metadata.fields.get("page-id", 8))
        got[page] = x
        assert x.request.http_head.startswith("GET /") and int(x.metadata.fields["payload-length"]) == len((pages[page - 1][2] or "").encode())
        assert x.main.payload_digest == hashlib.sha1((pages[page - 1][2] or "").encode()).hexdigest()
    assert sorted(got) == [1, 2, 3, 4, 5, 6, 7, 8]
    assert {p: x.main.record_type for p, x in got.items()} == {1: "revisit", 2: "revisit", 3: "response", 4: "response", 5: "response", 6: "response", 7: "response", 8: "response"}
    assert got[6].main.payload == other and got[1].main.refers_to == got[7].main.record_id and got[1].main.payload is None
    with pytest.raises(ValueError):
        list(warc.parse(b"WARC/1.1\r\nContent-Length: 9\r\n\r\nshort"))


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write_archives(spark, rows(spark, [], PAGES), path)
    assert warc.assemble(warc.read_archives(spark, path)).count() == 0
