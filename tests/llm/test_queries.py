"""The registered queries on small tables, against SQL or plain Python."""

import hashlib
import math
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from llm import kernels
from llm.queries import ORACLE, QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
R = np.random.default_rng(9)
WORDS = ["ab", "cde", "fgh", "ij", "klmno", "the", "of", "pq", "rstu", "vwx"] + [f"w{i}" for i in range(300)]


def prose(n, extra=()):
    return " ".join([*R.choice(WORDS, n), *extra])


def tables(empty=False):
    texts = [prose(int(n)) for n in R.choice([3, 8, 40, 90, 300], 60)]
    texts += [texts[3], texts[3] + " edited", texts[7].upper(), None, "", " \n\t", prose(30, ["idiot", "scum"]), "é 漢字 " + prose(20), "Menu\nMenu\n" + prose(12)]
    item = prose(14)
    texts += [prose(20) + " " + item + " " + prose(5), "x", texts[0]]
    ids = [*range(len(texts) - 2), None, 5]  # a null id, and one that comes twice with other texts
    docs = pa.table({"doc_id": pa.array(ids, pa.int64()), "text": texts, "lang": ["en"] * len(ids), "source": ["s"] * len(ids), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "label": ["clash"] * len(ids)})
    labels = pa.table({"doc_id": pa.array([*range(0, 60), None], pa.int64()), "quality": pa.array([*(i % 3 for i in range(60)), 1], pa.int32()), "toxic": pa.array([*(int(i % 7 == 0) for i in range(60)), None], pa.int32())})
    benchmark = pa.table({"item_id": pa.array([1, 2, None, 4], pa.int64()), "text": [item, "ij the", "p q, r", None]})
    same = "<p>é</p>" * 300
    pages = pa.table({"page_id": pa.array([1, 2, 3, 7, None, 9, 9], pa.int64()), "url": ["http://a", None, "u v", "u", "u", "u", "u"], "html": [same, same, "short", same, "x", None, "other"]})
    v = R.normal(size=(160, 8)).astype(np.float32)
    v[40:60] = v[7]
    vectors = [list(map(float, x)) for x in v] + [None, [0.0] * 8, [float("nan")] * 8]
    embeddings = pa.table({"vec_id": pa.array([*range(160), 500, 550, 600], pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float32())), "label": pa.array([0] * 163, pa.int32())})
    out = {"documents": docs, "labels": labels, "benchmark": benchmark, "pages": pages, "embeddings": embeddings}
    return {k: t.slice(0, 0) for k, t in out.items()} if empty else out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    for name, t in tables().items():
        pq.write_table(t, path / f"{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def rows(folder):
    t = pq.read_table(f"{folder}/documents.parquet")
    return list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))


def crc(i, m):
    return i is not None and zlib.crc32(str(i).encode()) % m


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in tables():
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    want = con.execute(ORACLE[name])
    columns = sorted(c[0] for c in want.description)
    plain = lambda rows_: sorted((tuple(str(r[c]) for c in columns) for r in rows_))
    want = plain([dict(zip([c[0] for c in want.description], r)) for r in want.fetchall()])
    assert plain([r.asDict() for r in QUERIES[name](spark, folder).select(*columns).collect()]) == want and want


def test_language_model_query(spark, folder, rows):
    got = QUERIES["op5_pitman_yor"](spark, folder).collect()
    count = {}
    for i, t in rows:
        if crc(i, 7) != 2:
            for w in [*words(t), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), crc(i, 7) == 2, len(words(t)) + 1, sum(w in count for w in [*words(t), None]), n, round(sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 for r in got)


@pytest.mark.parametrize("name, m, k, bar", [("op9_quality", 4, 2, 0.7), ("op10_toxicity", 5, 0, 0.5)])
def test_classifier_queries(spark, folder, rows, name, m, k, bar):
    got = QUERIES[name](spark, folder).collect()
    assert sorted((str(r.doc_id), r.held_out) for r in got) == sorted((str(i), i is not None and crc(i, m) == k) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= bar) for r in got)


def test_search_query(spark, folder):
    t = pq.read_table(f"{folder}/embeddings.parquet")
    ids, v = t["vec_id"].to_pylist()[:160], np.array(t["embedding"].to_pylist()[:160], dtype=np.float64)
    got = {}
    for r in QUERIES["op4_multi_index"](spark, folder).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == {0, 50, 100, 150}
    for q, hits in got.items():
        hits.sort()
        cos = v @ v[q] / (np.linalg.norm(v, axis=1) * np.linalg.norm(v[q]))
        want = sorted((-c, i) for c, i in zip(np.round(cos, 12).tolist(), ids) if i != q)[:5]
        assert [h[1] for h in hits] == [i for _, i in want] and [h[2] for h in hits] == pytest.approx([-c for c, _ in want])


def test_line_query(spark, folder, rows):
    got = QUERIES["op3_line_dedup"](spark, folder).collect()
    assert sorted((str(r.doc_id), r.n_lines) for r in got) == sorted((str(i), 0 if t is None else t.count("\n") + 1) for i, t in rows)
    by = {r.doc_id: r for r in got if r.doc_id not in (None, 5)}
    first = next(i for i, t in rows if t == rows[3][1])
    assert by[first].n_removed == 0 and by[60].n_removed == 1 and by[60].kept_sha256 == hashlib.sha256(b"").hexdigest() and by[68].n_removed == 1


def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    for name, t in tables(empty=True).items():
        pq.write_table(t, tmp_path / f"{name}.parquet")
    for name, query in {**QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_long_words_do_not_collide():
    a, b = "a", "b"
    for _ in range(11):
        a, b = a + b, b + a
    raw = np.frombuffer((a + " " + b).encode(), np.uint8)
    h = kernels.word_hashes(raw, np.array([0, len(a) + 1]), np.array([len(a), len(a) + 1 + len(b)]))
    assert h[0] != h[1]
