import hashlib
import random
import re

import numpy as np
import pytest

from llm import bpe, decontaminate, jaccard, kernels, lines, pitman_yor, substrings, suffix

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def corpus(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeats, empty and odd texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefg") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    out = []
    for _ in range(n):
        w = [r.choice(words) for _ in range(r.choice([2, 4, 5, 30, 120, 300]))]
        if r.random() < 0.3:
            w[len(w) // 2 : len(w) // 2] = passage
        out.append(" ".join(w))
    for k in range(20):
        w = out[k % 10].split()
        for _ in range(len(w) // 60):
            w[r.randrange(len(w))] = "edited"
        out.append(" ".join(w))
    out += [out[5], out[5], out[7].upper(), None, "", " \n\t", "é 漢字\x00 word", "a" * 400, "x y z\n" * 60]
    return list(enumerate(out))


def words_of(t, pattern=r"[^\x20\x09-\x0D]+"):
    return re.findall(pattern, (t or "").translate(LOWER))


def shingles(t):
    w = words_of(t)
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_suffix_arrays():
    r = np.random.default_rng(2)
    for _ in range(60):
        s = np.concatenate([r.integers(1, 4, int(r.integers(0, 40))), [0]])
        want = sorted(range(len(s)), key=lambda i: s.tolist()[i:])
        for waves in (600, 0):
            suffix.WAVES_MOST = waves
            assert suffix.suffix_array(s).tolist() == want
    suffix.WAVES_MOST = 600


@pytest.mark.parametrize("small, pivots, block", [(4, 2, 512), (2, 1, 3)])
def test_jaccard_against_all_pairs(spark, docs, small, pivots, block):
    rows = corpus()
    sets = {i: shingles(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.join_documents(spark, docs(rows), small=small, pivots=pivots, block=block).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}


def test_jaccard_odd_rows(spark, docs):
    t = "one two three four five six"
    got = jaccard.join_documents(spark, docs([(3, t), (3, t), (None, t), (1, t.upper()), (9, None)])).collect()
    assert sorted((str(r.doc_id), r.component_id) for r in got) == [("1", 1), ("3", 1), ("3", 1), ("9", 9), ("None", 1)]
    assert jaccard.join_documents(spark, docs([])).count() == 0


def test_bitmap_bounds_overlap():
    r = np.random.default_rng(3)
    for _ in range(50):
        x, y = (np.unique(r.integers(0, 2**63, 50).astype(np.uint64) % np.uint64(90)) * np.uint64(0x9E3779B97F4A7C15) for _ in range(2))
        x, y = np.sort(x), np.sort(y)
        bits = [np.frombuffer(jaccard.bitmap(s), np.uint8) for s in (x, y)]
        assert jaccard.overlap_bound(*bits, len(x), len(y)) >= jaccard.intersection(x, y) == len(np.intersect1d(x, y))


def test_repeats_against_brute_force(spark, docs):
    rows = corpus(4)
    seen, want = set(), {}
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - 99):
            w = b[k : k + 100]
            if w in seen:
                gone[k : k + 100] = b"\x01" * 100
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        want[i] = (len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), hashlib.sha256(kept).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substrings.remove_repeats(spark, docs(rows)).collect()}
    assert got == want
    assert substrings.remove_repeats(spark, docs([])).count() == 0


def test_repeats_of_one_id_are_one_document(spark, docs):
    t = "".join(chr(97 + i * i % 23) for i in range(300))
    got = sorted((str(r.doc_id), r.n_removed) for r in substrings.remove_repeats(spark, docs([(1, t), (1, t), (None, t)])).collect())
    assert [x for x in got if x[0] == "1"][0] == [x for x in got if x[0] == "1"][1] and ("None", 300) in got


def test_lines(spark, docs):
    long = "the quick brown fox jumps over the lazy dog and then it runs far away into the dark woods again"
    near = long.replace("quick", "quick,").replace("again", "AGAIN 7")
    texts = [(2, f"{long}\nown line of two\nab"), (1, f"first\n{near}"), (3, f"ab\n{long}"), (4, None), (5, "")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(spark, docs(texts)).collect()}
    assert got == {1: (f"first\n{near}", 2, 0), 2: ("own line of two\nab", 3, 1), 3: ("ab", 2, 1), 4: (None, 0, 0), 5: ("", 1, 0)}
    assert lines.dedup_lines(spark, docs([])).count() == 0


def test_bpe_against_the_library(spark, docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.default_path())
    t.no_truncation()
    t.no_padding()
    rows = corpus(5) + [(900, "It's <|endoftext|> ΣΑΣ İI x\x1cy \x85 \xa0 don't 12345 ½ ²"), (901, "z" * 3000 + "!" * 300), (902, "é é 漢字かな 🎉")]
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_documents(spark, docs(rows)).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


@pytest.mark.parametrize("block", [200_000, 3])
def test_decontamination_against_brute_force(spark, docs, block):
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    rows = corpus(6)
    items = [(0, rows[3][1]), (1, "é Word"), (2, None), (3, " ".join(rows[20][1].split()[:14])), (None, "aaa bbb"), (4, rows[3][1])]
    docs_ = docs(rows + [(500, "x aaa, BBB y é-word")])
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.digest(decontaminate.contaminated_spans(spark, docs_, spark.createDataFrame(items, "item_id long, text string"), block=block)).collect()}
    windows = {}
    for i, t in items:
        w = words_of(t, pattern)
        for k in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("null" if i is None else str(i))
    for i, t in rows + [(500, "x aaa, BBB y é-word")]:
        w, hit, found = words_of(t, pattern), set(), set()
        for x, names in windows.items():
            for k in range(len(w) - len(x) + 1):
                if tuple(w[k : k + len(x)]) == x:
                    hit.update(range(k, k + len(x)))
                    found |= names
        assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())


def test_language_model(spark, docs):
    rows = [(i, t) for i, t in corpus(7)]
    frame = docs(rows).selectExpr("doc_id", "text", "doc_id % 5 = 0 as held_out")
    model = pitman_yor.train(spark, frame.where("not held_out"), hot=50)
    got = {r.doc_id: r for r in pitman_yor.score(spark, model, frame).collect()}
    count = {}
    for i, t in rows:
        if i % 5:
            for w in [*words_of(t), None]:
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    for i, t in rows:
        tokens = [*words_of(t), None]
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens), sum(w in count for w in tokens), n)
        assert got[i].base_score == pytest.approx(sum(np.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in tokens))
        assert got[i].score < 0
    # probabilities of all words and of the unknown one add up to 1 in every context
    parts = [pitman_yor.Part(r.data, model.totals.value, model.hot.value) for r in model.seats.select("data").collect()]
    assert len(model.hot.value.words) and len(model.pairs.value[0])

    def probability(word, context):
        return np.max([p.probability(word, context) for p in parts], axis=0)  # other parts know less of a word

    words = np.unique(np.concatenate([p.word for p in parts]))
    for c in np.unique(np.concatenate([p.context for p in parts]))[::7].tolist():
        context = np.full(len(words) + 1, c, dtype="<u4")
        assert probability(np.append(words, np.uint64(12345)), context).sum() == pytest.approx(1, abs=1e-6)
    for i, t in rows[::5]:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        _, w, c = pitman_yor.tokens(raw, np.array([0, len(raw)]))
        assert got[i].score == pytest.approx(np.log10(probability(w, c)).sum())
    # neither how frequent words are sent nor the number of parts matters
    again = {r.doc_id: r.score for r in pitman_yor.score(spark, pitman_yor.train(spark, frame.where("not held_out"), hot=50, hot_pairs=0), frame).collect()}
    assert again == pytest.approx({i: r.score for i, r in got.items()})
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = {r.doc_id: r.score for r in pitman_yor.score(spark, pitman_yor.train(spark, frame.where("not held_out"), hot=50), frame).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert again == pytest.approx({i: r.score for i, r in got.items()})


def test_language_model_without_training(spark, docs):
    frame = docs([(1, "a b"), (None, None)]).selectExpr("doc_id", "text", "true as held_out")
    got = pitman_yor.score(spark, pitman_yor.train(spark, frame.where("not held_out")), frame).collect()
    assert sorted(r.n_tokens for r in got) == [1, 3] and {r.base_score for r in got} == {0.0}


def test_kernels_match_python():
    import pyarrow as pa

    texts = [t for _, t in corpus(8)]
    for _, _, raw, offs in kernels.pieces(pa.array(texts), 1 << 30):
        g, at = kernels.shingle_sets(raw, offs)
        assert np.diff(at).tolist() == [len(shingles(t)) for t in texts]
        digests = kernels.set_digests(g, at)
        assert len(set(digests.tolist())) == len({shingles(t) for t in texts})
