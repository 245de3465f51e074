"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are tagged (insult, threat, target, modal, negation, reported speech); transducers
for insults (a further one in a clause weighs more), threats (more behind a modal),
targets, negation scope and reported speech are composed into one machine, which reads
the tags of a clause and scales the weight of each insult or threat. A clause counts as
matched by its insults and threats together; a document's score is a logistic function of
its matched clauses, of their weights, and of both by its words.

Insult arcs are words and word beginnings of ``STEMS`` bytes learnt from labelled
documents (at most ``most``, chosen by a hash of the id), by the log ratio of their mean
shares of the words of toxic and of clean documents, beside a small fixed list. One half of these documents gives the arcs, the
other the logistic weights. Null and empty texts match nothing and get the score of no
match. Rows with null id or label are not learnt from; a document labelled both ways
counts as toxic; a null id is not held out. Scores depend on a row's text alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import batches, crc_mod, drop, ship, table, written

MOST = 20_000
THRESHOLD, PRIOR = 0.5, 0.002
STEMS = (4, 5, 6, 7)

TAGS = "IHTMNRO"
INSULT, THREAT, TARGET, MODAL, NEGATION, REPORT, OTHER = TAGS
SEEDS = {
    INSULT: "idiot idiots moron morons stupid scum trash loser losers pathetic worthless disgusting clown clowns dumb".split(),
    THREAT: "kill hurt destroy punish burn smash strangle".split(),
    TARGET: "you your yours he she they him her them his their people everyone".split(),
    MODAL: "will shall must should gonna going".split(),
    NEGATION: "not no never nobody isn hardly without".split(),
    REPORT: "said says say wrote writes claimed claims reported quoted called alleged".split(),
}


class Transducer:
    """start, and (state, tag) -> (state, factor)."""

    def __init__(self, start, arcs: dict):
        self.start, self.arcs = start, arcs

    def compose(self, other: "Transducer") -> "Transducer":
        """Both read the same tags; states pair up and factors multiply."""
        arcs, todo, seen = {}, [(self.start, other.start)], set()
        while todo:
            a, b = state = todo.pop()
            if state in seen:
                continue
            seen.add(state)
            for tag in TAGS:
                (x, f), (y, g) = self.arcs[a, tag], other.arcs[b, tag]
                arcs[state, tag] = ((x, y), f * g)
                todo.append((x, y))
        return Transducer((self.start, other.start), arcs)


def _insult() -> Transducer:
    return Transducer(0, {(s, t): (1 if s or t == INSULT else 0, 1.2 if s and t == INSULT else 1.0) for s in (0, 1) for t in TAGS})


def _threat(scope: int = 3) -> Transducer:
    return Transducer(0, {(s, t): (scope if t == MODAL else max(0, s - 1), 2.0 if s and t == THREAT else 1.0) for s in range(scope + 1) for t in TAGS})


def _negation(scope: int = 3) -> Transducer:
    return Transducer(0, {(s, t): (scope if t == NEGATION else max(0, s - 1), 0.3 if s and t in (INSULT, THREAT) else 1.0) for s in range(scope + 1) for t in TAGS})


def _report() -> Transducer:
    return Transducer(0, {(s, t): (1 if s or t == REPORT else 0, 0.5 if s and t in (INSULT, THREAT) else 1.0) for s in (0, 1) for t in TAGS})


def _target() -> Transducer:
    return Transducer(0, {(s, t): (1 if s or t == TARGET else 0, {INSULT: 1.3, THREAT: 3.0}.get(t, 1.0) if s else 1.0) for s in (0, 1) for t in TAGS})


GRAMMAR = _insult().compose(_threat()).compose(_target()).compose(_negation()).compose(_report())


def clause_weight(tagged: list[tuple[str, float, int]], grammar: Transducer = GRAMMAR) -> float:
    """Weight of a clause from its tagged words: (tag, weight, words since the last tagged one)."""
    state, total = grammar.start, 0.0
    for tag, weight, gap in tagged:
        for _ in range(min(gap, 3)):
            state, _ = grammar.arcs[state, OTHER]
        state, factor = grammar.arcs[state, tag]
        if tag in (INSULT, THREAT):
            total += weight * factor
    return total


_CLAUSE = np.zeros(256, dtype=np.int32)
_CLAUSE[[ord(c) for c in ".;:!?\n\r"]] = 1


def word_hash(word: str | bytes) -> int:
    raw = np.frombuffer(word.encode() if isinstance(word, str) else word, dtype=np.uint8)
    return int(K.hash_words(raw, K.prefix_hash(raw), np.array([0]), np.array([len(raw)]))[0])


class Lexicon:
    """Arcs by hash: whole words, and beginnings of so many bytes."""

    def __init__(self, words: dict[str, tuple[str, float]], stems: dict[int, dict[int, float]]):
        self.parts = [self._table({word_hash(w): v for w, v in words.items()})] + [self._table({h: (INSULT, x) for h, x in stems.get(k, {}).items()}) for k in STEMS]

    @staticmethod
    def _table(arcs: dict[int, tuple[str, float]]):
        keys = np.array(sorted(arcs), dtype=K.U64)
        maybe = np.zeros(1 << 16, dtype=bool)
        maybe[(keys & K.U64(0xFFFF)).astype(np.int64)] = True
        return keys, maybe, "".join(arcs[k][0] for k in keys.tolist()), np.array([arcs[k][1] for k in keys.tolist()])

    @staticmethod
    def _find(h: np.ndarray, part) -> tuple[np.ndarray, np.ndarray]:
        keys, maybe = part[:2]
        at = np.flatnonzero(maybe[(h & K.U64(0xFFFF)).astype(np.int64)])
        j = np.searchsorted(keys, h[at])
        ok = (j < len(keys)) & (keys[np.minimum(j, len(keys) - 1)] == h[at]) if len(keys) else np.zeros(len(at), bool)
        return at[ok], j[ok]

    def matches(self, raw: np.ndarray, offs: np.ndarray) -> list[tuple[float, float, float, float]]:
        """Per document: sum and largest of its clause weights, matched clauses, and words."""
        low = K.LOWER[raw]
        s, e, first = K.words(low, offs, K.ALNUM_BREAK)
        prefix = K.prefix_hash(low)
        out = [(0.0, 0.0, 0.0, float(n)) for n in np.diff(first).tolist()]
        at, row = self._find(K.hash_words(low, prefix, s, e), self.parts[0])
        found = {p: (self.parts[0][2][r], float(self.parts[0][3][r])) for p, r in zip(at.tolist(), row.tolist())}
        for k, part in zip(STEMS, self.parts[1:]):
            if len(part[0]):
                long = np.flatnonzero(e - s >= k)
                at, row = self._find(K.span_hash(prefix, s[long], s[long] + k), part)
                for p, r in zip(long[at].tolist(), row.tolist()):
                    tag, weight = found.get(p, (INSULT, 0.0))
                    if tag == INSULT:
                        found[p] = (INSULT, max(weight, float(part[3][r])))
        if not found:
            return out
        pos = np.array(sorted(found), dtype=np.int64)
        doc = np.searchsorted(first, pos, side="right") - 1
        strong = np.array([found[p][0] in (INSULT, THREAT) for p in pos.tolist()])
        wanted = np.zeros(len(offs) - 1, dtype=bool)
        wanted[doc[strong]] = True
        pos, doc = pos[wanted[doc]], doc[wanted[doc]]
        if not len(pos):
            return out
        clause = np.cumsum(_CLAUSE[raw])[s[pos]]
        cut = np.flatnonzero((np.diff(doc) != 0) | (np.diff(clause) != 0)) + 1
        for part in np.split(np.arange(len(pos)), cut):
            words = pos[part].tolist()
            w = clause_weight([(*found[p], p - q - 1) for p, q in zip(words, [words[0] - 1, *words])])
            if w > 0:
                d = int(doc[part[0]])
                a, b, n, size = out[d]
                out[d] = (a + w, max(b, w), n + 1, size)
        return out


def _inputs(m: list[tuple[float, float, float, float]]) -> np.ndarray:
    x = np.array(m, dtype=np.float64).reshape(-1, 4)
    share = 100 / (x[:, 3] + 20)
    return np.column_stack([np.ones(len(x)), np.log1p(x[:, 0]), np.log1p(x[:, 1]), np.log1p(x[:, 2]), np.log1p(x[:, 0] * share), np.log1p(x[:, 2] * share)])


class Model:
    def __init__(self, lexicon: Lexicon, weights: np.ndarray):
        self.lexicon, self.weights = lexicon, weights

    def score(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_inputs(self.lexicon.matches(raw, offs)) @ self.weights, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> np.ndarray:
    """Newton's method; at a separable set the ridge keeps the weights finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + ridge * w)
    return w


def _evidence(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each word or beginning by label: kind (0, or bytes of a beginning; -1: documents), word, its shares of the words of toxic and of clean documents in all, toxic documents."""
    n: dict[tuple[int, bytes], list[float]] = {}
    for batch in it:
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            low = (text.as_py() or "").encode().translate(K.LOWER.tobytes())
            seen: Counter[tuple[int, bytes]] = Counter()
            for w, c in Counter(low.translate(_BLANK).split()).items():
                seen[0, w] += c
                for k in STEMS:
                    if len(w) > k:
                        seen[k, w[:k]] += c
            size = max(1, sum(c for (k, _), c in seen.items() if k == 0))
            n.setdefault((-1, b""), [0.0, 0.0, 0])[0 if label else 1] += 1
            for x, c in seen.items():
                row = n.setdefault(x, [0.0, 0.0, 0])
                row[0 if label else 1] += c / size
                row[2] += bool(label)
    rows = [(k, w, *c) for (k, w), c in n.items()]
    for i in range(0, len(rows), 50_000):
        part = list(zip(*rows[i : i + 50_000]))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int32()), pa.array(part[1], pa.binary()), pa.array(part[2], pa.float64()), pa.array(part[3], pa.float64()), pa.array(part[4], pa.int64())], ["kind", "word", "toxic", "clean", "n"])


_BLANK = bytes(0x20 if K.ALNUM_BREAK[b] else b for b in range(256))


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST) -> Model:
    """Learn arcs and weights from at most ``most`` rows of labels (doc_id, label)."""
    ship(spark)
    clean = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg((F.max("label") > 0).cast("int").alias("label"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``most`` rows
    half = F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2))
    found = rows.where(half == 0).select("label", "text").mapInArrow(_evidence, "kind int, word binary, toxic double, clean double, n long")
    found = written(spark, found.groupBy("kind", "word").agg(F.round(F.sum("toxic"), 6).alias("toxic"), F.round(F.sum("clean"), 6).alias("clean"), F.sum("n").alias("n")), "toxicity-evidence")
    total = found.where("kind < 0").first()
    t, n = (total.toxic, total.clean) if total else (0, 0)
    odds = F.log((F.col("toxic") + PRIOR) / (t + 1.0)) - F.log((F.col("clean") + PRIOR) / (n + 1.0))
    least = max(3, int(t) // 200)
    arcs = found.where((F.col("n") >= least) & (F.col("kind") >= 0)).withColumn("odds", odds).where("odds > 3").orderBy(F.desc("n"), "kind", "word").collect()  # no more than ``most`` documents give
    drop(spark, found)
    words = {w: (tag, 4.0) for tag, ws in SEEDS.items() for w in ws}
    stems: dict[int, dict[int, float]] = {k: {} for k in STEMS}
    for r in arcs:
        weight = min(float(r.odds), 8.0) * min(1.0, r.n / (4.0 * least))  # a word of a few copies weighs less
        if r.kind == 0:
            w = bytes(r.word).decode("utf-8", "replace")
            words[w] = (INSULT, max(weight, words.get(w, ("", 0.0))[1]) if words.get(w, (INSULT,))[0] == INSULT else weight)
        else:
            stems[r.kind][word_hash(bytes(r.word))] = weight * 0.8
    lexicon = Lexicon(words, stems)
    sent = spark.sparkContext.broadcast(lexicon)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            for i, j, raw, offs in K.pieces(batch.column(1)):
                x = sent.value.matches(raw, offs)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *(pa.array(c, pa.float64()) for c in zip(*x))], ["label", "a", "b", "c", "n"])

    got = rows.where(half == 1).select("label", "text").mapInArrow(run, "label int, a double, b double, c double, n double").collect()  # at most ``most`` rows
    got = sorted(tuple(r) for r in got)
    if len({r[0] for r in got}) < 2:
        return Model(lexicon, np.array([-3.0, 2.0, 0.0, 0.0, 0.0, 0.0]))
    return Model(lexicon, _logistic(_inputs([r[1:] for r in got]), np.array([r[0] for r in got], dtype=np.float64)))


def score(spark: SparkSession, docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns in ``keep`` and a score for each row's text."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    source = docs.select("text", *[c for c in keep if c != "text"])
    names = list(keep)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            if not batch.num_rows:
                continue
            y = [sent.value.score(raw, offs) for _, _, raw, offs in K.pieces(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in names], pa.array(np.concatenate(y), pa.float64())], [*names, "score"])

    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in names) + "score double")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic").where(crc_mod("doc_id", 5) != 0).withColumnRenamed("toxic", "label")
    out = score(spark, docs, train(spark, docs, labels), ("doc_id",))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
