"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages (``passage`` consecutive words each). Every
passage is encoded from what its bytes and words look like (shares of letters,
capitals, digits, marks and symbols, word lengths, repeated words); a gated
attention (tanh and sigmoid branches) weighs the passages; the weighted passage
representation is scored. Only document labels are learnt from.

The fit uses at most ``most`` labelled documents (chosen by a hash of the id); fit and
scoring use every passage of each text. Rows with a null id or label are not learnt from; where labels of a
document disagree, their mean counts; a null id is not held out. Null and empty texts are one passage of
zero features and get the score of that passage. Scores depend on a row's text
alone. Without labels of both kinds the score is the share of label 1 (0.5
without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import batches, crc_mod, ship, table

PASSAGE = 48
MOST = 6000
THRESHOLD = 0.7

_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[0x41:0x5B] = 1  # capitals
_KINDS[0x61:0x7B] = 2
_KINDS[0x30:0x3A] = 3
_KINDS[[ord(c) for c in ".,;:'\"-()"]] = 4
_KINDS[[ord(c) for c in "!?"]] = 5
_KINDS[[ord(c) for c in "*#$%&@^~+=<>[]{}\\/_`"]] = 6
_KINDS[ord("|")] = 7
_KINDS[0x80:] = 8
_KINDS[[0x0A, 0x0D]] = 9
KINDS = 10
FEATURES = KINDS + 8


def features(raw: np.ndarray, offs: np.ndarray, passage: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """A row for each passage, and n + 1 offsets of documents into the rows."""
    s, e, first = K.words(raw, offs)
    docs = len(offs) - 1
    count = np.diff(first)
    bags = np.maximum(1, -(-count // passage))
    at = np.concatenate([[0], np.cumsum(bags)])
    doc = np.repeat(np.arange(docs), bags)
    k = np.arange(at[-1]) - at[doc]
    w0 = first[doc] + k * passage
    w1 = np.minimum(w0 + passage, first[doc + 1])
    n = (w1 - w0).astype(np.float64)
    out = np.zeros((len(doc), FEATURES))
    some = n > 0
    if not some.any():
        return out, at
    b0, b1 = s[w0[some]], e[w1[some] - 1]
    size = (b1 - b0).astype(np.float64)
    kind = _KINDS[raw]
    for j in range(1, KINDS):
        total = np.concatenate([[0], np.cumsum(kind == j, dtype=np.int32)])
        out[some, j] = (total[b1] - total[b0]) / size
    h = K.word_hashes(raw, s, e)
    length = (e - s).astype(np.float64)

    def mean(x: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(x, dtype=np.float64)])
        return (total[w1[some]] - total[w0[some]]) / n[some]

    own = np.repeat(np.arange(docs), count)

    def back(k: int) -> np.ndarray:
        x = np.zeros(len(h), dtype=bool)
        x[k:] = (h[k:] == h[:-k]) & (own[k:] == own[:-k])
        return x

    lone = (length == 1) & (kind[s] >= 4) & (kind[s] != 8)
    ends = kind[e - 1]
    out[some, KINDS] = mean(np.minimum(length, 40)) / 10
    out[some, KINDS + 1] = mean(back(1))
    out[some, KINDS + 2] = mean(back(2))
    out[some, KINDS + 3] = mean(lone)
    out[some, KINDS + 4] = mean((ends == 5) | (ends == 6))
    out[some, KINDS + 5] = mean((kind[s] == 1) & (kind[e - 1] == 1))
    out[some, KINDS + 6] = np.log1p(n[some]) / 5
    out[some, KINDS + 7] = 1.0
    return out, at


class Attention:
    """Encoder, gated attention and scorer, trained by Adam on whole bags."""

    def __init__(self, width: int = 16, gate: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale, self.constant = np.zeros(FEATURES), np.ones(FEATURES), None
        self.p = {
            "W": rng.normal(0, 0.3, (FEATURES, width)), "b": np.zeros(width),
            "V": rng.normal(0, 0.3, (width, gate)), "U": rng.normal(0, 0.3, (width, gate)), "w": rng.normal(0, 0.3, gate),
            "c": rng.normal(0, 0.3, width), "d": np.zeros(1),
        }

    def _forward(self, x: np.ndarray, at: np.ndarray) -> dict:
        p, bag = self.p, np.repeat(np.arange(len(at) - 1), np.diff(at))
        h = np.tanh(x @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, at[:-1])[bag])
        a /= np.add.reduceat(a, at[:-1])[bag]
        z = np.add.reduceat(a[:, None] * h, at[:-1], axis=0)
        return {"bag": bag, "h": h, "t": t, "g": g, "a": a, "z": z, "y": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["d"][0], -30, 30)))}

    def fit(self, x: np.ndarray, at: np.ndarray, y: np.ndarray, rounds: int = 150, rate: float = 0.03, decay: float = 1e-4) -> None:
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return
        self.mean, self.scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, rounds + 1):
            f, p = self._forward(x, at), self.p
            bag, h, a = f["bag"], f["h"], f["a"]
            dy = (f["y"] - y) / len(y)
            dz = dy[:, None] * p["c"]
            da = (dz[bag] * h).sum(axis=1)
            ds = a * (da - np.add.reduceat(a * da, at[:-1])[bag])
            dt, dg = ds[:, None] * p["w"] * f["g"] * (1 - f["t"] ** 2), ds[:, None] * p["w"] * f["t"] * f["g"] * (1 - f["g"])
            dh = (a[:, None] * dz[bag] + dt @ p["V"].T + dg @ p["U"].T) * (1 - h**2)
            grad = {"W": x.T @ dh, "b": dh.sum(axis=0), "V": h.T @ dt, "U": h.T @ dg, "w": ((f["t"] * f["g"]) * ds[:, None]).sum(axis=0), "c": f["z"].T @ dy, "d": np.array([dy.sum()])}
            for k in p:
                g = grad[k] + decay * p[k]
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(at) - 1, self.constant)
        return self._forward(np.clip((x - self.mean) / self.scale, -8, 8), at)["y"]


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = MOST, passage: int = PASSAGE) -> Attention:
    """Fit on at most ``most`` rows of labels (doc_id, label)."""
    ship(spark)
    clean = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    chosen = clean.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("label", "text")  # at most ``most`` rows

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            for i, j, raw, offs in K.pieces(batch.column(1)):
                x, at = features(raw, offs, passage)
                y = batch.column(0).slice(i, j - i).to_pylist()
                bags = [x[at[d] : at[d + 1]].astype("<f4").tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(y, pa.float64()), pa.array(bags, pa.binary())], ["label", "x"])

    got = rows.mapInArrow(run, "label double, x binary").toArrow()
    model = Attention()
    bags = [np.frombuffer(b.as_py(), dtype="<f4").reshape(-1, FEATURES).astype(np.float64) for b in got.column("x")]
    y = np.array(got.column("label").to_pylist(), dtype=np.float64)
    order = sorted(range(len(bags)), key=lambda i: (bags[i].tobytes(), y[i]))  # the same fit whatever the order of rows
    bags, y = [bags[i] for i in order], y[order]
    at = np.concatenate([[0], np.cumsum([len(b) for b in bags])]).astype(np.int64)
    model.fit(np.concatenate(bags) if bags else np.zeros((0, FEATURES)), at, y)
    return model


def score(spark: SparkSession, docs: DataFrame, model: Attention, keep: tuple[str, ...] = (), passage: int = PASSAGE) -> DataFrame:
    """The columns in ``keep`` and a score for each row's text."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    source = docs.select("text", *[c for c in keep if c != "text"])
    names = list(keep)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            if not batch.num_rows:
                continue
            y = [sent.value.score(*features(raw, offs, passage)) for _, _, raw, offs in K.pieces(batch.column(0))]
            yield pa.RecordBatch.from_arrays([*[batch.column(batch.schema.names.index(c)) for c in names], pa.array(np.concatenate(y), pa.float64())], [*names, "score"])

    return source.mapInArrow(run, "".join(f"`{c}` {source.schema[c].dataType.simpleString()}, " for c in names) + "score double")


def keep_good(spark: SparkSession, docs: DataFrame, model: Attention, threshold: float = THRESHOLD, passage: int = PASSAGE) -> DataFrame:
    """The rows of docs, with all their columns, whose text scores at least ``threshold``."""
    ship(spark)
    sent = spark.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(it):
            if batch.num_rows:
                y = np.concatenate([sent.value.score(*features(raw, offs, passage)) for _, _, raw, offs in K.pieces(batch.column(at))])
                yield batch.filter(pa.array(y >= threshold))

    return docs.mapInArrow(run, docs.schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    labels = table(spark, sf_dir, "labels", "doc_id", "quality").where(crc_mod("doc_id", 4) != 2).withColumnRenamed("quality", "label")
    out = score(spark, docs, train(spark, docs, labels), ("doc_id",))
    return out.select("doc_id", F.coalesce(crc_mod("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
