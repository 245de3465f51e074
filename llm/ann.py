"""Approximate nearest neighbours by cosine: an inverted multi-index.

Method: unit vectors are cut into two halves and each half is quantised by its
own codebook (k-means on at most ``sample`` distinct vectors); a vector's cell is
the pair of its centroids. A query walks through pairs in order of the summed
distance with a heap until their entries reach ``share`` of all, and ``least`` at least; the
entries of these cells are reranked by the exact cosine in double precision.
A query is sent with a bit for each cell and once, in blocks of ``QUERIES``, to meet blocks of
about ``BLOCK`` bytes of entries in cell order; a task holds one pair of blocks at a time, and the best so far.
Vectors without clusters, as here, have their neighbours in far cells: a tenth of
the entries then gives half of the true neighbours, a half of them over 0.9, so
the share is a parameter to lower where vectors cluster.

Every valid vector is indexed. Vectors that are null, zero, of another length
than most, or hold null or non-finite components take no part, and neither do
rows with a null id. Rows that repeat an id count once (the largest vector by its bytes).
Equal scores go to the smaller id. Large cells are dealt over several tasks by
their known size, so copies of one vector do not meet in one task; copies in a block are
held as one vector with all its ids, of which a query takes the smallest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm.common import drop, partitions, ship, table, written

SAMPLE, SHARE, LEAST, TOP = 16_000, 0.55, 4000, 5
#: Entries of a cell on average, and the most centroids of a half.
CELL, CENTROIDS_MOST = 12, 64
BLOCK, SALT_ROWS, QUERIES = 1 << 20, 8192, 1024
#: Of each vector of a block its cell and number of ids; the ids, ascending for each vector; the vectors.
LISTS = {"cells": "<i4", "counts": "<i4", "ids": "<i8", "vectors": None}
ASKED = {"q_ids": "<i8", "q_cells": "u1", "q_vectors": None}


def valid(vectors: DataFrame, id_col: str = "vec_id", column: str = "embedding") -> DataFrame:
    """Rows (vec_id long, v) that take part; v is array<float> if the column is, else array<double>."""
    single = vectors.select(column).schema[0].dataType.simpleString() == "array<float>"
    v = F.col(column) if single else F.col(column).cast("array<double>")
    ok = F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(F.coalesce(ok, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    size = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return rows.where(F.size("v") == (size.d if size else 0)).groupBy("vec_id").agg(F.max("v").alias("v"))


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(axis=1, keepdims=True)  # first, so that squares neither vanish nor overflow
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, always summed in the same order: equal vectors get equal scores."""
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1)))


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    if not len(x):
        return x
    x = np.unique(x, axis=0)
    rng = np.random.default_rng(seed)
    c = x[rng.permutation(len(x))[:k]]
    for _ in range(rounds):
        near = np.argmin((c * c).sum(axis=1) - 2 * x @ c.T, axis=1)
        for j in range(len(c)):
            if (own := near == j).any():
                c[j] = x[own].mean(axis=0)
    return c


class Codebooks:
    def __init__(self, sample: np.ndarray, k: int):
        self.half = (sample.shape[1] + 1) // 2
        u = _unit(sample) if len(sample) else sample
        self.books = [kmeans(u[:, : self.half], k), kmeans(u[:, self.half :], k)] if sample.shape[1] > 1 else [kmeans(u, k), np.zeros((1, 0))]
        self.counts: dict[int, int] = {}
        self.kind = "<f8"

    def distances(self, v: np.ndarray) -> list[np.ndarray]:
        u = _unit(v)
        return [np.maximum(0, (x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)) for x, c in zip((u[:, : self.half], u[:, self.half :]), self.books)]

    def cells(self, v: np.ndarray) -> np.ndarray:
        a, b = self.distances(v)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def walk(self, a: np.ndarray, b: np.ndarray, candidates: int) -> Iterator[int]:
        """Cells by summed distance until their entries reach ``candidates``."""
        i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
        a, b = a[i], b[j]
        heap, seen, got = [(a[0] + b[0], 0, 0)], {(0, 0)}, 0
        while heap and got < candidates:
            _, x, y = heapq.heappop(heap)
            cell = int(i[x]) * len(b) + int(j[y])
            if n := self.counts.get(cell, 0):
                got += n
                yield cell
            for p in ((x + 1, y), (x, y + 1)):
                if p[0] < len(a) and p[1] < len(b) and p not in seen:
                    seen.add(p)
                    heapq.heappush(heap, (a[p[0]] + b[p[1]], *p))


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kind(rows: DataFrame) -> str:
    """How vectors are packed: in the precision they came in."""
    return "<f4" if rows.schema["v"].dataType.simpleString() == "array<float>" else "<f8"


def _binaries(names) -> str:
    return ", ".join(f"{c} binary" for c in names)


def _pack(rows: list[tuple], names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.binary()) for k in range(len(names))], list(names))


def build(spark: SparkSession, rows: DataFrame, centroids: int | None = None, sample: int = SAMPLE) -> tuple[Codebooks, DataFrame]:
    """Codebooks, and the inverted lists as packed blocks of a cell's entries."""
    ship(spark)
    rows = written(spark, rows.select("vec_id", "v"), "ann-vectors")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toArrow()  # at most ``sample`` rows
    k = centroids or min(CENTROIDS_MOST, max(4, int((rows.count() / CELL) ** 0.5)))
    books = Codebooks(_matrix(drawn.column("v")).astype(np.float64) if drawn.num_rows else np.zeros((0, 2)), k)
    books.kind = kind = _kind(rows)
    sent = spark.sparkContext.broadcast(books)

    def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sent.value.cells(_matrix(batch.column(1)).astype(np.float64)), pa.int32())], ["vec_id", "v", "cell"])

    placed = rows.mapInArrow(assign, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, cell int")
    books.counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # centroids squared at most
    placed = placed.withColumn("salt", F.pmod(F.hash("vec_id"), _salts(books)).cast("int"))

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in it:
            for k in range(0, batch.num_rows, 2048):
                ids, v, cell = (batch.column(c).slice(k, 2048) for c in range(3))
                ids, v, cell = ids.to_numpy(), _matrix(v), cell.to_numpy()
                first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]).any(axis=1) | (cell[1:] != cell[:-1])]))
                counts = np.diff(np.concatenate([first, [len(ids)]]))
                held.append((cell[first].astype("<i4").tobytes(), counts.astype("<i4").tobytes(), ids.astype("<i8").tobytes(), v[first].astype(kind).tobytes()))
                n += sum(map(len, held[-1]))
                if n >= BLOCK:
                    yield _pack([tuple(map(b"".join, zip(*held)))], LISTS)
                    held, n = [], 0
        if held:
            yield _pack([tuple(map(b"".join, zip(*held)))], LISTS)

    # copies of a vector follow each other, by id
    packed = placed.repartition("cell", "salt").sortWithinPartitions("cell", "v", "vec_id").select("vec_id", "v", "cell").mapInArrow(pack, _binaries(LISTS))
    lists = written(spark, packed, "ann-lists")
    drop(spark, rows)
    return books, lists


def _salts(books: Codebooks):
    """Over how many tasks each cell is dealt: a map of centroids squared entries at most."""
    more = {c: -(-n // SALT_ROWS) for c, n in books.counts.items() if n > SALT_ROWS}
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in more.items() for x in pair]), F.col("cell")), F.lit(1)) if more else F.lit(1)


class Best:
    """The ``top`` best entries of each query of a block so far."""

    def __init__(self, queries: np.ndarray, top: int):
        self.queries, self.top = queries, top
        self.ids, self.scores = np.full((len(queries), top), -1, np.int64), np.full((len(queries), top), -np.inf)

    def add(self, q: np.ndarray, i: np.ndarray, s: np.ndarray) -> None:
        """Entries i with scores s, of queries by their places q."""
        met = np.unique(q)
        q = np.concatenate([q, np.repeat(met, self.top)])
        i, s = np.concatenate([i, self.ids[met].ravel()]), np.concatenate([s, self.scores[met].ravel()])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < self.top
        self.ids[q[keep], rank[keep]], self.scores[q[keep], rank[keep]] = i[keep], s[keep]

    def rows(self) -> pa.RecordBatch:
        got = self.scores > -np.inf
        q = np.repeat(self.queries, got.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(self.ids[got], pa.int64()), pa.array(self.scores[got], pa.float64())], ["query_id", "vec_id", "score"])


def meet(best: Best, vectors: np.ndarray, visited: np.ndarray, block: tuple[np.ndarray, ...]) -> None:
    """Rerank a block's entries (cells, counts, ids, vectors) for queries that visit their cells (bits)."""
    cells, counts, ids, entries = block
    top, start = best.top, np.cumsum(counts) - counts
    begin = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
    own = cells[begin]
    seen = visited[:, own >> 3] >> (7 - (own & 7)).astype(np.uint8) & 1
    near = _unit(vectors) @ _unit(entries).T
    near[np.repeat(seen == 0, np.diff(np.concatenate([begin, [len(cells)]])), axis=1)] = -9
    bound = np.maximum(best.scores[:, -1], -8) - 1e-9
    if (near >= bound[:, None]).sum() > 2 * top * len(vectors) and len(cells) > top:
        # one more than ``top``, since the query itself may be among them
        bound = np.maximum(bound, np.partition(near, len(cells) - top - 1, axis=1)[:, len(cells) - top - 1] - 1e-9)
    a, b = np.nonzero(near >= np.maximum(bound, -8)[:, None])
    for k in range(0, len(a), 1 << 15):
        q, e = a[k : k + (1 << 15)], b[k : k + (1 << 15)]
        score = cosine(vectors[q], entries[e])
        # of copies the smallest ids
        n = np.minimum(counts[e], top + 1)
        at = np.repeat(start[e] - np.cumsum(n) + n, n) + np.arange(n.sum())
        q, i, score = np.repeat(q, n), ids[at], np.repeat(score, n)
        other = i != best.queries[q]
        best.add(q[other], i[other], score[other])


def asked(spark: SparkSession, books: Codebooks, queries: DataFrame, candidates: int) -> DataFrame:
    """Queries in blocks, each query once: ids, vectors and a bit for each cell they visit."""
    sent, kind = spark.sparkContext.broadcast(books), _kind(queries)

    def visit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, last, bits = sent.value, None, b""
        for batch in it:
            for k in range(0, batch.num_rows, QUERIES):
                part, out = batch.slice(k, QUERIES), []
                v = _matrix(part.column(1))
                for q, (x, a, b) in enumerate(zip(v, *books.distances(v.astype(np.float64)))):
                    if last is None or (x != last).any():
                        on = np.zeros(len(a) * len(b), bool)
                        on[list(books.walk(a, b, candidates))] = True
                        last, bits = x, np.packbits(on).tobytes()
                    out.append((part.column(0)[q].as_py(), bits, x.astype(kind).tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.binary(), pa.binary()))], ["vec_id", "cells", "v"])

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for k in range(0, batch.num_rows, QUERIES):
                ids, bits, v = (batch.column(c).slice(k, QUERIES) for c in range(3))
                yield _pack([(ids.to_numpy().astype("<i8").tobytes(), b"".join(bits.to_pylist()), b"".join(v.to_pylist()))], ASKED)

    # copies are walked for once in a task, and are dealt to a few
    spread = queries.select("vec_id", "v").repartition(partitions(spark), "v", F.pmod(F.xxhash64("vec_id"), F.lit(8))).sortWithinPartitions("v")
    walked = written(spark, spread.mapInArrow(visit, "vec_id long, cells binary, v binary"), "ann-walked")
    out = written(spark, walked.repartition(-(-walked.count() // QUERIES) or 1).mapInArrow(pack, _binaries(ASKED)), "ann-asked")
    drop(spark, walked)
    return out


def search(spark: SparkSession, books: Codebooks, lists: DataFrame, queries: DataFrame, share: float = SHARE, least: int = LEAST, top: int = TOP) -> DataFrame:
    """For each query (vec_id, v) its ``top`` nearest other entries found: query_id, rank, vec_id, score."""
    ship(spark)
    kinds = [{**LISTS, "vectors": books.kind}, {**ASKED, "q_vectors": _kind(queries)}]
    blocks = asked(spark, books, queries, max(least, int(share * sum(books.counts.values())) + 1))
    # both sides are read where they lie: nothing is shuffled, and a task streams one side
    met = lists.hint("shuffle_replicate_nl").crossJoin(blocks).select(*LISTS, *ASKED)

    def rerank(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, Best] = {}
        for batch in it:
            for r in range(batch.num_rows):
                x = [np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in enumerate(t for names in kinds for t in names.values())]
                cells, counts, ids, entries, q_ids, q_cells, q_vectors = x
                own = best.setdefault(q_ids.tobytes(), Best(q_ids.copy(), top))
                meet(own, q_vectors.reshape(len(q_ids), -1).astype(np.float64), q_cells.reshape(len(q_ids), -1), (cells, counts, ids, entries.reshape(len(cells), -1).astype(np.float64)))
        for x in best.values():
            yield x.rows()

    # each task gives ``top`` entries of a query at most
    best = met.mapInArrow(rerank, "query_id long, vec_id long, score double").groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, top).alias("best"))
    return best.select("query_id", F.posexplode("best").alias("rank", "x")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.minus")).alias("score"))


def op4_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valid(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))
    books, lists = build(spark, rows)
    return search(spark, books, lists, rows.where(F.pmod("vec_id", F.lit(50)) == 0))
