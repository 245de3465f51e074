"""Exact n-gram Jaccard join of documents, and its connected groups.

A document's set holds its distinct ``n``-word shingles. Two documents link when
their sets' intersection is at least ``percent`` of their union.

Method: size-banded tiles with hashed bitmaps. Documents with equal sets are one
set. A tile is named by a band of set sizes (each ``BAND`` times the one before) and
one of a set's rarest shingles (n - ceil(0.8 n) + 1 of them suffice); a set that may
link with the next band lies in that band's tiles too, so linked sets share a tile.
For a pair within the size ratio the bits of both hashed bitmaps bound the overlap
from above; pairs that pass get the exact intersection of their sorted arrays.

Shingles that a task finds in several documents are summed over all tasks; the
``HOT_MOST`` most frequent are ordered last, so frequent passages make no tiles.
Tiles of at most ``small`` sets try all their pairs, others first the pairs with a
few pivots, the least sets by a hash, which are the same in most tiles of a group.
What these links leave apart is then compared within tiles, bitmap by bitmap, in
blocks of at most about two times ``BLOCK`` sets, so that no task holds a whole large
tile; only pairs that pass the bound leave the block. So no link between groups is lost
and copies are not expanded into all pairs.

Words are split at ASCII white space after lowering A-Z. A text of fewer words
than ``n`` is one shingle, one without words is empty and linked with nothing;
null is empty. Repeated ids may come with different texts; each row is joined by
its own. A text that only rows with a null id hold links with nothing but equal
texts and has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import batches, drop, only, partitions, ship, table, written
from llm.graph import components

N, PERCENT = 5, 80
#: Shingles ordered last: as many at most, and held by so many documents at least.
HOT_MOST, HOT_LEAST = 1 << 20, 12
SMALL_TILE, PIVOTS = 16, 2
BAND, BLOCK, CHUNK = 4, 512, 128
TOKEN = ("<u8", "<u8", "<u4")


def needed(a, b, percent: int):
    """The least overlap of sets of sizes a and b that link."""
    return -(-(percent * (a + b)) // (100 + percent))


def prefix_size(n, percent: int):
    return n - -(-(percent * n) // 100) + 1


def bands(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """The size band of each set, and the next one where the set may link with it."""
    edges = BAND ** np.arange(31, dtype=np.int64)
    low = np.searchsorted(edges, n, side="right")
    return low, low + (100 * n >= percent * edges[np.minimum(low, 30)])


def tile_names(token: np.ndarray, band: np.ndarray) -> np.ndarray:
    return K.mix(token ^ K.mix(band.astype(K.U64)))


def bitmap(grams: np.ndarray) -> bytes:
    """A bitmap of at least four bits a shingle; its width is a power of two, so wider ones fold."""
    width = max(64, 1 << int(4 * len(grams) - 1).bit_length()) if len(grams) else 64
    bits = np.zeros(width, dtype=bool)
    bits[(grams & K.U64(width - 1)).astype(np.int64)] = True
    return np.packbits(bits).tobytes()


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of bytes) of a smaller width."""
    while bits.shape[-1] > width:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] | bits[..., half:]
    return bits


def overlap_bound(x: np.ndarray, y: np.ndarray, nx, ny):
    """No overlap is larger: each bit that one map has alone stands for a shingle that the other lacks. x: a bitmap; y: one, or a row for each of several."""
    width = min(x.shape[-1], y.shape[-1])
    x, y = (np.ascontiguousarray(fold(z, width)).view(K.U64) for z in (x, y))
    return np.minimum(nx - np.bitwise_count(x & ~y).sum(axis=-1, dtype=np.int64), ny - np.bitwise_count(y & ~x).sum(axis=-1, dtype=np.int64))


def intersection(x: np.ndarray, y: np.ndarray) -> int:
    """Of sorted distinct arrays."""
    if len(x) > len(y):
        x, y = y, x
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    return int((y[at] == x).sum()) if len(y) else 0


def _describe(n: int):
    """A row (kind 0) per document, and (kind 1) frequent shingles with the documents of the task that hold them."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def frequent():
            g, c = np.unique(np.concatenate(held), return_counts=True)
            at = np.flatnonzero(c >= 2)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(at)), pa.int32()), pa.nulls(len(at), pa.int64()), pa.array(c[at], pa.int64()), pa.array(g[at].view(np.int64), pa.int64()), pa.nulls(len(at), pa.binary())], names)

        names = ["kind", "doc_id", "n", "set", "bits"]
        for batch in batches(it):
            for i, j, raw, offs in K.pieces(batch.column(1)):
                g, at = K.shingle_sets(raw, offs, n)
                held.append(g)
                size += len(g)
                maps = [bitmap(g[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i), pa.int32()), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(K.set_digests(g, at).view(np.int64), pa.int64()), pa.array(maps, pa.binary())], names)
                if size > 4 << 20:
                    yield frequent()
                    held, size = [], 0
        if size:
            yield frequent()

    return run


def _tokens(n: int, percent: int, parts: int, hot):
    """Each set's tile tokens, dealt by token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal = K.Dealer(parts)
        keys, ranks = hot.value
        maybe = np.zeros(1 << 23, dtype=bool)
        maybe[(keys & K.U64((1 << 23) - 1)).astype(np.int64)] = True
        for batch in batches(it):
            for _, _, raw, offs in K.pieces(batch.column(0)):
                g, at = K.shingle_sets(raw, offs, n)
                size = np.diff(at)
                sets = K.set_digests(g, at)
                late = np.zeros(len(g), dtype=np.int64)
                x = np.flatnonzero(maybe[(g & K.U64((1 << 23) - 1)).astype(np.int64)])
                if len(x) and len(keys):
                    j = np.minimum(np.searchsorted(keys, g[x]), len(keys) - 1)
                    ok = keys[j] == g[x]
                    late[x[ok]] = ranks[j[ok]]
                # within a set: shingles that are not frequent by hash, then the others from rare to frequent
                doc = np.repeat(np.arange(len(size)), size)
                some = np.zeros(len(size), dtype=bool)
                some[doc[late > 0]] = True
                for d in np.flatnonzero(some).tolist():
                    part = slice(at[d], at[d + 1])
                    g[part] = g[part][np.lexsort((g[part], late[part]))]
                take = np.where(size > 0, prefix_size(size, percent), 0)
                pick = np.arange(len(g)) - at[doc] < take[doc]
                t, d = g[pick], doc[pick]
                low, upper = bands(size, percent)
                more = upper[d] > low[d]
                t = np.concatenate([tile_names(t, low[d]), tile_names(t[more], upper[d[more]])])
                d = np.concatenate([d, d[more]])
                for p, v in deal.add((t % K.U64(parts)).astype(np.int64), t, sets[d], size[d].astype("<u4")):
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v], pa.binary())], ["part", "data"])
        for p, v in deal.flush():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v], pa.binary())], ["part", "data"])

    return run


PAIR = ("<u8", "<u8")


def _pairs_of(at: np.ndarray, sets: np.ndarray, n: np.ndarray, percent: int):
    """All pairs inside small tiles (rows grouped by tile, ordered by size) whose sizes allow a link."""
    size = np.diff(at)
    a, b = [], []
    for k in range(1, int(size.max()) if len(size) else 0):
        own = np.repeat(at[1:], size)
        i = np.flatnonzero(np.arange(len(sets)) + k < own)
        i = i[n[i] * 100 >= percent * n[i + k]]
        a.append(sets[i])
        b.append(sets[i + k])
    return (np.concatenate(a), np.concatenate(b)) if a else (sets[:0], sets[:0])


def _tile(percent: int, parts: int, small: int, pivots: int):
    """Tokens -> pairs to try (kind 0, dealt by pair) and the rows of tiles of more than ``small`` sets (kind 1)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, s, n = K.gather([x.as_buffer() for batch in it for x in batch.column(1)], TOKEN)
        order = np.lexsort((s, n, t))
        t, s, n = t[order], s[order], n[order].astype(np.int64)
        if not len(t):
            return
        keep = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s, n = t[keep], s[keep], n[keep]
        size = np.diff(np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1], [True]])))
        size = np.repeat(size, size)
        few = np.flatnonzero((size > 1) & (size <= small))
        found = [_pairs_of(np.flatnonzero(np.concatenate([[True], t[few][1:] != t[few][:-1], [True]])), s[few], n[few], percent)] if len(few) else []
        x = np.flatnonzero(size > small)
        if len(x):
            y = x[np.lexsort((K.mix(s[x]), t[x]))]
            first = np.flatnonzero(np.concatenate([[True], t[y][1:] != t[y][:-1]]))
            length = np.diff(np.concatenate([first, [len(y)]]))
            for k in range(pivots):
                lead = np.repeat(y[first + k], length)
                ok = (lead != y) & (np.minimum(n[lead], n[y]) * 100 >= percent * np.maximum(n[lead], n[y]))
                found.append((s[lead[ok]], s[y[ok]]))
        deal, rows = K.Dealer(parts), []
        for a, b in found:
            u = np.unique(np.column_stack([np.minimum(a, b), np.maximum(a, b)]), axis=0) if len(a) else np.zeros((0, 2), K.U64)
            rows += [(p, 0, v) for p, v in deal.add((K.mix(u[:, 0] ^ K.mix(u[:, 1])) % K.U64(parts)).astype(np.int64), u[:, 0], u[:, 1])]
        rows += [(p, 0, v) for p, v in deal.flush()]
        rows += [(0, 1, K.pack(t[y], s[y], n[y].astype("<u4"))) for y in np.split(x, range(1 << 16, len(x), 1 << 16)) if len(y)]
        for i in range(0, len(rows), 64):
            p, k, v = zip(*rows[i : i + 64])
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(k, pa.int32()), pa.array(v, pa.binary())], ["part", "kind", "data"])

    return run


def _distinct(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = K.gather([x.as_buffer() for batch in it for x in batch.column(1)], PAIR)
    u = np.unique(np.column_stack([a, b]), axis=0) if len(a) else np.zeros((0, 2), K.U64)
    for i in range(0, len(u), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(u[i : i + 50_000, k]).view(np.int64), pa.int64()) for k in (0, 1)], ["a", "b"])


def _prune(percent: int):
    """Keep pairs whose bitmaps leave room for a link."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            na, nb = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            keep = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), dtype=np.uint8) for k in (6, 7))
                keep.append(overlap_bound(x, y, int(na[i]), int(nb[i])) >= needed(int(na[i]), int(nb[i]), percent))
            yield pa.RecordBatch.from_arrays(batch.columns[:4], ["a", "b", "doc_a", "doc_b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _decide(n: int, percent: int):
    """Homes (rows of a lead's text, then rows of its partners' texts) -> links. Only one lead's set is held."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        home, lead = None, None
        for batch in batches(it, 500):
            homes, own, sets, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), []
            for i, j, raw, offs in K.pieces(batch.column(3)):
                g, cut = K.shingle_sets(raw, offs, n)
                digests = K.set_digests(g, cut).view(np.int64).tolist()
                for k in range(i, j):
                    if homes[k] != home:
                        home, lead = homes[k], None
                    if digests[k - i] != (sets[k] if sets[k] is not None else own[k]):
                        continue  # an id may have come with several texts
                    x = g[cut[k - i] : cut[k - i + 1]]
                    if sets[k] is None:
                        lead = x.copy()
                    elif lead is not None and intersection(lead, x) >= needed(len(lead), len(x), percent):
                        out.append((own[k], sets[k]))
            if out:
                a, b = zip(*out)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _bits(spark: SparkSession, described: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set, bits) of the wanted sets."""
    return only(spark, described.where("kind = 0").select("set", "bits"), wanted, "set").groupBy("set").agg(F.min("bits").alias("bits"))


def _verify(spark: SparkSession, docs: DataFrame, described: DataFrame, sets: DataFrame, pairs: DataFrame, n: int, percent: int, pruned: bool = False) -> DataFrame:
    """The links among pairs (a, b) of sets."""
    side = lambda x: sets.select(F.col("set").alias(x), F.col("doc_id").alias(f"doc_{x}"), F.col("n").alias(f"n_{x}"))
    if pruned:
        met = pairs.join(side("a"), "a").join(side("b"), "b")
    else:
        tried = written(spark, pairs, "jaccard-pairs")
        bits = written(spark, _bits(spark, described, tried.select(F.explode(F.array("a", "b")).alias("set")).distinct()), "jaccard-bits")
        met = tried.join(side("a"), "a").join(side("b"), "b")
        met = met.join(bits.select(F.col("set").alias("a"), F.col("bits").alias("bits_a")), "a").join(bits.select(F.col("set").alias("b"), F.col("bits").alias("bits_b")), "b")
        met = met.select("a", "b", "doc_a", "doc_b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(_prune(percent), "a long, b long, doc_a long, doc_b long")
    close = written(spark, met.select("a", "b", "doc_a", "doc_b"), "jaccard-close")
    if not pruned:
        drop(spark, tried, bits)
    # a home is one set, the lead, and some of its partners; of a pair the set of more pairs leads
    degree = close.select(F.explode(F.array("a", "b")).alias("set")).groupBy("set").agg(F.count("*").alias("d"))
    placed = close.join(degree.select(F.col("set").alias("a"), F.col("d").alias("d_a")), "a").join(degree.select(F.col("set").alias("b"), F.col("d").alias("d_b")), "b")
    ahead = F.col("d_a") >= F.col("d_b")
    pick = lambda x, y: F.when(ahead, F.col(x)).otherwise(F.col(y))
    placed = placed.select(pick("a", "b").alias("lead"), pick("doc_a", "doc_b").alias("doc_lead"), pick("b", "a").alias("set"), pick("doc_b", "doc_a").alias("doc"), pick("d_a", "d_b").alias("d"))
    placed = written(spark, placed.withColumn("home", F.xxhash64("lead", F.pmod(F.xxhash64("set"), F.ceil(F.col("d") / CHUNK)))), "jaccard-placed")
    asked = placed.select("home", "lead", F.lit(None).cast("long").alias("set"), F.col("doc_lead").alias("doc")).distinct().unionByName(placed.select("home", "lead", "set", "doc"))
    texts = only(spark, docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text")), asked.select("doc").distinct(), "doc")
    rows = asked.join(texts, "doc").select("home", "lead", "set", "text")
    found = written(spark, rows.repartition("home").sortWithinPartitions("home", F.col("set").isNotNull()).mapInArrow(_decide(n, percent), "a long, b long"), "jaccard-links")
    drop(spark, close, placed)
    return found


def _apart(percent: int, parts: int):
    """Blocks of tiles, their rows together -> pairs of a block whose groups differ and whose bitmaps leave room for a link, dealt by pair."""

    def block(rows: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        rows.sort(key=lambda r: (r["n"], r["set"]))
        s, n, c, k = (np.array([r[x] for r in rows], dtype=np.int64) for x in ("set", "n", "component", "chunk"))
        width = np.array([len(r["bits"]) for r in rows])
        maps = {w: np.stack([np.frombuffer(r["bits"], dtype=np.uint8) for r in rows if len(r["bits"]) == w]) for w in set(width.tolist())}
        at = {w: np.flatnonzero(width == w) for w in maps}
        a, b = [], []
        across = len(np.unique(k)) > 1 and rows[0]["across"]
        for w, own in at.items():
            for v, other in at.items():
                if v < w:
                    continue
                theirs = fold(maps[v], w)
                for i, x in zip(own.tolist(), maps[w]):
                    lo, hi = np.searchsorted(n[other], -(-percent * n[i] // 100)), np.searchsorted(n[other], n[i] * 100 // percent, side="right")
                    if lo >= hi:
                        continue
                    j = other[lo:hi]
                    ok = c[j] != c[i]
                    if v == w:
                        ok &= j > i
                    if across:
                        ok &= k[j] != k[i]
                    if ok.any():
                        j = j[ok]
                        j = j[overlap_bound(x, theirs[lo:hi][ok], n[i], n[j]) >= needed(n[i], n[j], percent)]
                        a.append(np.full(len(j), s[i]))
                        b.append(s[j])
        return (np.concatenate(a), np.concatenate(b)) if a else (s[:0], s[:0])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        deal, key, rows = K.Dealer(parts, 4 << 20), None, []

        def done():
            a, b = (x.view(K.U64) for x in block(rows)) if rows else (np.zeros(0, K.U64),) * 2
            a, b = np.minimum(a, b), np.maximum(a, b)
            for p, v in deal.add((K.mix(a ^ K.mix(b)) % K.U64(parts)).astype(np.int64), a, b):
                yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v], pa.binary())], ["part", "data"])

        for batch in batches(it, 500):
            for r in batch.to_pylist():
                if (r["tile"], r["block"]) != key:
                    yield from done()
                    key, rows = (r["tile"], r["block"]), []
                rows.append(r)
        yield from done()
        for p, v in deal.flush():
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([v], pa.binary())], ["part", "data"])

    return run


def _explode(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        t, s, n = K.gather([x.as_buffer() for x in batch.column(0)], TOKEN)
        for i in range(0, len(t), 50_000):
            j = slice(i, i + 50_000)
            yield pa.RecordBatch.from_arrays([pa.array(t[j].view(np.int64), pa.int64()), pa.array(s[j].view(np.int64), pa.int64()), pa.array(n[j], pa.int64())], ["tile", "set", "n"])


def _left_apart(spark: SparkSession, described: DataFrame, tiles: DataFrame, groups: DataFrame, percent: int, parts: int, block: int) -> DataFrame:
    """Pairs of sets that share a tile of more than a few sets, are not yet in one group, and may link by their bitmaps."""
    members = tiles.where("kind = 1").select("data").mapInArrow(_explode, "tile long, set long, n long")
    members = members.join(groups.withColumnRenamed("id", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    members = written(spark, members, "jaccard-members")
    mixed = members.groupBy("tile").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("m")).where("x <> y").select("tile", F.ceil(F.col("m") / block).cast("int").alias("chunks"))
    # chunks of a large tile meet pair by pair; a tile of one chunk is one block
    rows = members.join(mixed, "tile").withColumn("chunk", F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int"))
    rows = rows_ = written(spark, rows, "jaccard-mixed")
    bits = _bits(spark, described, rows.select("set").distinct())
    rows = rows.join(bits, "set")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    rows = rows.select("tile", (low.cast("long") * F.col("chunks") + high).alias("block"), (low != high).alias("across"), "chunk", "set", "n", "component", "bits")
    found = rows.repartition("tile", "block").sortWithinPartitions("tile", "block").mapInArrow(_apart(percent, parts), "part int, data binary")
    out = written(spark, found.repartition("part").mapInArrow(_distinct, "a long, b long"), "jaccard-apart")
    drop(spark, members, rows_)
    return out


def join_documents(spark: SparkSession, docs: DataFrame, n: int = N, percent: int = PERCENT, small: int = SMALL_TILE, pivots: int = PIVOTS, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id (the least doc_id reachable by links)."""
    ship(spark)
    parts = partitions(spark)
    docs = docs.select("doc_id", "text")
    described = written(spark, docs.mapInArrow(_describe(n), "kind int, doc_id long, n long, set long, bits binary"), "jaccard-documents")
    rows = described.where("kind = 0").select("doc_id", "n", "set")
    frequent = described.where("kind = 1").groupBy("set").agg(F.sum("n").alias("n")).where(F.col("n") >= HOT_LEAST).orderBy(F.desc("n"), "set").limit(HOT_MOST).toArrow()  # a fixed bound
    keys, held = frequent.column("set").to_numpy().astype(np.int64).view(K.U64), frequent.column("n").to_numpy().astype(np.int64)
    order = np.argsort(keys)
    hot = spark.sparkContext.broadcast((keys[order], held[order]))
    sets = rows.where("n > 0").groupBy("set").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")).alias("x"), F.min("doc_id").alias("least")).select("set", "x.doc_id", "x.n", "least")
    sets = written(spark, sets, "jaccard-sets")
    tokens = docs.select("text").mapInArrow(_tokens(n, percent, parts, hot), "part int, data binary")
    tiles = written(spark, tokens.repartition("part").mapInArrow(_tile(percent, parts, small, pivots), "part int, kind int, data binary"), "jaccard-tiles")
    pairs = tiles.where("kind = 0").select("part", "data").repartition("part").mapInArrow(_distinct, "a long, b long")
    links = _verify(spark, docs, described, sets, pairs, n, percent)
    groups = components(spark, links)
    apart = _left_apart(spark, described, tiles, groups, percent, parts, block)
    if apart.limit(1).count():
        more = _verify(spark, docs, described, sets, apart, n, percent, pruned=True)
        if more.limit(1).count():
            groups = components(spark, links.unionByName(more))
    drop(spark, apart, tiles)
    named = sets.select("set", "least").join(groups.withColumnRenamed("id", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    lowest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    named = named.join(lowest, "component").select("set", "component_id")
    out = rows.select("doc_id", F.col("n").alias("n_shingles"), "set").join(named, "set", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_documents(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
