"""Benchmark decontamination: windows of benchmark items that occur in documents.

Method: a prefix-filtered set join. A window (``window`` consecutive words of an
item; a shorter item is one window) must be contained whole, so its necessary
prefix is one shingle: the one that is rarest over all documents. Documents are
joined on those tokens; the token's offset bounds where the window may begin
(position) and the document's words where it may end (length); the words of the
whole window are then compared.

Items are joined in blocks of at most ``block`` windows, each broadcast only as
a block of that proven size. Null texts and texts without words have no words
and no windows. Items with equal windows are all reported; null item ids are
reported as "null". Repeated documents each get their row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import batches, ship, table

WINDOW, SHINGLE, BLOCK = 10, 3, 200_000


def text_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of lower-cased texts, and the first word of each text."""
    low = K.LOWER[raw]
    s, e, first = K.words(low, offs, K.ALNUM_BREAK)
    return K.hash_words(low, K.prefix_hash(low), s, e), first


def _gram(h: np.ndarray, k: int) -> np.ndarray:
    return K.ngram_hashes(h, k) ^ np.uint64(k)


class Index:
    """Windows of a block of items, and their shingles."""

    def __init__(self, items: list[tuple[str, str]], window: int, shingle: int):
        seen: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.items: list[list[str]] = []
        for item, text in items:
            raw = np.frombuffer((text or "").encode(), dtype=np.uint8)
            h, _ = text_hashes(raw, np.array([0, len(raw)]))
            for i in range(max(0, len(h) - window) + 1 if len(h) else 0):
                w = h[i : i + window]
                at = seen.setdefault(w.tobytes(), len(self.words))
                if at == len(self.words):
                    self.words.append(w)
                    self.items.append([])
                if item not in self.items[at]:
                    self.items[at].append(item)
        self.length = np.array([len(w) for w in self.words], dtype=np.int64)
        self.sizes = [min(shingle, len(w)) for w in self.words]
        self.grams = [_gram(w, k) for w, k in zip(self.words, self.sizes)]
        self.tokens = np.unique(np.concatenate(self.grams)) if self.grams else np.zeros(0, K.U64)
        self.flat = np.concatenate(self.words) if self.words else np.zeros(0, K.U64)
        self.base = np.concatenate([[0], np.cumsum(self.length)])
        self.kinds = sorted(set(self.sizes))

    def choose(self, counts: np.ndarray) -> None:
        """Each window's rarest shingle becomes its prefix."""
        rows = []
        for w, g in enumerate(self.grams):
            c = counts[np.searchsorted(self.tokens, g)]
            o = int(np.lexsort((g, c))[0])
            rows.append((g[o], w, o))
        rows.sort()
        self.key = np.array([r[0] for r in rows], dtype=K.U64)
        self.win = np.array([r[1] for r in rows], dtype=np.int64)
        self.off = np.array([r[2] for r in rows], dtype=np.int64)
        self.grams = []


def _maybe(tokens: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << 18, dtype=bool)
    out[(tokens & K.U64((1 << 18) - 1)).astype(np.int64)] = True
    return out


def _occurring(h: np.ndarray, kinds: list[int], tokens: np.ndarray, maybe: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word positions and hashes of shingles that are among the tokens."""
    for k in kinds:
        g = _gram(h, k)
        at = np.flatnonzero(maybe[(g & K.U64((1 << 18) - 1)).astype(np.int64)])
        x = g[at]
        j = np.searchsorted(tokens, x)
        ok = (j < len(tokens)) & (tokens[np.minimum(j, len(tokens) - 1)] == x)
        yield at[ok], x[ok]


def _counts(docs: DataFrame, index, kinds: list[int]) -> np.ndarray:
    """Occurrences of each of the index's shingles over all documents."""

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = index.value.tokens
        maybe, total = _maybe(tokens), np.zeros(len(tokens), dtype=np.int64)
        for batch in it:
            for _, _, raw, offs in K.pieces(batch.column(0)):
                h, _ = text_hashes(raw, offs)
                for _, x in _occurring(h, kinds, tokens, maybe):
                    total += np.bincount(np.searchsorted(tokens, x), minlength=len(tokens))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["i", "n"])

    out = np.zeros(len(index.value.tokens), dtype=np.int64)
    for r in docs.mapInArrow(count, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).collect():  # as many rows as a block has shingles
        out[r.i] = r.n
    return out


def _search(it: Iterator[pa.RecordBatch], index: Index, names: list[str]) -> Iterator[pa.RecordBatch]:
    maybe = _maybe(index.key)
    for batch in batches(it):
        for i, j, raw, offs in K.pieces(batch.column(1)):
            h, first = text_hashes(raw, offs)
            begin, end, win = [], [], []
            for at, x in _occurring(h, index.kinds, index.key, maybe) if len(index.key) else ():
                lo = np.searchsorted(index.key, x, side="left")
                n = np.searchsorted(index.key, x, side="right") - lo
                pos = np.repeat(at, n)
                row = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w, start = index.win[row], pos - index.off[row]
                doc = np.searchsorted(first, pos, side="right") - 1
                ok = (start >= first[doc]) & (start + index.length[w] <= first[doc + 1])
                w, start = w[ok], start[ok]
                for k in range(int(index.length.max())):
                    more = index.length[w] > k
                    good = ~more
                    good[more] = h[start[more] + k] == index.flat[index.base[w[more]] + k]
                    w, start = w[good], start[good]
                begin.append(start)
                end.append(start + index.length[w])
                win.append(w)
            begin = np.concatenate(begin) if begin else np.zeros(0, np.int64)
            end = np.concatenate(end) if end else np.zeros(0, np.int64)
            win = np.concatenate(win) if win else np.zeros(0, np.int64)
            order = np.argsort(begin, kind="stable")
            begin, end, win = begin[order], end[order], win[order]
            cut = np.searchsorted(begin, first)
            spans, items = [], []
            for d in range(j - i):
                a, b = cut[d], cut[d + 1]
                if a == b:
                    spans.append([])
                    items.append([])
                    continue
                base = first[d]
                spans.append(merge([(int(x - base), int(y - base)) for x, y in zip(begin[a:b], end[a:b])]))
                items.append(sorted({t for w in np.unique(win[a:b]) for t in index.items[w]}))
            part = batch.slice(i, j - i)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(np.diff(first), pa.int64()), pa.array([[{"a": a, "b": b} for a, b in s] for s in spans], pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), pa.array(items, pa.list_(pa.string()))],
                names,
            )


def _add(it: Iterator[pa.RecordBatch], index: Index, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) or (text, doc_id, n_words, spans, items) -> the latter, with the finds of one more block."""
    for batch in batches(it):
        at = batch.schema.names.index
        for found in _search(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at("text"))], names[:2])]), index, names):
            rows = batch.take(found.column(0))
            spans, items = found.column(2), found.column(3)
            if "items" in batch.schema.names:
                pairs = [[(x["a"], x["b"]) for x in [*a, *b]] for a, b in zip(rows.column(at("spans")).to_pylist(), spans.to_pylist())]
                spans = pa.array([[{"a": a, "b": b} for a, b in merge(p)] for p in pairs], spans.type)
                items = pa.array([sorted({*a, *b}) for a, b in zip(rows.column(at("items")).to_pylist(), items.to_pylist())], items.type)
            yield pa.RecordBatch.from_arrays([rows.column(at("text")), rows.column(at("doc_id")), found.column(1), spans, items], ["text", *names])


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _blocks(benchmark: DataFrame, window: int, most: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of about ``most`` windows, read one partition at a time."""
    block, n = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").toLocalIterator():
        block.append((r.item, r.text))
        raw = np.frombuffer((r.text or "").encode(), dtype=np.uint8)
        n += max(1, len(text_hashes(raw, np.array([0, len(raw)]))[0]) - window + 1)
        if n >= most:
            yield block
            block, n = [], 0
    if block:
        yield block


def _indexes(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int, shingle: int, block: int) -> Iterator:
    """A broadcast index of each block of items, its prefixes chosen by counts over all documents."""
    for part in _blocks(benchmark, window, block):
        index = spark.sparkContext.broadcast(Index(part, window, shingle))
        counts = _counts(docs.select("text"), index, index.value.kinds)
        chosen = index.value
        chosen.choose(counts)
        yield spark.sparkContext.broadcast(chosen)


def contaminated_spans(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """Per document: doc_id, n_words, spans (array of word ranges a to b, merged), items (sorted array)."""
    ship(spark)
    source = docs.select("doc_id", "text")
    names = ["doc_id", "n_words", "spans", "items"]
    schema = f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_words long, spans array<struct<a: long, b: long>>, items array<string>"
    # more items than one broadcast may hold: a row passes the blocks in turn, so rows that repeat an id stay apart
    out = None
    for chosen in _indexes(spark, source, benchmark, window, shingle, block):
        out = source.mapInArrow(lambda it, c=chosen: _add(it, c.value, names), f"text {source.schema['text'].dataType.simpleString()}, {schema}") if out is None else out.mapInArrow(lambda it, c=chosen: _add(it, c.value, names), out.schema)
    if out is None:
        empty = Index([], window, shingle)
        empty.choose(np.zeros(0))
        return source.mapInArrow(lambda it: _search(it, empty, names), schema)
    return out.select(*names)


def keep_clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    ship(spark)
    out, columns = docs, docs.columns
    for chosen in _indexes(spark, docs, benchmark, window, shingle, block):

        def run(it: Iterator[pa.RecordBatch], c=chosen) -> Iterator[pa.RecordBatch]:
            for batch in batches(it):
                pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(columns.index("text"))], ["doc_id", "text"])
                for found in _search(iter([pair]), c.value, ["doc_id", "n_words", "spans", "items"]):
                    rows = [r for r, items in zip(found.column(0).to_pylist(), found.column(3).to_pylist()) if not items]
                    yield batch.take(pa.array(rows, pa.int64()))

        out = out.mapInArrow(run, docs.schema)
    return out


def digest(found: DataFrame) -> DataFrame:
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["b"] - x["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(contaminated_spans(spark, table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text")))
