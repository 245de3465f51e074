"""Removal of long byte strings that also start earlier: suffix arrays over shards.

A byte goes if a string of ``length`` bytes that covers it also starts earlier:
in a document of smaller id, or earlier in the same document.

1. Every window of ``length`` bytes names its anchor, the smallest hash among the
   ``seed``-byte strings inside it, so equal windows name equal anchors at equal
   distances. Neighbouring windows with one anchor are a run. Runs meet by anchor;
   no run is lost, since every window lies in one.
2. Runs that are equal as a whole are copies: only the first stays and stands for
   the others, whose windows all start earlier elsewhere. Anchors with one run
   left are done.
3. The runs left, each with its bytes, are dealt by anchor into shards. A shard is
   sorted as one suffix array (induced sorting, see suffix.py); neighbours that
   share ``length`` bytes by their permuted common prefixes are equal windows, of
   which the first stays.
4. Ranges of removed windows meet their documents.

Strings are judged on the input. Null texts are empty. A null id comes last;
rows that repeat an id are the same document and are judged alike, never against
each other. Texts shorter than ``length`` lose nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import partitions, ship, table, written
from llm.suffix import common_prefixes, suffix_array

LENGTH, SEED = 100, 28
LAST = (1 << 63) - 1
RUN = ("<u8", "<u8", "<i8", "<u4", "<u2")  # anchor, bytes of the run, document, first window, windows
SPAN = ("<i8", "<u4", "<u4")  # document, from, to
ASK = ("<u8", "<i8", "<u4", "<u2")
DEALT = "part int, kind int, data binary"
#: Bytes that are sorted as one array; more of a shard make further arrays only where no anchor is cut.
SHARD_BYTES = 1 << 20


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.array(c, pa.large_binary() if sum(map(len, c)) > 1 << 30 else pa.binary())], ["part", "kind", "data"])


def slice_of(doc: np.ndarray, parts: int) -> np.ndarray:
    return (K.mix(doc.astype(np.int64).view(K.U64)) % K.U64(parts)).astype(np.int64)


def anchored_runs(raw: np.ndarray, offs: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Runs of windows with one anchor: anchor hash, hash of the run, document, first window, windows."""
    n = len(raw)
    if n < length:
        z = np.zeros(0, np.int64)
        return z.astype(K.U64), z.astype(K.U64), z, z, z
    prefix = K.prefix_hash(raw)
    i = np.arange(n - seed + 1)
    h = K.span_hash(prefix, i, i + seed)
    key = (h & K.U64(0xFFFFFFFF00000000)) | i.astype(K.U64)
    width, size = length - seed + 1, 1
    while size * 2 <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    if size < width:
        key = np.minimum(key[: len(key) - (width - size)], key[width - size :])
    anchor = (key & K.U64(0xFFFFFFFF)).astype(np.int64)
    doc_end = np.repeat(offs[1:], np.diff(offs))[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= doc_end
    begin = valid.copy()
    begin[1:] &= ~(valid[:-1] & (anchor[1:] == anchor[:-1]))
    finish = valid.copy()
    finish[:-1] &= ~(valid[1:] & (anchor[1:] == anchor[:-1]))
    a, b = np.flatnonzero(begin), np.flatnonzero(finish)
    m = anchor[a]
    run = K.span_hash(prefix, a, b + length) ^ K.mix((m - a).astype(K.U64))
    return h[m], run, np.searchsorted(offs, a, side="right") - 1, a, b - a + 1


def _doc_ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def _ranges(out: K.Dealer, parts: int, length: int, d: np.ndarray, a: np.ndarray, n: np.ndarray):
    """Ranges of bytes under runs of windows, dealt by document."""
    yield from out.add(slice_of(d, parts), d.astype("<i8"), a.astype("<u4"), (a.astype(np.int64) + n - 1 + length).astype("<u4"))


def _first_of_copies(h, r, d, a, n):
    """Runs sorted by anchor, bytes and place; where an anchor's and a run's rows begin; which rows are copies."""
    order = np.lexsort((a, d, r, h))
    h, r, d, a, n = (x[order] for x in (h, r, d, a, n))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_r = new_h | np.concatenate([[True], r[1:] != r[:-1]])
    first = np.maximum.accumulate(np.where(new_r, np.arange(len(h)), 0))
    copy = ~((d == d[first]) & (a == a[first]))  # the same id and place again is the same document
    return h, r, d, a, n, new_h, new_r, copy


def _scan(parts: int, length: int, seed: int, most: int = 24 << 20):
    """Runs (kind 3) by anchor. Copies within what a task holds are settled there, so that a task sends one row of a run."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def send():
            h, r, d, a, n, _, _, copy = _first_of_copies(*(np.concatenate(x) for x in zip(*held)))
            out = K.Dealer(parts)
            for p, x in [*_ranges(out, parts, length, d[copy], a[copy], n[copy]), *out.flush()]:
                yield _batch([(p, 0, x)])
            h, r, d, a, n = (x[~copy] for x in (h, r, d, a, n))
            order = np.lexsort((a, d))  # documents and places then repeat and compress
            h, r, d, a, n = (x[order] for x in (h, r, d, a, n))
            for p, x in [*out.add((h % K.U64(parts)).astype(np.int64), h, r, d, a, n), *out.flush()]:
                yield _batch([(p, 3, x)])

        for batch in it:
            ids = _doc_ids(batch.column(0))
            for i, _, raw, offs in K.pieces(batch.column(1)):
                h, r, d, a, n = anchored_runs(raw, offs, length, seed)
                held.append((h, r, ids[i + d].astype("<i8"), (a - offs[d]).astype("<u4"), n.astype("<u2")))
                size += 30 * len(h)
                if size > most:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    return run


def _collapse(parts: int, length: int):
    """Runs by anchor -> ranges of copies (kind 0) and the bytes to ask for (kind 1), both dealt by document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = []
        for batch in it:
            kind = batch.column(1).to_numpy()
            runs += [batch.column(2)[k].as_buffer() for k in np.flatnonzero(kind == 3).tolist()]
            if (kind == 0).any():
                yield batch.filter(pa.array(kind == 0))
        h, r, d, a, n = K.gather(runs, RUN)
        if not len(h):
            return
        h, r, d, a, n, new_h, new_r, copy = _first_of_copies(h, r, d, a, n)
        out = K.Dealer(parts)
        rows = [(p, 0, v) for p, v in [*_ranges(out, parts, length, d[copy], a[copy], n[copy]), *out.flush()]]
        group = np.cumsum(new_h) - 1
        classes = np.bincount(group, weights=new_r)
        x = np.flatnonzero(new_r & (classes[group] > 1))
        rows += [(p, 1, v) for p, v in [*out.add(slice_of(d[x], parts), h[x], d[x], a[x], n[x]), *out.flush()]]
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    return run


def _texts(docs: DataFrame, parts: int) -> DataFrame:
    """Documents as rows of kind 2, dealt as their ranges are."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ids = _doc_ids(batch.column(0))
            part = K.spread(parts)[slice_of(ids, parts)]
            text = batch.column(1)
            text = text.cast(pa.large_binary() if pa.types.is_large_string(text.type) else pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(np.full(len(ids), 2), pa.int32()), text, pa.array(ids, pa.int64())], ["part", "kind", "data", "doc"])

    return docs.select("doc_id", "text").mapInArrow(run, DEALT + ", doc long")


def _meet(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    """Each part's packed rows before its documents."""
    both = dealt.withColumn("doc", F.lit(None).cast("long")).unionByName(texts)
    return both.repartition("part").sortWithinPartitions("kind")


def _fetch(parts: int, length: int):
    """Asked-for runs and documents -> the runs' bytes, dealt by anchor."""

    names = K.spread(parts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, at, order = [], None, None
        for batch in it:
            kind = batch.column(1).to_numpy()
            asked += [batch.column(2)[k].as_buffer() for k in np.flatnonzero(kind == 1).tolist()]
            texts = np.flatnonzero(kind == 2)
            if not len(texts):
                continue
            if at is None:
                h, d, a, n = K.gather(asked, ASK)
                order = np.lexsort((a, d))
                h, d, a, n = (x[order] for x in (h, d, a, n))
                at, asked = d, []
            rows: dict[int, list] = {}
            for k in texts.tolist():
                doc = batch.column(3)[k].as_py()
                lo, hi = int(np.searchsorted(at, doc)), int(np.searchsorted(at, doc, side="right"))
                if lo == hi:
                    continue
                text = batch.column(2)[k].as_py() or b""
                for q in range(lo, hi):
                    s, m = int(a[q]), int(n[q]) - 1 + length
                    rows.setdefault(int(names[int(h[q] % K.U64(parts))]), []).append((int(h[q]), doc, s, text[s : s + m]))
            out = []
            for p, x in rows.items():
                hs, ds, ss, ts = zip(*x)
                out.append((p, 0, K.pack(np.array(hs, "<u8"), np.array(ds, "<i8"), np.array(ss, "<u4"), np.array([len(t) for t in ts], "<u4")) + b"".join(ts)))
            if out:
                yield _batch(out)

    return run


PIECE = ("<u8", "<i8", "<u4", "<u4")


def repeated_windows(spans: list[tuple[int, int, bytes]], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows (document, start) of a shard's spans (document, start, bytes) that also start earlier in it."""
    size = np.array([len(t) for _, _, t in spans], dtype=np.int64)
    s = np.ones(int(size.sum()) + len(spans) + 1, dtype=np.int64)
    base = np.concatenate([[0], np.cumsum(size + 1)])
    inside = np.ones(len(s), dtype=bool)
    inside[base[1:] - 1] = False
    inside[-1] = False
    s[inside] = np.frombuffer(b"".join(t for _, _, t in spans), dtype=np.uint8).astype(np.int64) + 2
    s[-1] = 0
    sa = suffix_array(s)
    shared = common_prefixes(s, sa, length)[sa]  # with the suffix before, in the array's order
    own = np.repeat(np.arange(len(spans)), size + 1)
    room = np.zeros(len(s), dtype=bool)
    room[:-1] = np.arange(len(s) - 1) + length <= (base[:-1] + size)[own]
    sa, shared = sa[room[sa]], np.minimum(shared, length)[room[sa]]
    # suffixes between two equal windows begin with the same bytes, so equal windows are neighbours here
    group = np.cumsum(shared < length)
    doc = np.array([d for d, _, _ in spans], dtype=np.int64)[own[sa]]
    start = np.array([a for _, a, _ in spans], dtype=np.int64)[own[sa]] + sa - base[own[sa]]
    order = np.lexsort((start, doc, group))
    group, doc, start = group[order], doc[order], start[order]
    if not len(group):
        return doc, start
    new = np.concatenate([[True], group[1:] != group[:-1]])
    first = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))
    later = (doc != doc[first]) | (start != start[first])
    return doc[later], start[later]


def _sort(parts: int, length: int):
    """Shards of runs -> ranges of repeated windows, dealt by document."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans: list[tuple[int, int, int, bytes]] = []
        for batch in it:
            for x in batch.column(2):
                data = x.as_py()
                h, d, a, m = K.unpack(data, PIECE)
                at = 8 + len(h) * sum(np.dtype(t).itemsize for t in PIECE)
                for i in range(len(h)):
                    spans.append((int(h[i]), int(d[i]), int(a[i]), data[at : at + int(m[i])]))
                    at += int(m[i])
        spans = sorted(set(spans))
        out = K.Dealer(parts)
        rows, k = [], 0
        while k < len(spans):
            shard, size = [], 0
            while k < len(spans) and (size < SHARD_BYTES or spans[k][0] == spans[k - 1][0]):
                shard.append(spans[k][1:])
                size += len(spans[k][3])
                k += 1
            d, a = repeated_windows(shard, length)
            order = np.lexsort((a, d))
            d, a = d[order], a[order]
            if len(d):  # neighbouring windows as one range
                new = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > a[:-1] + length)])
                at = np.flatnonzero(new)
                last = np.concatenate([at[1:], [len(d)]]) - 1
                rows += [(p, 0, v) for p, v in out.add(slice_of(d[at], parts), d[at].astype("<i8"), a[at].astype("<u4"), (a[last] + length).astype("<u4"))]
        rows += [(p, 0, v) for p, v in out.flush()]
        for k in range(0, len(rows), 64):
            yield _batch(rows[k : k + 64])

    return run


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ranges; ranges that touch are one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.concatenate([[True], a[1:] > b[:-1]])
    at = np.flatnonzero(new)
    return a[at], b[np.concatenate([at[1:], [len(a)]]) - 1]


def _apply(with_text: bool):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges, d = [], None
        for batch in it:
            kind = batch.column(1).to_numpy()
            ranges += [batch.column(2)[k].as_buffer() for k in np.flatnonzero(kind == 0).tolist()]
            texts = np.flatnonzero(kind == 2)
            if not len(texts):
                continue
            if d is None:
                d, a, b = K.gather(ranges, SPAN)
                order = np.argsort(d, kind="stable")
                d, a, b, ranges = d[order], a[order].astype(np.int64), b[order].astype(np.int64), []
            out = []
            for k in texts.tolist():
                doc, text = batch.column(3)[k].as_py(), batch.column(2)[k].as_py() or b""
                lo, hi = int(np.searchsorted(d, doc)), int(np.searchsorted(d, doc, side="right"))
                gone, spans, kept = 0, [], text
                if lo < hi:
                    x, y = merged(a[lo:hi], b[lo:hi])
                    gone, spans = int((y - x).sum()), list(zip(x.tolist(), y.tolist()))
                    edges = [0, *(e for s in spans for e in s), len(text)]
                    kept = b"".join(text[i:j] for i, j in zip(edges[::2], edges[1::2]))
                row = (None if doc == LAST else doc, len(text), gone, len(spans), hashlib.sha256(kept).hexdigest())
                out.append((*row, kept, [{"a": x, "b": y} for x, y in spans]) if with_text else row)
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            cols = list(zip(*out))
            kinds = [pa.int64()] * 4 + [pa.string()]
            if with_text:
                names, kinds = [*names, "kept", "spans"], [*kinds, pa.binary(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names)

    return run


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = LENGTH, seed: int = SEED, with_text: bool = False) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; on request also the kept bytes and the removed spans."""
    ship(spark)
    seed = min(seed, length)
    parts = partitions(spark)
    docs = docs.select("doc_id", "text")
    runs = docs.mapInArrow(_scan(parts, length, seed), DEALT)
    collapsed = written(spark, runs.repartition("part").mapInArrow(_collapse(parts, length), DEALT), "repeats-runs")
    asked = _meet(collapsed.where("kind = 1"), _texts(docs, parts))
    shards = asked.mapInArrow(_fetch(parts, length), DEALT).repartition("part").mapInArrow(_sort(parts, length), DEALT)
    found = written(spark, shards, "repeats-windows")
    ranges = collapsed.where("kind = 0").unionByName(found)
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary, spans array<struct<a: long, b: long>>" if with_text else "")
    return _meet(ranges, _texts(docs, parts)).mapInArrow(_apply(with_text), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark, table(spark, sf_dir, "documents", "doc_id", "text"))
