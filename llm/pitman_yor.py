"""Language-model scoring: a hierarchical Pitman-Yor model.

Tokens are the lower-cased words of a text and one end. A token sits in the
restaurant of its context, the preceding word; a restaurant's tables are customers
of its parent:

    preceding word -> its class (kind and hashed ending, 80) -> its kind (5) -> all words -> uniform

Each preceding word has its own restaurant, named by 14 bits of its hash within its
class (1.3 million names, so that what restaurants hold in total can be sent to all
tasks); words of one name share it. Dishes are all words in all contexts, however often.

Seating follows the Chinese-restaurant process: at first a dish has one table in each
restaurant; each sweep of a blocked Gibbs sampler then seats all customers of every
dish anew, from the contexts up, so that new tables are the parents' customers. Only
the number of tables matters to predictions, and whether a customer opens one depends
only on how many sit and on the tables so far, so that number is drawn without sizes;
customers after the first ``SINGLE`` come in blocks of a sixteenth of those seated.
Chance comes from hashes of the dish and the step, and restaurants' totals are
exchanged between rounds, until a round changes their tables by a tenth at most (or after
``ROUNDS_MOST``); so scores do not depend on how words are dealt. Predictive probabilities are averaged over
the samples. Discounts come from the counts of counts, over all training tokens.

Words are dealt over parts by hash, with all their dishes. The most frequent words (at
most ``HOT``) are dealt by word and context; their dishes above the contexts are few
and sampled together. Scores meet tokens in two ways: the most frequent pairs of context
and word (at most ``HOT_PAIRS``) are broadcast; all other tokens are dealt as the dishes.

A null text is an empty text, which has one token, the end. Every row gets its own
scores, whatever rows repeat its id. Without training tokens all words are unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from llm import kernels as K
from llm.common import batches, crc_mod, drop, partitions, ship, table, written

KINDS, ENDINGS, SUB, BITS = 5, 16, 14, 22
LEAVES = KINDS * ENDINGS
CONTEXTS, RANGES = LEAVES << SUB, 16
BURN_IN, SAMPLES = 1, 2
ROUNDS_MOST, SETTLED = 8, 0.1
SINGLE = 64
STRENGTH = 0.5
HOT, HOT_PAIRS = 1 << 13, 1 << 18
FLUSH = 1 << 20
END = K.U64(0xE4D0F7E47E57AB1E)
ROWS = "part int, kind int, data binary"
_HIGH = K.U64((1 << 64) - (1 << BITS))

_END_KIND = np.full(256, 3, dtype=np.int64)
_END_KIND[0x61:0x7B] = 1
_END_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 2
_END_KIND[0x80:] = 4


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, word hash and context of each token; a context's upper bits are its class."""
    low = K.LOWER[raw]
    s, e, first = K.words(low, offs)
    prefix = K.prefix_hash(low)
    h = K.hash_words(low, prefix, s, e)
    docs = len(offs) - 1
    tail = K.span_hash(prefix, np.maximum(s, e - 3), e)
    leaf = (_END_KIND[low[e - 1]] * ENDINGS + (tail % K.U64(ENDINGS)).astype(np.int64)) if len(s) else np.zeros(0, np.int64)
    after = (leaf << SUB) | (h >> K.U64(40)).astype(np.int64) & ((1 << SUB) - 1)
    count = np.diff(first)
    doc = np.repeat(np.arange(docs), count + 1)
    word = np.full(len(doc), END, dtype=K.U64)
    context = np.zeros(len(doc), dtype="<u4")  # of kind 0: the start of a text
    at = np.arange(len(h)) + np.repeat(np.arange(docs), count)
    word[at] = h
    context[at + 1] = after  # each word precedes the next token of its document
    return doc, word, context


def _row(part: int, kind: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([kind], pa.int32()), pa.array([data], pa.binary())], ["part", "kind", "data"])


def _blob(*arrays: np.ndarray) -> bytes:
    """Arrays of any lengths in one value; of 32-bit numbers first all low bytes, then the next, so that small ones compress."""
    arrays = [np.ascontiguousarray(a).view(np.uint8).reshape(-1, 4).T.ravel() if a.dtype == np.uint32 else a for a in arrays]
    return np.array([len(arrays), *(len(a) for a in arrays)], "<u8").tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unblob(data, dtypes: tuple) -> list[np.ndarray]:
    n = int(np.frombuffer(data, "<u8", 1)[0])
    out, at = [], 8 * (n + 1)
    for size, d in zip(np.frombuffer(data, "<u8", n, 8).tolist(), dtypes):
        if d == "<u4":
            out.append(np.ascontiguousarray(np.frombuffer(data, "u1", size, at).reshape(4, -1).T).view("<u4").ravel())
            at += size
            continue
        out.append(np.frombuffer(data, d, size, at))
        at += size * np.dtype(d).itemsize
    return out


def _starts(x: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, np.int64)


def _lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(np.concatenate([first, [n]]))


class Table:
    """Keys by a direct-mapped table; of keys that meet in a slot the last stays."""

    def __init__(self, keys: np.ndarray, bits: int):
        self.shift, self.slots = K.U64(64 - bits), np.full(1 << bits, -1, dtype=np.int32)
        self.keys = keys if len(keys) else np.zeros(1, K.U64)
        self.slots[self.slot(keys)] = np.arange(len(keys), dtype=np.int32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (K.mix(keys) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        i = self.slots[self.slot(keys)]
        return np.where((i >= 0) & (self.keys[i] == keys), i, -1)


class Hot:
    """The most frequent words, with their counts; P: their probability in each class, a matrix for each sample."""

    def __init__(self, words: np.ndarray, counts: np.ndarray):
        order = np.lexsort((words, counts))
        table_ = Table(words[order], 18)
        kept = np.sort(table_.slots[table_.slots >= 0])
        self.table = Table(words[order][kept], 18)
        self.words, self.counts, self.p = words[order][kept], counts[order][kept], []


def pair_keys(word: np.ndarray, context: np.ndarray) -> np.ndarray:
    return K.mix(word) ^ K.mix(context.astype(K.U64) + K.U64(1))


def _parts_of(word: np.ndarray, context: np.ndarray, hot: np.ndarray, parts: int) -> np.ndarray:
    return (np.where(hot, pair_keys(word, context), word) % K.U64(parts)).astype(np.uint16 if parts < 1 << 16 else np.int64)


def _count_words(parts: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, deal = [], 0, K.Dealer(parts)

        def send():
            w = np.sort(np.concatenate(held))
            first = _starts(w)
            for p, v in [*deal.add((w[first] % K.U64(parts)).astype(np.int64), w[first], _lengths(first, len(w)).astype("<u4")), *deal.flush()]:
                yield _row(p, 0, v)

        for batch in batches(it):
            for _, _, raw, offs in K.pieces(batch.column(0)):
                held.append(tokens(raw, offs)[1])
                size += len(held[-1])
                if size > 4 * FLUSH:
                    yield from send()
                    held, size = [], 0
        if size:
            yield from send()

    return run


def _ranks(n: np.ndarray) -> np.ndarray:
    """Counts by eighths of their logarithm."""
    return np.minimum(np.int64(8) * np.log2(np.maximum(n, 1)), 511).astype(np.int64)


def _sum_words(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words with their counts (kind 0); tokens, words and words by rank (kind 1)."""
    found = [x.as_buffer() for batch in it for x in batch.column(2)]
    if not found:
        return
    w, n = K.gather(found, ("<u8", "<u4"))
    order = np.argsort(w)
    w, n = w[order], n[order].astype(np.int64)
    first = _starts(w)
    n = np.add.reduceat(n, first)
    yield _row(0, 0, K.pack(w[first], n))
    yield _row(0, 1, np.concatenate([[n.sum(), len(n)], np.bincount(_ranks(n), minlength=512)]).astype("<f8").tobytes())


def _above(ranks: np.ndarray, most: int) -> int:
    """The least rank with at most so many above it."""
    above = np.cumsum(ranks[::-1])[::-1]
    return int(np.argmax(above <= most)) if (above <= most).any() else 512


def _csr(key: np.ndarray, word: np.ndarray, *more: np.ndarray) -> bytes:
    """Rows ordered by word: each word once."""
    first = _starts(word)
    return _blob(word[first], _lengths(first, len(word)).astype("<u4"), key, *more)


def _count_pairs(parts: int, hot_):
    """Distinct (word, context) with their counts, dealt by word, of frequent words by both."""
    names = K.spread(parts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, words, contexts, size = hot_.value, [], [], 0

        def send():
            w, c = np.concatenate(words), np.concatenate(contexts)
            order = np.argsort((w & _HIGH) | c)
            w, c = w[order], c[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
            n = _lengths(first, len(w)).astype("<u4")
            w, c = w[first], c[first]
            p = _parts_of(w, c, hot.table.find(w) >= 0, parts)
            order = np.argsort(p, kind="stable")
            w, c, n, p = w[order], c[order], n[order], p[order]
            cuts = _starts(p)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)]):
                yield _row(int(names[p[a]]), 0, _csr(c[a:b], w[a:b], n[a:b]))

        for batch in batches(it):
            for _, _, raw, offs in K.pieces(batch.column(0)):
                _, w, c = tokens(raw, offs)
                words.append(w)
                contexts.append(c)
                size += len(w)
                if size > FLUSH:
                    yield from send()
                    words.clear()
                    contexts.clear()
                    size = 0
                    K.trim()
        if size:
            yield from send()

    return run


def _dense(kind: int, index: int, x: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Sums by context, cut in ranges: small numbers as bytes, others apart."""
    x = x.astype(np.int64)
    width = CONTEXTS // RANGES
    for r in range(RANGES):
        part = x[r * width : (r + 1) * width]
        big = np.flatnonzero(part > 255)
        small = part.astype(np.uint8)
        small[big] = 0
        yield _row(index * RANGES + r, kind, _blob(np.frombuffer(zlib.compress(small.tobytes(), 1), np.uint8), big.astype("<u4"), part[big]))


def _reduce(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of what parts send: numbers (kind 1), sums by context (kind 2), cells of frequent words (kind 3)."""
    sums: dict[tuple[int, int], np.ndarray] = {}
    cells: dict[int, list] = {}
    for batch in it:
        for p, kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = x.as_buffer()
            if kind == 3:
                cells.setdefault(p, []).append(data)
                continue
            if kind == 1:
                value = np.frombuffer(data, "<f8")
            else:
                small, at, big = _unblob(data, ("u1", "<u4", "<i8"))
                value = np.frombuffer(zlib.decompress(small), np.uint8).astype(np.int64)
                value[at] = big
            sums[p, kind] = sums[p, kind] + value if (p, kind) in sums else value
    for (p, kind), value in sums.items():
        yield _row(p, kind, value.astype("<f8" if kind == 1 else "<f4").tobytes())
    for p, found in cells.items():
        s, w, leaf, n = K.gather(found, ("u1", "<u8", "u1", "<u8"))
        order = np.lexsort((leaf, w, s))
        s, w, leaf, n = s[order], w[order], leaf[order], n[order]
        first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (leaf[1:] != leaf[:-1]) | (s[1:] != s[:-1])]))
        yield _row(p, 3, K.pack(s[first], w[first], leaf[first], np.add.reduceat(n, first)))


class Level:
    """Dishes of the restaurants of one level: customers and tables of each."""

    def __init__(self, key: np.ndarray, rest: np.ndarray, up: np.ndarray | None, customers: np.ndarray):
        self.key, self.rest, self.up = key, rest.astype(np.int32), up  # a key's upper bits are a word's, the rest a restaurant's
        self.c = customers.astype(np.int64)
        self.t = np.minimum(self.c, 1)

    def seat(self, fresh: np.ndarray, d: float, step: int) -> None:
        """All customers of each dish come in anew; fresh: weight of a new table, but for d."""
        self.t = np.minimum(self.c, 1)
        n, at = 1, np.flatnonzero(self.c > 1)
        while len(at):
            m = np.minimum(1 if n < SINGLE else n // 16, self.c[at] - n)
            seated = np.maximum(n + (m - 1) / 2 - d * self.t[at], 1 - d)
            p = fresh[at] / (fresh[at] + seated)
            self.t[at] += drawn(m, p, self.key[at], step * 4096 + min(n, 4095) if n < SINGLE else step * 4096 + 64 + int(np.log2(n) * 12))
            n += 1 if n < SINGLE else n // 16
            at = at[self.c[at] > n]


def uniform(key: np.ndarray, step: int) -> np.ndarray:
    return ((K.mix(key ^ K.mix(np.array([step], K.U64) + K.U64(0x5851F42D4C957F2D))) >> K.U64(11)).astype(np.float64) + 0.5) * 2.0**-53


def drawn(m: np.ndarray, p: np.ndarray, key: np.ndarray, step: int) -> np.ndarray:
    """How many of m customers open a table: binomial, by inversion, or normal where eight or more are expected."""
    u = uniform(key, 2 * step)
    if not len(m) or m.max() == 1:
        return (u < p).astype(np.int64)
    out = np.zeros(len(m), np.int64)
    many = m * p >= 8
    if many.any():
        v, q = uniform(key[many], 2 * step + 1), p[many]
        z = np.sqrt(-2 * np.log(u[many])) * np.cos(2 * np.pi * v)
        out[many] = np.clip(np.rint(m[many] * q + z * np.sqrt(m[many] * q * (1 - q))), 0, m[many]).astype(np.int64)
    few = np.flatnonzero(~many)
    chance = (1 - p[few]) ** m[few]
    left, k = u[few] - chance, 0
    while len(few := few[left >= 0]) and k < 60:
        chance, left, k = chance[left >= 0], left[left >= 0], k + 1
        out[few] = np.minimum(k, m[few])
        chance = chance * np.maximum(m[few] - k + 1, 0) / k * p[few] / (1 - p[few])
        left = left - chance
    return out


def ladder(key: np.ndarray, n: np.ndarray) -> list[Level]:
    """Levels of distinct sorted keys (word, context), from the root down, every dish with one table."""
    out: list[Level] = []
    shifts, keys, ups = (0, SUB, SUB + 4, BITS), [key], []
    for a, b in zip(shifts, shifts[1:]):
        k = keys[-1] >> K.U64(b - a)
        first = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.zeros(0, bool)
        ups.append(np.cumsum(first, dtype=np.int32) - np.int32(1))
        keys.append(k[first])
    rests = [(key & ~_HIGH).astype(np.int64), (keys[1] & K.U64(127)).astype(np.int64), (keys[2] & K.U64(7)).astype(np.int64), np.zeros(len(keys[3]), np.int64)]
    customers = n
    for i in range(4):
        out.append(Level(keys[i], rests[i], ups[i] if i < 3 else None, customers))
        if i < 3:
            customers = np.bincount(ups[i], weights=out[-1].t, minlength=len(keys[i + 1]))
    return out[::-1]


SIZES = (1, KINDS, LEAVES)
HEAD = sum(SIZES)


def sums_of(levels: list[Level]) -> np.ndarray:
    """Customers, then tables, of the restaurants above the contexts."""
    return np.concatenate([*(np.bincount(x.rest, weights=x.c, minlength=m) for x, m in zip(levels, SIZES)), *(np.bincount(x.rest, weights=x.t, minlength=m) for x, m in zip(levels, SIZES))])


class Numbers:
    """Whole numbers, most of them small, in two bytes each."""

    def __init__(self, x: np.ndarray):
        self.at = np.flatnonzero(x >= 65535)
        self.big, self.small = x[self.at].astype(np.float64), np.minimum(x, 65535).astype(np.uint16)

    def __getitem__(self, i) -> np.ndarray:
        out = self.small[i].astype(np.float64)
        if len(self.at) and not isinstance(i, slice):
            large = np.flatnonzero(out == 65535)
            out[large] = self.big[np.searchsorted(self.at, np.asarray(i)[large])]
        elif len(self.at):
            out[self.at] = self.big
        return out

    def sum(self) -> float:
        return float(self.small.sum(dtype=np.int64)) + float((self.big - 65535).sum())


class Totals:
    """Customers and tables of each restaurant, of all parts; discounts by level, the root's first."""

    def __init__(self, head: np.ndarray, c: np.ndarray, t: np.ndarray, d: list[float], vocabulary: int):
        cut = np.cumsum(SIZES)[:-1]
        self.c, self.t = [*np.split(head[:HEAD], cut), Numbers(c)], [*np.split(head[HEAD:], cut), Numbers(t)]
        self.d, self.base = d, 1.0 / (vocabulary + 1)

    def back(self, level: int, rest=slice(None)) -> np.ndarray:
        """What restaurants leave to their parent."""
        return (STRENGTH + self.d[level] * self.t[level][rest]) / (STRENGTH + self.c[level][rest])

    def own(self, level: int, rest, c, t):
        return np.maximum(c - self.d[level] * t, 0) / (STRENGTH + self.c[level][rest])

    def fresh(self, level: int, rest) -> np.ndarray:
        return STRENGTH + self.d[level] * self.t[level][rest]


def chain(levels: list[Level], totals: Totals) -> list[np.ndarray]:
    """Predictive probability of each dish at each level above the contexts."""
    out, above = [], None
    for i, x in enumerate(levels[:3]):
        parent = totals.base if above is None else above[x.up]
        above = totals.own(i, x.rest, x.c, x.t) + totals.back(i)[x.rest] * parent
        out.append(above)
    return out


def sweep(levels: list[Level], totals: Totals, step: int) -> None:
    """Seat all customers of every dish anew."""
    above = chain(levels, totals)
    for i in range(len(levels) - 1, -1, -1):
        x = levels[i]
        parent = above[i - 1][x.up] if i else totals.base
        x.seat(totals.fresh(i, x.rest) * parent, totals.d[i], 4 * step + i)
        if i:
            levels[i - 1].c = np.bincount(x.up, weights=x.t, minlength=len(levels[i - 1].rest)).astype(np.int64)


def _expand(found: list, dtypes: tuple = ("<u8", "<u4", "<u4", "<u4")) -> list[np.ndarray]:
    """Words, and further columns, of many packed rows."""
    pieces = [_unblob(x, dtypes) for x in found]
    return [np.concatenate([np.repeat(x[0], x[1]) for x in pieces]), *(np.concatenate(x) for x in list(zip(*pieces))[2:])]


def _cells(deal: K.Dealer, sample: int, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> list[tuple[int, bytes]]:
    """Sums by word and class, dealt by word over a few parts."""
    leaf = (context >> SUB).astype(np.int64)
    first = _starts(word)
    at = np.repeat(np.arange(len(first)), _lengths(first, len(word))) * LEAVES + leaf
    total = np.bincount(at, weights=n, minlength=len(first) * LEAVES) if len(at) else np.zeros(0)
    some = np.flatnonzero(total)
    w = word[first][some // LEAVES]
    return list(deal.add((w % K.U64(RANGES)).astype(np.int64), np.full(len(w), sample, "u1"), w, (some % LEAVES).astype("u1"), total[some].astype("<u8")))


def _sum_pairs(hot_):
    """A part's distinct pairs (kind 0), and what they add to totals (kinds 1 to 3)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list] = {}
        for batch in it:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(2)):
                found.setdefault(p, []).append(x.as_py())
        for p in list(found):
            w, c, n = _expand(found.pop(p))
            order = np.argsort((w & _HIGH) | c)
            w, c, n = w[order], c[order], n[order].astype(np.int64)
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
            w, c, n = w[first], c[first], np.add.reduceat(n, first)
            yield _row(p, 0, _csr(c, w, n.astype("<u4")))
            hot = hot_.value.table.find(w) >= 0
            levels = ladder((w & _HIGH)[~hot] | c[~hot], n[~hot])
            ones = [(n == 1).sum(), (n == 2).sum(), *((x.c == k).sum() for x in levels[:3] for k in (1, 2))]
            yield _row(0, 1, np.concatenate([sums_of(levels), ones, np.bincount(_ranks(n), minlength=512)]).astype("<f8").tobytes())
            yield from _dense(2, 0, np.bincount(c, weights=n, minlength=CONTEXTS))
            yield from _dense(2, 1, np.bincount(c, minlength=CONTEXTS))
            deal = K.Dealer(RANGES)
            for q, v in [*_cells(deal, 0, w[hot], c[hot], np.ones(int(hot.sum()))), *deal.flush()]:
                yield _row(q, 3, v)
            del w, c, n, order, first, hot, levels
            K.trim()

    return run


def _gibbs(totals_, hot_, burn_in: int, samples: int, keep: bool):
    """Sampled seating of each part: its tables (kind 0, of pairs that occur twice or more), and what they add to totals (kinds 1 to 3)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, hot = totals_.value, hot_.value
        for batch in it:
            for p, x in zip(batch.column(0).to_pylist(), batch.column(2)):
                w, c, n = _expand([x.as_buffer()])
                place = hot.table.find(w)
                cold, warm = np.flatnonzero(place < 0), np.flatnonzero(place >= 0)
                levels = ladder((w & _HIGH)[cold] | c[cold], n[cold])
                top = Level(pair_keys(w[warm], c[warm]), c[warm], None, n[warm])
                fresh = totals.fresh(3, c[warm]) * hot.p[0][place[warm], c[warm] >> SUB]
                seats, deal, t, more = [], K.Dealer(RANGES), np.empty(len(w), np.int64), np.flatnonzero(n > 1)
                for s in range(burn_in + samples):
                    sweep(levels, totals, s)
                    top.seat(fresh, totals.d[3], 4 * s + 3)
                    if s < burn_in:
                        continue
                    k = s - burn_in
                    t[cold], t[warm] = levels[3].t, top.t
                    seats += [t[more].astype("<u4"), *(x.t[x.c > 1].astype("<u4") for x in levels[2::-1])]
                    yield _row(k, 1, sums_of(levels).astype("<f8").tobytes())
                    yield from _dense(2, k, np.bincount(c[more], weights=t[more] - 1, minlength=CONTEXTS))
                    for q, v in _cells(deal, k, w[warm], c[warm], t[warm]):
                        yield _row(q, 3, v)
                for q, v in deal.flush():
                    yield _row(q, 3, v)
                if keep:
                    yield _row(p, 0, _csr(c, w, n, *seats))
                del levels, top, fresh, seats, t, w, c, n, place, cold, warm, more
                K.trim()

    return run


class Part:
    """A part's sampled seating, for predictive probabilities."""

    def __init__(self, data, totals: list[Totals], hot: Hot):
        types = ("<u8", "<u4", "<u4", "<u4")
        if data is None:
            data = _blob(*[np.zeros(0, x) for x in [*types, *["<u4"] * (4 * len(totals))]])
        seats = _unblob(data, (*types, *["<u4"] * (4 * len(totals))))[4:]
        self.word, self.context, self.n = _expand([data])
        first = _starts(self.word)
        self.words, self.count = self.word[first], np.add.reduceat(self.n.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        order = np.argsort(self.words)
        self.words, self.count = self.words[order], self.count[order]
        self.key, self.totals, self.hot, self.t, self.above = (self.word & _HIGH) | self.context, totals, hot, [], []
        cold = hot.table.find(self.word) < 0
        for k, now in enumerate(totals):
            t = np.ones(len(self.n), dtype="<u4")
            t[self.n > 1] = seats[4 * k]
            self.t.append(t)
            levels = ladder(self.key[cold], self.n[cold])
            levels[3].t = t[cold].astype(np.int64)
            for i in (2, 1, 0):  # a level's customers are the tables below
                x = levels[i]
                x.c = np.bincount(levels[i + 1].up, weights=levels[i + 1].t, minlength=len(x.rest)).astype(np.int64)
                x.t = np.minimum(x.c, 1)
                x.t[x.c > 1] = seats[4 * k + 3 - i]
            self.above.append(chain(levels, now))
        key = self.key[cold]
        self.keys = [x[_starts(x)] for x in (key >> K.U64(BITS), key >> K.U64(SUB + 4), key >> K.U64(SUB))]

    def probability(self, word: np.ndarray, context: np.ndarray) -> np.ndarray:
        """Mean over the samples, of pairs of a word and a context."""

        def look(keys, wanted):
            if not len(keys):
                return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
            j = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            return j, keys[j] == wanted

        key, context = (word & _HIGH) | context, context.astype(np.int64)
        at, seen = look(self.key, key)
        place, leaf = self.hot.table.find(word), context >> SUB
        rests = (0, leaf >> 4, leaf)
        upper = [look(k, key >> K.U64(s)) for k, s in zip(self.keys, (BITS, SUB + 4, SUB))]
        out = np.zeros(len(word))
        for k, now in enumerate(self.totals):
            p = np.full(len(word), now.base)
            for i, (j, has) in enumerate(upper):
                p = now.back(i)[rests[i]] * p
                if len(self.above[k][i]):
                    p = np.where(has, self.above[k][i][j], p)
            if len(self.hot.words):
                p = np.where(place >= 0, self.hot.p[k][np.maximum(place, 0), leaf], p)
            p = now.back(3, context) * p
            if len(self.n):
                p += np.where(seen, now.own(3, context, self.n[at], self.t[k][at]), 0)
            out += p
        return out / max(1, len(self.totals))

    def known(self, word: np.ndarray) -> np.ndarray:
        """Counts of words that are not frequent ones."""
        if not len(self.words):
            return np.zeros(len(word), np.int64)
        j = np.minimum(np.searchsorted(self.words, word), len(self.words) - 1)
        return np.where(self.words[j] == word, self.count[j], 0)


def _frequent(hot: Hot, cells: list, sample: int) -> list[Level]:
    """Levels of the frequent words' dishes above the contexts, from their customers in each class."""
    rows = [K.unpack(x, ("u1", "<u8", "u1", "<u8")) for x in cells]
    rows = [[y[x[0] == sample] for y in x[1:]] for x in rows]
    w, leaf, n = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, K.U64), np.zeros(0, "u1"), np.zeros(0, "<u8"))
    at = hot.table.find(w).astype(np.int64) * LEAVES + leaf
    total = np.bincount(at, weights=n, minlength=len(hot.words) * LEAVES)
    some = np.flatnonzero(total)
    levels = ladder((some // LEAVES).astype(K.U64) << K.U64(BITS) | (some % LEAVES).astype(K.U64) << K.U64(SUB), total[some].astype(np.int64))[:3]
    levels[2].c = total[some].astype(np.int64)
    return levels


def _matrix(hot: Hot, levels: list[Level], totals: Totals) -> np.ndarray:
    """Probability of each frequent word in each class."""
    above = chain(levels, totals)
    word = np.arange(len(hot.words))
    out = np.full((len(word), LEAVES), totals.back(0)[0] * totals.base)
    leaf = np.arange(LEAVES)
    by_word, by_kind = np.full(len(word), -1.0), np.full((len(word), KINDS), -1.0)
    of = lambda i: (levels[i].key >> K.U64((0, BITS - SUB - 4, BITS - SUB)[i])).astype(np.int64)
    by_word[of(0)] = above[0]
    by_kind[of(1), levels[1].rest] = above[1]
    out = np.where(by_word[:, None] >= 0, by_word[:, None], out)
    out = np.where(by_kind[:, leaf >> 4] >= 0, by_kind[:, leaf >> 4], totals.back(1)[leaf >> 4] * out)
    out = totals.back(2)[leaf] * out
    out[of(2), levels[2].rest] = above[2]
    return out.astype("<f4")


class Model:
    """The seats of all parts, and (as broadcast) a Totals for each sample, the frequent words, and frequent pairs with their scores."""

    def __init__(self, seats: DataFrame, totals, parts: int, tokens: int, vocabulary: int, hot, pairs):
        self.seats, self.totals, self.parts, self.tokens, self.vocabulary, self.hot, self.pairs = seats, totals, parts, tokens, vocabulary, hot, pairs


def _gathered(rows: DataFrame) -> dict[int, dict[int, bytes]]:
    """By kind and part: sums of a fixed size, and cells of at most ``HOT`` words."""
    out: dict[int, dict[int, bytes]] = {1: {}, 2: {}, 3: {}}
    for r in rows.where("kind > 0").repartition("part", "kind").mapInArrow(_reduce, ROWS).collect():
        out[r.kind][r.part] = bytes(r.data)
    return out


def _settled(hot: Hot, got: dict, sample: int, c: np.ndarray, t: np.ndarray, head: np.ndarray, d: list[float], vocabulary: int, sweeps: int) -> tuple[Totals, np.ndarray]:
    """Totals of all parts and the frequent words' probabilities, their dishes above the contexts seated until they settle."""
    levels = _frequent(hot, list(got[3].values()), sample)
    totals = Totals(head + sums_of(levels), c, t, d, vocabulary)
    for s in range(sweeps):
        before = sums_of(levels)[HEAD:].sum()
        sweep(levels, totals, 1000 + s)
        totals = Totals(head + sums_of(levels), c, t, d, vocabulary)
        if abs(sums_of(levels)[HEAD:].sum() - before) <= 0.002 * before:
            break
    return totals, _matrix(hot, levels, totals)


def train(spark: SparkSession, texts: DataFrame, hot: int = HOT, hot_pairs: int = HOT_PAIRS, burn_in: int = BURN_IN, samples: int = SAMPLES) -> Model:
    """Learn from all rows of texts (text)."""
    ship(spark)
    parts, send = partitions(spark), spark.sparkContext.broadcast
    texts = texts.select("text")
    words = written(spark, texts.mapInArrow(_count_words(parts), ROWS).repartition("part").mapInArrow(_sum_words, ROWS), "language-words")
    total = np.zeros(514)
    for r in words.where("kind = 1").select("data").mapInArrow(_add_numbers, "data binary").collect():  # one row a task
        total = total + np.frombuffer(r.data, "<f8")
    (n, v), rank = total[:2], _above(total[2:], hot)

    def frequent(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x in batch.column(0):
                w, c = K.unpack(x.as_buffer(), ("<u8", "<i8"))
                at = _ranks(c) >= rank
                yield pa.RecordBatch.from_arrays([pa.array([K.pack(w[at], c[at])], pa.binary())], ["data"])

    found = words.where("kind = 0").select("data").mapInArrow(frequent, "data binary").collect()  # ``hot`` words at most
    common = Hot(*K.gather([r.data for r in found], ("<u8", "<i8")))
    drop(spark, words)
    sent = send(common)
    pairs = texts.mapInArrow(_count_pairs(parts, sent), ROWS).repartition("part").mapInArrow(_sum_pairs(sent), ROWS)
    pairs = written(spark, pairs, "language-pairs")
    got = _gathered(pairs)
    numbers = np.frombuffer(got[1][0], "<f8") if got[1] else np.zeros(2 * HEAD + 8 + 512)

    def dense(k: int) -> np.ndarray:
        width = CONTEXTS // RANGES
        return np.concatenate([np.frombuffer(got[2][k * RANGES + r], "<f4") if k * RANGES + r in got[2] else np.zeros(width, "<f4") for r in range(RANGES)])

    c, types = dense(0), dense(1)
    head, ones, ranks = numbers[: 2 * HEAD], numbers[2 * HEAD : 2 * HEAD + 8].copy(), numbers[2 * HEAD + 8 :]
    levels = _frequent(common, list(got[3].values()), 0)
    ones[2:] += [(x.c == k).sum() for x in levels for k in (1, 2)]
    discount = lambda a, b: float(np.clip(a / max(a + 2 * b, 1), 0.05, 0.95))
    d = [*(discount(*ones[2 + 2 * i : 4 + 2 * i]) for i in range(3)), discount(*ones[:2])]
    now, matrix = _settled(common, got, 0, c, types, head, d, int(v), 0)
    # rounds only for what all parts' restaurants hold in total, until that settles
    rows = pairs.where("kind = 0")
    for _ in range(ROUNDS_MOST):
        before, common.p = sum(float(x.sum()) for x in now.t), [matrix]
        sent = [send(now), send(common)]
        got = _gathered(rows.mapInArrow(_gibbs(*sent, burn_in, 1, False), ROWS))
        for x in sent:
            x.destroy()
        if not got[1]:
            break
        now, matrix = _settled(common, got, 0, c, types + dense(0), np.frombuffer(got[1][0], "<f8"), d, int(v), 20)
        if abs(sum(float(x.sum()) for x in now.t) - before) <= SETTLED * before:
            break
    common.p = [matrix]
    sent = [send(now), send(common)]
    seats = written(spark, rows.mapInArrow(_gibbs(*sent, burn_in, samples, True), ROWS), "language-seats")
    for x in sent:
        x.destroy()
    got = _gathered(seats)
    totals, matrices = [now] * samples, [matrix] * samples
    if got[1]:
        both = [_settled(common, got, k, c, types + dense(k), np.frombuffer(got[1][k], "<f8"), d, int(v), 20) for k in range(samples)]
        totals, matrices = [x for x, _ in both], [x for _, x in both]
    common.p = matrices
    drop(spark, pairs)
    seats = seats.where("kind = 0")
    rank, all_totals, sent = _above(ranks, hot_pairs), send(totals), send(common)

    def often(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for x in batch.column(0):
                part = Part(x.as_buffer(), all_totals.value, sent.value)
                at = np.flatnonzero((_ranks(part.n) >= rank) & (sent.value.table.find(part.word) >= 0))
                p = part.probability(part.word[at], part.context[at])
                yield pa.RecordBatch.from_arrays([pa.array([K.pack(pair_keys(part.word[at], part.context[at]), part.n[at].astype("<u8"), np.log10(p))], pa.binary())], ["data"])

    found = K.gather([r.data for r in seats.select("data").mapInArrow(often, "data binary").collect()], ("<u8", "<u8", "<f8"))  # ``hot_pairs`` at most
    order = np.lexsort((found[0], found[1]))
    return Model(seats, all_totals, parts, int(n), int(v), sent, send((found[0][order], found[2][order])))


def _add_numbers(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in it:
        for x in batch.column(0):
            value = np.frombuffer(x.as_buffer(), "<f8")
            total = value if total is None else total + value
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["data"])


DOC = ("<i8", "<i8", "u1", "<i8", "<i8", "<f8", "<f8")  # row, id, flags, tokens, known, base, score
PARTIAL = ("<i8", "<u4", "<f8", "<f8")


def _deal_tokens(parts: int, hot_, pairs_, tokens_: int, vocabulary: int):
    """Rows with what frequent words and pairs give them (kind 2, by row), and all other tokens (kind 1, as the dishes)."""
    names = K.spread(parts)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot, (keys, logs) = hot_.value, pairs_.value
        often = Table(keys, 21)
        base = np.log10((hot.counts + 1.0) / (tokens_ + vocabulary + 1.0))
        task = np.int64(TaskContext.get().partitionId()) << np.int64(32)
        rows, docs, size = 0, K.Dealer(parts, 4 << 20), 0
        held: list[tuple[np.ndarray, ...]] = []

        def send():
            w, c, row, warm = (np.concatenate(x) for x in zip(*held))
            order = np.argsort((w & _HIGH) | c)
            w, c, row, warm = w[order], c[order], row[order], warm[order]
            p = _parts_of(w, c, warm, parts)
            order = np.argsort(p, kind="stable")
            w, c, row, p = w[order], c[order], row[order], p[order]
            cuts = _starts(p)
            for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(p)]):
                yield _row(int(names[p[a]]), 1, _csr(c[a:b], w[a:b], row[a:b], np.array([task])))

        for batch in batches(it):
            ids = batch.column(0).cast(pa.int64())
            flags = ids.is_null().to_numpy(zero_copy_only=False).astype("u1") + 2 * batch.column(2).fill_null(False).to_numpy(zero_copy_only=False).astype("u1")
            ids = ids.fill_null(0).to_numpy()
            for i, j, raw, offs in K.pieces(batch.column(1)):
                doc, w, c = tokens(raw, offs)
                m = j - i
                place = hot.table.find(w)
                at = often.find(pair_keys(w, c)) if len(keys) else np.full(len(w), -1)
                x, y = np.flatnonzero(place >= 0), np.flatnonzero(at >= 0)
                here = task + rows + np.arange(m)
                for p, v in docs.add((K.mix(here.view(K.U64)) % K.U64(parts)).astype(np.int64), here, ids[i:j], flags[i:j], np.bincount(doc, minlength=m), np.bincount(doc[x], minlength=m), np.bincount(doc[x], weights=base[place[x]] if len(x) else None, minlength=m).astype("<f8"), np.bincount(doc[y], weights=logs[at[y]] if len(y) else None, minlength=m).astype("<f8")):
                    yield _row(p, 2, v)
                z = np.flatnonzero(at < 0)
                held.append((w[z], c[z], (rows + doc[z]).astype("<u4"), place[z] >= 0))
                size += len(z)
                rows += m
                if size > FLUSH:
                    yield from send()
                    held.clear()
                    size = 0
                    K.trim()
        if size:
            yield from send()
        for p, v in docs.flush():
            yield _row(p, 2, v)

    return run


def _score_tokens(parts: int, totals, hot, tokens_: int, vocabulary: int):
    """Seats and tokens, part by part -> sums of each row and part (kind 3), dealt by row; kind 2 passes."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, part, sums = None, None, K.Dealer(parts, 4 << 20)
        held, size = [], 0

        def score():
            w, c = _expand([x for x in held], ("<u8", "<u4", "<u4", "<u4", "<i8"))[:2]
            row = np.concatenate([x[3] + x[4][0] for x in (_unblob(y, ("<u8", "<u4", "<u4", "<u4", "<i8")) for y in held)])
            order = np.argsort((w & _HIGH) | c)
            w, c, row = w[order], c[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (c[1:] != c[:-1])]))
            n = _lengths(first, len(w))
            w, c = w[first], c[first]
            logs = np.repeat(np.log10(part.probability(w, c)), n)
            count, warm = part.known(w), hot.value.table.find(w) >= 0
            base = np.repeat(np.where(warm, 0.0, np.log10((count + 1.0) / (tokens_ + vocabulary + 1.0))), n)
            known = np.repeat((count > 0) & ~warm, n)
            order = np.argsort(row, kind="stable")
            row, logs, base, known = row[order], logs[order], base[order], known[order]
            first = _starts(row)
            here = row[first]
            return sums.add((K.mix(here.view(K.U64)) % K.U64(parts)).astype(np.int64), here, np.add.reduceat(known, first, dtype=np.int64).astype("<u4"), np.add.reduceat(base, first), np.add.reduceat(logs, first))

        for batch in it:
            for p, kind, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if kind == 2:
                    yield _row(p, 2, x.as_py())
                    continue
                if p != now:
                    if held:
                        yield from (_row(q, 3, v) for q, v in score())
                        held, size = [], 0
                    now, part = p, None
                    K.trim()
                if kind == 0:
                    part = Part(x.as_buffer(), totals.value, hot.value)
                    continue
                if part is None:
                    part = Part(None, totals.value, hot.value)
                held.append(x.as_py())
                size += len(held[-1])
                if size > 4 << 20:
                    yield from (_row(q, 3, v) for q, v in score())
                    held, size = [], 0
        if held:
            yield from (_row(q, 3, v) for q, v in score())
        for q, v in sums.flush():
            yield _row(q, 3, v)

    return run


def _add_up(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, parts = [], []
    for batch in it:
        for kind, x in zip(batch.column(1).to_pylist(), batch.column(2)):
            (docs if kind == 2 else parts).append(x.as_buffer())
    row, ids, flags, n, known, base, score = K.gather(docs, DOC)
    order = np.argsort(row)
    row, ids, flags, n, known, base, score = (x[order] for x in (row, ids, flags, n, known, base, score))
    r, k, b, s = K.gather(parts, PARTIAL)
    at = np.searchsorted(row, r)
    known = known + np.bincount(at, weights=k, minlength=len(row)).astype(np.int64)
    base, score = base + np.bincount(at, weights=b, minlength=len(row)), score + np.bincount(at, weights=s, minlength=len(row))
    for i in range(0, len(row), 10_000):
        j = slice(i, i + 10_000)
        yield pa.RecordBatch.from_arrays([pa.array(ids[j], pa.int64(), mask=(flags[j] & 1).astype(bool)), pa.array((flags[j] & 2).astype(bool)), pa.array(n[j]), pa.array(known[j]), pa.array(base[j]), pa.array(score[j])], ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def score(spark: SparkSession, model: Model, docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    ship(spark)
    hot, totals, pairs = model.hot, model.totals, model.pairs
    dealt = docs.select("doc_id", "text", "held_out").mapInArrow(_deal_tokens(model.parts, hot, pairs, model.tokens, model.vocabulary), ROWS)
    met = model.seats.unionByName(dealt).repartition("part").sortWithinPartitions("part", "kind")
    sums = met.mapInArrow(_score_tokens(model.parts, totals, hot, model.tokens, model.vocabulary), ROWS)
    out = sums.repartition("part").mapInArrow(_add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op5_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text").withColumn("held_out", F.coalesce(crc_mod("doc_id", 7) == 2, F.lit(False)))
    return score(spark, train(spark, docs.where("not held_out")), docs)
