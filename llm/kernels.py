"""Vectorised text kernels over Arrow batches: words, word hashes, shingles.

Texts of a batch are handled as one byte buffer with document offsets, so the
cost per document is a few NumPy calls per batch and not a Python loop.
Null texts are empty texts. Hashes are 64-bit; two different strings are taken
to differ in their hash.
"""

from __future__ import annotations

import ctypes
import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C55 | 1
_INV = pow(_BASE, -1, 1 << 64)

#: Bytes that separate words: the complement of ``[^\x20\x09-\x0D]+``.
SPACE_BREAK = np.zeros(256, dtype=bool)
SPACE_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Bytes that separate words: the complement of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
ALNUM_BREAK = np.zeros(256, dtype=bool)
ALNUM_BREAK[0x00:0x30] = ALNUM_BREAK[0x3A:0x61] = ALNUM_BREAK[0x7B:0x80] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverses
    if len(_powers) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            p = np.full(size, _BASE, dtype=U64)
            p[0] = 1
            q = np.full(size, _INV, dtype=U64)
            q[0] = 1
            _powers, _inverses = np.cumprod(p), np.cumprod(q)
    return _powers, _inverses


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> U64(30))
        x = x * U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


def buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts end to end, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    offs = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offs - offs[0]


def pieces(column: pa.Array, most: int = 1 << 20):
    """Row ranges of about ``most`` bytes (one row at least), so that temporary arrays stay small."""
    raw, offs = buffer(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, side="right")) - 1)
        yield i, j, raw[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
        i = j


def words(raw: np.ndarray, offs: np.ndarray, breaks: np.ndarray = SPACE_BREAK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, and the first word of each document (n + 1)."""
    n = len(raw)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = np.empty(n + 2, dtype=bool)
    inside[0] = inside[-1] = False
    np.logical_not(breaks[raw], out=inside[1:-1])
    edge = inside[1:] != inside[:-1]
    cuts = offs[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    split = cuts[inside[cuts] & inside[cuts + 1]]  # two texts meet inside a run of word bytes
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    if len(split):
        split = np.unique(split)
        starts, ends = np.sort(np.concatenate([starts, split])), np.sort(np.concatenate([ends, split]))
    return starts, ends, np.searchsorted(starts, offs, side="left")


def prefix_hash(raw: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] the polynomial hash of raw[i:j] times base ** i."""
    p, _ = _tables(len(raw) + 1)
    out = np.zeros(len(raw) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum((raw.astype(U64) + U64(1)) * p[: len(raw)], out=out[1:])
    return out


def prefix_hash_of(s: np.ndarray) -> np.ndarray:
    """As prefix_hash, of integers."""
    p, _ = _tables(len(s) + 1)
    out = np.zeros(len(s) + 1, dtype=U64)
    with np.errstate(over="ignore"):
        np.cumsum(mix(s.astype(U64) + U64(1)) * p[: len(s)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each raw[start:end]; equal strings give equal hashes wherever they lie."""
    _, q = _tables(len(prefix) + 1)
    with np.errstate(over="ignore"):
        return mix((prefix[ends] - prefix[starts]) * q[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


#: Longer words are hashed apart: polynomials modulo 2**64 collide on some long strings, of 1,024 bytes at least.
LONG_WORD = 512


def hash_words(raw: np.ndarray, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word raw[start:end]; prefix is raw's prefix_hash."""
    h = span_hash(prefix, starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return h


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    raw = LOWER[raw] if lower else raw
    return hash_words(raw, prefix_hash(raw), starts, ends)


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive word hashes."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=U64)
    out = h[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            out *= U64(0x9FB21C651E98DF25)
            out += h[k : k + m]
            out ^= out >> U64(29)
    return mix(out)


def shingle_sets(raw: np.ndarray, offs: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each document, and n + 1 offsets.

    A document of fewer words has its whole word sequence as one shingle; one
    without words has none.
    """
    s, e, first = words(raw, offs)
    h = word_hashes(raw, s, e)
    docs = len(offs) - 1
    count = np.diff(first)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(at[-1]), dtype=U64)
    grams = ngram_hashes(h, n)
    whole = np.flatnonzero(count >= n)
    if len(whole):
        k = np.arange(int(size[whole].sum())) - np.repeat(np.cumsum(size[whole]) - size[whole], size[whole])
        out[np.repeat(at[whole], size[whole]) + k] = grams[np.repeat(first[whole], size[whole]) + k]
    for k in range(1, n):
        short = np.flatnonzero(count == k)
        if len(short):
            x = h[first[short]].copy()
            with np.errstate(over="ignore"):
                for j in range(1, k):
                    x = mix(x * U64(0x9FB21C651E98DF25) + h[first[short] + j])
            out[at[short]] = mix(x ^ U64(0xA5A5A5A500000000 + k))
    for a, b in zip(at[:-1][size > 1].tolist(), at[1:][size > 1].tolist()):
        out[a:b].sort()
    keep = np.ones(len(out), dtype=bool)
    if len(out):
        keep[1:] = out[1:] != out[:-1]
        keep[at[:-1][size > 0]] = True
    total = np.concatenate([[0], np.cumsum(keep)])
    return out[keep], total[at]


def set_digests(grams: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One 64-bit digest for each set: a sum of mixed members, so that order does not matter."""
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(grams ^ U64(0x632BE59BD9B4E019)))])
        return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(U64))


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of one length in one binary value."""
    return b"".join([np.uint64(len(arrays[0])).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def unpack(data, dtypes: tuple) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(data, "<u8", 1)[0]), 8, []
    for d in dtypes:
        d = np.dtype(d)
        out.append(np.frombuffer(data, d, n, at))
        at += n * d.itemsize
    return out


def gather(values, dtypes: tuple) -> list[np.ndarray]:
    """The rows of many packed values, end to end."""
    parts = [unpack(v, dtypes) for v in values]
    return [np.concatenate(x) if parts else np.zeros(0, d) for d, x in zip(dtypes, zip(*parts) if parts else [()] * len(dtypes))]


def trim() -> None:
    """Give freed memory back to the system: workers live on, and several share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:  # another C library
        pass


def _murmur(x: np.ndarray, seed: int = 42) -> np.ndarray:
    """Spark's hash of an integer column, as public in Murmur3 (32 bits)."""
    u = np.uint32
    with np.errstate(over="ignore"):
        k = x.astype(u) * u(0xCC9E2D51)
        k = ((k << u(15)) | (k >> u(17))) * u(0x1B873593)
        h = u(seed) ^ k
        h = ((h << u(13)) | (h >> u(19))) * u(5) + u(0xE6546B64)
        h ^= u(4)
        h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
        h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
        return (h ^ (h >> u(16))).view(np.int32)


@lru_cache(maxsize=8)
def spread(parts: int) -> np.ndarray:
    """Numbers of parts that a repartition by them into as many partitions deals one to each."""
    names, begin = np.full(parts, -1, dtype=np.int64), 0
    while (names < 0).any():
        x = np.arange(begin, begin + 4 * parts + 64)
        at = _murmur(x).astype(np.int64) % parts
        for k in np.unique(at)[names[np.unique(at)] < 0].tolist():
            names[k] = x[np.argmax(at == k)]
        begin += len(x)
    return names


class Dealer:
    """Deals rows of arrays over parts, as few packed values; parts have the numbers of spread()."""

    def __init__(self, parts: int, most: int = 24 << 20):
        self.parts, self.most, self.size = parts, most, 0
        self.names = spread(parts)
        self.held: list[tuple[np.ndarray, tuple[np.ndarray, ...]]] = []

    def add(self, part: np.ndarray, *arrays: np.ndarray):
        """Yields (part, value) whenever enough is held."""
        if len(part):
            self.held.append((part, arrays))
            self.size += sum(a.nbytes for a in arrays)
        if self.size >= self.most:
            yield from self.flush()

    def flush(self):
        if self.held:
            part = np.concatenate([p for p, _ in self.held])
            arrays = [np.concatenate(x) for x in zip(*(a for _, a in self.held))]
            order = np.argsort(part, kind="stable")
            part, arrays = part[order], [a[order] for a in arrays]
            cuts = np.flatnonzero(np.diff(part)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(part)]):
                yield int(self.names[part[a]]), pack(*(x[a:b] for x in arrays))
        self.held, self.size = [], 0
