"""Suffix arrays by induced sorting, over NumPy arrays.

Suffixes are classified as smaller (S) or larger (L) than their successor; the
substrings between leftmost S suffixes are sorted and named; where names repeat,
their string is sorted recursively; all suffixes are then induced from these,
bucket by bucket. In the bytes of a shard a bucket is induced in a few array
operations (waves of equal first symbols); in recursive strings, whose alphabets
are large, by a plain scan. Permuted common prefixes come from prefix hashes.
"""

from __future__ import annotations

import numpy as np

from llm import kernels as K

WAVES_MOST = 600


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; s ends with its only smallest symbol."""
    n = len(s)
    out = np.empty(n, dtype=bool)
    out[-1] = True
    d = np.sign(np.diff(s))
    at = np.where(d != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the next place where neighbours differ
    out[:-1] = d[np.minimum(at, n - 2)] > 0
    return out


def _append(sa: np.ndarray, at: np.ndarray, where: np.ndarray, symbols: np.ndarray, step: int) -> None:
    """Put suffixes at the free ends of their buckets, in the order given."""
    order = np.argsort(symbols, kind="stable")
    w, c = where[order], symbols[order]
    first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
    count = np.diff(np.concatenate([first, [len(c)]]))
    rank = np.arange(len(c)) - np.repeat(first, count)
    sa[at[c] + step * rank] = w
    at[c[first]] += step * count


def _induce_waves(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, k = len(s), len(sizes)
    ends = np.cumsum(sizes)
    heads, tails = ends - sizes, ends - 1
    sa = np.full(n, -1, dtype=np.int64)
    mine = s[lms]
    by = np.argsort(mine, kind="stable")
    lms_of = lms[by]
    lms_at = np.searchsorted(mine[by], np.arange(k + 1))
    head = heads.copy()
    used = np.flatnonzero(sizes)

    def larger(wave: np.ndarray) -> np.ndarray:
        p = wave[wave > 0] - 1
        return p[~small[p]]

    for c in used.tolist():
        done = heads[c]
        while done < head[c]:
            wave, done = sa[done : head[c]].copy(), int(head[c])
            p = larger(wave)
            if len(p):
                _append(sa, head, p, s[p], 1)
        p = larger(lms_of[lms_at[c] : lms_at[c + 1]])
        if len(p):
            _append(sa, head, p, s[p], 1)
    tail = tails.copy()
    for c in used[::-1].tolist():
        done = tails[c]
        while done > tail[c]:
            wave, done = sa[tail[c] + 1 : done + 1][::-1].copy(), int(tail[c])
            p = wave[wave > 0] - 1
            p = p[small[p]]
            if len(p):
                _append(sa, tail, p, s[p], -1)
        wave = sa[heads[c] : head[c]][::-1]
        p = wave[wave > 0] - 1
        p = p[small[p]]
        if len(p):
            _append(sa, tail, p, s[p], -1)
    sa[0] = n - 1
    return sa


def _induce_scan(s: np.ndarray, small: np.ndarray, sizes: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n, ends = len(s), np.cumsum(sizes)
    start = np.full(n, -1, dtype=np.int64)
    order = np.argsort(s[lms], kind="stable")
    c = s[lms][order]
    count = np.bincount(c, minlength=len(sizes))
    start[ends[c] - count[c] + np.arange(len(c)) - (np.cumsum(count) - count)[c]] = lms[order]
    # by suffix: the symbol before it if that is of the type to induce, else -1; at -1, where no suffix is yet, -1 as well
    before = np.full(n + 1, -1, dtype=np.int64)
    before[1:n] = np.where(small[:-1], -1, s[:-1])
    larger = before.tolist()
    before[1:n] = np.where(small[:-1], s[:-1], -1)
    smaller = before.tolist()
    sa, head, tail = start.tolist(), (ends - sizes).tolist(), (ends - 1).tolist()
    for i in sa:  # reads what it has put further on
        c = larger[i]
        if c >= 0:
            at = head[c]
            sa[at] = i - 1
            head[c] = at + 1
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            at = tail[c]
            sa[at] = i - 1
            tail[c] = at - 1
    return np.array(sa, dtype=np.int64)


def suffix_array(s: np.ndarray) -> np.ndarray:
    """s: integers whose last is 0 and the only 0."""
    n = len(s)
    if n <= 2:
        return np.arange(n - 1, -1, -1, dtype=np.int64)
    s = s.astype(np.int64)
    sizes = np.bincount(s)
    induce = _induce_waves if np.count_nonzero(sizes) <= WAVES_MOST else _induce_scan
    small = _types(s)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induce(s, small, sizes, np.array([n - 1]))
    sa = induce(s, small, sizes, lms)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    order = sa[is_lms[sa]]
    # names: neighbours in the order have equal names if their substrings and types are equal
    nxt = np.full(n, n - 1, dtype=np.int64)
    nxt[lms[:-1]] = lms[1:]
    length = nxt[order] - order
    a, b = order[:-1], order[1:]
    same = (length[1:] == length[:-1]) & (a != n - 1)
    h = K.prefix_hash_of(s * 2 + small)
    stop = np.minimum(length[:-1] + 1, n - np.maximum(a, b))
    same &= (length[1:] == length[:-1]) & (K.span_hash(h, a, a + stop) == K.span_hash(h, b, b + stop))
    name = np.zeros(n, dtype=np.int64)
    name[order] = np.concatenate([[0], np.cumsum(~same)])
    reduced = name[lms]
    if reduced.max() + 1 < len(reduced):
        order = lms[suffix_array(reduced)]
    return induce(s, small, sizes, order)


def common_prefixes(s: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """Permuted: for each suffix, how much it shares with the one before it in the array, up to ``most``."""
    n = len(s)
    phi = np.full(n, -1, dtype=np.int64)
    phi[sa[1:]] = sa[:-1]
    h = K.prefix_hash_of(s)
    i = np.arange(n)
    out = np.zeros(n, dtype=np.int64)
    step = 1 << max(0, most.bit_length() - 1)
    while step:
        want = out + step
        ok = (phi >= 0) & (want <= most) & (np.maximum(i, phi) + want <= n)
        at = np.flatnonzero(ok)
        good = K.span_hash(h, i[at], i[at] + want[at]) == K.span_hash(h, phi[at], phi[at] + want[at])
        out[at[good]] = want[at[good]]
        step //= 2
    return out
