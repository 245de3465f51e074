import numpy as np
import pytest

from llm import kernels as K
from llm import pitman_yor as P


def test_all_customers_of_a_dish_are_seated_anew():
    n, d, fresh = 20_000, 0.5, 2.0
    x = P.Level(K.mix(np.arange(200, dtype=K.U64)), np.zeros(200, np.int64), None, np.full(200, n))
    x.seat(np.full(200, fresh), d, 3)
    r, want = np.random.default_rng(2), []
    for _ in range(20):
        u, t = r.random(n), 1
        for i in range(1, n):
            t += u[i] * (fresh + i - d * t) < fresh
        want.append(t)
    assert x.t.mean() > 10 and abs(x.t.mean() - np.mean(want)) < 4 * np.std(want) / 20**0.5
    before = x.t.copy()
    x.seat(np.full(200, fresh), d, 4)
    assert (before != x.t).mean() > 0.5


def test_tables_settle():
    r = np.random.default_rng(3)
    word, context = np.repeat(np.arange(300, dtype="<u8") << K.U64(P.BITS), 80), np.tile(np.arange(80, dtype=np.int64) << P.SUB, 300)
    levels = P.ladder(word | context.astype(K.U64), np.minimum(r.zipf(2, len(word)), 2000))
    c = np.bincount(context, weights=levels[3].c, minlength=P.CONTEXTS)
    seen = []
    for s in range(24):
        t = np.bincount(context, weights=levels[3].t, minlength=P.CONTEXTS)
        P.sweep(levels, P.Totals(P.sums_of(levels), c, t, [0.5] * 4, 300), s)
        seen.append(levels[3].t.sum())
    for x, below in zip(levels, levels[1:]):
        assert (x.c == np.bincount(below.up, weights=below.t)).all() and (x.t <= x.c).all()
    assert abs(seen[10] / np.mean(seen[-6:]) - 1) < 0.05 and levels[3].t.max() > 10


@pytest.mark.parametrize("parts", [1, 2, 7, 51, 211])
def test_parts_are_spread_evenly(parts):
    names = K.spread(parts)
    assert sorted((K._murmur(names).astype(np.int64) % parts).tolist()) == list(range(parts))
