"""Sets by their places: every set once, the best ones found whatever is left out."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pytest

from ripplenet.operators import optimise as o


def shared(a, b):
    return 0.3 * np.minimum(a, b)


@pytest.mark.parametrize("n,size", [(7, 1), (7, 3), (6, 6), (9, 4)])
def test_places_decode_to_every_set_once(n, size):
    sets = o.decoded(np.arange(math.comb(n, size)), size, n)
    assert {tuple(sorted(x)) for x in sets.tolist()} == set(itertools.combinations(range(n), size))
    assert (np.diff(sets[:, 0]) >= 0).all()  # greatest member rises, which the bound counts on


def actions(spark, n, seed, per=2):
    rng = np.random.default_rng(seed)
    rows = [(f"a{i:02}", f"m{i // per}", float(rng.lognormal(3, 1)) - 5, float(rng.random())) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id string, m string, gain double, cost double")


def brute(rows, most):
    out = []
    for size in range(1, most + 1):
        for s in itertools.combinations(rows, size):
            if len({x[1] for x in s}) == size:
                value = sum(x[2] for x in s) - sum(0.3 * min(x[2], y[2]) for x, y in itertools.combinations(s, 2))
                out.append((-round(value, 6), round(sum(x[3] for x in s), 6), size, "+".join(sorted(x[0] for x in s))))
    return sorted(out)


def test_all_and_best_sets_equal_brute_force(spark, monkeypatch):
    rows, df = actions(spark, 32, 4)
    pool = o.Pool(df.where("gain > 0"), shared)
    fit = [r for r in rows if r[2] > 0]
    want = brute(fit, 3)
    got = sorted((-round(r.value, 6), round(r.cost, 6), r.size, r.plan) for r in o.best_sets(spark, pool, 3).collect())
    assert got == want
    monkeypatch.setattr(o, "SETS_A_TASK", 500)
    best = o.best_sets(spark, pool, 3, keep=10)
    assert [(-round(r.value, 6), r.plan) for r in best.collect()] == [(w[0], w[3]) for w in want[:10]]
    whole = sum(math.comb(len(fit), k) for k in (1, 2, 3))
    assert sum(math.comb(min(len(fit), pool.reach(k, pool.seed(3, 10))), k) for k in (1, 2, 3)) < whole  # some were left out


def test_odd_pools(spark):
    rows, df = actions(spark, 5, 1, per=5)  # one merchant: no set of two
    assert {r.size for r in o.best_sets(spark, o.Pool(df, shared), 3).collect()} == {1}
    assert o.best_sets(spark, o.Pool(df.limit(0), shared), 3, keep=4).count() == 0
    gains = spark.createDataFrame([(f"a{i}", f"m{i}", -1.0 * i, 1.0) for i in range(6)], "id string, m string, gain double, cost double")
    assert o.best_sets(spark, o.Pool(gains, lambda a, b: 0 * (a + b)), 2, keep=1).first().plan == "a0"
    with pytest.raises(ValueError, match="at most"):
        o.Pool(spark.range(o.MOST_ACTIONS + 1).selectExpr("string(id) as id", "string(id) as m", "1.0 as gain", "1.0 as cost"), shared)
