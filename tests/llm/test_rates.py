"""Rates reach the targets of a skewed corpus, without a bound from above."""

from __future__ import annotations

import logging

import numpy as np

from ripplenet.llm import soft_mixing


def test_rates_grow_until_a_rare_domain_meets_its_target(spark, caplog):
    """Good documents are 5 % of the tokens and shall be 95 %: rates of about 19."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = lambda i: " ".join(f"{letters[i * k % 26]}{letters[i // 26]}{letters[k]}" for k in range(1, 7))
    rows = [(i, ("meadow river " if i % 20 == 0 else "junk filler ") + own(i)) for i in range(640)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 20 == 0 else "low") for i in range(640)], "doc_id long, domain string")
    with caplog.at_level(logging.INFO, logger=soft_mixing.__name__):
        out = soft_mixing.mix_to_targets(docs, labels, {"good": 0.95, "low": 0.05}).toPandas()
    total = out.tokens.sum()
    share = (out.rate * out.tokens * out.posterior.map(lambda p: p["good"])).sum() / total
    assert abs(share - 0.95) < 0.001 and out.rate.max() > 10
    assert "share of all tokens" in caplog.text


def test_descent_matches_brute_force_least_squares(spark):
    """Out of reach targets: the objective comes close to that of many plain projected steps in numpy."""
    rng = np.random.default_rng(5)
    p = np.round(rng.dirichlet((2, 1, 0.4), 200), 4)
    tokens = rng.integers(1, 400, 200)
    targets = np.array([0.9, 0.1, 0.0]) * tokens.sum()
    h = (tokens[:, None] * p * p).sum(axis=0)
    rate = np.ones(200)
    for _ in range(20_000):
        off = (rate * tokens) @ p - targets
        rate = np.clip(rate - 0.3 * p @ (off / h), 0, 1.5)
    best = (((rate * tokens) @ p - targets) ** 2 / h).sum()
    points = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens, strict=True)], "p0 double, p1 double, p2 double, tokens long")
    moves, residual = soft_mixing.fit_moves(points, targets.tolist(), max_rate=1.5, rounds=60, tolerance=1e-9)
    got = ((np.array(residual) * tokens.sum()) ** 2 / h).sum()
    assert got <= 1.05 * best + 1e-3 and len(moves) < 60


def test_targets_out_of_reach_are_told(spark):
    """Where no word tells domains apart, no rates can meet the targets: every row says so."""
    docs = spark.createDataFrame([(i, " ".join(["same", "words", *(f"{chr(97 + i % 26)}{chr(97 + i // 26)}{k}" for k in "xyz")])) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, "good" if i % 2 else "low") for i in range(40)], "doc_id long, domain string")
    rows = soft_mixing.mix_to_targets(docs, labels, {"good": 1.0}).collect()
    assert len(rows) == 40 and not any(r.met for r in rows) and max(abs(x) for x in rows[0].residual.values()) > 0.3


def test_repeated_and_null_ids_give_one_row_each(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c"), (2, None), (3, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "good"), (2, "low")], "doc_id long, domain string")
    for known in (labels, labels.limit(0)):
        got = [r.doc_id for r in soft_mixing.mix_to_targets(docs, known, {"good": 1.0}).collect()]
        assert sorted(got, key=str) == [1, 2, 3, None]


def test_registered_query_ends_at_the_best_totals(spark):
    """Brute force over all sets of up to three posteriors: no nonnegative rates come closer, in the fit's own distance."""
    import itertools

    from ripplenet.llm import queries

    sf = "/root/testdata/sf0.01"
    rows = queries.op8_soft_mixing(spark, sf).toPandas()
    names = sorted(rows.posterior[0])
    p = np.array([[m[n] for n in names] for m in rows.posterior])
    tokens = rows.tokens.to_numpy(float)
    targets = np.array([{"good": 0.95, "low": 0.05, "toxic": 0.0}[n] for n in names])
    h = (tokens[:, None] * p * p).sum(0) / tokens.sum()
    scale = 1 / np.sqrt(h)
    kinds = np.unique(p[tokens > 0], axis=0)
    best = None
    for size in (1, 2, 3):
        for s in itertools.combinations(range(len(kinds)), size):
            a = (kinds[list(s)] * scale).T
            x = np.linalg.lstsq(a, scale * targets, rcond=None)[0]
            if (x >= 0).all():
                off = kinds[list(s)].T @ x - targets
                cost = float((off * off / h).sum())
                if best is None or cost < best[0]:
                    best = cost, off
    got = np.array([rows.residual[0][n] for n in names])
    assert np.abs(got - best[1]).max() < 1e-5
    assert np.abs((rows.rate.to_numpy() * tokens) @ p / tokens.sum() - targets - got).max() < 1e-4  # rates as returned, rounded
    assert (rows.rate > 0).sum() > 50


def test_best_totals_of_a_cone(spark):
    """Random posteriors and targets: no point has a negative price, and prices are those of least squares over all columns."""
    rng = np.random.default_rng(9)
    for k in (2, 4):
        p = np.round(rng.dirichlet([0.5] * k, 60), 4)
        tokens = rng.integers(1, 300, 60)
        targets = rng.random(k) * tokens.sum()
        targets[0] = 0
        points = spark.createDataFrame([(*map(float, x), int(t)) for x, t in zip(p, tokens, strict=True)], ", ".join(f"p{i} double" for i in range(k)) + ", tokens long")
        best, price = soft_mixing.best_totals(points, targets.tolist())
        scale = 1 / np.sqrt((tokens[:, None] * p * p).sum(0) / tokens.sum())
        x = soft_mixing.nonnegative((p * scale).T, scale * targets / tokens.sum())
        assert np.allclose(np.array(best) / tokens.sum(), p.T @ x, atol=1e-6)
        assert (p @ np.array(price)).min() > -1e-6
    assert soft_mixing.best_totals(points.limit(0), targets.tolist())[0] == [0.0] * 4
