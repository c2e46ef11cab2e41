"""Concordance by inversions and monotone fits by ranges equal plain counts and fits."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplenet.operators import learn, ranked
from ripplenet.plans import learning, metrics, registry


def brute_inversions(y, n, low, high):
    return sum(int(n[i]) * int(n[j]) for i in range(len(y)) for j in range(i + 1, len(y)) if y[i] > y[j] and low <= int(y[i] ^ y[j]).bit_length() - 1 < high)


@pytest.mark.parametrize("low,high", [(0, 6), (3, 6), (0, 3)])
def test_inversions_by_bits(low, high):
    rng = np.random.default_rng(2)
    y, n = rng.permutation(50), rng.integers(1, 4, 50)
    assert ranked.inversions(y, n, low, high) == brute_inversions(y, n, low, high)
    assert ranked.inversions(np.zeros(0, int), np.zeros(0, int), low, high) == 0


@pytest.mark.parametrize("bits", [2, 5, 14])
def test_concordance_equals_all_pairs(spark, monkeypatch, bits):
    """With ties in both columns, a time that a third of the rows share, nulls, and stretches of 4 places."""
    monkeypatch.setattr(ranked, "LEAST_BITS", bits)
    rng = np.random.default_rng(bits)
    rows = [(float(rng.integers(12)) if i % 3 else 5.0, float(rng.integers(9)) / 4) for i in range(260)] + [(None, 1.0), (1.0, None)]
    t = spark.createDataFrame(rows, "seen double, risk double")
    whole = [r for r in rows if None not in r]
    pairs = [(a, b) for i, a in enumerate(whole) for b in whole[i + 1 :] if a[0] != b[0]]
    want = (len(pairs), sum((a[0] - b[0]) * (a[1] - b[1]) < 0 for a, b in pairs), sum(a[1] == b[1] for a, b in pairs))
    assert tuple(ranked.concordance(t, "seen", "risk").first()) == want
    assert tuple(ranked.concordance(t.limit(0), "seen", "risk").first()) == (0, 0, 0)


def test_concordance_makes_no_pairs(spark):
    """No join of the rows but by equal keys: nested loops are of one-row sides."""
    plan = metrics.concordance_index(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "LessThan" not in plan and " < " not in plan


def test_concordance_of_dealt_events_is_that_of_their_order(spark, tmp_path):
    """Dealt over files at random, the events give the rows of the SQL over the file in order, read by one thread."""
    import duckdb

    events = spark.read.parquet("/root/testdata/sf0.1/events.parquet")
    con = duckdb.connect(config={"threads": 1})
    con.execute("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet' WHERE user_id % 3 = 0")
    want = con.execute(registry.oracle_sql()["concordance_index"]).fetchone()
    for parts in (2, 9):
        events.where("user_id % 3 = 0").repartition(parts, F.xxhash64("event_id")).sortWithinPartitions(F.xxhash64("value")).write.parquet(f"{tmp_path}/{parts}/events.parquet")
        assert tuple(metrics.concordance_index(spark, f"{tmp_path}/{parts}").first()) == want
    nameless = events.where("user_id % 3 = 0").union(events.where("user_id = 1").withColumn("user_id", F.lit(None).cast("long")))
    nameless.write.parquet(f"{tmp_path}/null/events.parquet")
    assert tuple(metrics.concordance_index(spark, f"{tmp_path}/null").first()) == want  # who is unknown is in no pair


def plain_fit(x, y):
    blocks = []
    for v in np.unique(x):
        own = y[x == v]
        blocks.append([own.sum(), len(own), v, v])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            s, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + s, blocks[-1][1] + n, blocks[-1][2], hi]
    return [(lo, hi, s / n, n) for s, n, lo, hi in blocks]


@pytest.mark.parametrize("shape", ["noisy", "falling", "rising"])
def test_monotone_blocks_equal_a_plain_fit(spark, shape):
    rng = np.random.default_rng(7)
    x = np.round(rng.random(3000), 3)
    y = {"noisy": rng.random(3000) < x, "falling": rng.random(3000) < 1 - x, "rising": x > 0.5}[shape].astype(float)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(x, y, strict=True)], "s double, y double").repartition(7)
    got = sorted(tuple(r) for r in ranked.monotone_blocks(df, "s", "y").collect())
    want = plain_fit(x, y)
    assert [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose([r[2:] for r in got], [r[2:] for r in want])


def test_a_hundred_thousand_distinct_scores(spark):
    """All are different, and the fit is that of one pass over them in order."""
    rows = spark.range(100_000).select((F.col("id") / 7).alias("s"), (F.pmod(F.xxhash64("id"), F.lit(1000)) < F.col("id") / 100).cast("int").alias("y"))
    got = sorted(tuple(r) for r in ranked.monotone_blocks(rows, "s", "y").collect())
    blocks = []
    for s, y in sorted((r.s, r.y) for r in rows.collect()):
        blocks.append([y, 1, s, s])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            a, n, _, hi = blocks.pop()
            blocks[-1] = [blocks[-1][0] + a, blocks[-1][1] + n, blocks[-1][2], hi]
    assert got == [(lo, hi, a / n, float(n)) for a, n, lo, hi in blocks]


def test_calibration_by_join_equals_interpolation(spark):
    v = learning.Network(spark, SF).read("events").select("event_id", (F.col("value") / 100).alias("s"), (F.col("event_type") == "error").cast("int").alias("y"))
    knots = learn.isotonic(v, "s", "y")
    want = {r.event_id: r.c for r in v.select("event_id", learn.interpolate(F.col("s"), knots).alias("c")).collect()}
    got = {r.event_id: r.calibrated for r in learning.isotonic_calibration(spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)
