"""Fits where a source's rows lie equal those by rounds over pairs, whatever the batches and however many rows a source has."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplenet.operators import flows, learn
from ripplenet.operators import relational as r
from ripplenet.plans import learning
from ripplenet.sources.network import Network


def test_batches_end_where_a_source_ends():
    rows = ["a"] * 3 + ["b"] * 7 + ["c"] + ["d"] * 4 + [None] * 2
    for size in (1, 2, 3, 5, 20):
        parts = [pa.RecordBatch.from_arrays([pa.array(rows[i : i + size], pa.string()), pa.array(range(i, min(i + size, len(rows))))], ["s", "i"]) for i in range(0, len(rows), size)]
        got = list(flows.whole(iter(parts)))
        assert sum([b.column(1).to_pylist() for b, _ in got], []) == list(range(len(rows)))
        cuts = [b.column(0).to_pylist()[x:y] for b, ends in got for x, y in zip(ends[:-1], ends[1:], strict=True)]
        assert [(c[0], len(c)) for c in cuts] == [("a", 3), ("b", 7), ("c", 1), ("d", 4), (None, 2)]


@pytest.mark.parametrize("most", [3, 64])
def test_hawkes_of_flows_equals_pairs(spark, most):
    """With receipts of one time and one name, more receipts in reach than count, and unknown times, targets and sources."""
    rng = np.random.default_rng(most)
    rows = []
    for i in range(900):
        source = None if i % 97 == 0 else f"s{i % 4}"
        rows.append((source, None if i % 53 == 0 else f"t{i % 3}", None if i % 41 == 0 else float(rng.integers(0, 900)), None if i % 43 == 0 else float(rng.integers(0, 900)), int(rng.integers(1, 4)), f"p{i % 700}", i))
    rows = spark.createDataFrame(rows, "source string, target string, t double, t_in double, kind int, parent string, child long").repartition(3)
    got = {(x.source, x.target): (x.mu, x.alpha, x.n) for x in learn.hawkes_flows(rows, ["parent"], 1000.0, 1 / 48, 100.0, most).collect()}
    kids = rows.where("kind > 1").select("source", "target", "t", "child")
    pairs = r.interval_join(kids, rows.where("kind in (1, 3)").select("source", "t_in", "parent"), "source", "t", "t_in", 100.0)
    pairs = r.top_per_group(pairs, ["source", "target", "child"], [F.desc("t_in"), F.col("parent")], most).withColumn("u", F.col("t") - F.col("t_in"))
    want = {(x.source, x.target): (x.mu, x.alpha, x.n) for x in learn.hawkes_em(kids.select("source", "target", "child"), pairs, 1000.0, 1 / 48).collect()}
    assert got.keys() == want.keys() and len(got) > 12
    for k, (mu, alpha, n) in want.items():
        assert got[k] == (pytest.approx(mu, rel=1e-9) if mu is not None else None, pytest.approx(alpha, abs=1e-9), n), k


def test_crowded_suppliers_are_fitted_by_rounds(spark, monkeypatch):
    whole = {(x.source, x.target): x for x in learning.hawkes_fit(spark, SF).collect()}
    monkeypatch.setattr(flows, "MOST", 600)
    n = Network(spark, SF)
    rows, crowded = learning.supplier_flows(n)
    some = n.read("lineitem").groupBy("l_suppkey").count().where("count > 600").count()
    assert 0 < some < len(whole) / 25 and crowded.lines.select("l_suppkey").distinct().count() == some
    mixed = {(x.source, x.target): x for x in learning.hawkes_fit(spark, SF).collect()}
    assert mixed.keys() == whole.keys()
    assert all(mixed[k].n == x.n and abs(mixed[k].mu - x.mu) < 2e-8 and abs(mixed[k].alpha - x.alpha) < 2e-6 for k, x in whole.items())


def test_lines_are_joined_once_and_dealt_by_supplier_once(spark):
    """A line passes three exchanges, by order, part and supplier, and no payment meets its receipts as rows."""
    plan = learning.hawkes_fit(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [l_orderkey") == 1 and "Generate" not in plan
    assert plan.count("RepartitionByExpression") == 1


def test_parts_of_one_key_are_payments_of_one_receipt(spark, tmp_path):
    """A line whose part is listed twice is one receipt and two payments; one whose part is missing is a receipt alone."""
    for t in ("orders", "customer", "lineitem"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    part = spark.read.parquet(f"{SF}/part.parquet").where("p_partkey % 3 <> 0")
    part.union(part.where("p_partkey % 5 = 0")).write.parquet(f"{tmp_path}/part.parquet")
    n = Network(spark, str(tmp_path))
    rows, _ = learning.supplier_flows(n)
    assert rows.where(F.col("kind").isin(1, 3)).count() == n.trade.count()
    assert rows.where(F.col("kind") > 1).count() == n.supply.count()
