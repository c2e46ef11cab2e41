"""Stored fits, stored runs, factors and retained actions, audits that find what is wrong."""

from __future__ import annotations

import math

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import optimise as o
from ripplenet.plans import corpus, served
from ripplenet.sources import artifacts, runs
from ripplenet.sources.network import Network

MODEL = artifacts.Artifact("m", "logistic", ["a", "b"], [0.5, -2.0, 0.25], [1.0, 2.0], [2.0, 0.5], threshold=0.4, slope=0.8, intercept=0.1, tau=30.0, log_sigma=0.7)


def test_an_artifact_comes_back_as_it_was_and_scores_alike(spark, tmp_path):
    root = str(tmp_path)
    base = artifacts.save_artifact(spark, root, MODEL, dataset="d", seeds=[1, 2])
    assert artifacts.save_artifact(spark, root, MODEL) == base
    assert artifacts.load_artifact(spark, base, columns=["a", "b"]) == MODEL
    assert [(x["name"], x["folder"], x["about"]["seeds"]) for x in artifacts.list_artifacts(spark, root)] == [("m", base, [1, 2])]
    rows = spark.createDataFrame([(1, 3.0, 2.5), (2, -1.0, 1.0)], "id int, a double, b double")
    for r, a, b in zip(artifacts.served(rows, MODEL, ["id"], (24.0,)).orderBy("id").collect(), (3.0, -1.0), (2.5, 1.0), strict=True):
        z = 0.25 + 0.5 * (a - 1) / 2 - 2.0 * (b - 2) / 0.5
        p = 1 / (1 + math.exp(-(0.8 * z + 0.1)))
        by = p * 0.5 * (1 + math.erf(math.log(24 / 30) / 0.7 / math.sqrt(2)))
        assert abs(r.probability - p) < 1e-12 and r.flagged == (p >= 0.4) and abs(r.within_24 - by) < 1e-6


def test_a_changed_missing_or_unfit_artifact_is_refused(spark, tmp_path):
    root = str(tmp_path)
    base = artifacts.save_artifact(spark, root, MODEL)
    with pytest.raises(ValueError, match="fitted on columns a, b"):
        artifacts.load_artifact(spark, base, columns=["b", "a"])
    with pytest.raises(FileNotFoundError):
        artifacts.load_artifact(spark, f"{root}/none-0")
    with pytest.raises(ValueError, match="can't be served"):
        artifacts.save_artifact(spark, root, artifacts.Artifact("g", "graph", [], [0.0], [], []))
    half = f"{root}/half-1"
    spark.createDataFrame(MODEL.numbers(), "part string, i int, value double").write.parquet(f"{half}/numbers")
    assert len(artifacts.list_artifacts(spark, root)) == 1
    spark.createDataFrame([(p, i, v + (p == "weight")) for p, i, v in MODEL.numbers()], "part string, i int, value double").write.mode("overwrite").parquet(f"{base}/numbers")
    with pytest.raises(ValueError, match="not those that were saved"):
        artifacts.load_artifact(spark, base)


def test_runs_are_listed_latest_first_and_replace_only_themselves(spark, tmp_path):
    root = str(tmp_path)
    assert runs.list_runs(spark, root).count() == 0
    out = spark.createDataFrame([("A", 0.9, 0.0, 0, True), ("B", 0.3, 5.0, 1, True), ("C", 0.0, None, None, False)], "merchant_id string, probability double, hit_t double, hop int, affected boolean")
    hits = spark.createDataFrame([(5.0, "hit", "B", 1), (0.0, "hit", "A", 0), (0.0, "cash_out", "A", 0)], "t double, type string, merchant_id string, hop int")
    for i, kind in enumerate(["cascade", "search", "cascade"]):
        runs.save_run(spark, root, f"r{i}", out, hits, kind=kind, experiment="x" if i else "y", created=float(i))
    runs.save_run(spark, root, "r0", out.where("affected"), hits, kind="cascade", experiment="y", created=0.0)
    assert [(r.run_id, r.n_outcomes, r.n_events) for r in runs.list_runs(spark, root).collect()] == [("r2", 3, 3), ("r1", 3, 3), ("r0", 2, 3)]
    assert [r.run_id for r in runs.list_runs(spark, root, kind="cascade", limit=1, offset=1).collect()] == ["r0"]
    assert [r.run_id for r in runs.list_runs(spark, root, experiment="x", kind="search").collect()] == ["r1"]
    with pytest.raises(ValueError):
        runs.list_runs(spark, root, owner="me")
    assert [(r.sequence, r.merchant_id, r.type) for r in runs.events_for_run(spark, root, "r1").collect()] == [(1, "A", "cash_out"), (2, "A", "hit"), (3, "B", "hit")]
    assert [r.sequence for r in runs.events_for_run(spark, root, "r1", merchant_id="A", limit=1).collect()] == [1]
    assert sorted(r.merchant_id for r in runs.affected_ids(spark, root, "r1").collect()) == ["A", "B"] and runs.outcomes_for_run(spark, root, "no").count() == 0


def test_retained_actions_are_drawn_from_two_rankings_in_turn(spark):
    """Against a walk over both lists that skips what is taken and merchants that are full."""
    rows = [(f"a{i}", f"m{i % 5}", 10.0 * i, (i * 37 % 23) / 23, float(i * 53 % 29)) for i in range(20)]
    scored = spark.createDataFrame(rows, "id string, m string, cost double, score double, benefit double")
    for limit, most in ((6, 1), (9, 2), (50, 20)):
        lists = sorted(rows, key=lambda r: (-r[3], r[0])), sorted(rows, key=lambda r: (-r[4], r[0]))
        want, used = [], {}
        for pair in zip(*lists, strict=True):
            for r in pair:
                if len(want) < limit and r[0] not in want and used.get(r[1], 0) < most:
                    want.append(r[0])
                    used[r[1]] = used.get(r[1], 0) + 1
        got = o.retained_actions(scored, limit, most).collect()
        assert len(got) == 20 and [r.id for r in sorted((r for r in got if r.place), key=lambda r: r.place)] == want


def test_factors_are_scaled_over_the_pool(spark):
    actions = spark.createDataFrame([("x", "A", 100.0), ("y", "B", 300.0), ("z", "C", 100.0)], "id string, m string, cost double")
    nodes = spark.createDataFrame([("A", 0.5, 24.0, 1000, 0.2, 1.0), ("B", 1.0, 0.0, 100, 0.2, 3.0)], "m string, probability double, hit_t double, at_risk long, centrality double, leverage double")
    got = {r.id: r for r in o.scored_actions(actions, nodes, 168.0).collect()}
    assert got["x"].disruption == 500.0 and got["y"].urgency == 1.0 and got["z"].urgency == 1 / 8 and got["z"].leverage == 0.0
    want = 1.0 * (100 / 500) + 0.5 * 1.0 + 0.5 * 1.0 + 0.75 * 1.0 - 0.25 * 1.0
    assert abs(got["y"].score - want) < 1e-9 and got["y"].benefit == 100.0 - 300.0
    same = o.scored_actions(actions.where("id = 'x'"), nodes, 168.0).first()
    assert same.score == 0.0


def test_spread_cdf_rises_to_the_probability(spark):
    rows = spark.createDataFrame([(0.6, 40.0), (0.0, None), (None, 3.0)], "p double, tau double")
    ends = (1e-6, 40.0, 1e9)
    got = rows.select(*[e.spread_cdf("p", "tau", F.lit(x), F.lit(0.5)).alias(f"c{i}") for i, x in enumerate(ends)]).collect()
    assert abs(got[0].c0) < 1e-9 and abs(got[0].c1 - 0.3) < 1e-6 and abs(got[0].c2 - 0.6) < 1e-9
    assert all(v == 0 for r in got[1:] for v in r)


def test_an_audit_finds_features_that_know_the_future(spark, tmp_path, monkeypatch):
    """History read three weeks too far moves when the facts after the origin do."""
    n, honest = Network(spark, SF), corpus.node_history
    monkeypatch.setattr(corpus, "node_history", lambda n, origins: honest(n, [x + 504 for x in origins]).withColumn("origin", F.col("origin") - 504))
    found = served.audit_corpus(n, corpus.build_corpus(n, [40000.0], str(tmp_path))).collect()
    assert len(found) == 1 and found[0].n_moved > 0 and found[0].n_outside == 0 and not found[0].clean
