"""Ledger, versions and cached results survive failures; cascades end on cycles."""

from __future__ import annotations

import json
import math

import pytest
from conftest import SF
from pyspark.sql import functions as F

from ripplenet.operators import graph
from ripplenet.plans import joins
from ripplenet.sources import versions
from ripplenet.sources.network import Network
from ripplenet.streaming import ingest


def line(i, at, amount=100.0, payer="U1", payee="U2"):
    return json.dumps({"id": i, "amount": amount, "created_at": at, "status": "captured", "payer": payer, "payee": payee})


def held(ledger):
    good = sorted((r.batch, r.external_id) for r in ledger.events().collect())
    return good, sorted((r.batch, r.id or "", r.reason) for r in ledger.rejections().collect())


def test_a_batch_that_dies_before_its_commit_changes_nothing_until_rerun(spark, tmp_path, monkeypatch):
    src, cp = tmp_path / "in", str(tmp_path / "cp")
    src.mkdir()
    (src / "1.txt").write_text("\n".join([line("a", 1), line("b", 2), line("a", 3)]))
    ledger = ingest.Ledger(spark, str(tmp_path / "ledger"))
    assert held(ledger) == ([], [])
    ledger.run(ingest.read_lines(spark, str(src)), cp)
    first = held(ledger)
    assert first == ([(0, "a"), (0, "b")], [(0, "a", "duplicate")])

    (src / "2.txt").write_text("\n".join([line("b", 4), line("c", 5), "junk"]))

    def die(self, batch):
        raise RuntimeError("lost between write and commit")

    with monkeypatch.context() as m:
        m.setattr(ingest.Ledger, "commit", die)
        with pytest.raises(Exception, match="lost between|foreachBatch|FOREACH"):
            ledger.run(ingest.read_lines(spark, str(src)), cp)
    assert held(ledger) == first and ledger.batches() == [0]  # the written slice is not committed, so nobody sees it
    ledger.run(ingest.read_lines(spark, str(src)), cp)  # the same batch again
    after = held(ledger)
    assert after == ([(0, "a"), (0, "b"), (1, "c")], [(0, "a", "duplicate"), (1, "", "not_an_object"), (1, "b", "duplicate")])
    ledger.write(spark.createDataFrame([(x,) for x in (line("b", 4), line("c", 5), "junk")], "value string"), 1)  # a replay
    assert held(ledger) == after


def test_versions_are_published_in_one_step_and_stay_readable(spark, tmp_path):
    root = str(tmp_path / "overlay")
    one = spark.createDataFrame([("a", "b", 0.5), ("a", "c", 0.2)], "source string, target string, w double")
    est = spark.createDataFrame([("a", "b", 0.7), ("x", "y", 0.1), ("b", "c", 0.3)], "source string, target string, w double")
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node string")
    with pytest.raises(ValueError):
        versions.read_version(spark, root)
    assert versions.publish(one, root) == 1
    before = versions.read_version(spark, root)
    assert versions.install_overlay(spark, root, est, nodes=nodes) == 2
    rows = lambda v: sorted((r.source, r.target, r.w) for r in versions.read_version(spark, root, v).collect())
    assert rows(2) == [("a", "b", 0.7), ("a", "c", 0.2), ("b", "c", 0.3)] and rows(1) == [("a", "b", 0.5), ("a", "c", 0.2)]
    assert before.count() == 2  # a reader keeps its version
    assert versions.install_overlay(spark, root, est.limit(1), keep=False) == 3 and rows(3) == [("a", "b", 0.7)]
    (tmp_path / "overlay" / "_pointers" / "4.claim").touch()  # a writer took the number and died
    assert versions.publish(one, root) == 5 and versions.versions(spark, root) == [1, 2, 3, 5]


def test_cached_results_read_no_facts_and_miss_when_a_file_changes(spark, tmp_path):
    facts = str(tmp_path / "facts.parquet")
    Network(spark, SF).read("lineitem").limit(500).write.parquet(facts)
    built = []

    def build():
        built.append(1)
        return spark.read.parquet(facts).groupBy("l_suppkey").agg(F.count("*").alias("n"))

    get = lambda spec: versions.cached(spark, str(tmp_path / "store"), [facts], spec, build)
    want = sorted(map(tuple, get({"origin": 1.0}).collect()))
    again = get({"origin": 1.0})
    assert len(built) == 1 and sorted(map(tuple, again.collect())) == want
    assert "facts.parquet" not in again._jdf.queryExecution().executedPlan().toString()
    get({"origin": 2.0})
    assert len(built) == 2
    spark.read.parquet(facts).limit(3).write.mode("append").parquet(facts)
    get({"origin": 1.0})
    assert len(built) == 3
    kept = next(p for p in (tmp_path / "store").glob("*/rows/*.parquet"))
    kept.unlink()  # a broken result is built again
    for origin in (1.0, 2.0):
        get({"origin": origin})
    assert len(built) >= 4


def cascade(links, nodes, shocks, horizon, hops):
    p, t, hop = {n: 0.0 for n in nodes}, {}, {}
    for n, at in shocks:
        p[n], t[n], hop[n] = 1.0, at, 0
    phi = lambda x: 0.5 * (1 + math.erf(x / math.sqrt(2)))
    for h in range(1, hops + 1):
        miss, came = {}, {}
        for a, b, q, mu, s in links:
            left = horizon - t.get(a, 0.0)
            if p[a] <= 1e-6 or left <= 0:
                continue
            f = p[a] * q * phi((math.log(left) - mu) / s)
            if f > 1e-6:
                miss[b] = miss.get(b, 0.0) + math.log1p(-min(f, 1 - 1e-12))
                at = t.get(a, 0.0) + math.exp(mu + s * s / 2)
                if at <= horizon:
                    came[b] = min(came.get(b, at), at)
        new = {b: 1 - (1 - p[b]) * math.exp(m) for b, m in miss.items()}
        grown = {b: x for b, x in new.items() if x > p[b] + 1e-9}
        for b in miss:
            hop.setdefault(b, h)
        for b, at in came.items():
            t[b] = min(t.get(b, at), at)
        p |= grown
        if not grown:
            break
    return {n: (round(p[n], 5), round(t[n], 5) if n in t else None, hop.get(n)) for n in nodes}


def test_timed_cascade_on_a_cycle(spark):
    links = [("a", "b", 0.6, 2.5, 0.5), ("b", "c", 0.5, 3.0, 0.8), ("c", "a", 0.9, 2.0, 0.4), ("c", "b", 0.4, 3.5, 0.6), ("a", "d", 0.3, 6.5, 0.3), ("e", "a", 0.9, 1.0, 0.5)]
    nodes = list("abcdef")
    df = spark.createDataFrame(links, "source string, target string, q double, mu double, sigma double")
    out = graph.timed_cascade(df, spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame([("a", 5.0)], "node string, t double"), 168.0, 8)
    got = {r.node: (round(r.probability, 5), None if r.hit_t is None else round(r.hit_t, 5), r.hop) for r in out.collect()}
    assert got == cascade(links, nodes, [("a", 5.0)], 168.0, 8)
    assert got["f"] == (0.0, None, None) and got["d"][1] is None and got["c"][2] == 2


def test_overlay_merge_is_the_second_version(spark):
    got = joins.overlay_merge(spark, SF)
    assert {r.origin for r in got.select("origin").distinct().collect()} == {"stored", "estimated"}
    assert got.groupBy("source", "target").count().where("count > 1").isEmpty()
