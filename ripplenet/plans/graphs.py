"""Graph queries over the overlay of dependency edges."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import graph as g
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network

R = SQL.replace("WITH lines", "WITH RECURSIVE lines")


def _nodes(n: Network):
    return n.merchants.select(F.col("merchant_id").alias("node"))


def _own(n: Network, where: str = "true"):
    return n.merchants.where(where).select(F.col("merchant_id").alias("root"), F.col("merchant_id").alias("node"))


@query(R + ", w AS (SELECT source AS root, target AS node, 1 AS hops FROM edges WHERE source LIKE 'N%' UNION SELECT root, target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 3) SELECT root, node, min(hops) AS hops FROM w WHERE root <> node GROUP BY root, node")
def k_hop_reach(spark, d):
    n = Network(spark, d)
    return g.reach(n.edges, _own(n, "level = 0"), 3)


@query(R + """, dn AS (SELECT source AS root, target AS node, 1 AS hops FROM edges UNION SELECT root, target, hops + 1 FROM dn JOIN edges ON source = node WHERE hops < 2),
up AS (SELECT target AS root, source AS node, 1 AS hops FROM edges UNION SELECT root, source, hops + 1 FROM up JOIN edges ON target = node WHERE hops < 2)
SELECT merchant_id, (SELECT count(DISTINCT node) FROM dn WHERE root = merchant_id AND node <> root) AS down, (SELECT count(DISTINCT node) FROM up WHERE root = merchant_id AND node <> root) AS up FROM merchants""")
def reach_counts(spark, d):
    n = Network(spark, d)
    both = [g.reach(n.edges, _own(n), 2, upstream=u).groupBy("root").agg(F.count("*").alias(name)) for u, name in ((False, "down"), (True, "up"))]
    out = n.merchants.select(F.col("merchant_id").alias("root"))
    for part in both:
        out = out.join(part, "root", "left")
    return out.na.fill(0).withColumnRenamed("root", "merchant_id")


@query(R + """, w AS (SELECT 'N1' AS node, 0 AS hops UNION SELECT 'N7', 0 UNION SELECT target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 4)
SELECT merchant_id AS node, coalesce(min(hops), 5) AS hops FROM merchants LEFT JOIN w ON node = merchant_id GROUP BY merchant_id""")
def shock_distance(spark, d):
    n = Network(spark, d)
    return g.multi_source_hops(n.edges, _nodes(n), spark.createDataFrame([("N1",), ("N7",)], "node string"), 5)


STEP = """, x{i} AS (SELECT m.merchant_id AS node, CASE WHEN m.merchant_id IN ('N1','N7') THEN 1.0 ELSE least(coalesce(v, 0), 1) END AS e FROM merchants m LEFT JOIN (SELECT target, sum(e * pass_through) AS v FROM x{j} JOIN edges ON source = node GROUP BY target) ON target = m.merchant_id)"""


@query(SQL + ", x0 AS (SELECT merchant_id AS node, CASE WHEN merchant_id IN ('N1','N7') THEN 1.0 ELSE 0 END AS e FROM merchants)" + "".join(STEP.format(i=i + 1, j=i) for i in range(3)) + " SELECT node, round(e, 9) AS exposure FROM x3")
def upstream_exposure(spark, d):
    n = Network(spark, d)
    x = g.exposure(n.edges, _nodes(n), spark.createDataFrame([("N1",), ("N7",)], "node string"))
    return x.select("node", F.round("exposure", 9).alias("exposure"))


def power_sql(p: str, a: str, b: str, rounds: int) -> str:
    """The power method along a -> b as one table a round: p0, p1, ..."""
    out = f", {p}l AS MATERIALIZED (SELECT {a} AS here, {b} AS there, pass_through / sum(pass_through) OVER (PARTITION BY {a}) AS share FROM edges), {p}0 AS (SELECT merchant_id AS node, 1.0 / count(*) OVER () AS r FROM merchants)"
    for i in range(1, rounds + 1):
        out += f""", {p}{i} AS MATERIALIZED (SELECT m.merchant_id AS node, 0.15/c.n + 0.85 * (coalesce(v, 0) + z.lost / c.n) AS r FROM merchants m CROSS JOIN (SELECT count(*) AS n FROM merchants) c
 CROSS JOIN (SELECT coalesce(sum(r), 0) AS lost FROM {p}{i - 1} WHERE node NOT IN (SELECT {a} FROM edges)) z LEFT JOIN (SELECT there, sum(r * share) AS v FROM {p}{i - 1} JOIN {p}l ON here = node GROUP BY there) ON there = m.merchant_id)"""
    return out


@query(SQL + power_sql("p", "source", "target", 6) + " SELECT node, round(r, 9) AS rank FROM p6")
def weighted_pagerank(spark, d):
    n = Network(spark, d)
    return g.pagerank(n.edges.withColumn("weight", F.col("pass_through")), _nodes(n), rounds=6).select("node", F.round("rank", 9).alias("rank"))


@query(SQL + power_sql("p", "target", "source", 6) + " SELECT node, round(r, 6) AS rank FROM p6")
def reverse_pagerank(spark, d):
    n = Network(spark, d)
    return g.pagerank(n.edges.withColumn("weight", F.col("pass_through")), _nodes(n), rounds=6, reverse=True).select("node", F.round("rank", 6).alias("rank"))


KATZ = ", x{i} AS MATERIALIZED (SELECT merchant_id AS node, 1 + 0.1 * coalesce(v, 0) AS x FROM merchants LEFT JOIN (SELECT target, sum(x) AS v FROM x{j} JOIN edges ON source = node GROUP BY target) ON target = merchant_id)"


@query(SQL + ", x0 AS (SELECT merchant_id AS node, 1.0 AS x FROM merchants)" + "".join(KATZ.format(i=i + 1, j=i) for i in range(12)) + " SELECT node, round(x / sqrt((SELECT sum(x * x) FROM x12)), 6) AS katz FROM x12")
def katz_centrality(spark, d):
    n = Network(spark, d)
    return g.katz(n.edges, _nodes(n), rounds=12).select("node", F.round("katz", 6).alias("katz"))


@query(R + """, w AS (SELECT source AS first, target AS last, [source, target] AS path FROM edges WHERE source < target UNION ALL SELECT first, target, list_append(path, target) FROM w JOIN edges ON source = last WHERE target > first AND NOT list_contains(path, target) AND len(path) < 4)
SELECT len(path) AS length, count(*) AS n FROM w JOIN edges ON source = last AND target = first GROUP BY 1""")
def bounded_cycles(spark, d):
    found = g.cycles(Network(spark, d).edges, 4)
    return found.groupBy(F.size("path").cast("long").alias("length")).agg(F.count("*").alias("n"))


@query(SQL + "SELECT source, target, round(CASE WHEN n >= 20 THEN pass_through ELSE 0.5 * pass_through END, 9) AS weight FROM edges")
def dependency_projection(spark, d):
    w = F.when(F.col("n") >= 20, F.col("pass_through")).otherwise(0.5 * F.col("pass_through"))
    return Network(spark, d).edges.select("source", "target", F.round(w, 9).alias("weight"))


@query(R + """, w AS (SELECT source AS root, target AS node, 1 AS hops FROM edges UNION SELECT root, target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 3),
live AS (SELECT debtor, CAST(sum(amount_minor - paid_minor) AS BIGINT) AS v FROM obligations WHERE amount_minor > paid_minor GROUP BY debtor), r AS (SELECT DISTINCT root, node FROM w WHERE root <> node)
SELECT root AS merchant_id, CAST(sum(coalesce(v, 0)) AS BIGINT) AS downstream_minor FROM r LEFT JOIN live ON debtor = node GROUP BY root""")
def downstream_value(spark, d):
    n = Network(spark, d)
    live = n.obligations.where(e.is_open()).groupBy(F.col("debtor").alias("node")).agg(F.sum(e.outstanding()).alias("v"))
    r = g.reach(n.edges, _own(n), 3)
    return r.join(live, "node", "left").groupBy(F.col("root").alias("merchant_id")).agg(F.sum(F.coalesce("v", F.lit(0))).alias("downstream_minor"))


@query(R + """, w AS (SELECT source AS root, target AS node, 1 AS hops FROM edges UNION SELECT root, target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 2),
f AS (SELECT merchant_id, coalesce(v, 0) / greatest(opening_minor + credit_minor - floor_minor, 1) AS frag FROM merchants LEFT JOIN (SELECT debtor, sum(amount_minor - paid_minor) AS v FROM obligations GROUP BY debtor) ON debtor = merchant_id),
r AS (SELECT root, sum(least(frag, 5)) AS down FROM (SELECT DISTINCT root, node FROM w WHERE root <> node) JOIN f ON merchant_id = node GROUP BY root)
SELECT f.merchant_id, round(frag * ln(1 + coalesce(down, 0)), 6) AS criticality FROM f LEFT JOIN r ON root = f.merchant_id""")
def criticality(spark, d):
    n = Network(spark, d)
    owed = n.obligations.groupBy(F.col("debtor").alias("merchant_id")).agg(F.sum(F.col("amount_minor") - F.col("paid_minor")).alias("v"))
    frag = F.coalesce("v", F.lit(0)) / F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1))
    f = n.merchants.join(owed, "merchant_id", "left").select("merchant_id", frag.alias("frag"))
    down = g.reach(n.edges, _own(n), 2).join(f.select(F.col("merchant_id").alias("node"), "frag"), "node").groupBy(F.col("root").alias("merchant_id")).agg(F.sum(F.least("frag", F.lit(5.0))).alias("down"))
    return f.join(down, "merchant_id", "left").select("merchant_id", F.round(F.col("frag") * F.log1p(F.coalesce("down", F.lit(0.0))), 6).alias("criticality"))


@query("""WITH RECURSIVE ev AS (SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN event_id - event_id % 7 + (event_id % 7) // 2 END AS caused_by FROM events),
w AS (SELECT event_id AS leaf, 0 AS depth, event_id FROM ev UNION ALL SELECT leaf, depth + 1, caused_by FROM w JOIN ev USING (event_id) WHERE caused_by IS NOT NULL) SELECT leaf, depth, event_id FROM w""")
def causal_chains(spark, d):
    v = Network(spark, d).read("events").select("event_id")
    parent = F.when(F.col("event_id") % 7 != 0, F.col("event_id") - F.col("event_id") % 7 + F.expr("(event_id % 7) div 2"))
    ev = v.withColumn("caused_by", parent)
    return g.causal_chain(ev, ev)


SPILL = """, act{i} AS MATERIALIZED (SELECT node, greatest(load - buffer, 0) - sent AS excess FROM s{j} WHERE greatest(load - buffer, 0) - sent >= 1),
got{i} AS MATERIALIZED (SELECT target AS node, sum(x) AS got FROM (SELECT target, least(excess * share, live) AS x FROM act{i} JOIN sh ON sh.source = node) WHERE x >= 1 GROUP BY target),
s{i} AS MATERIALIZED (SELECT s.node, buffer, load + coalesce(got, 0) AS load, sent + coalesce(excess, 0) AS sent, CASE WHEN hop IS NULL AND load + coalesce(got, 0) > buffer THEN {i} ELSE hop END AS hop FROM s{j} s LEFT JOIN act{i} a ON a.node = s.node LEFT JOIN got{i} g ON g.node = s.node)"""


@query(
    SQL
    + """, owed AS (SELECT debtor, creditor, CAST(sum(amount_minor - paid_minor) AS DOUBLE) AS live FROM obligations WHERE amount_minor > paid_minor GROUP BY ALL),
sh AS MATERIALIZED (SELECT source, target, pass_through / sum(pass_through) OVER (PARTITION BY source) AS share, coalesce(live, 1e9) AS live FROM edges LEFT JOIN owed ON debtor = source AND creditor = target),
s0 AS MATERIALIZED (SELECT merchant_id AS node, CAST(opening_minor + credit_minor - floor_minor AS DOUBLE) AS buffer, CASE merchant_id WHEN 'N1' THEN 5e8 WHEN 'N7' THEN 3e8 ELSE 0 END AS load, 0.0::DOUBLE AS sent, CASE WHEN CASE merchant_id WHEN 'N1' THEN 5e8 WHEN 'N7' THEN 3e8 END > opening_minor + credit_minor - floor_minor THEN 0 END AS hop FROM merchants)"""
    + "".join(SPILL.format(i=i + 1, j=i) for i in range(6))
    + " SELECT node, round(greatest(load - buffer, 0), 2) AS shortfall, hop FROM s6"
)
def shortfall_propagation(spark, d):
    n = Network(spark, d)
    live = n.obligations.where(e.is_open()).groupBy(F.col("debtor").alias("source"), F.col("creditor").alias("target")).agg(F.sum(e.outstanding()).cast("double").alias("live"))
    edges = n.edges.join(live, ["source", "target"], "left").na.fill(1e9, ["live"])
    buffers = n.merchants.select(F.col("merchant_id").alias("node"), e.buffer("opening_minor", "credit_minor", "floor_minor").cast("double").alias("buffer"))
    out = g.linear_threshold(edges, buffers, spark.createDataFrame([("N1", 5e8), ("N7", 3e8)], "node string, shock double"))
    return out.select("node", F.round("shortfall", 2).alias("shortfall"), "hop")


def _reached(hours: float, mu: float, sigma: float) -> float:
    """The share of a log-normal lag below so many hours, by the approximation of :func:`exprs.normal_cdf`."""
    x = (math.log(hours) - mu) / sigma
    k = 1 / (1 + 0.2316419 * x)
    return 1 - math.exp(-x * x / 2) / math.sqrt(2 * math.pi) * k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))


OR = """, n{i} AS MATERIALIZED (SELECT merchant_id AS node, CASE WHEN merchant_id = 'N1' THEN 1.0 ELSE coalesce(hit, 0) END AS p FROM merchants LEFT JOIN (SELECT target, 1 - exp(sum(ln(1 - least(n.p * l.p, 1 - 1e-12)))) AS hit FROM n{j} n JOIN l ON l.source = n.node GROUP BY target) ON target = merchant_id)"""


@query(
    SQL
    + f", l AS MATERIALIZED (SELECT source, target, least(20 * pass_through, 0.9) * {_reached(168.0, 3.0, 0.8)!r} AS p FROM edges), n0 AS (SELECT merchant_id AS node, CASE WHEN merchant_id = 'N1' THEN 1.0 ELSE 0 END AS p FROM merchants)"
    + "".join(OR.format(i=i + 1, j=i) for i in range(6))
    + " SELECT node, round(p, 6) AS probability FROM n6"
)
def noisy_or_cascade(spark, d):
    n = Network(spark, d)
    lag = e.lognormal_cdf(F.lit(168.0), F.lit(3.0), F.lit(0.8))
    edges = n.edges.select("source", "target", (F.least(20 * F.col("pass_through"), F.lit(0.9)) * lag).alias("p"))
    out = g.noisy_or(edges, _nodes(n), spark.createDataFrame([("N1",)], "node string"))
    return out.select("node", F.round("probability", 6).alias("probability"))


_Z = "((ln({left}) - mu) / sigma)"
_K = f"(1 / (1 + 0.2316419 * abs({_Z})))"
_TAIL = f"exp(-{_Z} * {_Z} / 2) / {math.sqrt(2 * math.pi)!r} * {_K} * (0.319381530 + {_K} * (-0.356563782 + {_K} * (1.781477937 + {_K} * (-1.821255978 + {_K} * 1.330274429))))"
_CDF = f"CASE WHEN {_Z} >= 0 THEN 1 - {_TAIL} ELSE {_TAIL} END".format(left="168.0 - coalesce(hit_t, 0)")
TIMED = (
    f""", m{{i}} AS MATERIALIZED (SELECT target AS node, ln(1 - least(f, 1 - 1e-12)) AS miss, CASE WHEN arrival <= 168 THEN arrival END AS arrival FROM (SELECT target, p * q * ({_CDF.replace("{", "{{").replace("}", "}}")}) AS f, coalesce(hit_t, 0) + exp(mu + sigma * sigma / 2) AS arrival FROM c{{j}} c JOIN l ON l.source = c.node WHERE p > 1e-6 AND 168.0 - coalesce(hit_t, 0) > 0) WHERE f > 1e-6),
c{{i}} AS MATERIALIZED (SELECT c.node, CASE WHEN 1 - (1 - p) * exp(sm) > p + 1e-9 THEN 1 - (1 - p) * exp(sm) ELSE p END AS p, CASE WHEN a IS NULL THEN hit_t ELSE least(coalesce(hit_t, a), a) END AS hit_t, CASE WHEN hop IS NULL AND sm IS NOT NULL THEN {{i}} ELSE hop END AS hop FROM c{{j}} c LEFT JOIN (SELECT node, sum(miss) AS sm, min(arrival) AS a FROM m{{i}} GROUP BY node) g ON g.node = c.node)"""
)


@query(
    SQL
    + ", l AS MATERIALIZED (SELECT source, target, least(20 * pass_through, 0.9) AS q, 3.0 + 0.2 * (n % 4) AS mu, 0.8 AS sigma FROM edges), c0 AS (SELECT merchant_id AS node, CASE WHEN merchant_id IN ('N1', 'N7') THEN 1.0 ELSE 0.0 END::DOUBLE AS p, CASE merchant_id WHEN 'N1' THEN 0.0 WHEN 'N7' THEN 24.0 END::DOUBLE AS hit_t, CASE WHEN merchant_id IN ('N1', 'N7') THEN 0 END AS hop FROM merchants)"
    + "".join(TIMED.format(i=i + 1, j=i) for i in range(6))
    + " SELECT node, round(p, 6) AS probability, round(hit_t, 6) AS hit_t, hop FROM c6"
)
def timed_cascade(spark, d):
    """The chance to be hit within a week of two shocks, the earliest mean arrival, and the hops to it."""
    n = Network(spark, d)
    links = n.edges.select("source", "target", F.least(20 * F.col("pass_through"), F.lit(0.9)).alias("q"), (3.0 + 0.2 * (F.col("n") % 4)).alias("mu"), F.lit(0.8).alias("sigma"))
    out = g.timed_cascade(links, _nodes(n), spark.createDataFrame([("N1", 0.0), ("N7", 24.0)], "node string, t double"), 168.0)
    return out.select("node", F.round("probability", 6).alias("probability"), F.round("hit_t", 6).alias("hit_t"), "hop")
