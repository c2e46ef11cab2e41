"""Candidates, feasibility, exact, greedy and robust selection over surrogate values."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import graph as g
from ripplenet.operators import optimise as o
from ripplenet.operators import relational as r
from ripplenet.plans.joins import ROLES, profiles, roles
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network

EXPOSED = SQL + ROLES + """, x AS (SELECT merchant_id AS m, CAST(payable_minor - (opening_minor + credit_minor - floor_minor) AS DOUBLE) AS shortfall FROM merchants JOIN payable ON m = merchant_id)
"""


def exposed(n: Network):
    """Merchants with payables, and how far these exceed their buffer."""
    p = profiles(n).where("level = 0")
    gap = (F.col("payable_minor") - e.buffer("opening_minor", "credit_minor", "floor_minor")).cast("double")
    return p.join(roles(n)[0].select("merchant_id"), "merchant_id", "left_semi").select(F.col("merchant_id").alias("m"), gap.alias("shortfall"))


@query(EXPOSED + "SELECT 'injection' AS kind, m, shortfall * k AS amount, shortfall * k AS cost FROM x, (VALUES (0.6::DOUBLE), (1.0), (1.5)) v(k) WHERE shortfall * k >= 1000 UNION ALL SELECT 'credit_line', m, shortfall, 0.6::DOUBLE * shortfall FROM x WHERE shortfall >= 1000")
def candidate_actions(spark, d):
    return o.injections(exposed(Network(spark, d)))


@query(SQL + ROLES + "SELECT merchant_id, payable_minor + 500000 - (opening_minor + credit_minor - floor_minor) AS gap_minor FROM merchants JOIN payable ON m = merchant_id WHERE payable_minor + 500000 - (opening_minor + credit_minor - floor_minor) >= 100000")
def coverage_gap_actions(spark, d):
    gap = F.col("payable_minor") + 500000 - e.buffer("opening_minor", "credit_minor", "floor_minor")
    return profiles(Network(spark, d)).where("level = 0").select("merchant_id", gap.alias("gap_minor")).where("gap_minor >= 100000")


@query(SQL + """SELECT obligation_id, array_to_string(list_filter([CASE WHEN shift > 72 THEN 'too_long' END, CASE WHEN amount_minor - paid_minor <= 0 THEN 'settled' END, CASE WHEN amount_minor > 5000000 THEN 'over_cap' END, CASE WHEN due_t < 10000 THEN 'past_due' END], lambda v: v IS NOT NULL), ',') AS violations
FROM (SELECT *, 24.0 * priority AS shift FROM obligations)""")
def feasibility(spark, d):
    rules = {"too_long": 24.0 * F.col("priority") > 72, "settled": ~e.is_open(), "over_cap": F.col("amount_minor") > 5_000_000, "past_due": F.col("due_t") < 10000}
    return Network(spark, d).obligations.select("obligation_id", F.concat_ws(",", o.violations(rules)).alias("violations"))


ACTS = EXPOSED + f""", a AS (SELECT 'a-' || m AS id, m, shortfall AS gain, 0.5 * shortfall AS cost FROM x)
"""
PAIRS = ACTS + """, ov AS (SELECT p.id AS a, q.id AS b, 0.3 * least(p.gain, q.gain) AS overlap FROM a p JOIN a q ON p.id < q.id)
"""


def acts(n: Network):
    """One action a merchant: its gain and cost."""
    return exposed(n).select(F.concat(F.lit("a-"), "m").alias("id"), "m", F.col("shortfall").alias("gain"), (0.5 * F.col("shortfall")).alias("cost"))


def pool(n: Network):
    """All actions, and the overlap of any two."""
    a = g.cut(acts(n))
    p, q = a.alias("p"), a.alias("q")
    overlap = p.join(q, F.col("p.id") < F.col("q.id")).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"), (0.3 * F.least("p.gain", "q.gain")).alias("overlap"))
    return a, overlap


def shared(a, b):
    """What two actions' gains overlap."""
    return 0.3 * np.minimum(a, b)


@query(PAIRS + """, s AS (SELECT id AS plan, gain AS value, cost, 1 AS size FROM a UNION ALL SELECT p.id || '+' || q.id, p.gain + q.gain - overlap, p.cost + q.cost, 2 FROM a p JOIN a q ON p.id < q.id JOIN ov ON ov.a = p.id AND ov.b = q.id
 UNION ALL SELECT p.id || '+' || q.id || '+' || r.id, p.gain + q.gain + r.gain - o1.overlap - o2.overlap - o3.overlap, p.cost + q.cost + r.cost, 3 FROM a p JOIN a q ON p.id < q.id JOIN a r ON q.id < r.id JOIN ov o1 ON o1.a = p.id AND o1.b = q.id JOIN ov o2 ON o2.a = p.id AND o2.b = r.id JOIN ov o3 ON o3.a = q.id AND o3.b = r.id)
SELECT plan, size, round(value, 2) AS value, round(cost, 2) AS cost, row_number() OVER (ORDER BY value DESC, cost, size, plan) AS place FROM s""")
def exact_search(spark, d):
    """Every set of up to three actions, in order."""
    found = o.best_sets(spark, o.Pool(acts(Network(spark, d)), shared), 3)
    found = r.placed(found.select("plan", "size", "value", "cost"), [F.desc("value"), F.col("cost"), F.col("size"), F.col("plan")])
    return found.select("plan", "size", F.round("value", 2).alias("value"), F.round("cost", 2).alias("cost"), "place")


OPTIONS = EXPOSED + """, a AS (SELECT kind || '-' || m AS id, m, least(shortfall * k, shortfall) - 0.2::DOUBLE * (price * shortfall * k) AS gain, price * shortfall * k AS cost
 FROM x, (VALUES ('injection-0.6', 0.6::DOUBLE, 1.0::DOUBLE), ('injection-1.0', 1.0, 1.0), ('injection-1.5', 1.5, 1.0), ('credit_line', 1.0, 0.6)) v(kind, k, price) WHERE shortfall * k >= 1000),
s AS (SELECT id AS plan, 1 AS size, gain AS value, cost, gain AS least FROM a
 UNION ALL SELECT p.id || '+' || q.id, 2, p.gain + q.gain - 0.3 * least(p.gain, q.gain), p.cost + q.cost, least(p.gain, q.gain) FROM a p JOIN a q ON p.id < q.id AND p.m <> q.m
 UNION ALL SELECT p.id || '+' || q.id || '+' || r.id, 3, p.gain + q.gain + r.gain - 0.3 * least(p.gain, q.gain) - 0.3 * least(p.gain, r.gain) - 0.3 * least(q.gain, r.gain), p.cost + q.cost + r.cost, least(p.gain, q.gain, r.gain) FROM a p JOIN a q ON p.id < q.id AND p.m <> q.m JOIN a r ON q.id < r.id AND r.m <> p.m AND r.m <> q.m)
"""


def options(n: Network):
    """Four actions a merchant: cash of three sizes and a credit line, each with its gain less a fifth of its cost."""
    kinds = [("injection-0.6", 0.6, 1.0), ("injection-1.0", 1.0, 1.0), ("injection-1.5", 1.5, 1.0), ("credit_line", 1.0, 0.6)]
    each = exposed(n).withColumn("v", F.explode(F.array(*[F.struct(F.lit(a).alias("kind"), F.lit(b).alias("k"), F.lit(c).alias("price")) for a, b, c in kinds])))
    amount, cost = F.col("shortfall") * F.col("v.k"), F.col("v.price") * F.col("shortfall") * F.col("v.k")
    return each.where(amount >= 1000).select(F.concat_ws("-", "v.kind", "m").alias("id"), "m", (F.least(amount, F.col("shortfall")) - 0.2 * cost).alias("gain"), cost.alias("cost"))


@query(OPTIONS + "SELECT plan, size, round(value, 2) AS value, round(cost, 2) AS cost, place FROM (SELECT *, row_number() OVER (ORDER BY round(value, 4) DESC, round(cost, 4), size, plan) AS place FROM s) WHERE place <= 100")
def exact_best(spark, d):
    """The hundred best sets of up to three of all options; ranges of sets that can't hold one are never decoded."""
    best = o.best_sets(spark, o.Pool(options(Network(spark, d)), shared), 3, keep=200)
    place = F.row_number().over(Window.orderBy(F.desc(F.round("value", 4)), F.round("cost", 4), "size", "plan"))  # 200 rows
    return best.withColumn("place", place.cast("long")).where("place <= 100").select("plan", "size", F.round("value", 2).alias("value"), F.round("cost", 2).alias("cost"), "place")


POOLS = (4, 8, 16, 32)


@query(OPTIONS + f""", ranked AS (SELECT gain, row_number() OVER (ORDER BY gain DESC, id) AS nth FROM a), b AS (SELECT k AS kept, (SELECT min(gain) FROM ranked WHERE nth <= k) AS edge FROM (VALUES {", ".join(f"({k})" for k in POOLS)}) v(k)),
o AS (SELECT kept, max(value) FILTER (least >= edge) AS objective, (SELECT max(value) FROM s) AS whole FROM s, b GROUP BY kept)
SELECT kept, (SELECT count(*) FROM a) AS n, round(objective, 2) AS objective, round(whole, 2) AS optimum, round(whole - objective, 2) AS regret, whole - objective <= 1e-6 * greatest(1, abs(whole)) AS retained FROM o""")
def pruning_benchmark(spark, d):
    """The best set among the first actions by gain beside the best of all: what a smaller pool gives away."""
    pool = o.Pool(options(Network(spark, d)), shared)
    best = lambda k: o.best_sets(spark, pool, 3, keep=1, first=k).select(F.lit(k).alias("kept"), "value")
    rows = best(POOLS[0])
    for k in POOLS[1:]:
        rows = rows.union(best(k))
    whole = o.best_sets(spark, pool, 3, keep=1).select(F.col("value").alias("whole"))
    lost = F.col("whole") - F.col("value")
    return rows.join(F.broadcast(whole)).select("kept", F.lit(len(pool.ids)).cast("long").alias("n"), F.round("value", 2).alias("objective"), F.round("whole", 2).alias("optimum"), F.round(lost, 2).alias("regret"), (lost <= 1e-6 * F.greatest(F.lit(1.0), F.abs("whole"))).alias("retained"))


@query(
    PAIRS
    + """, one AS (SELECT id, gain FROM a WHERE gain > 1e-9 ORDER BY gain DESC, id LIMIT 1),
two AS (SELECT a.id, a.gain - 0.3 * least(a.gain, one.gain) AS g FROM a, one WHERE a.id <> one.id AND a.gain - 0.3 * least(a.gain, one.gain) > 1e-9 ORDER BY g DESC, a.id LIMIT 1),
taken AS (SELECT id FROM one UNION ALL SELECT id FROM two),
three AS (SELECT a.id, a.gain - sum(0.3 * least(a.gain, p.gain)) AS g FROM a, a p WHERE p.id IN (SELECT id FROM taken) AND a.id NOT IN (SELECT id FROM taken) GROUP BY a.id, a.gain HAVING g > 1e-9 ORDER BY g DESC, a.id LIMIT 1)
SELECT 1 AS step, id FROM one UNION ALL SELECT 2, id FROM two UNION ALL SELECT 3, id FROM three"""
)
def greedy_search(spark, d):
    a, overlap = pool(Network(spark, d))
    evaluate = lambda plans: o.pairwise_value(plans, a.select("id", "gain", "cost"), overlap).select("plan", "value")
    picked = o.greedy(a, evaluate, 3, per_cost=False)
    return spark.createDataFrame(list(enumerate(picked, 1)), "step int, id string")


@query("SELECT user_id % 40 AS plan, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS spread, round(avg(value) + 0.5 * stddev_pop(value) + 0.01 * max(user_id), 6) AS score FROM events GROUP BY 1")
def robust_selection(spark, d):
    w = Network(spark, d).read("events").select((F.col("user_id") % 40).alias("plan"), F.col("value").alias("disruption"), F.col("user_id").alias("cost"))
    found = o.robust(w, 0.5, 0.01)
    return found.select("plan", *[F.round(c, 6).alias(c) for c in ("mean", "spread", "score")])


@query("SELECT k AS plan, round(avg(value), 6) AS mean, round(avg(value) FILTER (rn <= greatest(ceil(n * 0.5), 1)) - avg(value), 6) AS spread FROM (SELECT user_id % 40 AS k, value, row_number() OVER (PARTITION BY user_id % 40 ORDER BY value DESC) AS rn, count(*) OVER (PARTITION BY user_id % 40) AS n FROM events) GROUP BY k")
def robust_tail(spark, d):
    w = Network(spark, d).read("events").select((F.col("user_id") % 40).alias("plan"), F.col("value").alias("disruption"), F.lit(0).alias("cost"))
    return o.robust(w, tail=0.5).select("plan", F.round("mean", 6).alias("mean"), F.round("spread", 6).alias("spread"))


@query(ACTS + "SELECT id, round(gain - 0.4 * cost, 2) AS penalised, CASE WHEN gain >= 1e8 THEN round(cost, 2) END AS constrained_cost, round(gain / cost, 6) AS efficiency, round(CASE WHEN top > 0 THEN gain / top ELSE 0 END, 9) AS importance FROM (SELECT *, max(gain) OVER () AS top FROM a)")
def objective_forms(spark, d):
    a = acts(Network(spark, d))
    gain, cost, top = F.col("gain"), F.col("cost"), F.col("top")
    return a.join(F.broadcast(a.agg(F.max("gain").alias("top")))).select("id", F.round(gain - 0.4 * cost, 2).alias("penalised"), F.when(gain >= 1e8, F.round(cost, 2)).alias("constrained_cost"), F.round(gain / cost, 6).alias("efficiency"), F.round(F.when(top > 0, gain / top).otherwise(0.0), 9).alias("importance"))


@query("SELECT n AS merchants, round(0.6 + n * 100 / 45000 + n / 900, 6) AS seconds, n <= 10000 AS within FROM (VALUES (100), (1000), (10000), (50000)) v(n)")
def scale_cost_model(spark, d):
    n = F.col("merchants")
    return spark.createDataFrame([(100,), (1000,), (10000,), (50000,)], "merchants int").select("merchants", F.round(0.6 + n * 100 / 45000 + n / 900, 6).alias("seconds"), (n <= 10000).alias("within"))
