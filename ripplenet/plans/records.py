"""Smaller records and checks: severity, mutations, outcomes, plan summaries, grids."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.plans.joins import ROLES, profiles
from ripplenet.operators.relational import placed
from ripplenet.plans.registry import query
from ripplenet.sources.datasets import differing_fields
from ripplenet.sources.network import SQL, Network

# Replay records for strategies: orders stand for runs, their priority for the strategy, their customer for the scenario.
RUNS = "WITH run AS (SELECT o_custkey % 50 AS scenario, substr(o_orderpriority, 1, 1) AS strategy, avg(o_totalprice) AS disruption, count(*) AS n, max(o_orderkey) AS seed FROM orders GROUP BY ALL)\n"


def runs(spark, d):
    o = Network(spark, d).read("orders")
    return o.groupBy((F.col("o_custkey") % 50).alias("scenario"), F.substring("o_orderpriority", 1, 1).alias("strategy")).agg(F.avg("o_totalprice").alias("disruption"), F.count("*").alias("n"), F.max("o_orderkey").alias("seed"))


@query(SQL + "SELECT DISTINCT debtor AS merchant_id FROM obligations WHERE settled_t > due_t + 30000")
def baseline_affected(spark, d):
    return Network(spark, d).obligations.where(F.col("settled_t") > F.col("due_t") + 30000).select(F.col("debtor").alias("merchant_id")).distinct()


@query("SELECT family, CASE family WHEN 'delayed_payment' THEN 1.0 WHEN 'partial_default' THEN 0.85 WHEN 'demand_collapse' THEN 0.5 ELSE 1.0 END AS lost, CASE family WHEN 'delayed_payment' THEN 120.0 ELSE 168.0 END AS window_hours FROM (VALUES ('delayed_payment'), ('partial_default'), ('demand_collapse'), ('supplier_failure')) v(family)")
def severity_profile(spark, d):
    f = spark.createDataFrame([(x,) for x in ("delayed_payment", "partial_default", "demand_collapse", "supplier_failure")], "family string")
    lost = F.when(F.col("family") == "partial_default", 0.85).when(F.col("family") == "demand_collapse", 0.5).otherwise(1.0)
    return f.select("family", lost.alias("lost"), F.when(F.col("family") == "delayed_payment", 120.0).otherwise(168.0).alias("window_hours"))


@query(SQL + ", m AS (SELECT obligation_id, due_t AS before, due_t + 120 AS after FROM obligations WHERE amount_minor > paid_minor AND due_t >= 40000) SELECT obligation_id, 'due_t' AS field, before, after, after - before AS moved FROM m")
def mutation_log(spark, d):
    o = Network(spark, d).obligations.where(e.is_open() & (F.col("due_t") >= 40000))
    log = o.select("obligation_id", F.create_map(F.lit("due_t"), F.col("due_t")).alias("b"), F.create_map(F.lit("due_t"), F.col("due_t") + 120).alias("a"))
    flat = log.select("obligation_id", "a", F.explode("b").alias("field", "before")).withColumn("after", F.element_at("a", F.col("field")))
    return flat.select("obligation_id", "field", "before", "after", (F.col("after") - F.col("before")).alias("moved"))


@query(SQL + "SELECT merchant_id, sector, tier, level FROM merchants")
def observable_view(spark, d):
    return Network(spark, d).merchants.drop("opening_minor", "floor_minor", "credit_minor", "weight")


@query(SQL + ROLES + "SELECT merchant_id, round(greatest(coalesce(receivable_minor, 0) / 1e6, coalesce(payable_minor, 0) / greatest(opening_minor + credit_minor - floor_minor, 1)) - 0.5 * (opening_minor / 1e6), 6) AS bound FROM merchants LEFT JOIN payable p ON p.m = merchant_id LEFT JOIN receivable r ON r.m = merchant_id")
def net_benefit_bound(spark, d):
    leverage = F.col("payable_minor") / F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1))
    bound = F.greatest(F.col("receivable_minor") / 1e6, leverage) - 0.5 * (F.col("opening_minor") / 1e6)
    return profiles(Network(spark, d)).select("merchant_id", F.round(bound, 6).alias("bound"))


@query(RUNS + "SELECT a.scenario, a.strategy, round(b.disruption - a.disruption, 4) AS prevented, round((b.disruption - a.disruption) / b.disruption, 9) AS share, round((b.disruption - a.disruption) / a.n, 6) AS efficiency FROM run a JOIN run b ON a.scenario = b.scenario AND b.strategy = '5' WHERE a.strategy <> '5'")
def strategy_outcomes(spark, d):
    r = runs(spark, d)
    ref = r.where("strategy = '5'").select("scenario", F.col("disruption").alias("ref"))
    saved = F.col("ref") - F.col("disruption")
    return r.where("strategy <> '5'").join(ref, "scenario").select("scenario", "strategy", F.round(saved, 4).alias("prevented"), F.round(saved / F.col("ref"), 9).alias("share"), F.round(saved / F.col("n"), 6).alias("efficiency"))


@query(RUNS + "SELECT strategy, count(*) AS n, round(avg(disruption), 4) AS mean, round(median(disruption), 4) AS median, row_number() OVER (ORDER BY round(avg(disruption), 4), strategy) AS place FROM run GROUP BY strategy")
def strategy_summary(spark, d):
    s = runs(spark, d).groupBy("strategy").agg(F.count("*").alias("n"), F.round(F.avg("disruption"), 4).alias("mean"), F.round(F.median("disruption"), 4).alias("median"))
    return s.withColumn("place", F.row_number().over(Window.orderBy("mean", "strategy")).cast("long"))  # five rows


@query(RUNS + "SELECT a.scenario, a.strategy, round(a.disruption - b.disruption, 4) AS worsened FROM run a JOIN run b ON a.scenario = b.scenario AND b.strategy = '5' WHERE a.disruption > b.disruption + 1000")
def realised_floor_report(spark, d):
    r = runs(spark, d)
    ref = r.where("strategy = '5'").select("scenario", F.col("disruption").alias("ref"))
    return r.join(ref, "scenario").where(F.col("disruption") > F.col("ref") + 1000).select("scenario", "strategy", F.round(F.col("disruption") - F.col("ref"), 4).alias("worsened"))


@query(RUNS + ", s AS (SELECT strategy, avg(disruption) FILTER (scenario = 0) AS nominal, avg(disruption) + 0.5 * stddev_pop(disruption) AS robust FROM run GROUP BY strategy) SELECT arg_min(strategy, (nominal, strategy)) AS nominal_best, arg_min(strategy, (robust, strategy)) AS robust_best, arg_min(strategy, (nominal, strategy)) <> arg_min(strategy, (robust, strategy)) AS differs FROM s")
def robust_flags(spark, d):
    s = runs(spark, d).groupBy("strategy").agg(F.avg(F.when(F.col("scenario") == 0, F.col("disruption"))).alias("nominal"), (F.avg("disruption") + 0.5 * F.stddev_pop("disruption")).alias("robust"))
    best = s.agg(F.min_by("strategy", F.struct("nominal", "strategy")).alias("nominal_best"), F.min_by("strategy", F.struct("robust", "strategy")).alias("robust_best"))
    return best.withColumn("differs", F.col("nominal_best") != F.col("robust_best"))


@query("SELECT o_custkey AS plan, count(*) AS n_actions, round(sum(o_totalprice), 2) AS cost, count(DISTINCT o_orderpriority) AS n_merchants, sum(o_totalprice) <= 2000000 AND count(*) <= 12 AND count(*) - count(DISTINCT o_orderpriority) <= 8 AS feasible FROM orders GROUP BY o_custkey")
def search_feasibility(spark, d):
    o = Network(spark, d).read("orders").groupBy(F.col("o_custkey").alias("plan")).agg(F.count("*").alias("n_actions"), F.sum("o_totalprice").alias("sum"), F.countDistinct("o_orderpriority").alias("n_merchants"))
    ok = (F.col("sum") <= 2_000_000) & (F.col("n_actions") <= 12) & (F.col("n_actions") - F.col("n_merchants") <= 8)
    return o.select("plan", "n_actions", F.round("sum", 2).alias("cost"), "n_merchants", ok.alias("feasible"))


@query("SELECT o_orderkey AS plan, round(o_totalprice, 2) AS promised, round(v, 2) AS replayed, abs(o_totalprice - v) <= 1e-9 * o_totalprice AS complete FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS v FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def plan_completeness(spark, d):
    n = Network(spark, d)
    v = n.read("lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.sum("l_extendedprice").alias("v"))
    j = n.read("orders").select(F.col("o_orderkey").alias("plan"), "o_totalprice").join(v, "plan")
    return j.select("plan", F.round("o_totalprice", 2).alias("promised"), F.round("v", 2).alias("replayed"), (F.abs(F.col("o_totalprice") - F.col("v")) <= 1e-9 * F.col("o_totalprice")).alias("complete"))


@query("WITH s AS (SELECT user_id AS rule, string_agg(event_type, '>' ORDER BY ts) AS picks FROM events GROUP BY user_id) SELECT picks, min(rule) AS rule, count(*) AS n FROM s GROUP BY picks")
def rule_signatures(spark, d):
    v = Network(spark, d).read("events")
    picks = F.concat_ws(">", F.transform(F.array_sort(F.collect_list(F.struct("ts", "event_type"))), lambda x: x.event_type))
    s = v.groupBy(F.col("user_id").alias("rule")).agg(picks.alias("picks"))
    return s.groupBy("picks").agg(F.min("rule").alias("rule"), F.count("*").alias("n"))


@query("SELECT user_id AS rule, count(*) FILTER (value / 100 > 0.5 + 0.05) AS wins, count(*) AS n, count(*) FILTER (value / 100 > 0.5 + 0.05) > count(*) / 2 AS better FROM events GROUP BY user_id")
def held_out_rule_test(spark, d):
    win = F.count_if(F.col("value") / 100 > 0.5 + 0.05)
    return Network(spark, d).read("events").groupBy(F.col("user_id").alias("rule")).agg(win.alias("wins"), F.count("*").alias("n"), (win > F.count("*") / 2).alias("better"))


@query("SELECT user_id AS dataset, epoch_us(min(ts)) AS origin_us, row_number() OVER (ORDER BY min(ts), user_id) AS place FROM events GROUP BY user_id")
def dataset_epoch_order(spark, d):
    s = Network(spark, d).read("events").groupBy(F.col("user_id").alias("dataset")).agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("origin_us"))
    return placed(s, [F.col("origin_us"), F.col("dataset")])


@query("SELECT event_id, substr(sha256(event_id || '|' || user_id || '|' || event_type), 1, 12) AS stable_id FROM events")
def stable_event_id(spark, d):
    v = Network(spark, d).read("events")
    return v.select("event_id", e.content_id(F.col("event_id").cast("string"), F.col("user_id").cast("string"), "event_type", length=12).alias("stable_id"))


@query("SELECT h AS hours, h = 100.0 AS full_window FROM (VALUES (6.0), (24.0), (48.0), (72.0), (100.0)) v(h)".replace("(VALUES (6.0)", "(VALUES (6.0::DOUBLE)"))
def horizon_grid(spark, d):
    grid = F.array_distinct(F.concat(F.filter(F.array(*map(F.lit, (6.0, 24.0, 48.0, 72.0, 168.0))), lambda x: x < 100.0), F.array(F.lit(100.0))))
    return spark.range(1).select(F.explode(grid).alias("hours")).withColumn("full_window", F.col("hours") == 100.0)


@query(RUNS + "SELECT a.scenario, a.strategy AS arm, round(100 * (b.disruption - a.disruption) / b.disruption, 6) AS cut_percent, round(greatest(b.disruption - a.disruption, 0), 4) AS kept_value, b.n - a.n AS defaults_avoided FROM run a JOIN run b ON a.scenario = b.scenario AND b.strategy = '1' WHERE a.strategy IN ('2', '3')")
def plan_arm_metrics(spark, d):
    r = runs(spark, d)
    ref = r.where("strategy = '1'").select("scenario", F.col("disruption").alias("ref"), F.col("n").alias("m"))
    saved = F.col("ref") - F.col("disruption")
    return r.where("strategy IN ('2', '3')").join(ref, "scenario").select("scenario", F.col("strategy").alias("arm"), F.round(100 * saved / F.col("ref"), 6).alias("cut_percent"), F.round(F.greatest(saved, F.lit(0.0)), 4).alias("kept_value"), (F.col("m") - F.col("n")).alias("defaults_avoided"))


@query("SELECT c_custkey, field FROM (SELECT c_custkey, 'c_nationkey' AS field FROM customer WHERE c_custkey % 5 = 0 AND c_nationkey <> (c_nationkey + c_custkey) % 25 UNION ALL SELECT c_custkey, 'c_mktsegment' FROM customer WHERE c_custkey % 7 = 0 AND c_mktsegment <> 'BUILDING')")
def snapshot_equality(spark, d):
    a = Network(spark, d).read("customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    moved = F.when(F.col("c_custkey") % 5 == 0, (F.col("c_nationkey") + F.col("c_custkey")) % 25).otherwise(F.col("c_nationkey")).cast("int")
    b = a.select("c_custkey", moved.alias("c_nationkey"), F.when(F.col("c_custkey") % 7 == 0, "BUILDING").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return differing_fields(a, b, "c_custkey")


@query(SQL + ", t AS (SELECT unnest([20000, 30000, 40000]) AS cut), s AS (SELECT cut, payer, payee, CAST(sum(amount_minor) AS BIGINT) AS v FROM trade, t WHERE trade.t < cut GROUP BY ALL), w AS (SELECT cut, payer, payee, v / sum(v) OVER (PARTITION BY cut, payer) AS share FROM s), f AS (SELECT payer, payee, total_minor / sum(total_minor) OVER (PARTITION BY payer) AS true_share FROM pairs WHERE payer LIKE 'N%') SELECT round(avg(m), 9) AS mean_mae, count(*) AS n_windows FROM (SELECT cut, avg(abs(share - true_share)) AS m FROM w JOIN f USING (payer, payee) GROUP BY cut)")
def pooled_recovery(spark, d):
    n = Network(spark, d)
    cuts = n.trade.select("payer", "payee", "amount_minor", F.explode(F.filter(F.array(*map(F.lit, (20000, 30000, 40000))), lambda c: c > F.col("t"))).alias("cut"))
    s = cuts.groupBy("cut", "payer", "payee").agg(F.sum("amount_minor").alias("v"))
    w = s.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("cut", "payer")))
    f = n.pairs.where("payer LIKE 'N%'").select("payer", "payee", (F.col("total_minor") / F.sum("total_minor").over(Window.partitionBy("payer"))).alias("true_share"))
    m = w.join(f, ["payer", "payee"]).groupBy("cut").agg(F.avg(F.abs(F.col("share") - F.col("true_share"))).alias("m"))
    return m.agg(F.round(F.avg("m"), 9).alias("mean_mae"), F.count("*").alias("n_windows"))
