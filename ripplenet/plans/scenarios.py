"""Scenario construction and the views a snapshot is made of."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.plans.joins import ROLES, profiles
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network

AT = 40000.0

TARGETS = SQL + ROLES + """, k AS (SELECT merchant_id, coalesce(degree, 0) AS degree, coalesce(throughput_minor, 0) AS size, coalesce(payable_minor, 0) / greatest(opening_minor + credit_minor - floor_minor, 1) AS frag,
 CAST(('0x' || substr(sha256('seed-7|' || merchant_id), 9, 8)) AS BIGINT) AS u FROM merchants LEFT JOIN flow f ON f.m = merchant_id LEFT JOIN degree g ON g.m = merchant_id LEFT JOIN payable p ON p.m = merchant_id WHERE merchant_id NOT IN ('N0'))
"""


@query(TARGETS + """SELECT 'most_connected' AS strategy, merchant_id, place FROM (SELECT merchant_id, row_number() OVER (ORDER BY degree DESC, merchant_id) AS place FROM k) WHERE place <= 3
UNION ALL SELECT 'largest', merchant_id, place FROM (SELECT merchant_id, row_number() OVER (ORDER BY size DESC, merchant_id) AS place FROM k) WHERE place <= 3
UNION ALL SELECT 'most_dependent', merchant_id, place FROM (SELECT merchant_id, row_number() OVER (ORDER BY frag DESC, merchant_id) AS place FROM k) WHERE place <= 3
UNION ALL SELECT 'random', merchant_id, place FROM (SELECT merchant_id, row_number() OVER (ORDER BY u, merchant_id) AS place FROM k) WHERE place <= 3""")
def shock_targets(spark, d):
    b = F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1))
    k = profiles(Network(spark, d)).where("merchant_id <> 'N0'").select("merchant_id", "degree", F.col("throughput_minor").alias("size"), (F.col("payable_minor") / b).alias("frag"), e.uniform(F.lit("seed-7"), F.col("merchant_id")).alias("u"))
    out = None
    for name, order in (("most_connected", F.desc("degree")), ("largest", F.desc("size")), ("most_dependent", F.desc("frag")), ("random", F.col("u"))):
        top = k.orderBy(order, "merchant_id").limit(3).withColumn("place", F.row_number().over(Window.orderBy(order, "merchant_id")).cast("long"))
        part = top.select(F.lit(name).alias("strategy"), "merchant_id", "place")
        out = part if out is None else out.union(part)
    return out


@query(SQL + """, rec AS (SELECT creditor, obligation_id, amount_minor - paid_minor AS v, due_t FROM obligations WHERE amount_minor > paid_minor AND due_t >= 40000 AND due_t < 41000),
after AS (SELECT r.creditor, r.obligation_id, r.due_t, r.v, CAST(coalesce(sum(p.amount_minor) FILTER (p.t >= r.due_t AND p.t <= r.due_t + 720), 0) AS BIGINT) AS c FROM rec r LEFT JOIN supply p ON p.payer = r.creditor GROUP BY ALL)
SELECT creditor, arg_min(obligation_id, (-least(CAST(v * 0.85 AS BIGINT), c), due_t, obligation_id)) AS obligation_id, max(least(CAST(v * 0.85 AS BIGINT), c)) AS bearing_minor FROM after GROUP BY creditor""")
def load_bearing_receivable(spark, d):
    n = Network(spark, d)
    rec = n.obligations.where(e.is_open() & (F.col("due_t") >= AT) & (F.col("due_t") < AT + 1000)).select("creditor", "obligation_id", e.outstanding().alias("v"), "due_t")
    paid = n.supply.where(F.col("t").between(AT, AT + 1720)).select(F.col("payer").alias("creditor"), "t", "amount_minor")
    inside = F.when((F.col("t") >= F.col("due_t")) & (F.col("t") <= F.col("due_t") + 720), F.col("amount_minor"))
    after = rec.join(paid, "creditor", "left").groupBy("creditor", "obligation_id", "due_t", "v").agg(F.coalesce(F.sum(inside), F.lit(0)).alias("c"))
    bearing = F.least(F.round(F.col("v") * 0.85, 0).cast("long"), F.col("c"))
    return after.groupBy("creditor").agg(F.min_by("obligation_id", F.struct(-bearing, F.col("due_t"), F.col("obligation_id"))).alias("obligation_id"), F.max(bearing).alias("bearing_minor"))


@query(SQL + """, f AS (SELECT debtor AS m, min(due_t) - 1 AS pay_t FROM obligations WHERE amount_minor > paid_minor AND due_t >= 40000 GROUP BY debtor), r AS (SELECT creditor AS m, min(due_t) AS rec_t FROM obligations WHERE amount_minor > paid_minor AND due_t >= 40000 GROUP BY creditor)
SELECT merchant_id, coalesce(rec_t, pay_t, 40000) AS shock_t FROM merchants LEFT JOIN r ON r.m = merchant_id LEFT JOIN f ON f.m = merchant_id""")
def shock_time(spark, d):
    n = Network(spark, d)
    o = n.obligations.where(e.is_open() & (F.col("due_t") >= AT))
    pay = o.groupBy(F.col("debtor").alias("merchant_id")).agg((F.min("due_t") - 1).alias("pay_t"))
    rec = o.groupBy(F.col("creditor").alias("merchant_id")).agg(F.min("due_t").alias("rec_t"))
    return n.merchants.join(rec, "merchant_id", "left").join(pay, "merchant_id", "left").select("merchant_id", F.coalesce("rec_t", "pay_t", F.lit(AT)).alias("shock_t"))


@query(SQL + """, w AS (SELECT * FROM obligations WHERE amount_minor > paid_minor AND due_t >= 40000 AND due_t < 40168)
SELECT 'delayed_payment' AS family, obligation_id, due_t + 120 AS due_t, amount_minor FROM w WHERE debtor = 'N1' UNION ALL SELECT 'partial_default', obligation_id, due_t, CAST(amount_minor - amount_minor * 85 // 100 AS BIGINT) FROM w WHERE debtor = 'N2'
UNION ALL SELECT 'supplier_failure', obligation_id, due_t, 0 FROM w WHERE creditor IN ('S1', 'S2', 'S3') UNION ALL SELECT 'demand_collapse', obligation_id, due_t, amount_minor // 2 FROM w WHERE debtor IN ('N3', 'N4')""")
def scenario_families(spark, d):
    w = Network(spark, d).obligations.where(e.is_open() & (F.col("due_t") >= AT) & (F.col("due_t") < AT + 168))
    branch = lambda name, cond, due, amount: w.where(cond).select(F.lit(name).alias("family"), "obligation_id", due.alias("due_t"), amount.cast("long").alias("amount_minor"))
    due, a = F.col("due_t"), F.col("amount_minor")
    return (
        branch("delayed_payment", "debtor = 'N1'", due + 120, a)
        .union(branch("partial_default", "debtor = 'N2'", due, a - F.expr("amount_minor * 85 div 100")))
        .union(branch("supplier_failure", "creditor IN ('S1', 'S2', 'S3')", due, F.lit(0)))
        .union(branch("demand_collapse", "debtor IN ('N3', 'N4')", due, F.expr("amount_minor div 2")))
    )


@query("SELECT n_nationkey AS seed, 'sc-' || substr(sha256('net|' || n_nationkey || '|delayed_payment'), 1, 16) AS scenario_id FROM nation")
def scenario_ids(spark, d):
    return Network(spark, d).read("nation").select(F.col("n_nationkey").alias("seed"), F.concat(F.lit("sc-"), e.content_id(F.lit("net"), F.col("n_nationkey").cast("string"), F.lit("delayed_payment"))).alias("scenario_id"))


@query(SQL + "SELECT CAST(max(due_t) AS DOUBLE) AS horizon_end, CAST(sum(amount_minor - paid_minor) FILTER (due_t >= 40000) AS BIGINT) AS payables_minor FROM obligations WHERE amount_minor > paid_minor")
def horizon_payables(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    return o.agg(F.max("due_t").alias("horizon_end"), F.sum(F.when(F.col("due_t") >= AT, e.outstanding())).alias("payables_minor"))


@query(SQL + "SELECT obligation_id, amount_minor, round(amount_minor * 0.0004 * 5, 4) AS fee, CASE WHEN amount_minor > 1000000 THEN 'instalments' ELSE 'bullet' END AS terms, (amount_minor - paid_minor > 0 AND priority <= 3 AND due_t >= 40000) AS eligible FROM obligations WHERE debtor = 'N2'")
def offer_contract(spark, d):
    o = Network(spark, d).obligations.where("debtor = 'N2'")
    ok = e.is_open() & (F.col("priority") <= 3) & (F.col("due_t") >= AT)
    return o.select("obligation_id", "amount_minor", F.round(F.col("amount_minor") * e.EXTENSION_RATE * 5, 4).alias("fee"), F.when(F.col("amount_minor") > 1_000_000, "instalments").otherwise("bullet").alias("terms"), ok.alias("eligible"))


@query(SQL + ROLES + "SELECT merchant_id, coalesce(payable_minor, 0) AS payable_minor, round(CASE WHEN payable_minor > 0 THEN (opening_minor + credit_minor - floor_minor + coalesce(receivable_minor, 0)) / payable_minor END, 6) AS cover, round(coalesce(payable_minor, 0) / greatest(opening_minor + credit_minor - floor_minor, 1), 6) AS leverage FROM merchants LEFT JOIN payable p ON p.m = merchant_id LEFT JOIN receivable r ON r.m = merchant_id")
def merchant_snapshot(spark, d):
    b = e.buffer("opening_minor", "credit_minor", "floor_minor")
    return profiles(Network(spark, d)).select("merchant_id", "payable_minor", F.round(e.cover_ratio(b, "receivable_minor", "payable_minor"), 6).alias("cover"), F.round(F.col("payable_minor") / F.greatest(b, F.lit(1)), 6).alias("leverage"))


@query(SQL + "SELECT count(*) FILTER (opening_minor < 0) AS negative_balance, count(*) FILTER (floor_minor > opening_minor + credit_minor) AS floor_above_means, count(*) FILTER (sector IS NULL) AS no_sector, (SELECT count(*) FROM obligations WHERE paid_minor > amount_minor) AS overpaid, (SELECT count(*) FROM payments WHERE payer = payee) AS self_payments, (SELECT count(*) FROM edges WHERE pass_through > 1) AS excess_share FROM merchants")
def validation_checks(spark, d):
    n = Network(spark, d)
    out = n.merchants.agg(F.count_if(F.col("opening_minor") < 0).alias("negative_balance"), F.count_if(F.col("floor_minor") > F.col("opening_minor") + F.col("credit_minor")).alias("floor_above_means"), F.count_if(F.col("sector").isNull()).alias("no_sector"))
    for name, rows in (("overpaid", n.obligations.where("paid_minor > amount_minor")), ("self_payments", n.payments.where("payer = payee")), ("excess_share", n.edges.where("pass_through > 1"))):
        out = out.join(F.broadcast(rows.agg(F.count("*").alias(name))))  # one row each
    return out


@query(SQL + ", a AS (SELECT source, CAST(sum(total_minor) AS BIGINT) AS allocated FROM edges GROUP BY source), t AS (SELECT payer, CAST(sum(amount_minor) AS BIGINT) AS through FROM inner_payments GROUP BY payer) SELECT source, allocated, through, allocated <= through AS consistent, round(n / 20, 3) AS power FROM a JOIN t ON payer = source JOIN (SELECT source AS s, sum(n) AS n FROM edges GROUP BY 1) ON s = source")
def flow_consistency(spark, d):
    n = Network(spark, d)
    a = n.edges.groupBy("source").agg(F.sum("total_minor").alias("allocated"), F.sum("n").alias("n"))
    t = n.inner.groupBy(F.col("payer").alias("source")).agg(F.sum("amount_minor").alias("through"))
    return a.join(t, "source").select("source", "allocated", "through", (F.col("allocated") <= F.col("through")).alias("consistent"), F.round(F.col("n") / 20, 3).alias("power"))
