"""Aggregates over payments, obligations and merchants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import edges as ed
from ripplenet.operators import relational as r
from ripplenet.plans.joins import ROLES, profiles, roles
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network

GAPS = """, gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY payer, payee ORDER BY t, amount_minor) AS gap FROM trade),
feat AS (SELECT payer, payee, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor, avg(amount_minor) AS mean_amount, stddev_samp(amount_minor) AS sd, min(t) AS first_t, max(t) AS last_t,
  median(gap) AS median_gap, avg(gap) AS mean_gap, stddev_samp(gap) AS sd_gap, count(gap) AS n_gaps FROM gaps GROUP BY payer, payee)
"""
RECURRENCE = "CASE WHEN median_gap IS NULL THEN 'one_off' WHEN abs(median_gap-24) <= 0.3*24 THEN 'daily' WHEN abs(median_gap-168) <= 0.3*168 THEN 'weekly' WHEN abs(median_gap-336) <= 0.3*336 THEN 'biweekly' WHEN abs(median_gap-720) <= 0.3*720 THEN 'monthly' WHEN abs(median_gap-2184) <= 0.3*2184 THEN 'quarterly' ELSE 'irregular' END"
REGULARITY = "CASE WHEN n_gaps < 2 OR mean_gap <= 0 THEN 0 ELSE greatest(least(1 - sd_gap/mean_gap, 1), 0) END"


@query(SQL + GAPS + f"SELECT payer, payee, n, total_minor, round(mean_amount, 4) AS mean_amount, round(coalesce(sd, 0), 4) AS std_amount, first_t, last_t, round(median_gap, 6) AS median_gap, {RECURRENCE} AS recurrence, round({REGULARITY}, 6) AS regularity FROM feat")
def edge_features(spark, d):
    return ed.edge_features(Network(spark, d).trade).select(
        "payer", "payee", "n", "total_minor", F.round("mean_amount", 4).alias("mean_amount"), F.round("std_amount", 4).alias("std_amount"), "first_t", "last_t", F.round("median_gap", 6).alias("median_gap"), "recurrence", F.round("regularity", 6).alias("regularity")
    )


@query(SQL + """SELECT (SELECT count(*) FROM merchants) AS n_merchants, (SELECT count(*) FROM payments) AS n_events, (SELECT count(*) FROM obligations) AS n_obligations, (SELECT count(*) FROM edges) AS n_edges,
 (SELECT count(*) FROM pairs) AS n_pairs, (SELECT min(t) FROM payments) AS first_t, (SELECT max(t) FROM payments) AS last_t, (SELECT CAST(sum(amount_minor) AS BIGINT) FROM payments) AS total_minor""")
def graph_stats(spark, d):
    n = Network(spark, d)
    out = n.payments.agg(F.count("*").alias("n_events"), F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.sum("amount_minor").alias("total_minor"))
    for name, df in (("n_merchants", n.merchants), ("n_obligations", n.obligations), ("n_edges", n.edges), ("n_pairs", n.pairs)):
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))  # one row each
    return out


@query(SQL + "SELECT DISTINCT payer, payee FROM payments")
def distinct_pairs(spark, d):
    return Network(spark, d).payments.select("payer", "payee").distinct()


@query(SQL + "SELECT payer, CAST(coalesce(sum(total_minor) FILTER (payee = 'B11'), 0) AS BIGINT) AS \"B11\", CAST(coalesce(sum(total_minor) FILTER (payee = 'B22'), 0) AS BIGINT) AS \"B22\", CAST(coalesce(sum(total_minor) FILTER (payee = 'B33'), 0) AS BIGINT) AS \"B33\" FROM pairs WHERE payer LIKE 'S%' GROUP BY payer")
def value_flow_matrix(spark, d):
    return r.value_matrix(Network(spark, d).pairs.where("payer LIKE 'S%'"), "payer", "payee", "total_minor", ["B11", "B22", "B33"])


@query(SQL + GAPS + f""", res AS (SELECT debtor AS payer, creditor AS payee, count(*) FILTER (settled_t <= due_t) AS on_time, count(*) FILTER (status = 'settled' OR due_t < 50000) AS resolved FROM obligations GROUP BY ALL)
SELECT payer, payee, round(CASE WHEN resolved > 0 THEN (on_time + 1) / (resolved + 2) WHEN n_gaps >= 2 THEN 0.55 + 0.40 * ({REGULARITY}) ELSE 0.75 END, 6) AS reliability,
 CASE WHEN resolved > 0 THEN 'outcomes' WHEN n_gaps >= 2 THEN 'regularity' ELSE 'prior' END AS basis FROM feat LEFT JOIN res USING (payer, payee)""")
def edge_reliability(spark, d):
    n = Network(spark, d)
    return ed.reliability(ed.edge_features(n.trade), n.obligations, 50000.0)


@query(SQL + ROLES + "SELECT m AS merchant_id, throughput_minor, n_events FROM flow")
def throughput(spark, d):
    return roles(Network(spark, d))[2]


@query(SQL + ROLES + """SELECT merchant_id, coalesce(throughput_minor,0) AS throughput_minor, coalesce(degree,0) AS degree, greatest(coalesce(payable_minor,0) - opening_minor - credit_minor + floor_minor, 0) AS cash_deficit
FROM merchants LEFT JOIN flow f ON f.m = merchant_id LEFT JOIN degree g ON g.m = merchant_id LEFT JOIN payable p ON p.m = merchant_id""")
def cheap_baselines(spark, d):
    p = profiles(Network(spark, d))
    gap = F.greatest(F.col("payable_minor") - e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(0))
    return p.select("merchant_id", "throughput_minor", "degree", gap.alias("cash_deficit"))


@query(SQL + "SELECT debtor, creditor, CAST(sum(greatest(amount_minor-paid_minor,0)) AS BIGINT) AS live_minor, min(due_t) AS earliest_due FROM obligations WHERE amount_minor > paid_minor AND due_t <= 45000 GROUP BY ALL")
def live_commitments(spark, d):
    o = Network(spark, d).obligations.where(e.is_open() & (F.col("due_t") <= 45000))
    return o.groupBy("debtor", "creditor").agg(F.sum(e.outstanding()).alias("live_minor"), F.min("due_t").alias("earliest_due"))


@query(SQL + "SELECT coalesce(sector, '*') AS sector, coalesce(tier, '*') AS tier, count(*) AS n, CAST(sum(opening_minor) AS BIGINT) AS opening_minor, grouping_id(sector, tier) AS level FROM merchants GROUP BY GROUPING SETS ((sector), (tier), ())")
def network_overview(spark, d):
    m = Network(spark, d).merchants
    cube = m.cube("sector", "tier").agg(F.count("*").alias("n"), F.sum("opening_minor").alias("opening_minor"), F.grouping_id().cast("long").alias("level")).where("level > 0")
    return cube.select(F.coalesce("sector", F.lit("*")).alias("sector"), F.coalesce("tier", F.lit("*")).alias("tier"), "n", "opening_minor", "level")


@query(SQL + "SELECT round(least(sum(greatest(amount_minor-paid_minor,0)) FILTER (debtor IN ('N1','N2','N3')) / sum(greatest(amount_minor-paid_minor,0)), 1), 9) AS exposure FROM obligations")
def systemic_exposure(spark, d):
    held = F.sum(F.when(F.col("debtor").isin("N1", "N2", "N3"), e.outstanding()))
    return Network(spark, d).obligations.agg(F.round(F.least(held / F.sum(e.outstanding()), F.lit(1.0)), 9).alias("exposure"))


@query(SQL + ROLES + """, k AS (SELECT *, opening_minor + credit_minor - floor_minor AS buffer FROM merchants JOIN payable ON m = merchant_id)
SELECT count(*) FILTER (payable_minor > buffer) AS n_vulnerable, round(count(*) FILTER (payable_minor > buffer) / count(*), 9) AS share, CAST(sum(payable_minor) FILTER (payable_minor > buffer) AS BIGINT) AS exposed_minor, CAST(sum(opening_minor) AS BIGINT) AS capital_minor FROM k""")
def dashboard_kpis(spark, d):
    p = profiles(Network(spark, d)).where("payable_minor > 0")
    weak = F.col("payable_minor") > e.buffer("opening_minor", "credit_minor", "floor_minor")
    return p.agg(F.count_if(weak).alias("n_vulnerable"), F.round(F.count_if(weak) / F.count("*"), 9).alias("share"), F.sum(F.when(weak, F.col("payable_minor"))).alias("exposed_minor"), F.sum("opening_minor").alias("capital_minor"))


@query("SELECT CAST(sum(CAST(round_even(value * 100, 0) AS BIGINT)) AS BIGINT) AS raw_minor, count(*) AS n, count(DISTINCT event_id) AS n_distinct, count(*) FILTER (value <= 0) AS n_rejected FROM events")
def value_reconciliation(spark, d):
    v = Network(spark, d).read("events")
    return v.agg(F.sum(e.to_minor("value")).alias("raw_minor"), F.count("*").alias("n"), F.countDistinct("event_id").alias("n_distinct"), F.count_if(F.col("value") <= 0).alias("n_rejected"))


@query(SQL + """, o AS (SELECT debtor, sum(CASE WHEN settled_t > due_t THEN (settled_t - due_t) / 24 * amount_minor ELSE 0 END) AS delay, count(*) FILTER (amount_minor > paid_minor AND due_t < 50000) AS defaults, CAST(sum(greatest(amount_minor-paid_minor,0)) AS BIGINT) AS deficit FROM obligations GROUP BY debtor)
SELECT round(sum(weight * delay) / 1e9, 6) AS delay_part, CAST(sum(weight * defaults * 500000) AS BIGINT) AS default_part, round(sum(weight * 0.02 * deficit) / 1e9, 6) AS deficit_part FROM o JOIN merchants ON merchant_id = debtor""")
def disruption_objective(spark, d):
    n = Network(spark, d)
    delay = F.sum(e.lateness(F.coalesce(F.col("settled_t") - F.col("due_t"), F.lit(0.0))) * F.col("amount_minor"))
    o = n.obligations.groupBy(F.col("debtor").alias("merchant_id")).agg(delay.alias("delay"), F.count_if(e.is_overdue(50000.0)).alias("defaults"), F.sum(e.outstanding()).alias("deficit"))
    j = o.join(n.merchants, "merchant_id")
    return j.agg(F.round(F.sum(F.col("weight") * F.col("delay")) / 1e9, 6).alias("delay_part"), F.sum(F.col("weight") * F.col("defaults") * 500000).cast("long").alias("default_part"), F.round(F.sum(F.col("weight") * 0.02 * F.col("deficit")) / 1e9, 6).alias("deficit_part"))


@query(SQL + """, o AS (SELECT payer AS m, total_minor / sum(total_minor) OVER (PARTITION BY payer) AS s FROM pairs), i AS (SELECT payee AS m, total_minor / sum(total_minor) OVER (PARTITION BY payee) AS s FROM pairs)
SELECT m AS merchant_id, 'out' AS side, round(sum(s*s), 9) AS hhi FROM o GROUP BY m UNION ALL SELECT m, 'in', round(sum(s*s), 9) FROM i GROUP BY m""")
def concentration(spark, d):
    p = Network(spark, d).pairs
    part = None
    for side, key in (("out", "payer"), ("in", "payee")):
        g = p.groupBy(F.col(key).alias("merchant_id")).agg(F.sum(F.col("total_minor").cast("decimal(38,0)") * F.col("total_minor")).cast("double").alias("sq"), F.sum("total_minor").alias("all"))
        g = g.select("merchant_id", F.lit(side).alias("side"), F.round(F.col("sq") / F.col("all") / F.col("all"), 9).alias("hhi"))
        part = g if part is None else part.union(g)
    return part


@query(SQL + ROLES + """, x AS (SELECT throughput_minor AS v, row_number() OVER (ORDER BY throughput_minor, m) AS i, count(*) OVER () AS n FROM flow)
SELECT round(2 * sum(CAST(i AS DOUBLE) * v) / (max(n) * sum(v)) - (max(n) + 1) / max(n), 9) AS gini FROM x""")
def gini(spark, d):
    x = roles(Network(spark, d))[2].select(F.col("throughput_minor").alias("v"), "merchant_id")
    x = r.placed(x, [F.col("v"), F.col("merchant_id")], "i")
    g = x.agg(F.sum(F.col("i") * F.col("v").cast("decimal(30,0)")).cast("double").alias("w"), F.sum(F.col("v").cast("decimal(30,0)")).cast("double").alias("s"), F.count("*").alias("n"))
    return g.select(F.round(2 * F.col("w") / (F.col("n") * F.col("s")) - (F.col("n") + 1) / F.col("n"), 9).alias("gini"))


@query(SQL + """, x AS (SELECT ln(amount_minor) AS l, row_number() OVER (ORDER BY amount_minor DESC, event_id) AS i, count(*) OVER () AS n FROM exogenous)
SELECT round(1 / avg(l - (SELECT l FROM x WHERE i = greatest(10, n // 10) + 1)), 6) AS hill, count(*) AS k FROM x WHERE i <= greatest(10, n // 10)""")
def hill_tail_index(spark, d):
    return ed.hill_index(Network(spark, d).exogenous, "amount_minor", 0.1, 10)


@query(SQL + "SELECT layer, count(*) AS n, round(avg(amount_minor), 4) AS mean, round(stddev_pop(amount_minor), 3) AS std, min(amount_minor) AS low, quantile_cont(amount_minor, 0.5) AS p50, round(quantile_cont(amount_minor, 0.95), 4) AS p95, round(quantile_cont(amount_minor, 0.99), 4) AS p99, max(amount_minor) AS high, round(max(amount_minor) / quantile_cont(amount_minor, 0.5), 6) AS ratio FROM payments GROUP BY layer")
def describe_amounts(spark, d):
    """Quantiles from counts per distinct amount: no buffer holds a layer's amounts."""
    per = Network(spark, d).payments.groupBy("layer", F.col("amount_minor").alias("v")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("layer")
    per = per.withColumns({"upto": F.sum("n").over(w.orderBy("v")), "all": F.sum("n").over(w)})
    nth = lambda at: F.min(F.when(F.col("upto") > at, F.col("v")))

    def p(q):
        place = (F.col("all") - 1) * F.lit(q)
        part = F.max(place - F.floor(place))
        low, high = nth(F.floor(place)), nth(F.ceil(place))
        return low + (high - low) * part

    v, n = F.col("v").cast("double"), F.col("n")
    mean = F.sum(v * n) / F.sum("n")
    totals = per.groupBy("layer").agg(
        F.sum("n").alias("n"), mean.alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"), p(0.5).alias("p50"), F.round(p(0.95), 4).alias("p95"), F.round(p(0.99), 4).alias("p99"),
    )
    spread = per.join(F.broadcast(totals.select("layer", "mean")), "layer").groupBy("layer").agg(F.sqrt(F.sum(n * (v - F.col("mean")) * (v - F.col("mean"))) / F.sum("n")).alias("std"))  # one row a layer
    return totals.join(F.broadcast(spread), "layer").select(
        "layer", "n", F.round("mean", 4).alias("mean"), F.round("std", 3).alias("std"), "low", "p50", "p95", "p99", "high", F.round(F.col("high") / F.col("p50"), 6).alias("ratio")
    )


@query(SQL + ", w AS (SELECT CAST(floor((t % 168) / 24) AS BIGINT) AS day, CAST(sum(amount_minor) AS BIGINT) AS v FROM exogenous GROUP BY 1) SELECT round(stddev_pop(v) / avg(v), 9) AS cv, count(*) AS n_days FROM w")
def seasonality_cv(spark, d):
    w = Network(spark, d).exogenous.groupBy(F.floor(F.pmod("t", F.lit(168.0)) / 24).alias("day")).agg(F.sum("amount_minor").alias("v"))
    return w.agg(F.round(F.stddev_pop("v") / F.avg("v"), 9).alias("cv"), F.count("*").alias("n_days"))


@query(SQL + "SELECT CAST(sum(amount_minor) AS BIGINT) AS obligated_minor, CAST(sum(CASE WHEN status = 'cancelled' THEN 0 WHEN status = 'settled' THEN amount_minor ELSE paid_minor END) AS BIGINT) AS accounted_minor, CAST(sum(amount_minor - paid_minor) AS BIGINT) AS residual_minor FROM obligations")
def conserved_principal(spark, d):
    done = F.when(F.col("status") == "cancelled", 0).when(F.col("status") == "settled", F.col("amount_minor")).otherwise(F.col("paid_minor"))
    return Network(spark, d).obligations.agg(F.sum("amount_minor").alias("obligated_minor"), F.sum(done).alias("accounted_minor"), F.sum(F.col("amount_minor") - F.col("paid_minor")).alias("residual_minor"))


@query("SELECT l_returnflag || l_linestatus AS strategy, count(*) AS n, round(avg(l_discount), 6) AS mean_reduction, median(l_discount) AS median_reduction, round(sum(l_discount * l_extendedprice) / sum(l_extendedprice), 6) AS efficiency, count(*) FILTER (l_quantity > 45) AS infeasible FROM lineitem GROUP BY 1")
def strategy_leaderboard(spark, d):
    x = Network(spark, d).read("lineitem")
    return x.groupBy(F.concat("l_returnflag", "l_linestatus").alias("strategy")).agg(
        F.count("*").alias("n"), F.round(F.avg("l_discount"), 6).alias("mean_reduction"), F.median("l_discount").alias("median_reduction"),
        F.round(F.sum(F.col("l_discount") * F.col("l_extendedprice")) / F.sum("l_extendedprice"), 6).alias("efficiency"), F.count_if(F.col("l_quantity") > 45).alias("infeasible"),
    )


@query(SQL + ROLES + "SELECT merchant_id, round(payable_minor / greatest(opening_minor + credit_minor - floor_minor, 1), 6) AS fragility, opening_minor + credit_minor - floor_minor + coalesce(receivable_minor, 0) - payable_minor AS slack FROM merchants JOIN payable p ON p.m = merchant_id LEFT JOIN receivable r ON r.m = merchant_id")
def fragility_and_slack(spark, d):
    p = profiles(Network(spark, d)).where("payable_minor > 0 OR level = 0")
    b = e.buffer("opening_minor", "credit_minor", "floor_minor")
    return p.select("merchant_id", F.round(F.col("payable_minor") / F.greatest(b, F.lit(1)), 6).alias("fragility"), (b + F.col("receivable_minor") - F.col("payable_minor")).alias("slack"))


@query(SQL + "SELECT debtor, CAST(sum(amount_minor - paid_minor) AS BIGINT) AS committed_minor, count(*) AS n FROM obligations WHERE due_t >= 30000 AND due_t <= 30720 AND amount_minor > paid_minor GROUP BY debtor")
def commitments_in_window(spark, d):
    o = Network(spark, d).obligations.where(F.col("due_t").between(30000, 30720) & e.is_open())
    return o.groupBy("debtor").agg(F.sum(e.outstanding()).alias("committed_minor"), F.count("*").alias("n"))


@query(SQL + "SELECT source, round(avg(pass_through), 9) AS mean_pass_through, round(max(pass_through) / median(pass_through), 6) AS top_to_median FROM edges GROUP BY source")
def mean_pass_through(spark, d):
    g = Network(spark, d).edges.groupBy("source")
    return g.agg(F.round(F.avg("pass_through"), 9).alias("mean_pass_through"), F.round(F.max("pass_through") / F.median("pass_through"), 6).alias("top_to_median"))


WILSON = "round(({p} + 3.8416/(2*n) {s} 1.96*sqrt(({p}*(1-{p}) + 3.8416/(4*n))/n)) / (1 + 3.8416/n), 9)"


@query("SELECT event_type, n, k, " + WILSON.format(p="(k/n)", s="-") + " AS low, " + WILSON.format(p="(k/n)", s="+") + " AS high FROM (SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS k FROM events GROUP BY 1)")
def wilson_interval(spark, d):
    v = Network(spark, d).read("events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("value") > 50).alias("k"))
    p, n = F.col("k") / F.col("n"), F.col("n")
    half = 1.96 * F.sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)
    ends = [F.round((p + 3.8416 / (2 * n) + s * half) / (1 + 3.8416 / n), 9) for s in (-1, 1)]
    return v.select("event_type", "n", "k", ends[0].alias("low"), ends[1].alias("high"))


@query("SELECT user_id, min(value) AS low, max(value) AS high, count(DISTINCT event_type) AS depth, round(max(value) - min(value), 6) AS span FROM events GROUP BY user_id")
def pulls_range(spark, d):
    v = Network(spark, d).read("events").groupBy("user_id")
    return v.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.countDistinct("event_type").alias("depth"), F.round(F.max("value") - F.min("value"), 6).alias("span"))


@query(SQL + ROLES + "SELECT count(*) FILTER (sector = s2) AS same_sector, count(*) AS n, round(count(*) FILTER (sector = s2) / count(*), 9) AS share, count(DISTINCT source) AS n_sources, max(deg) AS top_degree FROM edges JOIN merchants ON merchant_id = source JOIN (SELECT merchant_id AS m2, sector AS s2 FROM merchants) ON m2 = target JOIN (SELECT m AS m3, degree AS deg FROM degree) ON m3 = source")
def structure_diagnostics(spark, d):
    n = Network(spark, d)
    a = n.merchants.select(F.col("merchant_id").alias("source"), F.col("sector").alias("s1"))
    b = n.merchants.select(F.col("merchant_id").alias("target"), F.col("sector").alias("s2"))
    g = n.edges.join(a, "source").join(b, "target").join(roles(n)[3].withColumnRenamed("merchant_id", "source"), "source")
    same = F.count_if(F.col("s1") == F.col("s2"))
    return g.agg(same.alias("same_sector"), F.count("*").alias("n"), F.round(same / F.count("*"), 9).alias("share"), F.countDistinct("source").alias("n_sources"), F.max("degree").alias("top_degree"))
