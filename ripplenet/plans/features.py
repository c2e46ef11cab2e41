"""Feature tables: per merchant, per interval, per pair."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import edges as ed
from ripplenet.operators import graph as g
from ripplenet.operators import relational as r
from ripplenet.plans.graphs import R, STEP, power_sql
from ripplenet.plans.joins import LAGS, response_lags
from ripplenet.plans.registry import query
from ripplenet.sources.network import SECTORS, SQL, TIERS, Network

ORIGIN, HORIZON, K = 40000.0, 168.0, 8

NODE = """, o AS (SELECT *, amount_minor - paid_minor AS left_minor FROM obligations WHERE issued_t < 40000 AND amount_minor > paid_minor),
pay AS (SELECT debtor AS m, sum(left_minor) AS v, count(*) AS n, sum(left_minor) FILTER (due_t < 40024) AS d24, sum(left_minor) FILTER (due_t < 40072) AS d72, sum(left_minor) FILTER (due_t < 40000) AS late, min(due_t) FILTER (due_t >= 40000) AS first_due FROM o GROUP BY debtor),
rec AS (SELECT creditor AS m, sum(left_minor) AS v, count(*) AS n, min(due_t) FILTER (due_t >= 40000) AS first_due FROM o GROUP BY creditor),
h AS (SELECT * FROM payments WHERE t < 40000),
hin AS (SELECT m, sum(CAST(v AS HUGEINT) * v)::DOUBLE / sum(v) / sum(v) AS hhi FROM (SELECT payee AS m, payer, CAST(sum(amount_minor) AS BIGINT) AS v FROM h GROUP BY ALL) GROUP BY m),
hout AS (SELECT m, sum(CAST(v AS HUGEINT) * v)::DOUBLE / sum(v) / sum(v) AS hhi FROM (SELECT payer AS m, payee, CAST(sum(amount_minor) AS BIGINT) AS v FROM h GROUP BY ALL) GROUP BY m),
rhythm AS (SELECT m, CASE WHEN count(gap) > 1 AND avg(gap) > 0 THEN least(stddev_samp(gap) / avg(gap), 10) ELSE 0 END AS cv FROM (SELECT payee AS m, t - lag(t) OVER (PARTITION BY payee ORDER BY t) AS gap FROM h) GROUP BY m),
fin AS (SELECT payee AS m, sum(amount_minor) AS v, count(*) AS n, count(DISTINCT payer) AS deg, max(t) AS last FROM h GROUP BY payee),
fout AS (SELECT payer AS m, sum(amount_minor) AS v, count(*) AS n, count(DISTINCT payee) AS deg, max(t) AS last FROM h GROUP BY payer),
b AS (SELECT *, greatest(opening_minor + credit_minor - floor_minor, 1) AS buf FROM merchants)
SELECT merchant_id, round(ln(1 + buf), 6) AS log_buffer, round(ln(1 + opening_minor), 6) AS log_opening, round(least(credit_minor / buf, 5), 6) AS credit_ratio,
 round(ln(1 + coalesce(pay.v, 0)), 6) AS log_payables, round(ln(1 + coalesce(rec.v, 0)), 6) AS log_receivables, round(coalesce(pay.v, 0) / buf, 6) AS pay_ratio, round(coalesce(rec.v, 0) / buf, 6) AS rec_ratio,
 round(least(greatest((coalesce(rec.v, 0) - coalesce(pay.v, 0)) / buf, -50), 50), 6) AS net_ratio, round(coalesce(d24, 0) / buf, 6) AS due_24, round(coalesce(d72, 0) / buf, 6) AS due_72, round(coalesce(late, 0) / buf, 6) AS overdue,
 least(coalesce(pay.n, 0), 100) / 10 AS n_payables, least(coalesce(rec.n, 0), 100) / 10 AS n_receivables, round(least(coalesce(pay.first_due - 40000, 168) / 168, 1), 6) AS to_first_due, round(least(coalesce(rec.first_due - 40000, 168) / 168, 1), 6) AS to_first_receivable,
 round(coalesce(hin.hhi, 0), 6) AS in_concentration, round(coalesce(hout.hhi, 0), 6) AS out_concentration, round(coalesce(cv, 0), 6) AS in_gap_cv,
 round(ln(1 + coalesce(fin.v, 0)), 6) AS log_in, round(ln(1 + coalesce(fout.v, 0)), 6) AS log_out, round(least(coalesce(fin.v, 0) / greatest(coalesce(fout.v, 0), 1), 10), 6) AS in_out,
 least(coalesce(fin.n, 0), 2000) / 100 AS n_in, least(coalesce(fout.n, 0), 2000) / 100 AS n_out, coalesce(fin.deg, 0) / 10 AS in_degree, coalesce(fout.deg, 0) / 10 AS out_degree,
 round(ln(1 + 40000 - coalesce(fin.last, 0)) / 10, 6) AS since_in, round(ln(1 + 40000 - coalesce(fout.last, 0)) / 10, 6) AS since_out,
 CASE sector WHEN 'retail' THEN 0 WHEN 'manufacturing' THEN 1 WHEN 'logistics' THEN 2 WHEN 'services' THEN 3 ELSE 4 END AS sector_index, CASE tier WHEN 'large' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS tier_index
FROM b LEFT JOIN pay ON pay.m = merchant_id LEFT JOIN rec ON rec.m = merchant_id LEFT JOIN fin ON fin.m = merchant_id LEFT JOIN fout ON fout.m = merchant_id LEFT JOIN hin ON hin.m = merchant_id LEFT JOIN hout ON hout.m = merchant_id LEFT JOIN rhythm ON rhythm.m = merchant_id"""


def node_base(n: Network, origin: float = ORIGIN):
    """The balance, book and history groups, from facts before the origin alone."""
    o = n.obligations.where(e.observed(origin, t="issued_t") & e.is_open()).withColumn("left_minor", e.outstanding())
    part = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("left_minor"))), F.lit(0))
    due = F.col("due_t")
    pay = o.groupBy(F.col("debtor").alias("merchant_id")).agg(
        F.sum("left_minor").alias("pay"), F.count("*").alias("np"), part(due < origin + 24).alias("d24"), part(due < origin + 72).alias("d72"), part(due < origin).alias("late"), F.min(F.when(due >= origin, due)).alias("first_due")
    )
    rec = o.groupBy(F.col("creditor").alias("merchant_id")).agg(F.sum("left_minor").alias("rec"), F.count("*").alias("nr"), F.min(F.when(due >= origin, due)).alias("first_rec"))
    h = n.payments.where(e.observed(origin))
    fin = h.groupBy(F.col("payee").alias("merchant_id")).agg(F.sum("amount_minor").alias("vi"), F.count("*").alias("ni"), F.countDistinct("payer").alias("di"), F.max("t").alias("li"))
    fout = h.groupBy(F.col("payer").alias("merchant_id")).agg(F.sum("amount_minor").alias("vo"), F.count("*").alias("no"), F.countDistinct("payee").alias("do"), F.max("t").alias("lo"))
    per = h.groupBy("payer", "payee").agg(F.sum("amount_minor").alias("v"))
    square = (F.sum(F.col("v").cast("decimal(38,0)") * F.col("v")).cast("double") / F.sum("v") / F.sum("v"))  # Herfindahl index
    hin, hout = (per.groupBy(F.col(side).alias("merchant_id")).agg(square.alias(name)) for side, name in (("payee", "hhi_in"), ("payer", "hhi_out")))
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("payee").orderBy("t"))
    cv = F.when((F.count("gap") > 1) & (F.avg("gap") > 0), F.least(F.stddev_samp("gap") / F.avg("gap"), F.lit(10.0))).otherwise(0.0)
    rhythm = h.withColumn("gap", gap).groupBy(F.col("payee").alias("merchant_id")).agg(cv.alias("cv"))
    m = n.merchants
    for t in (pay, rec, fin, fout, hin, hout, rhythm):
        m = m.join(t, "merchant_id", "left")
    m = m.na.fill(0, ["pay", "np", "d24", "d72", "late", "rec", "nr", "vi", "ni", "di", "li", "vo", "no", "do", "lo", "hhi_in", "hhi_out", "cv"])
    return m.withColumn("buf", F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1)))


def node_columns(base, origin):
    """The feature columns of :func:`node_base` rows at their origin."""
    c = F.col
    over = lambda x: F.round(c(x) / c("buf"), 6)
    index = lambda x, names: F.coalesce(*[F.when(c(x) == v, F.lit(i)) for i, v in enumerate(names)])
    return base.select(
        "merchant_id", F.round(F.log1p("buf"), 6).alias("log_buffer"), F.round(F.log1p("opening_minor"), 6).alias("log_opening"), F.round(F.least(c("credit_minor") / c("buf"), F.lit(5.0)), 6).alias("credit_ratio"),
        F.round(F.log1p("pay"), 6).alias("log_payables"), F.round(F.log1p("rec"), 6).alias("log_receivables"), over("pay").alias("pay_ratio"), over("rec").alias("rec_ratio"),
        F.round(e.clip((c("rec") - c("pay")) / c("buf"), -50, 50), 6).alias("net_ratio"), over("d24").alias("due_24"), over("d72").alias("due_72"), over("late").alias("overdue"),
        (F.least(c("np"), F.lit(100)) / 10).alias("n_payables"), (F.least(c("nr"), F.lit(100)) / 10).alias("n_receivables"), F.round(F.least(F.coalesce(c("first_due") - origin, F.lit(HORIZON)) / HORIZON, F.lit(1.0)), 6).alias("to_first_due"),
        F.round(F.least(F.coalesce(c("first_rec") - origin, F.lit(HORIZON)) / HORIZON, F.lit(1.0)), 6).alias("to_first_receivable"), F.round("hhi_in", 6).alias("in_concentration"), F.round("hhi_out", 6).alias("out_concentration"), F.round("cv", 6).alias("in_gap_cv"),
        F.round(F.log1p("vi"), 6).alias("log_in"), F.round(F.log1p("vo"), 6).alias("log_out"), F.round(e.bounded_ratio(c("vi").cast("double"), c("vo").cast("double"), 10), 6).alias("in_out"),
        (F.least(c("ni"), F.lit(2000)) / 100).alias("n_in"), (F.least(c("no"), F.lit(2000)) / 100).alias("n_out"), (c("di") / 10).alias("in_degree"), (c("do") / 10).alias("out_degree"),
        F.round(F.log1p(origin - c("li")) / 10, 6).alias("since_in"), F.round(F.log1p(origin - c("lo")) / 10, 6).alias("since_out"), index("sector", SECTORS).alias("sector_index"), index("tier", TIERS).alias("tier_index"), origin.alias("origin"),
    )


@query(SQL + NODE)
def node_features(spark, d):
    return node_columns(node_base(Network(spark, d)), F.lit(ORIGIN)).drop("origin")


SHOCK = 500_000_000
STRUCTURE = (
    """, w AS (SELECT 'N1' AS node, 0 AS hops UNION SELECT target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 4),
dn AS (SELECT source AS root, target AS node, 1 AS hops FROM edges UNION SELECT root, target, hops + 1 FROM dn JOIN edges ON source = node WHERE hops < 2),
up AS (SELECT target AS root, source AS node, 1 AS hops FROM edges UNION SELECT root, source, hops + 1 FROM up JOIN edges ON target = node WHERE hops < 2),
x0 AS (SELECT merchant_id AS node, CASE WHEN merchant_id = 'N1' THEN 1.0 ELSE 0 END AS e FROM merchants)"""
    + "".join(STEP.replace("IN ('N1','N7')", "= 'N1'").format(i=i + 1, j=i) for i in range(3))
    + power_sql("p", "source", "target", 5)
    + power_sql("q", "target", "source", 5)
    + f""" SELECT merchant_id AS node, round(p.r * (SELECT count(*) FROM merchants), 6) AS pagerank, round(q.r * (SELECT count(*) FROM merchants), 6) AS reverse_pagerank,
 least((SELECT count(DISTINCT node) FROM dn WHERE root = merchant_id AND node <> root), 500) / 10 AS reach_down, least((SELECT count(DISTINCT node) FROM up WHERE root = merchant_id AND node <> root), 500) / 10 AS reach_up,
 coalesce((SELECT min(hops) FROM w WHERE node = merchant_id), 5) / 4 AS hops, round(x3.e, 6) AS exposure, merchant_id = 'N1' AS is_origin,
 round(CASE WHEN merchant_id = 'N1' THEN {SHOCK} / greatest(opening_minor + credit_minor - floor_minor, 1) ELSE 0 END, 6) AS shock_ratio, round(ln(1 + {SHOCK}), 6) AS log_total_shock
FROM merchants JOIN p5 p ON p.node = merchant_id JOIN q5 q ON q.node = merchant_id JOIN x3 ON x3.node = merchant_id"""
)


@query(R + STRUCTURE)
def structure_features(spark, d):
    """Ranks, reach and shock columns that complete the node features."""
    n = Network(spark, d)
    nodes = n.merchants.select(F.col("merchant_id").alias("node"))
    edges = g.cut(n.edges.withColumn("weight", F.col("pass_through")))
    own = nodes.select(F.col("node").alias("root"), "node")
    origin = spark.createDataFrame([("N1",)], "node string")
    down, up = (g.reach(edges, own, 2, upstream=u).groupBy(F.col("root").alias("node")).agg(F.count("*").alias(name)) for u, name in ((False, "down"), (True, "up")))
    size = nodes.count()
    buf = n.merchants.select(F.col("merchant_id").alias("node"), F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1)).alias("buf"))
    out = nodes.join(g.pagerank(edges, nodes, 5), "node").join(g.pagerank(edges, nodes, 5, reverse=True).withColumnRenamed("rank", "back"), "node").join(buf, "node")
    out = out.join(down, "node", "left").join(up, "node", "left").join(g.multi_source_hops(edges, nodes, origin, 5), "node").join(g.exposure(edges, nodes, origin), "node").na.fill(0)
    hit = F.col("node") == "N1"
    return out.select(
        "node", F.round(F.col("rank") * size, 6).alias("pagerank"), F.round(F.col("back") * size, 6).alias("reverse_pagerank"), (F.least(F.col("down"), F.lit(500)) / 10).alias("reach_down"), (F.least(F.col("up"), F.lit(500)) / 10).alias("reach_up"),
        (F.col("hops") / 4).alias("hops"), F.round("exposure", 6).alias("exposure"), hit.alias("is_origin"), F.round(F.when(hit, F.lit(SHOCK) / F.col("buf")).otherwise(0.0), 6).alias("shock_ratio"), F.round(F.log1p(F.lit(SHOCK)), 6).alias("log_total_shock"),
    )


@query("SELECT a.*, b.* EXCLUDE (node) FROM (" + SQL + NODE + ") a JOIN (" + R + STRUCTURE + ") b ON b.node = a.merchant_id")
def node_table(spark, d):
    """All node features of the contract, one row a merchant."""
    return node_features(spark, d).join(structure_features(spark, d).withColumnRenamed("node", "merchant_id"), "merchant_id")


@query(SQL + """, k AS (SELECT range AS k FROM range(8)), g AS (SELECT debtor, k FROM (SELECT DISTINCT debtor FROM obligations), k),
due AS (SELECT debtor, CAST(floor((due_t - 40000) / 21.0) AS BIGINT) AS k, sum(amount_minor - paid_minor) AS v FROM obligations WHERE due_t >= 40000 AND due_t < 40168 AND issued_t < 40000 AND amount_minor > paid_minor GROUP BY ALL)
SELECT g.debtor AS merchant_id, g.k, round(coalesce(v, 0) / buf, 6) AS due_ratio, round(sum(coalesce(v, 0)) OVER (PARTITION BY g.debtor ORDER BY g.k) / buf, 6) AS cum_due_ratio, round((g.k + 1) / 8, 6) AS elapsed
FROM g LEFT JOIN due ON due.debtor = g.debtor AND due.k = g.k JOIN (SELECT merchant_id, greatest(opening_minor + credit_minor - floor_minor, 1) AS buf FROM merchants) ON merchant_id = g.debtor""")
def interval_features(spark, d):
    n = Network(spark, d)
    o = n.obligations
    grid = o.select("debtor").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(K - 1)).cast("array<bigint>")))
    live = o.where(F.col("due_t").between(ORIGIN, ORIGIN + HORIZON) & (F.col("due_t") < ORIGIN + HORIZON) & e.observed(ORIGIN, t="issued_t") & e.is_open())
    due = live.groupBy("debtor", F.floor((F.col("due_t") - ORIGIN) / (HORIZON / K)).alias("k")).agg(F.sum(e.outstanding()).alias("v"))
    buf = n.merchants.select(F.col("merchant_id").alias("debtor"), F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1)).alias("buf"))
    v = F.coalesce("v", F.lit(0))
    run = F.sum(v).over(Window.partitionBy("debtor").orderBy("k"))
    return grid.join(due, ["debtor", "k"], "left").join(buf, "debtor").select(F.col("debtor").alias("merchant_id"), "k", F.round(v / F.col("buf"), 6).alias("due_ratio"), F.round(run / F.col("buf"), 6).alias("cum_due_ratio"), F.round((F.col("k") + 1) / K, 6).alias("elapsed"))


def pair_lags(n: Network, origin: float = ORIGIN):
    """Median time from the payer's latest earlier receipt (up to 720 hours) to a payment, per pair of the trade layer."""
    out = n.trade.where(e.observed(origin)).select("payer", "payee", "t")
    into = n.payments.where(e.observed(origin)).select(F.col("payee").alias("payer"), F.col("t").alias("t_in")).distinct()
    lags = r.asof_join(out, into, "payer", "t", "t_in", [], max_gap=720.0).where("t_in is not null")
    return lags.groupBy("payer", "payee").agg(F.median(F.col("t") - F.col("t_in")).alias("lag"))


PAIR = """, gaps AS (SELECT *, t - lag(t) OVER (PARTITION BY payer, payee ORDER BY t, amount_minor) AS gap FROM trade WHERE t < 40000),
p AS (SELECT payer, payee, count(*) AS n, sum(amount_minor) AS v, avg(amount_minor) AS mean, stddev_samp(amount_minor) AS sd, median(gap) AS mg, CASE WHEN count(gap) < 2 OR avg(gap) <= 0 THEN 0 ELSE greatest(least(1 - stddev_samp(gap)/avg(gap), 1), 0) END AS reg, (max(t) - min(t)) / 40000 AS active FROM gaps GROUP BY payer, payee),
owed AS (SELECT debtor, creditor, sum(amount_minor - paid_minor) AS v FROM obligations WHERE issued_t < 40000 AND amount_minor > paid_minor GROUP BY ALL), b AS (SELECT merchant_id, greatest(opening_minor + credit_minor - floor_minor, 1) AS buf FROM merchants),
lagged AS (SELECT payer, payee, median(lag) AS ml FROM (SELECT o.payer, o.payee, o.t - i.t AS lag FROM (SELECT payer, payee, t FROM trade WHERE t < 40000) o ASOF JOIN (SELECT DISTINCT payee AS m, t FROM payments WHERE t < 40000) i ON o.payer = i.m AND o.t > i.t) WHERE lag <= 720 GROUP BY ALL)
SELECT payer, payee, round(ln(1+n), 6) AS log_n, round(ln(1+p.v), 6) AS log_total, round(ln(1+mean), 6) AS log_mean, round(least(coalesce(sd, 0)/greatest(mean, 1), 10), 6) AS cv, round(p.v / sum(p.v) OVER (PARTITION BY payer), 6) AS share_out, round(p.v / sum(p.v) OVER (PARTITION BY payee), 6) AS share_in, round(reg, 6) AS regularity, round(ln(1+coalesce(mg, 0))/10, 6) AS log_gap, round(active, 6) AS active,
 round(coalesce(owed.v, 0) / buf, 6) AS owed_ratio, round(ln(1 + coalesce(ml, 0)) / 10, 6) AS log_lag FROM p JOIN b ON merchant_id = payer LEFT JOIN owed ON debtor = payer AND creditor = payee LEFT JOIN lagged USING (payer, payee)"""


@query(SQL + PAIR)
def pair_features(spark, d):
    n = Network(spark, d)
    f = ed.edge_features(n.trade.where(e.observed(ORIGIN)))
    owed = n.obligations.where(e.observed(ORIGIN, t="issued_t") & e.is_open()).groupBy(F.col("debtor").alias("payer"), F.col("creditor").alias("payee")).agg(F.sum(e.outstanding()).alias("owed"))
    buf = n.merchants.select(F.col("merchant_id").alias("payer"), F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1)).alias("buf"))
    f = f.join(buf, "payer").join(owed, ["payer", "payee"], "left").join(pair_lags(n), ["payer", "payee"], "left")
    share = lambda by: F.round(F.col("total_minor") / F.sum("total_minor").over(Window.partitionBy(by)), 6)
    return f.select(
        "payer", "payee", F.round(F.log1p("n"), 6).alias("log_n"), F.round(F.log1p("total_minor"), 6).alias("log_total"), F.round(F.log1p("mean_amount"), 6).alias("log_mean"),
        F.round(F.least(F.col("std_amount") / F.greatest("mean_amount", F.lit(1.0)), F.lit(10.0)), 6).alias("cv"), share("payer").alias("share_out"), share("payee").alias("share_in"), F.round("regularity", 6).alias("regularity"),
        F.round(F.log1p(F.coalesce("median_gap", F.lit(0.0))) / 10, 6).alias("log_gap"), F.round((F.col("last_t") - F.col("first_t")) / 40000, 6).alias("active"),
        F.round(F.coalesce("owed", F.lit(0)) / F.col("buf"), 6).alias("owed_ratio"), F.round(F.log1p(F.coalesce("lag", F.lit(0.0))) / 10, 6).alias("log_lag"),
    )


@query(SQL + LAGS + "SELECT m, round(ln(1 + median(lag)) / 10, 6) AS log_lag, count(*) AS n FROM lags WHERE lag > 0 AND lag <= 720 GROUP BY m")
def pair_response_lags(spark, d):
    lags = response_lags(Network(spark, d)).where("lag > 0")
    return lags.groupBy("m").agg(F.round(F.log1p(F.median("lag")) / 10, 6).alias("log_lag"), F.count("*").alias("n"))


@query("SELECT range AS k, round(range * 21.0, 6) AS low, round((range + 1) * 21.0, 6) AS high, list_contains([6.0, 24.0, 48.0, 72.0, 168.0], 168.0) AS full_window FROM range(8)")
def interval_edges(spark, d):
    k = spark.range(K).withColumnRenamed("id", "k")
    return k.select("k", F.round(F.col("k") * 21.0, 6).alias("low"), F.round((F.col("k") + 1) * 21.0, 6).alias("high"), F.lit(True).alias("full_window"))


@query(SQL + "SELECT merchant_id, k, concat_ws(',', CASE WHEN k = 0 THEN 1 ELSE 0 END, CASE WHEN k = 1 THEN 1 ELSE 0 END, CASE WHEN k = 2 THEN 1 ELSE 0 END) AS one_hot, round(ln(1 + 168 / 3.0), 6) AS log_width, 1 AS bias FROM merchants, (SELECT range AS k FROM range(3))")
def hazard_design(spark, d):
    m = Network(spark, d).merchants.select("merchant_id", F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<bigint>")).alias("k"))
    hot = F.concat_ws(",", *[(F.col("k") == i).cast("int").cast("string") for i in range(3)])
    return m.select("merchant_id", "k", hot.alias("one_hot"), F.round(F.log1p(F.lit(168 / 3.0)), 6).alias("log_width"), F.lit(1).alias("bias"))
