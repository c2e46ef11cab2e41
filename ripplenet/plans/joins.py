"""Joins: keyed, as-of, range, semi and anti, with their aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import relational as r
from ripplenet.plans.registry import query
from ripplenet.sources import versions
from ripplenet.sources.network import SQL, Network

EVENT_TYPES = ("click", "error", "purchase", "signup", "view")
OUT = "greatest(amount_minor - paid_minor, 0)"
ROLES = """, payable AS (SELECT debtor AS m, CAST(sum(greatest(amount_minor-paid_minor,0)) AS BIGINT) AS payable_minor FROM obligations GROUP BY debtor),
receivable AS (SELECT creditor AS m, CAST(sum(greatest(amount_minor-paid_minor,0)) AS BIGINT) AS receivable_minor FROM obligations GROUP BY creditor),
flow AS (SELECT m, CAST(sum(amount_minor) AS BIGINT) AS throughput_minor, count(*) AS n_events FROM (SELECT payer AS m, amount_minor FROM inner_payments UNION ALL SELECT payee, amount_minor FROM inner_payments) GROUP BY m),
degree AS (SELECT m, count(*) AS degree FROM (SELECT payer AS m FROM pairs UNION ALL SELECT payee FROM pairs) GROUP BY m)
"""


def roles(n: Network):
    """Payables, receivables, throughput and degree per merchant."""
    payable = n.obligations.groupBy(F.col("debtor").alias("merchant_id")).agg(F.sum(e.outstanding()).alias("payable_minor"))
    receivable = n.obligations.groupBy(F.col("creditor").alias("merchant_id")).agg(F.sum(e.outstanding()).alias("receivable_minor"))
    both = n.inner.select(F.explode(F.array("payer", "payee")).alias("merchant_id"), "amount_minor")
    flow = both.groupBy("merchant_id").agg(F.sum("amount_minor").alias("throughput_minor"), F.count("*").alias("n_events"))
    degree = n.pairs.select(F.explode(F.array("payer", "payee")).alias("merchant_id")).groupBy("merchant_id").agg(F.count("*").alias("degree"))
    return payable, receivable, flow, degree


def profiles(n: Network):
    m = n.merchants
    for part in roles(n):
        m = m.join(part, "merchant_id", "left")
    return m.na.fill(0)


@query(SQL + ROLES + """SELECT merchant_id, coalesce(payable_minor,0) AS payable_minor, coalesce(receivable_minor,0) AS receivable_minor, coalesce(throughput_minor,0) AS throughput_minor,
 coalesce(n_events,0) AS n_events, coalesce(degree,0) AS degree FROM merchants LEFT JOIN payable p ON p.m = merchant_id LEFT JOIN receivable r ON r.m = merchant_id LEFT JOIN flow f ON f.m = merchant_id LEFT JOIN degree g ON g.m = merchant_id""")
def merchant_profiles(spark, d):
    return profiles(Network(spark, d)).select("merchant_id", "payable_minor", "receivable_minor", "throughput_minor", "n_events", "degree")


@query(SQL + """, recent AS (SELECT payer, payee, count(*) AS k, CAST(sum(amount_minor) AS BIGINT) AS v FROM inner_payments WHERE t >= 55000 GROUP BY ALL)
SELECT source, target, coalesce(k, n) AS n_events, coalesce(v, 0) AS recent_minor FROM edges LEFT JOIN recent ON source = payer AND target = payee""")
def edge_observations(spark, d):
    n = Network(spark, d)
    recent = n.inner.where("t >= 55000").groupBy(F.col("payer").alias("source"), F.col("payee").alias("target")).agg(F.count("*").alias("k"), F.sum("amount_minor").alias("v"))
    return n.edges.join(recent, ["source", "target"], "left").select("source", "target", F.coalesce("k", "n").alias("n_events"), F.coalesce("v", F.lit(0)).alias("recent_minor"))


DAMAGE = """, late AS (SELECT debtor, count(*) FILTER (settled_t > due_t + {x}) AS n_late, CAST(coalesce(sum(amount_minor) FILTER (settled_t > due_t + {x}), 0) AS BIGINT) AS value FROM obligations GROUP BY debtor)"""


def _late(n: Network, slack: float):
    hit = F.col("settled_t") > F.col("due_t") + slack
    return n.obligations.groupBy("debtor").agg(F.count_if(hit).alias("n_late"), F.coalesce(F.sum(F.when(hit, F.col("amount_minor"))), F.lit(0)).alias("value"))


@query(SQL + DAMAGE.format(x=0).replace("late AS", "shocked AS") + DAMAGE.format(x=20000).replace("late AS", "calm AS") + "SELECT s.debtor, greatest(s.value - coalesce(c.value, 0), 0) AS disrupted_minor, s.n_late - coalesce(c.n_late, 0) AS n_late FROM shocked s LEFT JOIN calm c ON s.debtor = c.debtor")
def incremental_damage(spark, d):
    n = Network(spark, d)
    s, c = _late(n, 0), _late(n, 20000).toDF("debtor", "n0", "v0")
    return s.join(c, "debtor", "left").select("debtor", F.greatest(F.col("value") - F.coalesce("v0", F.lit(0)), F.lit(0)).alias("disrupted_minor"), (F.col("n_late") - F.coalesce("n0", F.lit(0))).alias("n_late"))


@query(SQL + "SELECT DISTINCT creditor FROM obligations WHERE due_t < 1300 AND amount_minor > paid_minor AND priority = 1 AND creditor NOT IN (SELECT creditor FROM obligations WHERE due_t < 1000 AND amount_minor > paid_minor AND priority = 1)")
def attributable_affected(spark, d):
    o = Network(spark, d).obligations.where(e.is_open() & (F.col("priority") == 1))
    shocked, calm = (o.where(F.col("due_t") < t).select("creditor").distinct() for t in (1300, 1000))
    return shocked.join(calm, "creditor", "left_anti")


@query(SQL + ", ego AS (SELECT 'N1' AS m UNION SELECT target FROM edges WHERE source = 'N1' UNION SELECT source FROM edges WHERE target = 'N1') SELECT layer, payer, payee, count(*) AS n FROM inner_payments WHERE payer IN (SELECT m FROM ego) AND payee IN (SELECT m FROM ego) GROUP BY ALL")
def ego_network_events(spark, d):
    n = Network(spark, d)
    near = n.edges.where("source = 'N1' OR target = 'N1'").select(F.explode(F.array("source", "target")).alias("m")).union(spark.createDataFrame([("N1",)], "m string")).distinct()
    kept = n.inner.join(near, F.col("payer") == near.m, "left_semi").join(near, F.col("payee") == near.m, "left_semi")
    return kept.groupBy("layer", "payer", "payee").agg(F.count("*").alias("n"))


ESTIMATE = """, early AS (SELECT payer, payee, CAST(sum(amount_minor) AS BIGINT) AS v FROM inner_payments WHERE t < 20000 GROUP BY ALL),
est AS (SELECT payer AS source, payee AS target, share FROM (SELECT *, v / sum(v) OVER (PARTITION BY payer) AS share, row_number() OVER (PARTITION BY payer ORDER BY v DESC, payee) AS k FROM early) WHERE k <= 3)
"""


def estimated_edges(n: Network):
    early = n.inner.where("t < 20000").groupBy("payer", "payee").agg(F.sum("amount_minor").alias("v"))
    share = F.col("v") / F.sum("v").over(Window.partitionBy("payer"))
    top = r.top_per_group(early.withColumn("share", share), ["payer"], [F.desc("v"), F.col("payee")], 3)
    return top.select(F.col("payer").alias("source"), F.col("payee").alias("target"), "share")


@query(SQL + ESTIMATE + """SELECT (SELECT count(*) FROM est) AS n_estimated, (SELECT count(*) FROM edges) AS n_true, count(*) AS n_matched, round(avg(abs(share - pass_through)), 9) AS mae,
 round(count(*) / (SELECT count(*) FROM est), 9) AS precision, round(count(*) / (SELECT count(*) FROM edges), 9) AS recall FROM est JOIN edges USING (source, target)""")
def dependency_recovery(spark, d):
    n = Network(spark, d)
    est, true = estimated_edges(n), n.edges
    both = est.join(true.select("source", "target", "pass_through"), ["source", "target"], "full")
    is_e, is_t = F.col("share").isNotNull(), F.col("pass_through").isNotNull()
    got = both.agg(F.count_if(is_e).alias("n_estimated"), F.count_if(is_t).alias("n_true"), F.count_if(is_e & is_t).alias("n_matched"), F.round(F.avg(F.abs(F.col("share") - F.col("pass_through"))), 9).alias("mae"))
    return got.select("*", F.round(F.col("n_matched") / F.col("n_estimated"), 9).alias("precision"), F.round(F.col("n_matched") / F.col("n_true"), 9).alias("recall"))


LAGS = """, outf AS (SELECT payer AS m, t, amount_minor FROM supply), inf AS (SELECT DISTINCT payee AS m, t FROM trade),
lags AS (SELECT outf.m, outf.t, amount_minor, outf.t - inf.t AS lag FROM outf ASOF JOIN inf ON outf.m = inf.m AND outf.t > inf.t)
"""


def response_lags(n: Network):
    """Every payment of a supplier with the time since its latest earlier receipt, up to 720 hours."""
    out = n.supply.select(F.col("payer").alias("m"), "t", "amount_minor")
    into = n.trade.select(F.col("payee").alias("m"), F.col("t").alias("t_in"))
    return r.asof_join(out, into, "m", "t", "t_in", [], max_gap=720.0).where("t_in is not null").withColumn("lag", F.col("t") - F.col("t_in"))


@query(SQL + LAGS + "SELECT m, count(*) AS n, round(avg(lag), 6) AS mean_lag, round(median(lag), 6) AS median_lag, round(avg(ln(lag)), 6) AS mu_log, round(stddev_samp(ln(lag)), 6) AS sigma_log FROM lags WHERE lag > 0 AND lag <= 720 GROUP BY m")
def response_lag_law(spark, d):
    lags = response_lags(Network(spark, d)).where("lag > 0")
    ln = F.log("lag")
    return lags.groupBy("m").agg(
        F.count("*").alias("n"), F.round(F.avg("lag"), 6).alias("mean_lag"), F.round(F.median("lag"), 6).alias("median_lag"), F.round(F.avg(ln), 6).alias("mu_log"), F.round(F.stddev_samp(ln), 6).alias("sigma_log")
    )


PARENTS = """, kids AS (SELECT event_id, payer AS m, t, amount_minor, row_number() OVER (ORDER BY event_id, t, amount_minor) AS k FROM supply),
par AS (SELECT k, m, row_number() OVER (PARTITION BY k ORDER BY i.t DESC, i.amount_minor DESC) AS rn, kids.t - i.t AS u FROM kids JOIN trade i ON i.payee = m AND i.t < kids.t AND i.t >= kids.t - 384)
"""


@query(SQL + PARENTS + "SELECT m, count(DISTINCT k) AS n_children, count(*) AS n_parents, round(sum(exp(-u/48)/48), 6) AS kernel_mass FROM par WHERE rn <= 64 GROUP BY m")
def hawkes_parents(spark, d):
    n = Network(spark, d)
    kids = n.supply.select("event_id", F.col("payer").alias("m"), "t", "amount_minor")
    copy = F.row_number().over(Window.partitionBy("event_id", "t", "amount_minor").orderBy("m"))  # identical rows stay apart
    kids = kids.withColumn("copy", copy)
    inflow = n.trade.select(F.col("payee").alias("m"), F.col("t").alias("t_in"), F.col("amount_minor").alias("a_in"))
    pairs = r.interval_join(kids, inflow, "m", "t", "t_in", 384.0)
    pairs = r.top_per_group(pairs, ["event_id", "copy", "t", "amount_minor"], [F.desc("t_in"), F.desc("a_in")], 64)
    mass = e.hawkes_kernel(F.col("t") - F.col("t_in"), F.lit(1.0), F.lit(1 / 48))
    return pairs.groupBy("m").agg(F.countDistinct("event_id", "copy", "t").alias("n_children"), F.count("*").alias("n_parents"), F.round(F.sum(mass), 6).alias("kernel_mass"))


@query(SQL + """, k AS (SELECT range AS k, 40000 + range * 21.0 AS lo, 40000 + (range + 1) * 21.0 AS hi FROM range(8))
SELECT debtor, k, CAST(sum(greatest(amount_minor - paid_minor, 0)) AS BIGINT) AS due_minor, count(*) AS n FROM obligations JOIN k ON due_t >= lo AND due_t < hi GROUP BY ALL""")
def due_by_interval(spark, d):
    o = Network(spark, d).obligations.where("due_t >= 40000 AND due_t < 40168")
    k = F.floor((F.col("due_t") - 40000) / 21.0)
    return o.groupBy("debtor", k.alias("k")).agg(F.sum(e.outstanding()).alias("due_minor"), F.count("*").alias("n"))


@query(SQL + """, edge(low, high) AS (VALUES (0,6),(6,12),(12,24),(24,48),(48,72),(72,120),(120,168)), hit AS (SELECT debtor, settled_t - due_t AS h FROM obligations WHERE settled_t > due_t)
SELECT low, high, count(*) AS n, count(DISTINCT debtor) AS n_debtors FROM edge JOIN hit ON h >= low AND h < high GROUP BY ALL""")
def hit_time_buckets(spark, d):
    hit = Network(spark, d).obligations.where("settled_t > due_t").select("debtor", (F.col("settled_t") - F.col("due_t")).alias("h"))
    edges = spark.createDataFrame(list(zip(e.HIT_EDGES, e.HIT_EDGES[1:], strict=False)), "low int, high int")
    return hit.join(F.broadcast(edges), (F.col("h") >= F.col("low")) & (F.col("h") < F.col("high"))).groupBy("low", "high").agg(F.count("*").alias("n"), F.countDistinct("debtor").alias("n_debtors"))


@query("""WITH v AS (SELECT event_id, user_id, event_type, value FROM events)
SELECT count(*) AS n_pairs, count(*) FILTER ((a.value > b.value AND a.event_type < b.event_type) OR (a.value < b.value AND a.event_type > b.event_type)) AS n_agree, count(*) FILTER (a.value = b.value) AS n_tied
FROM v a JOIN v b ON a.user_id = b.user_id AND a.event_id < b.event_id AND a.event_type <> b.event_type""")
def concordant_pairs(spark, d):
    """Pairs of one user with different types, counted from running sums per type: no pair is made."""
    v = Network(spark, d).read("events").select("user_id", "event_type", "value")
    at = [F.count_if(F.col("event_type") == t).alias(f"n{i}") for i, t in enumerate(EVENT_TYPES)]
    per = v.groupBy("user_id", "value").agg(*at)
    w = Window.partitionBy("user_id")
    above = w.orderBy(F.desc("value")).rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumns({f"up{i}": F.coalesce(F.sum(f"n{i}").over(above), F.lit(0)) for i in range(len(at))})
    two = [(F.col(f"n{i}"), F.col(f"up{i}"), F.col(f"n{j}")) for i in range(len(at)) for j in range(i + 1, len(at))]
    agree = sum((up * later for _, up, later in two), F.lit(0))  # the type first in order has the higher value
    tied = sum((n * later for n, _, later in two), F.lit(0))
    counted = per.agg(F.sum(agree).alias("n_agree"), F.sum(tied).alias("n_tied"))
    totals = v.groupBy("user_id").agg(*at)
    pairs = sum((n * later for n, _, later in two), F.lit(0))
    return totals.agg(F.sum(pairs).alias("n_pairs")).join(F.broadcast(counted)).select("n_pairs", "n_agree", "n_tied")


@query(SQL + """, a AS (SELECT source, target AS via, pass_through AS p FROM edges), b AS (SELECT source AS via, target, pass_through AS q FROM edges)
SELECT source, target, count(*) AS n_paths, round(max(p * q), 9) AS best FROM a JOIN b USING (via) WHERE source <> target GROUP BY ALL""")
def two_hop_paths(spark, d):
    g = Network(spark, d).edges
    a = g.select("source", F.col("target").alias("via"), F.col("pass_through").alias("p"))
    b = g.select(F.col("source").alias("via"), "target", F.col("pass_through").alias("q"))
    return a.join(b, "via").where("source <> target").groupBy("source", "target").agg(F.count("*").alias("n_paths"), F.round(F.max(F.col("p") * F.col("q")), 9).alias("best"))


@query("""WITH k AS (SELECT event_id, user_id, event_type FROM events),
exact AS (SELECT event_id AS id, 'item' AS how FROM events WHERE event_type = 'purchase'), usr AS (SELECT DISTINCT user_id AS id, 'user' AS how FROM events WHERE event_type = 'error'), kind AS (SELECT DISTINCT event_type AS id, 'batch' AS how FROM events WHERE event_type = 'signup')
SELECT event_id, coalesce(exact.how, usr.how, kind.how, 'none') AS matched_by FROM k LEFT JOIN exact ON exact.id = event_id LEFT JOIN usr ON usr.id = user_id LEFT JOIN kind ON kind.id = event_type""")
def lookup_by_precedence(spark, d):
    v = Network(spark, d).read("events").select("event_id", "user_id", "event_type")
    key = lambda kind, c, how: v.where(F.col("event_type") == kind).select(c).distinct().withColumn(how, F.lit(how))
    k = v.join(key("purchase", "event_id", "item"), "event_id", "left").join(key("error", "user_id", "user"), "user_id", "left").join(key("signup", "event_type", "batch"), "event_type", "left")
    return k.select("event_id", F.coalesce("item", "user", "batch", F.lit("none")).alias("matched_by"))


@query(SQL + """, s AS (SELECT priority AS scenario, list(DISTINCT creditor) AS members FROM obligations WHERE amount_minor > paid_minor GROUP BY priority)
SELECT m.merchant_id, count(s.scenario) AS n_scenarios FROM merchants m JOIN s ON list_contains(s.members, m.merchant_id) GROUP BY ALL""")
def scenarios_of_merchant(spark, d):
    n = Network(spark, d)
    s = n.obligations.where(e.is_open()).select(F.col("priority").alias("scenario"), F.col("creditor").alias("merchant_id")).distinct()
    return s.join(n.merchants, "merchant_id", "left_semi").groupBy("merchant_id").agg(F.count("*").alias("n_scenarios"))


@query("""SELECT c_custkey AS record_id, coalesce('N' || n_nationkey, 'external_sink') AS payer, coalesce('S' || s_suppkey, 'N0') AS payee
FROM customer LEFT JOIN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2) ON n_nationkey = c_nationkey LEFT JOIN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) ON s_suppkey = c_custkey % 100""")
def entity_resolution(spark, d):
    n = Network(spark, d)
    nation = n.read("nation").where("n_regionkey <> 2").select(F.col("n_nationkey").alias("c_nationkey"), F.concat(F.lit("N"), "n_nationkey").alias("payer"))
    supplier = n.read("supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("hint"), F.concat(F.lit("S"), "s_suppkey").alias("payee"))
    c = n.read("customer").select(F.col("c_custkey").alias("record_id"), "c_nationkey", (F.col("c_custkey") % 100).alias("hint"))
    return c.join(nation, "c_nationkey", "left").join(supplier, "hint", "left").select("record_id", F.coalesce("payer", F.lit(e.SINK)).alias("payer"), F.coalesce("payee", F.lit("N0")).alias("payee"))


@query(SQL + """, part3 AS (SELECT obligation_id AS parent, amount_minor, k, CASE WHEN k < 2 THEN amount_minor // 3 ELSE amount_minor - 2 * (amount_minor // 3) END AS part FROM (SELECT DISTINCT obligation_id, amount_minor FROM obligations WHERE priority = 2), range(3) r(k))
SELECT parent, max(amount_minor) AS amount_minor, CAST(sum(part) AS BIGINT) AS children_minor, count(*) AS n_children FROM part3 GROUP BY parent, amount_minor""")
def restructured_tranches(spark, d):
    o = Network(spark, d).obligations.where("priority = 2").select(F.col("obligation_id").alias("parent"), "amount_minor").distinct()
    kids = o.select("parent", "amount_minor", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    third = F.expr("amount_minor div 3")
    kids = kids.withColumn("part", F.when(F.col("k") < 2, third).otherwise(F.col("amount_minor") - 2 * third))
    return kids.groupBy("parent", "amount_minor").agg(F.sum("part").alias("children_minor"), F.count("*").alias("n_children"))


@query(SQL + """, c(id, kind, target, shift) AS (SELECT 'A' || row_number() OVER (ORDER BY obligation_id, amount_minor, priority), CASE WHEN priority = 1 THEN 'extension' ELSE 'acceleration' END, obligation_id, 24.0 * priority FROM (SELECT DISTINCT obligation_id, amount_minor, priority FROM obligations WHERE amount_minor > paid_minor)),
o AS (SELECT obligation_id, max(due_t) AS due_t FROM obligations GROUP BY obligation_id)
SELECT id, kind, target, CASE WHEN o.due_t IS NULL THEN 'unknown' WHEN kind = 'extension' AND shift > 20 THEN 'too_long' WHEN kind = 'acceleration' AND shift > 100 THEN 'too_early' ELSE 'ok' END AS verdict FROM c LEFT JOIN o ON o.obligation_id = target""")
def action_targets(spark, d):
    o = Network(spark, d).obligations
    c = o.where(e.is_open()).select("obligation_id", "amount_minor", "priority").distinct()
    c = r.placed(c, [F.col("obligation_id"), F.col("amount_minor"), F.col("priority")])
    c = c.select(F.concat(F.lit("A"), "place").alias("id"), F.when(F.col("priority") == 1, "extension").otherwise("acceleration").alias("kind"), F.col("obligation_id").alias("target"), (24.0 * F.col("priority")).alias("shift"))
    due = o.groupBy(F.col("obligation_id").alias("target")).agg(F.max("due_t").alias("due_t"))
    verdict = F.when(F.col("due_t").isNull(), "unknown").when((F.col("kind") == "extension") & (F.col("shift") > 20), "too_long").when((F.col("kind") == "acceleration") & (F.col("shift") > 100), "too_early").otherwise("ok")
    return c.join(due, "target", "left").select("id", "kind", "target", verdict.alias("verdict"))


@query(SQL + ESTIMATE + """SELECT source, target, pass_through, 'stored' AS origin FROM edges ANTI JOIN est USING (source, target) UNION ALL SELECT source, target, share, 'estimated' FROM est""")
def overlay_merge(spark, d):
    """Estimated edges installed over the stored ones, as the second version of the overlay, read back."""
    import uuid

    n = Network(spark, d)
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    root = f"{root}/overlay-{uuid.uuid4().hex}"
    versions.publish(n.edges.select("source", "target", "pass_through"), root)
    nodes = n.merchants.select(F.col("merchant_id").alias("node"))
    second = versions.install_overlay(spark, root, estimated_edges(n).withColumnRenamed("share", "pass_through"), nodes=nodes)
    return versions.read_version(spark, root, second)
