"""Windows, ranks, top-k and set operations."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import edges as ed
from ripplenet.operators import relational as r
from ripplenet.plans.joins import ESTIMATE, ROLES, estimated_edges, profiles, roles
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network


@query(SQL + "SELECT payer, payee, t, round(t - lag(t) OVER (PARTITION BY payer, payee ORDER BY t, amount_minor), 6) AS gap FROM levy WHERE payer IN ('S1','S2','S3')")
def inter_arrival_gaps(spark, d):
    g = ed.gaps(Network(spark, d).levy.where("payer IN ('S1', 'S2', 'S3')"), ["payer", "payee"])
    return g.select("payer", "payee", "t", F.round("gap", 6).alias("gap"))


@query(SQL + ROLES + "SELECT m AS merchant_id, row_number() OVER (ORDER BY throughput_minor, m) AS ordinal, CAST(rank() OVER (ORDER BY n_events) AS DOUBLE) + (count(*) OVER (PARTITION BY n_events) - 1) / 2 AS average_rank FROM flow")
def ranks(spark, d):
    flow = roles(Network(spark, d))[2]
    both = r.placed(r.average_places(flow, "n_events", "merchant_id", "average_rank"), [F.col("throughput_minor"), F.col("merchant_id")], "ordinal")
    return both.select("merchant_id", "ordinal", "average_rank")


@query("SELECT user_id, event_id, max(value) OVER w AS peak, round(value - lag(value, 1, 0) OVER (PARTITION BY user_id ORDER BY ts), 6) AS step, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS errors FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def running_maximum(spark, d):
    by = Window.partitionBy("user_id").orderBy("ts")
    run = by.rowsBetween(Window.unboundedPreceding, 0)
    err = F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).over(run)
    step = F.round(F.col("value") - F.lag("value", 1, 0.0).over(by), 6)
    return Network(spark, d).read("events").select("user_id", "event_id", F.max("value").over(run).alias("peak"), step.alias("step"), err.alias("errors"))


@query("""SELECT user_id, k, round(1 - exp(sum(ln(1 - h)) OVER (PARTITION BY user_id ORDER BY k)), 9) AS cdf, round(h * exp(coalesce(sum(ln(1 - h)) OVER (PARTITION BY user_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)), 9) AS density
FROM (SELECT user_id, event_id % 8 AS k, avg(value) / 400 AS h FROM events GROUP BY ALL)""")
def survival_curve(spark, d):
    h = Network(spark, d).read("events").groupBy("user_id", (F.col("event_id") % 8).alias("k")).agg((F.avg("value") / 400).alias("h"))
    by = Window.partitionBy("user_id").orderBy("k")
    log = F.log1p(-F.col("h"))
    before = F.coalesce(F.sum(log).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return h.select("user_id", "k", F.round(1 - F.exp(F.sum(log).over(by)), 9).alias("cdf"), F.round(F.col("h") * F.exp(before), 9).alias("density"))


@query("""WITH s AS (SELECT event_id, round(value / 5) * 5 AS v, ntile(10) OVER (ORDER BY round(value / 5) * 5, event_id) AS tile, event_type = 'error' AS y FROM events),
e AS (SELECT tile, min(v) AS low, max(v) AS high FROM s GROUP BY tile), b AS (SELECT tile, sum(CASE WHEN low = high AND low = before THEN 0 ELSE 1 END) OVER (ORDER BY tile) AS bin FROM (SELECT *, lag(high) OVER (ORDER BY tile) AS before FROM e))
SELECT CAST(bin AS BIGINT) AS bin, count(*) AS n, round(avg(v), 6) AS mean_score, count(*) FILTER (y) AS positives FROM s JOIN b USING (tile) GROUP BY bin""")
def equal_mass_bins(spark, d):
    v = Network(spark, d).read("events").select("event_id", (F.round(F.col("value") / 5) * 5).alias("v"), (F.col("event_type") == "error").alias("y"))
    return r.tied_bins(v, "v", 10, "event_id").groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_score"), F.count_if("y").alias("positives"))


@query(SQL + """, h AS (SELECT CASE WHEN x < 24 THEN 0 WHEN x < 720 THEN 24 WHEN x < 7200 THEN 720 ELSE 7200 END AS low FROM (SELECT settled_t - due_t AS x FROM obligations WHERE settled_t > due_t)), c AS (SELECT low, count(*) AS n FROM h GROUP BY low)
SELECT low, n, CAST(sum(n) OVER (ORDER BY low) AS BIGINT) AS seen, round(sum(n) OVER (ORDER BY low) / sum(n) OVER (), 9) AS share FROM c""")
def cumulative_share(spark, d):
    x = F.col("settled_t") - F.col("due_t")
    low = F.when(x < 24, 0).when(x < 720, 24).when(x < 7200, 720).otherwise(7200)
    c = Network(spark, d).obligations.where("settled_t > due_t").groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    seen = F.sum("n").over(Window.orderBy("low"))  # four rows
    return c.select("low", "n", seen.alias("seen"), F.round(seen / F.sum("n").over(Window.partitionBy()), 9).alias("share"))


@query("SELECT user_id, count(*) FILTER (nxt > value) AS rises, count(*) FILTER (nxt IS NOT NULL) AS steps FROM (SELECT *, lead(value) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events) GROUP BY user_id")
def monotonicity(spark, d):
    v = Network(spark, d).read("events").withColumn("next", F.lead("value").over(Window.partitionBy("user_id").orderBy("ts")))
    return v.groupBy("user_id").agg(F.count_if(F.col("next") > F.col("value")).alias("rises"), F.count("next").alias("steps"))


@query("""WITH k(x, y) AS (VALUES (0, 0.0), (10, 0.05), (40, 0.4), (60, 0.7), (100, 1.0)), b AS (SELECT x AS x0, y AS y0, lead(x) OVER (ORDER BY x) AS x1, lead(y) OVER (ORDER BY x) AS y1 FROM k)
SELECT event_id, round(y0 + (y1 - y0) * (least(greatest(value, 0), 99.999999) - x0) / (x1 - x0), 6) AS p FROM events JOIN b ON least(greatest(value, 0), 99.999999) >= x0 AND least(greatest(value, 0), 99.999999) < x1""")
def linear_interpolation(spark, d):
    knots = spark.createDataFrame([(0.0, 10.0, 0.0, 0.05), (10.0, 40.0, 0.05, 0.4), (40.0, 60.0, 0.4, 0.7), (60.0, 100.0, 0.7, 1.0)], "x0 double, x1 double, y0 double, y1 double")
    v = Network(spark, d).read("events").select("event_id", e.clip(F.col("value"), 0, 99.999999).alias("x"))
    j = v.join(F.broadcast(knots), (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return j.select("event_id", F.round(F.col("y0") + (F.col("y1") - F.col("y0")) * (F.col("x") - F.col("x0")) / (F.col("x1") - F.col("x0")), 6).alias("p"))


@query(SQL + ROLES + "SELECT m AS merchant_id, n_events, throughput_minor FROM flow ORDER BY throughput_minor DESC, n_events, m LIMIT 12")
def top_exposures(spark, d):
    return roles(Network(spark, d))[2].select("merchant_id", "n_events", "throughput_minor").orderBy(F.desc("throughput_minor"), "n_events", "merchant_id").limit(12)


@query(SQL + "SELECT payee, string_agg(payer, ',' ORDER BY k) AS sources FROM (SELECT payee, payer, row_number() OVER (PARTITION BY payee ORDER BY total_minor DESC, payer) AS k FROM pairs) WHERE k <= 5 GROUP BY payee")
def top_sources(spark, d):
    top = r.top_per_group(Network(spark, d).pairs, ["payee"], [F.desc("total_minor"), F.col("payer")], 5)
    listed = F.array_sort(F.collect_list(F.struct("rank", "payer")))
    return top.groupBy("payee").agg(F.concat_ws(",", F.transform(listed, lambda x: x.payer)).alias("sources"))


@query(SQL + "SELECT source, target, round(pass_through * total_minor, 2) AS strength FROM edges ORDER BY pass_through * total_minor DESC, source, target LIMIT 25")
def dependency_ranking(spark, d):
    s = F.col("pass_through") * F.col("total_minor")
    return Network(spark, d).edges.orderBy(s.desc(), "source", "target").limit(25).select("source", "target", F.round(s, 2).alias("strength"))


@query(SQL + ROLES + """, k AS (SELECT merchant_id, opening_minor + credit_minor - floor_minor AS buffer, coalesce(payable_minor, 0) AS p, coalesce(degree, 0) AS g FROM merchants LEFT JOIN payable a ON a.m = merchant_id LEFT JOIN degree b ON b.m = merchant_id)
SELECT merchant_id, row_number() OVER (ORDER BY greatest(p - buffer, 0) DESC, merchant_id) AS by_deficit, row_number() OVER (ORDER BY g DESC, merchant_id) AS by_degree, row_number() OVER (ORDER BY CASE WHEN p > 0 THEN buffer / p END NULLS LAST, merchant_id) AS by_cover FROM k""")
def naive_rankings(spark, d):
    b = e.buffer("opening_minor", "credit_minor", "floor_minor")
    cover = F.when(F.col("payable_minor") > 0, b / F.col("payable_minor"))
    p = profiles(Network(spark, d)).select("merchant_id", "degree", F.greatest(F.col("payable_minor") - b, F.lit(0)).alias("deficit"), cover.alias("cover"))
    for name, order in (("by_deficit", F.desc("deficit")), ("by_degree", F.desc("degree")), ("by_cover", F.asc_nulls_last("cover"))):
        p = r.placed(p, [order, F.col("merchant_id")], name)
    return p.select("merchant_id", "by_deficit", "by_degree", "by_cover")


@query(SQL + ROLES + ", k AS (SELECT merchant_id, tier, throughput_minor AS v, max(throughput_minor) OVER () AS top, max(throughput_minor) OVER (PARTITION BY tier) AS tier_top FROM merchants JOIN flow ON m = merchant_id) SELECT merchant_id, round(v / top, 9) AS raw, round(v / tier_top, 9) AS own_scale FROM k")
def systemic_ranking(spark, d):
    n = Network(spark, d)
    k = n.merchants.join(roles(n)[2], "merchant_id")
    v = F.col("throughput_minor")
    top = k.agg(F.max(v).alias("top"))
    by_tier = k.groupBy("tier").agg(F.max(v).alias("tier_top"))
    return k.join(F.broadcast(by_tier), "tier").join(F.broadcast(top)).select("merchant_id", F.round(v / F.col("top"), 9).alias("raw"), F.round(v / F.col("tier_top"), 9).alias("own_scale"))


@query(SQL + "SELECT obligation_id, debtor, amount_minor, row_number() OVER (PARTITION BY debtor ORDER BY priority, due_t, amount_minor DESC, obligation_id) AS place FROM obligations WHERE amount_minor > paid_minor")
def settlement_queue(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    w = Window.partitionBy("debtor").orderBy("priority", "due_t", F.desc("amount_minor"), "obligation_id")
    return o.select("obligation_id", "debtor", "amount_minor", F.row_number().over(w).cast("long").alias("place"))


@query(SQL + "SELECT creditor, max(amount_minor - paid_minor) AS largest_minor, arg_min(obligation_id, (-(amount_minor - paid_minor), due_t, obligation_id)) AS obligation_id FROM obligations WHERE amount_minor > paid_minor GROUP BY creditor")
def largest_receivable(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    key = F.struct(-e.outstanding(), F.col("due_t"), F.col("obligation_id"))
    return o.groupBy("creditor").agg(F.max(e.outstanding()).alias("largest_minor"), F.min_by("obligation_id", key).alias("obligation_id"))


@query(SQL + ROLES + """, a AS (SELECT m, 2 * row_number() OVER (ORDER BY throughput_minor DESC, m) - 1 AS p FROM flow), b AS (SELECT m, 2 * row_number() OVER (ORDER BY degree DESC, m) AS p FROM degree)
SELECT m AS merchant_id, min(p) AS place FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY m ORDER BY place, m LIMIT 20""")
def interleaved_rankings(spark, d):
    _, _, flow, degree = roles(Network(spark, d))
    place = lambda df, c: r.placed(df, [F.desc(c), F.col("merchant_id")])
    both = place(flow, "throughput_minor").select("merchant_id", (2 * F.col("place") - 1).alias("p")).union(place(degree, "degree").select("merchant_id", 2 * F.col("place")))
    return both.groupBy("merchant_id").agg(F.min("p").alias("place")).orderBy("place", "merchant_id").limit(20)


@query(SQL + "SELECT obligation_id, amount_minor, cost FROM (SELECT DISTINCT obligation_id, amount_minor, round(0.0004 * 2 * amount_minor, 4) AS cost FROM obligations WHERE amount_minor > paid_minor) ORDER BY cost, obligation_id LIMIT 120")
def cheapest_first(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    cost = F.round(e.action_cost(F.lit("extension"), "amount_minor", F.lit(48.0)), 4)
    return o.select("obligation_id", "amount_minor", cost.alias("cost")).distinct().orderBy("cost", "obligation_id").limit(120)


@query(SQL + ROLES + """, ranked AS (SELECT m, row_number() OVER (ORDER BY throughput_minor DESC, m) AS k FROM flow), pool AS (SELECT * FROM ranked WHERE k <= 60)
SELECT m AS merchant_id, k AS place FROM pool WHERE k IN (SELECT CAST(round_even(1 + i * 59 / 9, 0) AS BIGINT) FROM range(10) r(i))""")
def evenly_spaced_pool(spark, d):
    flow = roles(Network(spark, d))[2]
    top = flow.orderBy(F.desc("throughput_minor"), "merchant_id").limit(60)
    top = top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("throughput_minor"), "merchant_id")).cast("long"))
    picks = spark.range(10).select(F.bround(1 + F.col("id") * 59 / 9, 0).cast("long").alias("place"))
    return top.join(F.broadcast(picks), "place", "left_semi").select("merchant_id", "place")


@query("SELECT o_custkey, max(o_totalprice) AS best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS o_orderkey FROM orders GROUP BY o_custkey")
def best_offer(spark, d):
    return Network(spark, d).read("orders").groupBy("o_custkey").agg(F.max("o_totalprice").alias("best"), F.max_by("o_orderkey", F.struct("o_totalprice", "o_orderkey")).alias("o_orderkey"))


@query("SELECT l_returnflag, l_linestatus, k, l_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC, l_orderkey) AS k FROM (SELECT DISTINCT l_returnflag, l_linestatus, l_extendedprice, l_orderkey FROM lineitem)) WHERE k IN (1, 5, 9)")
def stratified_picks(spark, d):
    x = Network(spark, d).read("lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice", "l_orderkey").distinct()
    top = r.top_per_group(x, ["l_returnflag", "l_linestatus"], [F.desc("l_extendedprice"), F.col("l_orderkey")], 9)
    return top.where("rank IN (1, 5, 9)").select("l_returnflag", "l_linestatus", F.col("rank").cast("long").alias("k"), "l_orderkey")


@query(SQL + ESTIMATE + ", p AS (SELECT source, target FROM est), q AS (SELECT source, target FROM edges) SELECT (SELECT count(*) FROM (SELECT * FROM p INTERSECT SELECT * FROM q)) AS tp, (SELECT count(*) FROM (SELECT * FROM p EXCEPT SELECT * FROM q)) AS fp, (SELECT count(*) FROM (SELECT * FROM q EXCEPT SELECT * FROM p)) AS fn")
def confusion_on_universe(spark, d):
    n = Network(spark, d)
    p, q = estimated_edges(n).select("source", "target", F.lit(1).alias("p")), n.edges.select("source", "target", F.lit(1).alias("q"))
    j = p.join(q, ["source", "target"], "full").na.fill(0)
    return j.agg(F.count_if(F.col("p") + F.col("q") == 2).alias("tp"), F.count_if(F.col("q") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn"))


@query(SQL + "SELECT obligation_id, min(part) AS part FROM (SELECT obligation_id, 0 AS part FROM obligations WHERE priority = 1 UNION ALL SELECT obligation_id, 1 FROM obligations WHERE debtor = 'N1' UNION ALL SELECT obligation_id, 2 FROM obligations WHERE creditor = 'S1') GROUP BY obligation_id")
def union_keep_first(spark, d):
    o = Network(spark, d).obligations
    parts = [o.where(c).select("obligation_id", F.lit(i).alias("part")) for i, c in enumerate(("priority = 1", "debtor = 'N1'", "creditor = 'S1'"))]
    return r.keep_first(parts, "obligation_id")


@query("SELECT user_id, 'train' AS split FROM events WHERE epoch_us(ts) < 1705000000000000 EXCEPT SELECT user_id, 'train' FROM events WHERE epoch_us(ts) >= 1706500000000000")
def split_disjointness(spark, d):
    v = Network(spark, d).read("events").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    early, late = v.where("us < 1705000000000000").select("user_id"), v.where("us >= 1706500000000000").select("user_id")
    return early.distinct().join(late.distinct(), "user_id", "left_anti").select("user_id", F.lit("train").alias("split"))


@query(SQL + """, a AS (SELECT debtor, creditor FROM obligations WHERE amount_minor > paid_minor AND priority = 3), b AS (SELECT debtor, creditor FROM obligations WHERE amount_minor > paid_minor AND priority = 4)
SELECT 'rescued' AS kind, debtor, creditor FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'newly', debtor, creditor FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def rescued_and_newly_affected(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    a, b = (o.where(F.col("priority") == p).select("debtor", "creditor").distinct() for p in (3, 4))
    less = lambda x, y, kind: x.join(y, ["debtor", "creditor"], "left_anti").select(F.lit(kind).alias("kind"), "debtor", "creditor")
    return less(a, b, "rescued").union(less(b, a, "newly"))


@query("SELECT (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P')) AS only_left, (SELECT count(*) FROM (SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus <> 'P' EXCEPT ALL SELECT o_orderkey, o_custkey FROM orders)) AS only_right")
def book_equality(spark, d):
    o = Network(spark, d).read("orders")
    a, b = o.select("o_orderkey", "o_custkey"), o.where("o_orderstatus <> 'P'").select("o_orderkey", "o_custkey")
    left, right = a.exceptAll(b).agg(F.count("*").alias("only_left")), b.exceptAll(a).agg(F.count("*").alias("only_right"))
    return left.join(F.broadcast(right))


@query(SQL + ROLES + "SELECT sector, merchant_id, round(CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0 END, 9) AS scaled FROM (SELECT sector, merchant_id, throughput_minor AS v, min(throughput_minor) OVER (PARTITION BY sector) AS lo, max(throughput_minor) OVER (PARTITION BY sector) AS hi FROM merchants JOIN flow ON m = merchant_id)")
def min_max_scale(spark, d):
    n = Network(spark, d)
    return n.merchants.join(roles(n)[2], "merchant_id").select("sector", "merchant_id", F.round(r.min_max_scaled("throughput_minor", ["sector"]), 9).alias("scaled"))





@query()
def greedy_budget_fill(spark, d):
    """Ranked candidates funded in order while the budget lasts, smaller ones after one that is too large.

    All open obligations of a debtor are folded in ranked order, batch by batch; a batch carries the money left on.
    """
    o = Network(spark, d).obligations.where(e.is_open())
    o = o.select("debtor", "priority", "due_t", "amount_minor", "obligation_id", e.outstanding().alias("need")).repartition("debtor")
    o = o.sortWithinPartitions("debtor", F.desc("priority"), "due_t", F.desc("amount_minor"), "obligation_id", "need")
    return o.select("debtor", "need").mapInArrow(funded(300_000_000), "debtor string, left_minor long, n_picks int")


def funded(budget: int):
    """Money left and number of candidates funded for each debtor of (debtor, need), sorted by debtor and rank."""

    def run(batches):
        debtor, left, picks = None, budget, 0
        for batch in batches:
            done = []
            for who, need in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if who != debtor:
                    if debtor is not None:
                        done.append((debtor, left, picks))
                    debtor, left, picks = who, budget, 0
                if need <= left:
                    left, picks = left - need, picks + 1
            yield given(done)
        if debtor is not None:
            yield given([(debtor, left, picks)])

    def given(rows):
        kinds = (pa.string(), pa.int64(), pa.int32())
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], t) for k, t in enumerate(kinds)], ["debtor", "left_minor", "n_picks"])

    return run
