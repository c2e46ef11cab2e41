"""Evaluation metrics; scores and labels come from the events table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.operators import metrics as m
from ripplenet.operators import ranked
from ripplenet.operators import relational as r
from ripplenet.plans.registry import query
from ripplenet.sources.network import Network

BASE = "WITH b AS (SELECT event_id, user_id, round(value / 4) * 4 / 100 AS score, event_type IN ('error','purchase') AS y, user_id % 4 AS family, value FROM events)\n"


def scored(spark, d):
    v = Network(spark, d).read("events")
    return v.select("event_id", "user_id", (F.round(F.col("value") / 4) * 4 / 100).alias("score"), F.col("event_type").isin("error", "purchase").alias("y"), (F.col("user_id") % 4).alias("family"), "value")


STEPS = ", s AS (SELECT family, score, sum(y::INT) AS pos, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS seen, sum(pos) OVER (PARTITION BY family) AS positives, sum(n) OVER (PARTITION BY family) AS rows FROM s WINDOW w AS (PARTITION BY family ORDER BY score DESC)) "
SBASE = BASE.rstrip() + STEPS


@query(SBASE + "SELECT family, round(sum(pos * tp / seen) / max(positives), 9) AS average_precision FROM t GROUP BY family")
def average_precision(spark, d):
    return m.average_precision(scored(spark, d), "score", "y", ["family"]).select("family", F.round("average_precision", 9).alias("average_precision"))


@query(SBASE + "SELECT family, round(sum(pos * ((rows - positives) - (seen - tp)) + pos * (n - pos) / 2) / (max(positives) * (max(rows) - max(positives))), 9) AS auc FROM t GROUP BY family")
def roc_auc(spark, d):
    return m.roc_auc(scored(spark, d), "score", "y", ["family"]).select("family", F.round("auc", 9).alias("auc"))


@query(SBASE + "SELECT family, round(max(2 * tp / (seen + positives)), 9) AS f1, arg_max(score, (2 * tp / (seen + positives), score)) AS threshold FROM t GROUP BY family")
def best_f1_threshold(spark, d):
    return m.best_f1(scored(spark, d), "score", "y", ["family"]).select("family", F.round("f1", 9).alias("f1"), "threshold")


@query(BASE + """, c AS (SELECT family, count(*) FILTER (score > 0.5 AND y) AS tp, count(*) FILTER (score > 0.5 AND NOT y) AS fp, count(*) FILTER (score <= 0.5 AND y) AS fn, count(*) FILTER (score <= 0.5 AND NOT y) AS tn FROM b GROUP BY family)
SELECT *, round(tp/(tp+fp), 9) AS precision, round(tp/(tp+fn), 9) AS recall, round(2*tp/(2*tp+fp+fn), 9) AS f1 FROM c""")
def confusion_metrics(spark, d):
    c = scored(spark, d).groupBy("family").agg(*m.confusion(F.col("score") > 0.5, F.col("y")))
    return m.precision_recall(c).withColumns({x: F.round(x, 9) for x in ("precision", "recall", "f1")})


@query(BASE + ", p AS (SELECT user_id, max(value) FILTER (y) AS hit, max(value) FILTER (NOT y) AS truth FROM b GROUP BY user_id) SELECT count(*) AS n, round(avg(abs(hit - truth)), 6) AS mae, round(sqrt(avg((hit-truth)*(hit-truth))), 6) AS rmse, round(median(abs(hit - truth)), 6) AS median_error, round(avg(hit - truth), 6) AS bias, round(avg((abs(hit-truth) <= 6)::INT), 6) AS within_6, round(avg((abs(hit-truth) <= 24)::INT), 6) AS within_24 FROM p WHERE hit IS NOT NULL AND truth IS NOT NULL")
def timing_errors(spark, d):
    p = scored(spark, d).groupBy("user_id").agg(F.max(F.when(F.col("y"), F.col("value"))).alias("hit"), F.max(F.when(~F.col("y"), F.col("value"))).alias("truth")).dropna()
    x = F.col("hit") - F.col("truth")
    near = lambda h: F.round(F.avg((F.abs(x) <= h).cast("int")), 6)
    return p.agg(F.count("*").alias("n"), F.round(F.avg(F.abs(x)), 6).alias("mae"), F.round(F.sqrt(F.avg(x * x)), 6).alias("rmse"), F.round(F.median(F.abs(x)), 6).alias("median_error"), F.round(F.avg(x), 6).alias("bias"), near(6).alias("within_6"), near(24).alias("within_24"))


@query(BASE + "SELECT family, round(avg((score - y::INT) * (score - y::INT)), 9) AS brier, round(avg(-CASE WHEN y THEN ln(least(greatest(score,1e-6),1-1e-6)) ELSE ln(1-least(greatest(score,1e-6),1-1e-6)) END), 9) AS log_loss FROM b GROUP BY family")
def brier_and_log_loss(spark, d):
    e = F.col("score") - F.col("y").cast("int")
    return scored(spark, d).groupBy("family").agg(F.round(F.avg(e * e), 9).alias("brier"), F.round(m.log_loss(F.col("score"), F.col("y")), 9).alias("log_loss"))


@query(BASE + ", k AS (SELECT *, ntile(10) OVER (ORDER BY score, event_id) AS bin FROM b), c AS (SELECT bin, count(*) AS n, avg(score) AS conf, avg(y::INT) AS rate FROM k GROUP BY bin) SELECT round(sum(n * abs(conf - rate)) / sum(n), 9) AS ece, round(max(abs(conf - rate)), 9) AS mce FROM c")
def calibration_error(spark, d):
    k = r.tiled(scored(spark, d), [F.col("score"), F.col("event_id")], 10, "bin")
    c = k.groupBy("bin").agg(F.count("*").alias("n"), F.avg("score").alias("conf"), F.avg(F.col("y").cast("int")).alias("rate"))
    gap = F.abs(F.col("conf") - F.col("rate"))
    return c.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 9).alias("ece"), F.round(F.max(gap), 9).alias("mce"))


@query(BASE + "SELECT family, round(avg(y::INT), 6) AS precision_at_20 FROM (SELECT *, row_number() OVER (PARTITION BY family ORDER BY score DESC, event_id) AS k FROM b) WHERE k <= 20 GROUP BY family")
def precision_at_k(spark, d):
    top = r.top_per_group(scored(spark, d), ["family"], [F.desc("score"), F.col("event_id")], 20)
    return top.groupBy("family").agg(F.round(F.avg(F.col("y").cast("int")), 6).alias("precision_at_20"))


@query(BASE + ", t AS (SELECT user_id, min(value) AS seen, avg(score) AS risk FROM b GROUP BY user_id) SELECT count(*) AS pairs, count(*) FILTER ((a.seen < b.seen AND a.risk > b.risk) OR (a.seen > b.seen AND a.risk < b.risk)) AS concordant, count(*) FILTER (a.risk = b.risk) AS tied FROM t a JOIN t b ON a.user_id < b.user_id AND a.seen <> b.seen")
def concordance_index(spark, d):
    """A user's scores are added up in the order of events: sums of doubles depend on the order, and with them which users tie."""
    own = Window.partitionBy("user_id").orderBy("event_id", "value").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    b = scored(spark, d).where("user_id is not null").withColumn("risk", F.avg("score").over(own))
    t = b.groupBy("user_id").agg(F.min("value").alias("seen"), F.first("risk").alias("risk"))
    return ranked.concordance(t, "seen", "risk")


@query(BASE + ", t AS (SELECT user_id, row_number() OVER (ORDER BY avg(value), user_id) AS a, row_number() OVER (ORDER BY count(*), user_id) AS b FROM b GROUP BY user_id) SELECT round(corr(a, b), 6) AS spearman FROM t")
def spearman(spark, d):
    t = scored(spark, d).groupBy("user_id").agg(F.avg("value").alias("a"), F.count("*").alias("b"))
    return m.spearman(t, "a", "b", "user_id").select(F.round("spearman", 6).alias("spearman"))


@query(BASE + "SELECT family, CASE WHEN value < 24 THEN 'short' ELSE 'long' END AS horizon, count(*) AS n, round(avg(y::INT), 6) AS prevalence FROM b GROUP BY ALL")
def pooled_slices(spark, d):
    return scored(spark, d).groupBy("family", F.when(F.col("value") < 24, "short").otherwise("long").alias("horizon")).agg(F.count("*").alias("n"), F.round(F.avg(F.col("y").cast("int")), 6).alias("prevalence"))


@query(BASE + ", s AS (SELECT user_id % 25 AS scenario, family, avg(value) AS v FROM b GROUP BY ALL) SELECT s.scenario, s.family, round((s.v - r.v) / nullif(r.v, 0), 9) AS gap, round(greatest(s.v - r.v, 0), 6) AS regret FROM (SELECT *, min(family) OVER (PARTITION BY scenario) AS m FROM s) s JOIN s r ON r.scenario = s.scenario AND r.family = s.m")
def optimality_gap(spark, d):
    s = scored(spark, d).groupBy((F.col("user_id") % 25).alias("scenario"), "family").agg(F.avg("value").alias("v"))
    ref = s.groupBy("scenario").agg(F.min_by("v", "family").alias("ref"))
    return s.join(ref, "scenario").select("scenario", "family", F.round(F.try_divide(F.col("v") - F.col("ref"), F.col("ref")), 9).alias("gap"), F.round(F.greatest(F.col("v") - F.col("ref"), F.lit(0.0)), 6).alias("regret"))


@query(BASE + "SELECT family, round(avg(score), 6) AS score FROM b GROUP BY family ORDER BY score DESC NULLS LAST, family LIMIT 3")
def metric_leaderboard(spark, d):
    s = scored(spark, d).groupBy("family").agg(F.round(F.avg("score"), 6).alias("score"))
    return s.orderBy(F.coalesce("score", F.lit(0.0)).desc(), "family").limit(3)


@query()
def clustered_bootstrap(spark, d):
    x = m.bootstrap(scored(spark, d), "score", "user_id", ["family"], 200, "ci")
    return x.select("family", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"))
