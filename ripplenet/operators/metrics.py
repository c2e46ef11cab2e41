"""Ranking, calibration and timing metrics as window and aggregate expressions.

Scores are ranked over distinct values, not rows: counts per value are aggregated first (map-side), and the
ordered window runs over those counts.  Ties therefore count as one step, which is a function of the data alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.relational import placed


def steps(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Per distinct score, from the highest: positives and rows of it and of all above it."""
    per = df.groupBy(*by, F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    over = Window.partitionBy(*by) if by else Window.partitionBy()
    run = over.orderBy(F.desc("score"))
    return per.withColumns({"tp": F.sum("pos").over(run), "seen": F.sum("n").over(run), "positives": F.sum("pos").over(over), "rows": F.sum("n").over(over)})


def average_precision(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Mean precision over positives; null where there are none."""
    s = steps(df, score, label, by)
    return s.groupBy(*by).agg((F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / F.nullif(F.max("positives"), F.lit(0))).alias("average_precision"))


def roc_auc(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Chance that a positive outranks a negative, ties one half; null if one class is missing."""
    s = steps(df, score, label, by)
    neg = F.col("n") - F.col("pos")
    below = (F.col("rows") - F.col("positives")) - (F.col("seen") - F.col("tp"))
    wins = F.sum(F.col("pos") * below + F.col("pos") * neg / 2)
    return s.groupBy(*by).agg((wins / F.nullif(F.max("positives") * (F.max("rows") - F.max("positives")), F.lit(0))).alias("auc"))


def best_f1(df: DataFrame, score: str, label: str, by: list[str]) -> DataFrame:
    """Best F1 over thresholds and the (highest) threshold that reaches it."""
    s = steps(df, score, label, by).withColumn("f1", 2 * F.col("tp") / (F.col("seen") + F.col("positives")))
    return s.groupBy(*by).agg(F.max("f1").alias("f1"), F.max_by("score", F.struct("f1", "score")).alias("threshold"))


def confusion(predicted: Column, actual: Column) -> list[Column]:
    return [
        F.count_if(predicted & actual).alias("tp"),
        F.count_if(predicted & ~actual).alias("fp"),
        F.count_if(~predicted & actual).alias("fn"),
        F.count_if(~predicted & ~actual).alias("tn"),
    ]


def precision_recall(counts: DataFrame) -> DataFrame:
    tp, p, a = F.col("tp"), F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")
    ratio = lambda x, y: F.coalesce(F.try_divide(x, y), F.lit(0.0))
    return counts.select("*", ratio(tp, p).alias("precision"), ratio(tp, a).alias("recall"), ratio(2 * tp, p + a).alias("f1"))


def log_loss(p: Column, y: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.when(y, F.log(q)).otherwise(F.log(1 - q)))


def spearman(df: DataFrame, a: str, b: str, key: str) -> DataFrame:
    """Correlation of ordinal ranks (ties by key); 0 on a constant column."""
    r = placed(placed(df.select(a, b, key), [F.col(a), F.col(key)], "__a"), [F.col(b), F.col(key)], "__b").select(F.col("__a").alias("a"), F.col("__b").alias("b"))
    return r.agg(F.coalesce(F.corr("a", "b"), F.lit(0.0)).alias("spearman"))


def bootstrap(df: DataFrame, value: str, cluster: str, by: list[str], draws: int, seed: str) -> DataFrame:
    """Percentile interval of the mean under resampled clusters.

    Every cluster gets a Poisson(1) multiplicity per draw from a hash of (seed, draw, cluster): no random state,
    one pass, partial sums per cluster.
    """
    sums = df.groupBy(*by, cluster).agg(F.sum(value).alias("s"), F.count(value).alias("n"))
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("draw"), F.col(cluster)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    cdf = (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)
    times = sum(((u >= c).cast("int") for c in cdf[1:]), (u >= cdf[0]).cast("int"))
    drawn = sums.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("times", times)
    means = drawn.groupBy(*by, "draw").agg((F.sum(F.col("times") * F.col("s")) / F.nullif(F.sum(F.col("times") * F.col("n")), F.lit(0))).alias("m"))
    return means.groupBy(*by).agg(F.percentile("m", 0.025).alias("low"), F.percentile("m", 0.975).alias("high"))
