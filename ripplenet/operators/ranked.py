"""Exact rank statistics without pairs and without one-task sorts: inversions, concordance, monotone fits.

Rows are placed in a total order by ranges; what one task sees is a stretch of places of bounded size, and what
meets in one place is one number per pair of stretches or one row per range.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.graph import cut
from ripplenet.operators.relational import latest_marks, placed

#: Stretches of places per order at most (their pairs are counted on the driver), and the least places of one.
STRETCHES, LEAST_BITS = 1024, 14


def inversions(y: np.ndarray, n: np.ndarray, low: int, high: int) -> int:
    """Weighted pairs (i before j) with y[i] > y[j] whose highest differing bit is one of low .. high - 1.

    The order is refined bit by bit: among rows equal in all higher bits, every 1 before a 0 is a pair.
    """
    y, n = y.astype(np.int64), n.astype(np.int64)
    total = 0
    order = np.argsort(y >> high, kind="stable")
    y, n = y[order], n[order]
    for bit in reversed(range(low, high)):
        one = (y >> bit) & 1
        ones = np.cumsum(n * one)
        head = np.r_[True, (y[1:] >> (bit + 1)) != (y[:-1] >> (bit + 1))] if len(y) else np.zeros(0, bool)
        base = (ones - n * one)[head][np.cumsum(head) - 1] if len(y) else ones
        total += sum(int(x) for x in (n * (1 - one) * (ones - base)))
        order = np.argsort(y >> bit, kind="stable")
        y, n = y[order], n[order]
    return total


def concordance(rows: DataFrame, time: str, risk: str) -> DataFrame:
    """(pairs, concordant, tied): pairs of rows of different times; those whose earlier row has the higher risk; those of equal risk.

    Equal (time, risk) rows are counted together first.  Ties are ordered so that none is an inversion: by (time, risk) one
    way and by (risk, time) the other.  Both orders are cut into stretches; a pair of rows in different stretches of both is counted from
    sums per pair of stretches, one in the same stretch of time by the task that holds it, and the rest by the task of the stretch of risk.
    """
    points = rows.where(f"{time} is not null and {risk} is not null").groupBy(F.col(time).alias("a"), F.col(risk).alias("b")).agg(F.count("*").alias("n"))
    at = placed(points, [F.col("a"), F.col("b")], "x")
    at = cut(placed(at, [F.col("b"), F.col("a")], "y").select("a", "b", "n", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y")))
    size, total = at.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = max(LEAST_BITS, (max(size, 1) // STRETCHES).bit_length())
    top = max(int(size).bit_length(), bits)

    def counted(key: str, low: int, high: int) -> DataFrame:
        def run(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("x")
            return pd.DataFrame({"found": [str(inversions(group["y"].to_numpy(), group["n"].to_numpy(), low, high))]})

        stretch = F.shiftright(key, bits).alias("stretch")
        return at.select(stretch, "x", "y", "n").groupBy("stretch").applyInPandas(run, "found string")

    near = counted("x", bits, top).union(counted("y", 0, bits)).agg(F.sum(F.col("found").cast("decimal(38,0)")).alias("near"))
    cells = at.groupBy(F.shiftright("x", bits).cast("int").alias("i"), F.shiftright("y", bits).cast("int").alias("j")).agg(F.sum("n").alias("n")).collect()  # STRETCHES squared at most
    far = 0
    if cells:
        grid = np.zeros((max(r.i for r in cells) + 1, max(r.j for r in cells) + 1), object)
        for r in cells:
            grid[r.i, r.j] = r.n
        above = np.cumsum(np.cumsum(grid, 0)[:, ::-1], 1)[:, ::-1]  # rows up to i, columns from j
        far = int((grid[1:, :-1] * above[:-1, 1:]).sum()) if grid.size > 1 and min(grid.shape) > 1 else 0
    two = lambda x: F.coalesce(F.sum((x * (x - 1) / 2).cast("decimal(38,0)")), F.lit(0))
    n = F.col("n").cast("decimal(19,0)")
    same = at.groupBy("a").agg(F.sum("n").cast("decimal(19,0)").alias("n")).agg(two(n).alias("same_time"))
    risk_ties = at.groupBy("b").agg(F.sum("n").cast("decimal(19,0)").alias("n")).agg(two(n).alias("same_risk"))
    both = at.agg(two(n).alias("same_both"))
    out = near.join(F.broadcast(same)).join(F.broadcast(risk_ties)).join(F.broadcast(both))  # one row each
    return out.select(
        (F.lit(total * (total - 1) // 2) - F.col("same_time")).cast("long").alias("pairs"), (F.coalesce("near", F.lit(0)) + F.lit(far)).cast("long").alias("concordant"), (F.col("same_risk") - F.col("same_both")).cast("long").alias("tied")
    )


def _pooled(batches):
    """Blocks of a stretch of rising scores, adjacent violators pooled; rows come sorted within a range."""
    held: list[list[float]] = []
    where = None

    def out():
        names = ["range", "y", "n", "low", "high"]
        return pa.RecordBatch.from_arrays([pa.array([where] * len(held), pa.int64()), *(pa.array([float(h[i]) for h in held]) for i in range(4))], names)

    for batch in batches:
        for at, y, n, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if at != where and held:
                yield out()
                held = []
            where = at
            held.append([y, n, low, high])
            while len(held) > 1 and held[-2][0] * held[-1][1] >= held[-1][0] * held[-2][1]:
                y, n, _, high = held.pop()
                held[-1] = [held[-1][0] + y, held[-1][1] + n, held[-1][2], high]
    if held:
        yield out()


def monotone_blocks(rows: DataFrame, score: str, label: str) -> DataFrame:
    """(low, high, rate, n): the blocks of the least-squares rising fit of label on score, exact at any number of scores.

    Labels are added up per distinct score, scores cut into ranges and violators pooled within each.  Where the last block of a range
    violates the first of the next, these ranges join and are pooled again; pooling in any order ends at the same fit.
    Only a row per range is compared in one place.
    """
    per = rows.where(f"{score} is not null and {label} is not null").groupBy(F.col(score).cast("double").alias("x")).agg(F.sum(F.col(label).cast("double")).alias("y"), F.count("*").cast("double").alias("n"))
    ranged = per.repartitionByRange("x").sortWithinPartitions("x").select(F.spark_partition_id().cast("long").alias("range"), "y", "n", F.col("x").alias("low"), F.col("x").alias("high"))
    schema = "range long, y double, n double, low double, high double"
    blocks = cut(ranged.mapInArrow(_pooled, schema))
    while True:
        ends = blocks.groupBy("range").agg(F.min_by(F.struct("y", "n"), "low").alias("first"), F.max_by(F.struct("y", "n"), "low").alias("last"), F.min("low").alias("low"))
        w = Window.orderBy("low")  # a row per range
        before = F.lag("last").over(w)
        fits = F.coalesce(before["y"] * F.col("first.n") < F.col("first.y") * before["n"], F.lit(True))
        chains = ends.withColumn("head", fits).withColumn("chain", F.sum(F.col("head").cast("long")).over(w))
        if chains.where("not head").isEmpty():
            break
        joined = blocks.join(F.broadcast(chains.select("range", "chain")), "range").select(F.col("chain").alias("range"), "y", "n", "low", "high")
        blocks = cut(joined.repartition("range").sortWithinPartitions("range", "low").mapInArrow(_pooled, schema))
    return blocks.select("low", "high", (F.col("y") / F.col("n")).alias("rate"), "n")


def calibrated(rows: DataFrame, score: str, blocks: DataFrame, name: str) -> DataFrame:
    """``rows`` with the fit at their score: a block's rate inside it, on the line between blocks, flat outside.

    A score finds the block before it by their places in one range order, so neither blocks nor scores are gathered.
    """
    knots = placed(blocks, [F.col("low")], "at")
    after = knots.select((F.col("at") - 1).alias("at"), F.col("low").alias("next_low"), F.col("rate").alias("next_rate"))
    knots = cut(knots.join(after, "at", "left").withColumn("one", F.lit(1)))
    asked = rows.where(F.col(score).isNotNull()).select(F.col(score).cast("double").alias("x")).distinct().withColumn("one", F.lit(1))
    # the block before is strictly below: the score itself may begin the next one
    found = latest_marks(asked, knots.select("one", "low", "high", "rate", "next_low", "next_rate"), "one", "x", "low", 1, ["rate"])
    x, m = F.col("x"), F.col("mark")
    part = (x - m["high"]) / (m["next_low"] - m["high"])
    value = F.when(x <= m["high"], m["rate"]).when(m["next_low"].isNull(), m["rate"]).otherwise(m["rate"] + (m["next_rate"] - m["rate"]) * part)
    first = knots.where("at = 1").select(F.col("rate").alias("first_rate"))  # one row
    values = asked.join(found.select("x", value.alias("value")), "x", "left").join(F.broadcast(first)).select("x", F.coalesce("value", "first_rate").alias(name))
    return rows.join(values, rows[score].cast("double") == values["x"], "left").drop("x")
