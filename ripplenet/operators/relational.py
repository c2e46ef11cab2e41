"""Relational building blocks that the DataFrame API lacks, as compositions of what it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ripplenet.operators.graph import cut


def asof_join(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, carry: list[str], *, max_gap: float | None = None) -> DataFrame:
    """Each left row with the latest right row of its key strictly before it.

    Both sides go through one shuffle on the key and one sorted window; no pairs are made, so a key with
    many rows costs a sort.  Right rows tie-break on the carried columns; left rows without a match keep nulls.
    Rows of equal time count as simultaneous: they never match.
    """
    marks = F.struct(F.col(right_t).alias("t"), *carry)
    l = left.select("*", F.col(left_t).alias("__t"), F.lit(None).cast(right.select(marks.alias("m")).schema["m"].dataType).alias("__m"), F.lit(0).alias("__side"))
    filler = [F.lit(None).cast(f.dataType).alias(f.name) if f.name != key else F.col(key) for f in left.schema.fields]
    r = right.select(*filler, F.col(right_t).alias("__t"), marks.alias("__m"), F.lit(1).alias("__side"))
    # left rows come first among equal times, so that they see earlier rows alone
    w = Window.partitionBy(key).orderBy("__t", "__side", F.col("__m")).rowsBetween(Window.unboundedPreceding, -1)
    out = l.union(r).withColumn("__last", F.last("__m", ignorenulls=True).over(w)).where("__side = 0")
    if max_gap is not None:
        out = out.withColumn("__last", F.when(F.col("__t") - F.col("__last.t") <= max_gap, F.col("__last")))
    return out.select(*left.columns, F.col("__last.t").alias(right_t), *[F.col(f"__last.{c}").alias(c) for c in carry])


def latest_marks(points: DataFrame, marks: DataFrame, key: str, t: str, mark_t: str, n: int, tie: list[str], *, outer: bool = False) -> DataFrame:
    """(point, back, points' columns, mark): each point with its key's ``n`` latest marks strictly before it.

    ``point`` numbers the points, ``back`` is 1 for the latest mark; points without a mark are in the result with ``outer`` alone (and n = 1).
    Points and marks are sorted together by ranges of (key, time) and marks counted along that order; a point's
    marks are those of the last ``n`` places.  A key of any size is spread over ranges, and nothing but counts
    meets in one task.  Marks of equal time are ordered by ``tie``.
    """
    one = points.select(F.col(key).alias("__key"), F.col(t).alias("__t"), F.lit(0).alias("__side"), F.struct(*points.columns).alias("__point"))
    two = marks.select(F.col(key).alias("__key"), F.col(mark_t).alias("__t"), F.lit(1).alias("__side"), F.struct(*marks.columns).alias("__mark"))
    both = one.unionByName(two, allowMissingColumns=True).where("__key is not null and __t is not null")
    order = ["__key", "__t", "__side", *[F.col(f"__mark.{x}") for x in tie], "__tie"]
    both = both.withColumn("__tie", F.xxhash64("__point", "__mark"))
    ranged = cut(both.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sums = ranged.groupBy("__range").agg(F.sum("__side").alias("n"))  # one row a range
    starts = sums.select("__range", F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    own = Window.partitionBy("__range").orderBy(*order)
    rows = ranged.withColumns({"__own": F.sum("__side").over(own.rowsBetween(Window.unboundedPreceding, 0)), "__row": F.row_number().over(own)})
    rows = cut(rows.join(F.broadcast(starts), "__range").withColumn("__place", F.col("__start") + F.col("__own")))
    asked = rows.where("__side = 0").select(F.expr("(bigint(__range) << 32) + __row").alias("point"), "__key", "__t", "__point", F.col("__place").alias("__last"))
    asked = asked.withColumn("__place", F.explode(F.sequence(F.greatest(F.col("__last") - n + 1, F.lit(1)), F.greatest("__last", F.lit(1)))))
    held = rows.where("__side = 1").select("__place", F.col("__key").alias("__mark_key"), F.col("__t").alias("__mark_t"), "__mark")
    held = held.withColumnRenamed("__place", "__at")
    found = asked.join(held, F.expr("__at = __place and __mark_key = __key and __mark_t < __t"), "left" if outer else "inner")
    return found.select("point", (F.col("__last") - F.col("__place") + 1).cast("int").alias("back"), "__point.*", F.col("__mark").alias("mark"))


def asof_join_spread(left: DataFrame, right: DataFrame, key: str, left_t: str, right_t: str, carry: list[str], *, max_gap: float | None = None) -> DataFrame:
    """:func:`asof_join` for keys that may hold a large part of all rows: ranges of (key, time) take the place of a window per key.

    Costs a range sort written once and a join by place; a left row with a null key or time keeps nulls.
    """
    found = latest_marks(left, right.select(key, right_t, *carry), key, left_t, right_t, 1, carry, outer=True)
    near = F.lit(True) if max_gap is None else F.col(left_t) - F.col(f"mark.{right_t}") <= max_gap
    names = [right_t, *carry]
    out = found.select(*left.columns, *[F.when(near, F.col(f"mark.{c}")).alias(c) for c in names])
    lost = left.where(F.col(key).isNull() | F.col(left_t).isNull())
    return out.union(lost.select(*left.columns, *[F.lit(None).cast(out.schema[c].dataType).alias(c) for c in names]))


def interval_join(points: DataFrame, other: DataFrame, key: str, t: str, other_t: str, reach: float) -> DataFrame:
    """Pairs of one key with ``t - reach <= other_t < t``.

    Time is cut into buckets of ``reach``: a point meets the bucket it lies in and the one before, which
    bounds the pairs looked at by a small multiple of those returned.
    """
    b = F.floor(F.col(t) / reach)
    left = points.withColumn("__b", F.explode(F.array(b - 1, b)))
    right = other.withColumn("__b", F.floor(F.col(other_t) / reach))
    hit = (F.col(other_t) < F.col(t)) & (F.col(other_t) >= F.col(t) - reach)
    return left.join(right, [key, "__b"]).where(hit).drop("__b")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark prunes on the map side (window group limit)."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def keep_first(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of the parts, each key once, from the earliest part that has it."""
    tagged = [p.withColumn("__part", F.lit(i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for p in tagged[1:]:
        both = both.unionByName(p)
    order = [F.col("__part"), *[F.col(c) for c in parts[0].columns if c != key]]
    return top_per_group(both, [key], order, 1).drop("__part", "rank")


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def min_max_scaled(col: str, by: list[str]) -> Column:
    """0 to 1 within the group; 0 where the column is constant."""
    w = Window.partitionBy(*by)
    low, high = F.min(col).over(w), F.max(col).over(w)
    return F.when(high > low, (F.col(col) - low) / (high - low)).otherwise(F.lit(0.0))


def average_rank(value: Column, by: list[str] | None = None) -> Column:
    """1-based rank, ties averaged; without ``by`` the whole column is ranked in one task: see :func:`average_places`."""
    over = Window.partitionBy(*by) if by else Window.partitionBy()
    return F.rank().over(over.orderBy(value)) + (F.count("*").over((Window.partitionBy(*(by or []), value))) - 1) / 2


def placed(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with the 1-based place of each row in a total order.

    Rows are dealt by ranges of the whole order, so ties of one value spread too; ranges are written once, counted,
    and numbered from where the ranges before them end.  Only one count a range meets in one task.
    """
    ranged = cut(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("__range", before.alias("__start"))  # one row a partition
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(starts), "__range").withColumn(name, (F.col("__start") + F.col("__own")).cast("long")).drop("__range", "__own", "__start")


def tiled(df: DataFrame, order: list[Column], n: int, name: str = "tile") -> DataFrame:
    """``df`` with the tile 1..n of each row, as SQL's ntile: the first tiles hold one row more where n does not divide."""
    size = df.agg(F.count("*").alias("__size"))
    base, more = F.expr(f"__size div {n}"), F.col("__size") % n
    at = F.col("__place") - 1
    long = more * (base + 1)  # rows in the tiles that hold one more
    tile = F.when(at < long, F.floor(at / (base + 1))).otherwise(more + F.floor((at - long) / F.greatest(base, F.lit(1)))) + 1
    return placed(df, order, "__place").join(F.broadcast(size)).withColumn(name, tile.cast("long")).drop("__place", "__size")


def tied_bins(df: DataFrame, value: str, n: int, key: str) -> DataFrame:
    """Equal-mass bins of a sorted column; a bin whose values all tie with the tail of the one before joins it."""
    tiles = tiled(df, [F.col(value), F.col(key)], n)
    edges = tiles.groupBy("tile").agg(F.min(value).alias("low"), F.max(value).alias("high"))
    w = Window.orderBy("tile")
    joined = (F.col("low") == F.col("high")) & (F.col("low") == F.lag("high").over(w))
    edges = edges.withColumn("bin", F.sum(F.when(F.coalesce(joined, F.lit(False)), 0).otherwise(1)).over(w))
    return tiles.join(F.broadcast(edges.select("tile", "bin")), "tile").drop("tile")  # n rows


def average_places(df: DataFrame, value: str, key: str, name: str) -> DataFrame:
    """``df`` with the 1-based rank of a column over all rows, ties averaged, from places and sums per value."""
    rows = placed(df, [F.col(value), F.col(key)], "__at")
    mean = rows.groupBy(value).agg(((F.min("__at") + F.max("__at")) / 2).alias(name))
    return rows.drop("__at").join(mean, value)


def value_matrix(pairs: DataFrame, rows: str, cols: str, value: str, columns: list[str]) -> DataFrame:
    """Dense form of a pair table for a stated list of columns."""
    return pairs.groupBy(rows).pivot(cols, columns).agg(F.sum(value)).na.fill(0)
