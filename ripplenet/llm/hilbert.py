"""Shards along a Hilbert curve over quantised metadata.

Language, source and length are quantised order-preserving and equi-depth, one byte range or
size class per cell side; the cell's place on the Hilbert curve orders the rows; runs of
near equal bytes become shards, so that min/max statistics of a file prune on any dimension.

Equal texts stand together whatever their metadata say: a group takes the cell of its
smallest place on the curve, and a shard's end falls beside a group, not inside it, unless the group is larger
than a quarter of a shard.

Plan: nothing is sorted globally.  Bytes and rows are summed per part: a cell's rows are cut into parts by the
leading bits of the text's checksum, as many as its count asks for, and a group of very many equal texts is
cut further by ids.  Prefix sums run over those sums, and only rows of one part are ordered among themselves.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c


def hilbert_index(coords: np.ndarray, bits: int) -> np.ndarray:
    """Place on the curve of each row of ``coords`` (n, dims), by Skilling's transform."""
    x = coords.astype(np.int64).T.copy()
    dims = len(x)
    for b in range(bits - 1, 0, -1):
        bit, low = 1 << b, (1 << b) - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, 0) ^ swap
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where(x[-1] & (1 << b), (1 << b) - 1, 0)
    x ^= flip
    out = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> b & 1)
    return out


def string_key(col: Column) -> Column:
    """The first six bytes as a number of the same order; null sorts as empty."""
    return F.conv(F.rpad(F.hex(F.substring(F.coalesce(col, F.lit("")).cast("binary"), 1, 6)), 12, "0"), 16, 10).cast("long")


def hilbert_shards(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    dims: tuple[str, ...] = ("lang", "source"),
    shards: int = 40,
    bits: int = 5,
    rows_a_part: int = 1024,
    overhead: int = 16,
) -> DataFrame:
    """(doc_id, size, text_crc32, curve, shard, slot) for every row.

    ``size`` is the text's UTF-8 bytes plus ``overhead``; null texts count as empty.  The curve's
    dimensions are ``dims`` (strings; null is the empty string) and the size.  Shard boundaries
    cut the order at equal bytes, each at the nearest edge of a row or of a group of equal texts (same checksum and size)
    that is no larger than a quarter of a shard: so a shard's bytes differ from the mean by at most the
    largest such unit.  Slots count from 0 within a shard without gaps.  Repeated and null ids are rows like others,
    though rows equal in id and text may swap slots; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "hilbert")
    raw = F.coalesce(F.col(text_col).cast("binary"), F.lit(b""))
    keys = {f"key{i}": string_key(F.col(d).cast("string")) for i, d in enumerate(dims)}
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(raw) + overhead).cast("long").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        *[k.alias(n) for n, k in keys.items()],
    )
    rows = scratch.table(rows, "rows")
    names = [*keys, "size"]
    sides = 1 << bits
    depths = F.array(*[F.lit(i / sides) for i in range(1, sides)])
    cuts = rows.agg(*[F.percentile_approx(n, depths, 10_000).alias(n) for n in names]).first()
    cells = [F.lit(0).cast("long")]
    for n in names:
        place = F.lit(0)
        for cut in sorted(set(cuts[n] or ())):
            place = place + (F.col(n) > cut).cast("int")
        cells[0] = cells[0] * sides + place
    grid = np.indices((sides,) * len(names)).reshape(len(names), -1).T
    # sides ** dims rows: a bound set by parameters, whatever the input
    curve = spark.createDataFrame([(i, int(h)) for i, h in enumerate(hilbert_index(grid, bits))], "cell long, curve long")
    laid = rows.withColumn("cell", cells[0]).join(F.broadcast(curve), "cell").select("doc_id", "size", "text_crc32", "curve")

    # equal texts share one cell
    text = ["text_crc32", "size"]
    groups = laid.groupBy(*text).agg(F.min("curve").alias("place"), F.count("*").alias("n")).where("n > 1").withColumn("copies", F.col("n"))
    laid = c.dealt(laid, groups, text, F.col("doc_id"), scratch, "groups", how="left")
    laid = laid.select("doc_id", *text, F.coalesce("place", "curve").alias("curve"), F.coalesce("copies", F.lit(1)).cast("long").alias("copies"))
    laid = scratch.table(laid, "laid")

    # parts: (cell, leading bits of the checksum), and (hot group, salt), in this order along the curve
    counts = scratch.table(laid.groupBy("curve").agg(F.count("*").alias("rows")), "counts")  # at most one row a cell
    n_rows = counts.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    lead = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("rows") / rows_a_part))).cast("int")
    laid = laid.join(F.broadcast(counts.select("curve", (32 - F.least(lead, F.lit(32))).alias("tail"))), "curve")
    hot = (F.col("copies") > rows_a_part) & (F.col("copies") > n_rows * c.HOT_PART)
    part = ["curve", "band", "hot_crc", "hot_size", "salt"]
    laid = laid.withColumns(
        {
            "band": F.expr("text_crc32 div bigint(pow(2, tail))"),
            "hot_crc": F.when(hot, F.col("text_crc32")).otherwise(-1),
            "hot_size": F.when(hot, F.col("size")).otherwise(-1),
            "salt": F.when(hot, F.pmod(F.xxhash64("doc_id"), F.lit(c.SALTS)).cast("int")).otherwise(0),
        }
    ).drop("tail")
    parts = scratch.table(laid.groupBy(*part).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")), "parts")
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner, outer = Window.partitionBy("curve").orderBy(*part[1:]), Window.orderBy("curve")
    whole = parts.groupBy("curve").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
    whole = whole.select("curve", before(outer, "bytes").alias("cell_byte"), before(outer, "rows").alias("cell_row"))
    starts = parts.select(*part, before(inner, "bytes").alias("byte"), before(inner, "rows").alias("row")).join(whole, "curve")
    starts = starts.select(*part, (F.col("cell_byte") + F.col("byte")).alias("part_byte"), (F.col("cell_row") + F.col("row")).alias("part_row"))
    starts = starts.withColumn("hot_byte", F.min("part_byte").over(Window.partitionBy(*part[:4])))  # where a hot group begins
    total = parts.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]

    own = Window.partitionBy(*part).orderBy(*text, "doc_id")
    alike = Window.partitionBy(*part, *text).orderBy("doc_id")
    placed = laid.join(starts, part).withColumns(
        {"at": F.col("part_byte") + before(own, "size"), "row": F.col("part_row") + F.row_number().over(own) - 1, "nth": F.row_number().over(alike) - 1}
    )
    begins = F.when(F.col("hot_crc") >= 0, F.col("hot_byte")).otherwise(F.col("at") - F.col("nth") * F.col("size"))
    kept = F.col("copies") * F.col("size") * (4 * shards) <= total  # groups up to a quarter of a shard stay whole
    twice = F.when(kept, 2 * begins + F.col("copies") * F.col("size")).otherwise(2 * F.col("at") + F.col("size"))  # twice the unit's middle
    placed = placed.withColumn("twice", twice).select(
        "doc_id", "size", "text_crc32", "curve", F.expr(f"least({shards - 1}, twice * {shards} div {2 * max(total, 1)})").cast("int").alias("shard"), "row"
    )
    placed = scratch.table(placed, "placed", keep=True)
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # one row a shard
    out = placed.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", "curve", "shard", (F.col("row") - F.col("first")).alias("slot"))
    scratch.clear()
    return out
