"""Quality rules whose cut-offs adapt to language and source.

Every metric is summarised by a mergeable quantile sketch: integer values fall into
buckets that keep their six leading bits (relative error below 1/32), and a sketch is the
count per bucket.  Sketches merge by adding counts.  The fence of a (language, source) group is read from
a blend: the group's own sketch, and those of its language and of the whole corpus scaled down to ``shrink``
documents each, so a small group leans on its parents and a large one stands for itself.

Nothing in a fence is a fixed cut-off.  Its spread is the way from the median to the point that leaves out ``TAIL`` per
cent of the group, so a source where a larger part of the documents holds symbols or repeats gets a fence for
them, and junk up to that part of a group cannot widen its own fence.  Where the points agree, as they
do for metrics that are zero in most documents, the spread is what one occurrence makes in a document of the group's
median length, read from the sketches of words and lines, or of its own length if that is shorter.
Counts aggregate map-side; their number is bounded by groups x metrics x buckets, whatever
the number of rows, and they never leave the executors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

SPACE, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Metric (per mille) -> its formula, and the size whose median turns occurrences into per mille.
METRICS = {
    "mean_word": ("1000 * word_chars div n_words", "n_words"),
    "symbols": ("1000 * n_symbols div n_words", "n_words"),
    "dup_lines": ("1000 * n_dup_lines div n_lines", "n_lines"),
    "repeats": ("1000 * n_repeat_words div n_words", "n_words"),
}
#: How much one occurrence adds to the metric's count (a long word beyond the mean, a symbol, a line, a window of words).
OCCURRENCE = {"mean_word": 10, "symbols": 1, "dup_lines": 1, "repeats": 6}
#: Per cent of a group beyond each of the two outer points: the part that may be junk and leave the fence as it is.
TAIL = 15
#: Documents of a parent's sketch count in this part of a document, so that blends are whole numbers.
PART = 1000


def repeated_words(h: np.ndarray) -> int:
    """Words inside 3-word windows that occur twice or more."""
    if len(h) < 4:
        return 0
    tri = c.mix(c.mix(c.mix(h[:-2]) + h[1:-1]) + h[2:])
    _, back, count = np.unique(tri, return_inverse=True, return_counts=True)
    hit = count[back] > 1
    cover = np.zeros(len(h), bool)
    for i in range(3):
        cover[i : i + len(hit)] |= hit
    return int(cover.sum())


def _features(batches):
    cache = c.WordHashes()
    for batch in batches:
        rows = []
        for raw in batch.column(1):
            raw = raw.as_py() or b""
            words = raw.split()
            solid = raw.translate(None, SPACE)
            lines = [x for x in raw.split(b"\n") if x.split()]
            high = np.frombuffer(solid, np.uint8)
            chars = len(solid) - int(((high & 0xC0) == 0x80).sum())
            rows.append((len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(cache.of(words)), len(lines)))
        numbers = np.array(rows, np.int64).reshape(-1, 6)
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(2), batch.column(3), *(pa.array(numbers[:, i]) for i in range(6))],
            ["doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"],
        )


def bucket(v: Column) -> Column:
    """Lower edge of the sketch's bucket."""
    shift = (F.length(F.bin(v)) - 6).cast("int")
    return F.when(v < 64, v).otherwise(F.call_function("shiftleft", F.call_function("shiftright", v, shift), shift))


def quantile_sketches(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n) of long rows (keys, metric, value)."""
    return rows.groupBy(*keys, "metric", bucket(F.col("value")).alias("bucket")).agg(F.count("*").alias("n"))


def blended(sketch: DataFrame, shrink: int) -> DataFrame:
    """(lang, source, metric, bucket, w): each group's sketch with those of its language and of the corpus behind it."""
    merge = lambda keys: sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    groups = sketch.select("lang", "source", "metric").distinct()
    parts = [sketch.select("lang", "source", "metric", "bucket", (PART * F.col("n")).alias("w"))]
    for keys in (["lang"], []):
        parent = merge(keys)
        size = parent.groupBy(*keys, "metric").agg(F.sum("n").alias("size"))
        scaled = parent.join(size, [*keys, "metric"]).select(*keys, "metric", "bucket", F.expr(f"{shrink * PART} * n div size").alias("w"))
        parts.append(groups.join(scaled, [*keys, "metric"]).select("lang", "source", "metric", "bucket", "w"))
    return parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "source", "metric", "bucket").agg(F.sum("w").alias("w")).where("w > 0")


def points(sketch: DataFrame, keys: list[str], weight: str = "n", tail: int = TAIL) -> DataFrame:
    """(keys, metric, size, low, mid, high): the values that leave ``tail`` per cent below, half, and ``tail`` per cent above."""
    by = Window.partitionBy(*keys, "metric")
    ranked = sketch.withColumns({"below": F.sum(weight).over(by.orderBy("bucket")), "size": F.sum(weight).over(by)})
    at = lambda percent: F.min(F.when(100 * F.col("below") >= percent * F.col("size"), F.col("bucket")))
    return ranked.groupBy(*keys, "metric").agg(F.max("size").alias("size"), at(tail).alias("low"), at(50).alias("mid"), at(100 - tail).alias("high"))


def quality_verdicts(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    source_col: str = "source",
    min_words: int = 50,
    max_repeat_percent: int = 50,
    width: int = 5,
    shrink: int = 50,
) -> DataFrame:
    """Base features, fences and verdict per document.

    Words are runs outside ``\\x20\\x09-\\x0D``.  ``base_failed`` marks fewer than ``min_words`` words
    or more than ``max_repeat_percent`` % repeated words.  Others fail if a metric leaves its
    fence: median + width * max(high - median, least), for the mean word length also below, where ``high`` leaves out ``TAIL`` per cent and
    ``least`` is what one occurrence makes in a document of its own or, if that is shorter, of median length, and at least 1.  Points and lengths are those of the documents of
    its language and source that passed the base rules, blended with their parents (see the module).
    Null texts have no words and fail; null languages and sources form groups of their own.
    Ids may repeat: every row is judged by itself.  Other columns are ignored.
    """
    scratch = c.Scratch(docs.sparkSession, "quality")
    slim = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).cast("binary").alias("raw"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
    )
    schema = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
    feats = slim.mapInArrow(_features, schema).withColumn(
        "base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words"))
    )
    feats = scratch.table(feats, "features")
    passed = feats.where(~F.col("base_failed"))
    measured = {m: F.expr(f) for m, (f, _) in METRICS.items()} | {size: F.col(size) for size in ("n_words", "n_lines")}
    values = passed.select("lang", "source", F.explode(F.create_map(*[x for m, f in measured.items() for x in (F.lit(m), f)])).alias("metric", "value"))
    fine = scratch.table(quantile_sketches(values, ["lang", "source"]), "sketches")
    read = points(blended(fine, shrink), ["lang", "source"], "w").groupBy("lang", "source")
    wide = read.agg(*[F.max(F.when(F.col("metric") == m, F.col(q))).alias(f"{m}_{q}") for m in measured for q in ("low", "mid", "high")])
    # one row per language and source, as many as the metadata has values, and not grown by rows
    wide = scratch.table(wide, "fences")
    fences = {}
    for m, (_, size) in METRICS.items():
        low, mid, high = (F.col(f"{m}_{q}") for q in ("low", "mid", "high"))
        least = F.greatest(F.lit(1), F.expr(f"{1000 * OCCURRENCE[m]} div least({size}, {size}_mid)"))
        fences[f"max_{m}"] = mid + width * F.greatest(high - mid, least)
        if m == "mean_word":
            fences["min_mean_word"] = mid - width * F.greatest(mid - low, least)
    inside = F.expr(METRICS["mean_word"][0]) >= F.col("min_mean_word")
    for m, (formula, _) in METRICS.items():
        inside = inside & (F.expr(formula) <= F.col(f"max_{m}"))
    rows = passed.groupBy("lang", "source").agg(F.count("*").alias("n"))
    judged = c.dealt(feats, wide.join(rows, ["lang", "source"]), ["lang", "source"], F.col("doc_id"), scratch, "groups", how="left")
    judged = judged.select(*feats.columns, *[F.when(~F.col("base_failed"), f).alias(n) for n, f in fences.items()])
    out = judged.withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(inside))
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
