"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of words in which numbers, units and names are typed placeholders.
Two readings stand side by side: a literal one (numbers and units replaced, all else lower-cased), word by word, and a
template (names replaced too), in which a run of numbers, units or names is one placeholder, so that a longer number or name moves
nothing.  Windows of both readings are hashed and joined with those of the
benchmark, each reading with its own.  Windows that line up on one diagonal cover a stretch of the item; a stretch
that is long enough is a leak if its slots are consistent: each value of the item stands for one
value of the document and the other way round, as in a question asked anew with other parameters.

Only DataFrame functions are used, and the plan is one at every size.  The documents are read once for the window
hashes.  A broadcast of the buckets of the benchmark's hashes (bounded in number) leaves few windows, which
then meet the benchmark in salted joins; hits aggregate per document, and the texts of documents with a
long enough stretch are read again, sieved by the buckets of their ids before they are joined by shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

# Words for numbers and units of measurement.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
    " thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen"
)
UNIT_WORDS = (
    "mm cm km mg kg ml kb mb gb hz khz mhz kw kwh mph kph lb lbs oz ft inch inches foot feet yard yards mile miles meter meters metre metres kilometer"
    " kilometers kilometre kilometres gram grams kilogram kilograms liter liters litre litres second seconds minute minutes hour hours day days week weeks"
    " month months year years dollar dollars cent cents euro euros pound pounds percent degree degrees celsius fahrenheit volt volts watt watts"
)
#: Placeholders: a number, a unit, a name; and the mark that stands for a decimal point.
NUMBER, UNIT, NAME, POINT = "\x01", "\x02", "\x03", "\x04"
WORD = r"\p{L}\p{N}\p{M}\x04"
SALTS = 32
#: Stands for a null id, so that it joins like others.
NO_ID = -(1 << 63)


def _split(text: Column) -> Column:
    return F.filter(F.split(text, rf"[^{WORD}\x03]+"), lambda w: w != "")


def spaced(text: Column) -> Column:
    """Text with numbers set apart, their points and commas kept as part of them."""
    text = F.translate(F.coalesce(text, F.lit("")), "\x01\x02\x03\x04", "    ")
    marked = F.regexp_replace(text, r"(?<=[0-9])[.,](?=[0-9])", POINT)
    return F.regexp_replace(marked, r"[0-9][0-9\x04]*", " $0 ")


def _typed(words: Column) -> Column:
    numbers, units = NUMBER_WORDS.split(), UNIT_WORDS.split()
    return F.transform(
        words,
        lambda w: F.when((w >= "0") & (w < ":"), NUMBER).when(w.isin(numbers), NUMBER).when(w.isin(units), UNIT).otherwise(w),
    )


def literal_words(base: Column) -> Column:
    return _typed(_split(F.lower(base)))


def template_words(base: Column) -> Column:
    """As :func:`literal_words`, with words that begin with a capital and hold a small letter as names."""
    named = F.regexp_replace(base, rf"(?<![{WORD}])\p{{Lu}}[{WORD}]*\p{{Ll}}[{WORD}]*", NAME)
    return _typed(_split(F.lower(named)))


def raw_words(base: Column) -> Column:
    return _split(base)


def is_slot(word: Column) -> Column:
    return word.isin(NUMBER, UNIT, NAME)


def _goes_on(words: Column, i: Column) -> Column:
    """Whether the word at ``i`` continues a run of one placeholder; ``words`` is a column that is at hand, not to be worked out anew."""
    return is_slot(F.get(words, i)) & F.coalesce(F.get(words, i) == F.get(words, i - 1), F.lit(False))


def folded(hashes: Column) -> Column:
    """Hashes of template words with each run of one placeholder as one; a column at hand, as above."""
    slots = [F.xxhash64(F.lit(x)) for x in (NUMBER, UNIT, NAME)]
    return F.filter(hashes, lambda h, i: ~(((h == slots[0]) | (h == slots[1]) | (h == slots[2])) & F.coalesce(h == F.get(hashes, i - 1), F.lit(False))))


def readings(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, reading, words, raw, starts, lens, slots, n_raw) of rows (keys, literal, template, raw) at hand: one row a reading, one element a token.

    ``raw`` holds each token's words as they stand, ``starts`` the place of its first word, ``lens`` their number.
    """
    n = F.size("raw")
    every = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    heads = rows.where(n > 0).select("*", F.filter(every, lambda i: ~_goes_on(F.col("template"), i)).alias("heads"))
    end = lambda j: F.coalesce(F.get("heads", j + 1), n)
    runs = F.transform("heads", lambda i, j: F.concat_ws(" ", F.slice("raw", i + 1, end(j) - i)))
    word = F.struct(F.lit(0).alias("reading"), F.col("literal").alias("words"), F.col("raw").alias("raw"), every.alias("starts"), F.transform("raw", lambda _: F.lit(1)).alias("lens"), F.transform("template", is_slot).alias("slots"))
    token = F.transform("heads", lambda i: F.get("template", i))
    run = F.struct(F.lit(1).alias("reading"), token.alias("words"), runs.alias("raw"), F.col("heads").alias("starts"), F.transform("heads", lambda i, j: end(j) - i).alias("lens"), F.transform("heads", lambda i: is_slot(F.get("template", i))).alias("slots"))
    return heads.select(*keys, n.alias("n_raw"), F.explode(F.array(word, run)).alias("r")).select(*keys, "n_raw", "r.*")


def hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def windows(rows: DataFrame, keys: list[str], width: int) -> DataFrame:
    """(keys, pos, h): the hash of the window that begins at each word, from the words' hashes in column ``hashes``.

    Each word becomes a row first and then looks ahead in its list: as a plain projection that is compiled, which a lambda over the list is not.
    """
    ahead = [F.get("hashes", F.col("pos") + k) for k in range(1, width)]
    words = rows.select(*keys, "hashes", F.posexplode("hashes").alias("pos", "first")).where(F.col("pos") + width <= F.size("hashes"))
    return words.select(*keys, "pos", F.xxhash64("first", *ahead).alias("h"))


def _benchmark(items: DataFrame, width: int, min_literals: int) -> DataFrame:
    """(item_id, reading, width, pos, h) of the windows of the items' readings; windows of slots only are no evidence."""
    size = F.least(F.size("words"), F.lit(width))
    starts = F.sequence(F.lit(1), F.size("words") - size + 1)
    rows = items.where(F.size("words") > 0).select("item_id", "reading", size.alias("width"), "words", F.posexplode(starts).alias("pos", "start"))
    window = F.slice("words", F.col("start"), F.col("width"))
    solid = F.size(F.filter(window, lambda w: ~is_slot(w)))
    return rows.where(solid >= F.least(F.lit(min_literals), F.ceil(F.col("width") / 2))).select("item_id", "reading", "width", "pos", F.xxhash64(hashed(window)).alias("h")).distinct()


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = 8,
    min_words: int = 13,
    min_literals: int = 4,
    max_conflicts: float = 0.2,
) -> DataFrame:
    """(doc_id, contaminated, item_ids, covered_words, spans) for every document.

    A document is contaminated by an item if, on one diagonal, windows of ``width`` words cover at least
    ``min_words`` words of the item (all of a shorter one; a run counts its words), and either these words
    stand there as they are, or slots are consistent: conflicts (an item's value, in the template reading a whole run, with a second
    counterpart, or the reverse) are at most ``max_conflicts`` of the slots.  A window needs
    ``min_literals`` words that are no slots.  ``spans`` lists item, first and last word in the document
    (words of letters, digits and marks, numbers set apart).  Null and empty texts are clean; an empty
    benchmark finds nothing; repeated items report each; an id that repeats with other texts is one row, contaminated if
    one of its texts is, and a null id is an id like others; other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = c.Scratch(spark, "templates")
    text = F.col(text_col).cast("string")
    own = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("part"), text.alias("text"))
    key = ["doc_id", "part"]
    salt = F.pmod(F.xxhash64(*key), F.lit(SALTS)).cast("int")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    items = benchmark.select(F.col(item_id_col).cast("long").alias("item_id"), spaced(F.col(item_text_col).cast("string")).alias("base"))
    items = items.select("item_id", literal_words(F.col("base")).alias("literal"), template_words(F.col("base")).alias("template"), raw_words(F.col("base")).alias("raw"))
    items = scratch.table(readings(scratch.table(items, "split"), ["item_id"]), "items")
    keys = scratch.table(_benchmark(items, width, min_literals), "keys")
    known = scratch.table(keys.select("reading", "width", "h").distinct(), "known")
    widths = sorted(r.width for r in known.select("width").distinct().collect())  # at most ``width`` values

    # both readings of each document, one row per window
    base = own.where(F.length("text") > 0).select(*key, spaced(F.col("text")).alias("base"))
    read = base.select(*key, F.posexplode(F.array(hashed(literal_words(F.col("base"))), hashed(template_words(F.col("base"))))).alias("reading", "hashes"))
    read = read.withColumn("hashes", F.when(F.col("reading") == 1, folded(F.col("hashes"))).otherwise(F.col("hashes")))
    hits = None
    for w in widths:
        rows = windows(read, [*key, "reading"], w)
        mine = known.where(F.col("width") == w).select("reading", "h")
        low = F.col("h").bitwiseAND(F.lit(c.BUCKETS - 1)).cast("int").alias("bucket")  # hashes fall into buckets as they are
        rows = rows.select("*", low).join(F.broadcast(mine.select(low).distinct()), "bucket", "left_semi")  # at most BUCKETS rows
        rows = rows.withColumn("salt", salt).join(salted(mine).hint("merge"), ["reading", "h", "salt"], "left_semi")
        rows = rows.select(*key, "reading", F.lit(w).alias("width"), "pos", "h")
        hits = rows if hits is None else hits.union(rows)
    found = own.select("doc_id").distinct()
    back = F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id")
    if hits is None:
        empty = F.array().cast("array<long>")
        spans = F.array().cast("array<struct<item_id:long,first:int,last:int>>")
        scratch.clear()
        return found.select(back, F.lit(False).alias("contaminated"), empty.alias("item_ids"), F.lit(0).cast("long").alias("covered_words"), spans.alias("spans"))
    hits = scratch.table(hits.distinct(), "hits")

    # a stretch on one diagonal covers no more tokens than all windows of the reading together; runs hold at most ``slack`` words more
    used = items.join(keys.select("item_id").distinct(), "item_id", "left_semi")
    needs, slack = used.agg(F.min("n_raw"), F.max(F.col("n_raw") - F.size("words"))).first()
    end = F.col("pos") + F.col("width")
    before = F.max(end).over(Window.partitionBy(*key, "reading").orderBy("pos", "width").rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.greatest(F.lit(0), end - F.greatest("pos", F.coalesce(before, F.col("pos"))))
    likely = hits.select(*key, "reading", "pos", "width").distinct().select(*key, "reading", fresh.alias("n")).groupBy(*key, "reading").agg(F.sum("n").alias("n"))
    likely = likely.where(F.col("n") >= min(min_words, needs or 0) - F.col("reading") * (slack or 0)).select(*key, "reading")
    hits = hits.join(likely, [*key, "reading"], "left_semi")
    placed = salted(keys.withColumnRenamed("pos", "item_pos"))
    lined = hits.withColumn("salt", salt).join(placed, ["reading", "width", "h", "salt"]).select(*key, "reading", "item_id", "width", "item_pos", (F.col("pos") - F.col("item_pos")).alias("shift"))
    cover = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.sequence(F.col("item_pos"), F.col("item_pos") + F.col("width") - 1)))))
    lined = lined.groupBy(*key, "reading", "item_id", "shift").agg(cover.alias("cover")).join(items.drop("words", "starts"), ["item_id", "reading"])
    lined = lined.withColumn("covered", F.aggregate("cover", F.lit(0), lambda n, p: n + F.get("lens", p)))
    lined = lined.where(F.col("covered") >= F.least(F.lit(min_words), F.col("n_raw")))
    lined = scratch.table(lined, "lined")

    ids = lined.select(*key).distinct()
    near = own.withColumn("bucket", c.bucket_of(*map(F.col, key))).join(c.buckets_of(lined, *key), "bucket", "left_semi")
    texts = near.join(ids.hint("merge"), key, "left_semi").select(*key, "text").dropDuplicates(key).select(*key, spaced(F.col("text")).alias("base"))
    split = [f(F.col("base")).alias(n) for n, f in (("literal", literal_words), ("template", template_words), ("raw", raw_words))]
    texts = readings(scratch.table(texts.select(*key, *split), "texts"), key).select(*key, "reading", F.col("raw").alias("doc_words"), F.col("starts").alias("doc_starts"), F.col("lens").alias("doc_lens"))
    judged = lined.join(texts, [*key, "reading"]).withColumn(
        "pairs",
        F.transform(
            "cover",
            lambda p: F.struct(F.get("raw", p).alias("a"), F.get("doc_words", p + F.col("shift")).alias("b"), F.get("slots", p).alias("slot"), F.get("lens", p).alias("len")),
        ),
    )
    kinds = lambda f: F.size(F.array_distinct(F.transform("values", f)))
    same = F.aggregate(F.filter("pairs", lambda x: F.lower(x.a) == F.lower(x.b)), F.lit(0), lambda n, x: n + x.len)
    judged = judged.withColumns({"values": F.filter("pairs", lambda x: x.slot), "same": same})
    conflicts = 2 * kinds(lambda x: F.concat_ws("\x05", x.a, x.b)) - kinds(lambda x: x.a) - kinds(lambda x: x.b)
    judged = judged.where((F.col("same") >= F.least(F.lit(min_words), F.col("n_raw"))) | (conflicts <= max_conflicts * F.size("values")))
    first, last = (f("cover") + F.col("shift") for f in (F.array_min, F.array_max))
    span = F.struct("item_id", F.get("doc_starts", first).alias("first"), (F.get("doc_starts", last) + F.get("doc_lens", last) - 1).alias("last"))
    leaks = judged.groupBy("doc_id").agg(
        F.array_sort(F.collect_set("item_id")).alias("item_ids"), F.max("covered").cast("long").alias("covered_words"), F.array_sort(F.collect_set(span)).alias("spans")
    )
    out = found.join(leaks, "doc_id", "left").select(
        back,
        F.col("item_ids").isNotNull().alias("contaminated"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
        F.coalesce("covered_words", F.lit(0)).cast("long").alias("covered_words"),
        F.coalesce("spans", F.array().cast("array<struct<item_id:long,first:int,last:int>>")).alias("spans"),
    )
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
