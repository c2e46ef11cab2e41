"""Ingestion: validation, idempotence, a monotone state machine, and late facts.

The rules are column expressions that batch and stream share.  In a stream, duplicates go by id within a
watermark, and the state of a record is the latest of a monotone order, so late and repeated
events never move it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# States of a payment record in their order, final ones, and reasons of rejection.
RANKS = {"unknown": 0, "planned": 1, "submitted": 2, "pending": 3, "held": 4, "succeeded": 5, "failed": 5}
FINAL = ("succeeded", "failed")
REASONS = ("not_an_object", "no_id", "no_amount", "non_positive_amount", "no_created_at", "unsettled_status", "unknown_parties", "self_payment", "duplicate")

RAW = "id string, amount double, created_at long, currency string, status string, payer string, payee string, customer_id string, contact_id string, notes struct<payer_merchant_id:string, payee_merchant_id:string>"


def rank(state: Column) -> Column:
    return F.coalesce(*[F.when(state == s, F.lit(r)) for s, r in RANKS.items()], F.lit(0))


def parse(lines: DataFrame, col: str = "value") -> DataFrame:
    """Raw JSON lines as fields; a line that is no object keeps null fields and ``is_object`` false."""
    got = lines.select(F.col(col).alias("raw"), F.from_json(F.col(col), RAW).alias("r"))
    return got.select("raw", F.coalesce(F.trim(F.col("raw")).startswith("{") & F.col("r").isNotNull(), F.lit(False)).alias("is_object"), "r.*")


def parties(records: DataFrame) -> DataFrame:
    """Payer and payee hints by precedence: notes, then the field, then customer, then contact."""
    known = lambda *c: F.coalesce(*[F.nullif(F.col(x), F.lit("")) for x in c])
    return records.withColumns({"payer_hint": known("notes.payer_merchant_id", "payer", "customer_id", "contact_id"), "payee_hint": known("notes.payee_merchant_id", "payee")})


def rejection() -> Column:
    """First rule that a record breaks, or null; amounts below one minor unit count as not positive."""
    return (
        F.when(~F.col("is_object"), "not_an_object")
        .when(F.col("id").isNull() | (F.col("id") == ""), "no_id")
        .when(F.col("amount").isNull() | F.isnan("amount"), "no_amount")
        .when(F.col("amount") < 1, "non_positive_amount")
        .when(F.col("created_at").isNull(), "no_created_at")
        .when(~F.coalesce(F.col("status").isin("captured", "settled"), F.lit(False)), "unsettled_status")
        .when(F.col("payer_hint").isNull() & F.col("payee_hint").isNull(), "unknown_parties")
        .when(F.col("payer_hint") == F.col("payee_hint"), "self_payment")
    )


def validate(lines: DataFrame) -> DataFrame:
    return parties(parse(lines)).withColumn("reason", rejection())


def events(valid: DataFrame, sink: str = "external_sink") -> DataFrame:
    """Payment events of accepted records."""
    return valid.select(
        F.col("id").alias("external_id"), F.coalesce("payer_hint", F.lit(sink)).alias("payer"), F.coalesce("payee_hint", F.lit(sink)).alias("payee"), F.floor("amount").cast("long").alias("amount_minor"),
        (F.col("created_at") / 3600.0).alias("t"), F.substring(F.sha2("raw", 256), 1, 32).alias("payload_hash"),
    )


def ingest_batch(lines: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(events, rejections): first of equal ids wins, ids in ``seen(external_id)`` are duplicates.

    A record rejected by a rule never makes a later one a duplicate.
    """
    return split(validate(lines), seen)


def split(v: DataFrame, seen: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """:func:`ingest_batch` of validated records."""
    bad = v.where("reason is not null").select("id", "reason", "raw")
    good = v.where("reason is null")
    place = F.row_number().over(Window.partitionBy("id").orderBy("created_at", "raw"))
    good = good.withColumn("place", place)
    if seen is not None:
        good = good.join(seen.select(F.col("external_id").alias("id"), F.lit(True).alias("old")).distinct(), "id", "left")
    else:
        good = good.withColumn("old", F.lit(None).cast("boolean"))
    again = (F.col("place") > 1) | F.coalesce("old", F.lit(False))
    return events(good.where(~again)), bad.union(good.where(again).select("id", F.lit("duplicate").alias("reason"), "raw"))


def ingest_stream(lines: DataFrame, watermark: str = "7 days") -> DataFrame:
    """Accepted events of a stream of JSON lines, each id once within the watermark."""
    good = validate(lines).where("reason is null").withColumn("at", F.timestamp_seconds("created_at"))
    once = good.withWatermark("at", watermark).dropDuplicatesWithinWatermark(["id"])
    return events(once)


def fold_states(updates: DataFrame) -> DataFrame:
    """(record, state, n): state after all updates, whatever their order of arrival.

    The highest rank wins; between the two final states the earlier one (by time, then id) stays.
    """
    r = rank(F.col("state"))
    key = F.struct((-r).alias("r"), "at", "event_id")
    return updates.groupBy("record").agg(F.min_by("state", key).alias("state"), F.count("*").alias("n"))


def fold_stream(updates: DataFrame) -> DataFrame:
    """:func:`fold_states` over a stream, for the update output mode.

    The state kept per record is the least key seen, so updates may arrive in any order and in any trigger;
    late ones are facts like any other, and no watermark drops them.
    """
    return fold_states(updates)


def reconcile(ledger: DataFrame, facts: DataFrame) -> DataFrame:
    """(record, before, after, source): ledger(record, before) read against later facts(record, fact).

    A final state stays whatever the facts say; an open one takes the fact, or stays unresolved without one.
    """
    final = F.col("before").isin(*FINAL)
    both = ledger.join(facts, "record", "left")
    source = F.when(final, "final").when(F.col("fact").isNull(), "unresolved").otherwise("reconciled")
    return both.select("record", "before", F.when(final, F.col("before")).otherwise(F.coalesce("fact", "before")).alias("after"), source.alias("source"))


def write_ledger(stream: DataFrame, path: str, checkpoint: str):
    """Runs what is there and appends it, exactly once, to a Parquet ledger."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.format("text").load(path)


class Ledger:
    """Events and rejections of batches on disk, each batch once whatever fails or is replayed.

    A batch's rows are a slice of their own, replaced as a whole, and a commit file is written after them; readers see committed batches
    only.  So a batch that died half-way changes nothing until it is run again, and one that is replayed gives the same rows in the same place.
    Ids of other committed batches are duplicates; its own are not.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def batches(self) -> list[int]:
        """Committed batches in order."""
        fs, p = self._fs("commits")
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n) for n in names if n.isdigit())

    def _rows(self, table: str, schema: str) -> DataFrame:
        paths = [f"{self.path}/{table}/batch={b}" for b in self.batches()]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, batch long")
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/{table}").parquet(*paths)
        return rows.withColumn("batch", F.col("batch").cast("long"))

    def events(self) -> DataFrame:
        return self._rows("events", "external_id string, payer string, payee string, amount_minor long, t double, payload_hash string")

    def rejections(self) -> DataFrame:
        return self._rows("rejections", "id string, reason string, raw string")

    def commit(self, batch: int) -> None:
        fs, p = self._fs(f"commits/{batch}")
        fs.createNewFile(p)

    def write(self, lines: DataFrame, batch: int) -> None:
        """Ingests one batch; the sink for ``foreachBatch``.

        Its records are held as validated: a filter on the reason would else go below the parsing, which is then
        done again for every field that a rule looks at, and once more for each of the two tables.
        """
        held = validate(lines).select("raw", "id", "amount", "created_at", "payer_hint", "payee_hint", "reason").persist()
        try:
            good, bad = split(held, self.events().where(F.col("batch") != batch))
            good.write.mode("overwrite").parquet(f"{self.path}/events/batch={batch}")
            bad.write.mode("overwrite").parquet(f"{self.path}/rejections/batch={batch}")
        finally:
            held.unpersist()
        self.commit(batch)

    def run(self, stream: DataFrame, checkpoint: str):
        """Ingests what a stream of lines holds."""
        q = stream.writeStream.foreachBatch(self.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return q
