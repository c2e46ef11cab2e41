"""Ingestion queries: validation, deduplication, state folding, ledgers."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.plans.registry import query
from ripplenet.sources.network import Network
from ripplenet.streaming import ingest as i

def raw_lines(spark, d):
    """The events table as JSON payment records, with the flaws that ingestion must catch."""
    v = Network(spark, d).read("events")
    c = F.col
    rec = F.struct(
        F.when(c("event_id") % 89 == 0, F.lit("")).otherwise(F.concat(F.lit("p"), F.floor(c("event_id") / 2 * F.when(c("event_id") % 10 == 0, 1).otherwise(2)).cast("string"))).alias("id"),
        F.when(c("event_id") % 83 != 0, F.floor(c("value") * 100).cast("double")).alias("amount"),
        F.when(c("event_id") % 79 != 0, F.unix_seconds(c("ts").cast("timestamp"))).alias("created_at"),
        F.when(c("event_type") == "error", "failed").otherwise("captured").alias("status"),
        F.when(c("event_id") % 73 != 0, F.concat(F.lit("U"), c("user_id").cast("string"))).alias("payer"),
        F.when(c("event_id") % 73 != 0, F.concat(F.lit("U"), (c("user_id") * 7 % 150).cast("string"))).alias("payee"),
    )
    return v.select(F.when(c("event_id") % 97 == 0, "not json").otherwise(F.to_json(rec)).alias("value"))


RAW = """WITH r AS (SELECT event_id, event_id % 97 <> 0 AS is_object, CASE WHEN event_id % 89 = 0 THEN '' ELSE 'p' || CAST(floor(event_id / 2 * CASE WHEN event_id % 10 = 0 THEN 1 ELSE 2 END) AS BIGINT) END AS id,
 CASE WHEN event_id % 83 <> 0 THEN floor(value * 100) END AS amount, CASE WHEN event_id % 79 <> 0 THEN epoch_us(ts) // 1000000 END AS created_at, CASE WHEN event_type = 'error' THEN 'failed' ELSE 'captured' END AS status,
 CASE WHEN event_id % 73 <> 0 THEN 'U' || user_id END AS payer, CASE WHEN event_id % 73 <> 0 THEN 'U' || (user_id * 7 % 150) END AS payee FROM events),
v AS (SELECT *, CASE WHEN NOT is_object THEN 'not_an_object' WHEN id = '' THEN 'no_id' WHEN amount IS NULL THEN 'no_amount' WHEN amount < 1 THEN 'non_positive_amount' WHEN created_at IS NULL THEN 'no_created_at' WHEN status <> 'captured' THEN 'unsettled_status'
 WHEN payer IS NULL AND payee IS NULL THEN 'unknown_parties' WHEN payer = payee THEN 'self_payment' END AS reason FROM r),
w AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY created_at, event_id) > 1 THEN 'duplicate' ELSE reason END AS verdict FROM v)
"""


@query(RAW + "SELECT coalesce(verdict, 'accepted') AS reason, count(*) AS n FROM w GROUP BY 1")
def rejection_reasons(spark, d):
    good, bad = i.ingest_batch(raw_lines(spark, d))
    return bad.groupBy("reason").agg(F.count("*").alias("n")).union(good.agg(F.lit("accepted").alias("reason"), F.count("*").alias("n")))


@query(RAW + "SELECT payer, payee, count(*) AS n, CAST(sum(amount) AS BIGINT) AS total_minor, count(DISTINCT id) AS n_ids FROM w WHERE verdict IS NULL GROUP BY ALL")
def ingested_pairs(spark, d):
    good, _ = i.ingest_batch(raw_lines(spark, d))
    return good.groupBy("payer", "payee").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total_minor"), F.countDistinct("external_id").alias("n_ids"))


@query(RAW + ", seen AS (SELECT DISTINCT id FROM w WHERE verdict IS NULL AND created_at < 1705000000) SELECT count(*) FILTER (seen.id IS NULL) AS fresh, count(*) FILTER (seen.id IS NOT NULL) AS known FROM w LEFT JOIN seen USING (id) WHERE verdict IS NULL")
def dedup_against_history(spark, d):
    lines = raw_lines(spark, d)
    first, _ = i.ingest_batch(lines)
    again, dropped = i.ingest_batch(lines, first.where(F.col("t") * 3600 < 1705000000))
    total = first.agg(F.count("*").alias("all"))
    return again.agg(F.count("*").alias("fresh")).join(F.broadcast(total)).select("fresh", (F.col("all") - F.col("fresh")).alias("known"))


STATES = """WITH u AS (SELECT CAST(user_id AS VARCHAR) AS record, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'held' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM events),
k AS (SELECT *, CASE state WHEN 'submitted' THEN 2 WHEN 'pending' THEN 3 WHEN 'held' THEN 4 ELSE 5 END AS r FROM u) """


def updates(spark, d):
    v = Network(spark, d).read("events")
    e = F.col("event_type")
    state = F.when(e == "click", "submitted").when(e == "view", "pending").when(e == "signup", "held").when(e == "purchase", "succeeded").otherwise("failed")
    return v.select(F.col("user_id").cast("string").alias("record"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", state.alias("state"))


@query(STATES + "SELECT record, arg_min(state, (-r, us, event_id)) AS state, count(*) AS n FROM k GROUP BY record")
def folded_states(spark, d):
    return i.fold_states(updates(spark, d))


@query("SELECT event_type, CASE WHEN starts_with(event_type, 'p') THEN 'payment' WHEN event_type LIKE '%up' THEN 'account' ELSE 'other' END AS scope, CASE event_type WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'pending' END AS outcome, count(*) AS n FROM events GROUP BY ALL")
def event_classification(spark, d):
    e = F.col("event_type")
    v = Network(spark, d).read("events")
    scope = F.when(e.startswith("p"), "payment").when(e.endswith("up"), "account").otherwise("other")
    return v.groupBy("event_type", scope.alias("scope"), F.when(e == "purchase", "succeeded").when(e == "error", "failed").otherwise("pending").alias("outcome")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id FROM events WHERE event_type = 'error' AND event_id NOT IN (SELECT event_id FROM events WHERE event_id % 2 = 0) ORDER BY ts, event_id LIMIT 500")
def unprocessed_queue(spark, d):
    v = Network(spark, d).read("events")
    todo = v.where("event_type = 'error'").join(v.where("event_id % 2 = 0").select("event_id"), "event_id", "left_anti")
    return todo.orderBy("ts", "event_id").limit(500).select("event_id", "user_id")


@query("SELECT user_id AS record, event_type AS trigger, min(event_id) AS event_id, count(*) AS n FROM events WHERE event_type IN ('error', 'signup') GROUP BY ALL")
def reentry_once(spark, d):
    v = Network(spark, d).read("events").where("event_type in ('error', 'signup')")
    return v.groupBy(F.col("user_id").alias("record"), F.col("event_type").alias("trigger")).agg(F.min("event_id").alias("event_id"), F.count("*").alias("n"))


@query("SELECT user_id, CAST(session AS BIGINT) AS session, count(*) AS n, epoch_us(min(ts)) AS first_us FROM (SELECT *, sum(CASE WHEN gap > 3600000000 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts) AS session FROM (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS gap FROM events)) GROUP BY ALL")
def activity_sessions(spark, d):
    w = Window.partitionBy("user_id").orderBy("us")
    v = Network(spark, d).read("events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    gap = F.col("us") - F.lag("us").over(w)
    v = v.withColumn("new", F.when((gap > 3_600_000_000) | gap.isNull(), 1).otherwise(0)).withColumn("session", F.sum("new").over(w))
    return v.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("us").alias("first_us"))


@query("SELECT event_id, 'batch-' || user_id AS batch FROM events WHERE props LIKE '{\"k\": 1%' AND CAST(json_extract(props, '$.k') AS BIGINT) >= 10")
def batch_discovery(spark, d):
    v = Network(spark, d).read("events").where(F.col("props").like('{"k": 1%') & (F.get_json_object("props", "$.k").cast("long") >= 10))
    return v.select("event_id", F.concat(F.lit("batch-"), "user_id").alias("batch"))


@query(RAW + """, b AS (SELECT *, CASE WHEN created_at IS NULL OR NOT is_object THEN 2 WHEN created_at < 1705000000 THEN 0 ELSE 1 END AS batch FROM v),
k AS (SELECT *, CASE WHEN reason IS NULL AND row_number() OVER (PARTITION BY id, reason IS NULL ORDER BY batch, created_at, event_id) > 1 THEN 'duplicate' ELSE reason END AS final FROM b)
SELECT batch, count(*) FILTER (final IS NULL) AS accepted, count(*) FILTER (final = 'duplicate') AS duplicates, count(*) FILTER (final IS NOT NULL AND final <> 'duplicate') AS rejected, CAST(coalesce(sum(amount) FILTER (final IS NULL), 0) AS BIGINT) AS total_minor FROM k GROUP BY batch""")
def import_ledger(spark, d):
    """Three batches of the raw lines through the ledger, the second of them twice: what each left."""
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    ledger = i.Ledger(spark, f"{root}/ledger-{uuid.uuid4().hex}")
    lines = raw_lines(spark, d)
    at = F.get_json_object("value", "$.created_at").cast("long")
    batches = (at < 1705000000, at >= 1705000000, at.isNull())  # one look at a line each
    for b in (0, 1, 1, 2):
        ledger.write(lines.where(batches[b]), b)
    good = ledger.events().groupBy("batch").agg(F.count("*").alias("accepted"), F.sum("amount_minor").alias("total_minor"))
    bad = ledger.rejections().groupBy("batch").agg(F.count_if(F.col("reason") == "duplicate").alias("duplicates"), F.count_if(F.col("reason") != "duplicate").alias("rejected"))
    both = good.join(bad, "batch", "full").na.fill(0)
    return both.select(F.col("batch").cast("int").alias("batch"), "accepted", "duplicates", "rejected", "total_minor")
