"""Runs and what came of them: outcomes a merchant and events in order, filed by run.

A run's rows are written before its record, so a run that is listed is whole; a run saved again replaces its own slice (every run has outcomes).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.operators.relational import page, placed
from ripplenet.sources import datasets

RECORD = "kind string, status string, experiment string, dataset string, created double, n_outcomes long, n_events long, run_id string"
OUTCOME = "merchant_id string, probability double, hit_t double, hop int, affected boolean, run_id string"
EVENT = "sequence long, t double, type string, merchant_id string, hop int, run_id string"


def save_run(spark: SparkSession, root: str, run_id: str, outcomes: DataFrame, events: DataFrame | None = None, *, kind: str, status: str = "done", experiment: str = "", dataset: str = "", created: float = 0.0) -> None:
    """Files outcomes (merchant_id, probability, hit_t, hop, affected) and, if given, events (t, type, merchant_id, hop); events are numbered by time and merchant."""
    tag = lambda df, schema: df.withColumn("run_id", F.lit(run_id)).select(*[F.col(c.split()[0]).cast(c.split()[1]).alias(c.split()[0]) for c in schema.split(", ")])
    datasets.replace_slice(tag(outcomes, OUTCOME), f"{root}/outcomes", ["run_id"])
    if events is not None:
        order = [F.col(c) for c in ("t", "hop", "merchant_id", "type")]
        datasets.replace_slice(tag(placed(events, order, "sequence"), EVENT), f"{root}/events", ["run_id"])
    counts = outcomes_for_run(spark, root, run_id).count(), events_for_run(spark, root, run_id).count() if events is not None else 0
    datasets.replace_slice(spark.createDataFrame([(kind, status, experiment, dataset, created, *counts, run_id)], RECORD), f"{root}/runs", ["run_id"])


def _table(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    path = f"{root}/{name}"
    return spark.read.schema(schema).parquet(path) if datasets.exists(spark, path) else spark.createDataFrame([], schema)


def list_runs(spark: SparkSession, root: str, *, limit: int = 50, offset: int = 0, **wanted: str) -> DataFrame:
    """Records of runs, latest first; ``wanted`` filters by kind, status, experiment or dataset."""
    runs = _table(spark, root, "runs", RECORD)
    for column, value in wanted.items():
        if column not in ("kind", "status", "experiment", "dataset"):
            raise ValueError(f"runs can't be filtered by {column}")
        runs = runs.where(F.col(column) == value)
    return page(runs, [F.desc("created"), F.col("run_id")], offset, limit)


def outcomes_for_run(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return _table(spark, root, "outcomes", OUTCOME).where(F.col("run_id") == run_id)


def events_for_run(spark: SparkSession, root: str, run_id: str, *, merchant_id: str | None = None, limit: int | None = None) -> DataFrame:
    """Events of a run (and merchant) in order; only the run's folder is read."""
    found = _table(spark, root, "events", EVENT).where(F.col("run_id") == run_id)
    if merchant_id is not None:
        found = found.where(F.col("merchant_id") == merchant_id)
    found = found.orderBy("sequence")
    return found if limit is None else found.limit(limit)


def affected_ids(spark: SparkSession, root: str, run_id: str) -> DataFrame:
    return outcomes_for_run(spark, root, run_id).where("affected").select("merchant_id")
