"""Fitted models on disk: numbers beside a manifest that tells what they are and how to know them.

A folder's name ends with the hash of its numbers, so one fit saved twice is one artifact.  The manifest is created after the
numbers, in one step: what a writer that died has left is not an artifact.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.sources import versions

FORMAT = 1
#: Kinds that can be served as a column expression.
KINDS = ("logistic", "linear")


@dataclass(frozen=True)
class Artifact:
    """A model: its columns in order, a weight for each and the intercept (last), their laws, and how a score is read."""

    name: str
    kind: str
    columns: list[str]
    weights: list[float]
    mean: list[float]
    scale: list[float]
    threshold: float = 0.5
    slope: float = 1.0
    intercept: float = 0.0
    tau: float | None = None
    log_sigma: float | None = None

    def numbers(self) -> list[tuple[str, int, float]]:
        parts = {"weight": self.weights, "mean": self.mean, "scale": self.scale, "threshold": [self.threshold], "recalibration": [self.slope, self.intercept]}
        if self.tau is not None and self.log_sigma is not None:
            parts["time"] = [self.tau, self.log_sigma]
        return sorted((part, i, float(v)) for part, values in parts.items() for i, v in enumerate(values))

    def probability(self) -> Column:
        """The recalibrated probability (logistic) or the plain value (linear) as a column over the model's columns."""
        z = F.lit(self.weights[-1])
        for c, w, m, s in zip(self.columns, self.weights[:-1], self.mean, self.scale, strict=True):
            z = z + F.lit(w) * (F.col(c) - F.lit(m)) / F.lit(s)
        return z if self.kind == "linear" else e.logistic(F.lit(self.slope) * z + F.lit(self.intercept))

    def by(self, end: float) -> Column:
        """Chance of the event by ``end`` hours, spread around the predicted time that was fitted with the weights; null where no time was."""
        if self.tau is None or self.log_sigma is None:
            return F.lit(None).cast("double")
        return e.spread_cdf(self.probability(), F.lit(self.tau), F.lit(end), F.lit(self.log_sigma))


def digest(numbers: list[tuple[str, int, float]]) -> str:
    return hashlib.sha256(json.dumps([[p, i, repr(v)] for p, i, v in sorted(numbers)]).encode()).hexdigest()


def schema_of(columns: list[str]) -> str:
    """Version of a feature schema: the hash of its column names in order."""
    return hashlib.sha256("\n".join(columns).encode()).hexdigest()[:16]


def save_artifact(spark: SparkSession, root: str, model: Artifact, **about: object) -> str:
    """Writes the model under ``root`` and returns its folder; ``about`` (dataset, seeds, metrics) is kept in the manifest."""
    if model.kind not in KINDS:
        raise ValueError(f"kind {model.kind!r} can't be served; kinds are {', '.join(KINDS)}")
    if not len(model.columns) == len(model.mean) == len(model.scale) == len(model.weights) - 1:
        raise ValueError("one weight, mean and scale a column, and an intercept")
    numbers = model.numbers()
    base = f"{root}/{model.name}-{digest(numbers + [(c, -1, 0.0) for c in model.columns])[:16]}"
    if f"{base}/manifest" not in _manifests(spark, root):
        spark.createDataFrame(numbers, "part string, i int, value double").coalesce(1).write.mode("overwrite").parquet(f"{base}/numbers")
        told = {"format": FORMAT, "name": model.name, "kind": model.kind, "columns": model.columns, "schema": schema_of(model.columns), "sum": digest(numbers), "about": about}
        versions._create(spark, f"{base}/manifest", json.dumps(told, sort_keys=True, default=str))
    return base


def load_artifact(spark: SparkSession, base: str, *, columns: list[str] | None = None) -> Artifact:
    """The model of a folder, or the reason why it is refused; ``columns`` are those the caller can supply, in order."""
    if f"{base}/manifest" not in _manifests(spark, base.rsplit("/", 1)[0]):
        raise FileNotFoundError(f"no artifact at {base}")
    told = versions._read(spark, f"{base}/manifest")
    if told["format"] != FORMAT:
        raise ValueError(f"format {told['format']} is not supported")
    if told["kind"] not in KINDS:
        raise ValueError(f"kind {told['kind']!r} can't be served; kinds are {', '.join(KINDS)}")
    numbers = [(r.part, r.i, r.value) for r in spark.read.schema("part string, i int, value double").parquet(f"{base}/numbers").collect()]  # as many as columns
    if digest(numbers) != told["sum"]:
        raise ValueError("the numbers on disk are not those that were saved")
    if columns is not None and schema_of(columns) != told["schema"]:
        raise ValueError(f"fitted on columns {', '.join(told['columns'])}; got {', '.join(columns)}")
    of = lambda part: [v for p, _, v in sorted(numbers) if p == part]
    tau, log_sigma = of("time") or (None, None)
    slope, intercept = of("recalibration")
    return Artifact(told["name"], told["kind"], told["columns"], of("weight"), of("mean"), of("scale"), of("threshold")[0], slope, intercept, tau, log_sigma)


def _manifests(spark: SparkSession, root: str) -> list[str]:
    """Manifests that are whole, under the name the caller uses for the root."""
    out = []
    for folder in versions._list(spark, root):
        name = folder.getPath().getName()
        if any(f.getPath().getName() == "manifest" for f in versions._list(spark, f"{root}/{name}")):
            out.append(f"{root}/{name}/manifest")
    return sorted(out)


def list_artifacts(spark: SparkSession, root: str) -> list[dict]:
    """Manifests of all artifacts under a folder, by name; what is half-written is passed over."""
    return [versions._read(spark, m) | {"folder": m.removesuffix("/manifest")} for m in _manifests(spark, root)]


def served(df: DataFrame, model: Artifact, keys: list[str], ends: tuple[float, ...] = ()) -> DataFrame:
    """Keys, probability, whether it reaches the threshold, and the chance by each end: columns over the rows, nothing is fitted."""
    p = model.probability()
    return df.select(*keys, p.alias("probability"), (p >= F.lit(model.threshold)).alias("flagged"), *[model.by(x).alias(f"within_{x:g}") for x in ends])
