"""Tables in versions, and results that are addressed by what they were made from.

A version is a folder that is written once; a pointer file, created after it in one step, makes it visible.  Pointers are
numbered and never overwritten, so readers of an older version keep theirs and two writers can't both take a number.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplenet.sources.datasets import checksum


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _list(spark: SparkSession, path: str) -> list:
    fs, p = _fs(spark, path)
    return list(fs.listStatus(p)) if fs.exists(p) else []


def _create(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a small file appear whole under a name that must be free: false if another writer was first.

    The right to the name is an empty file beside it, which only one writer can create and nobody deletes.
    """
    fs, p = _fs(spark, path)
    _, claim = _fs(spark, f"{path}.claim")
    if not fs.createNewFile(claim):
        return False
    _, part = _fs(spark, f"{path}.part")
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    return bool(fs.rename(part, p))


def _read(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path).collect()))


def versions(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the visible versions, oldest first."""
    names = [s.getPath().getName() for s in _list(spark, f"{root}/_pointers")]
    return sorted(int(n) for n in names if n.isdigit())


def read_version(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The latest version, or the one asked for."""
    known = versions(spark, root)
    if version is None and known:
        version = known[-1]
    if version not in known:
        raise ValueError(f"no version {version} under {root}")
    found = _read(spark, f"{root}/_pointers/{version}")
    return spark.read.schema(found["schema"]).parquet(f"{root}/{found['folder']}")


def publish(df: DataFrame, root: str, **about: str) -> int:
    """Writes a new version and makes it visible; returns its number.

    A folder without a pointer, left by a writer that died, is never read.  If another writer takes the number first, the next one is tried.
    """
    spark = df.sparkSession
    folder = f"v-{hashlib.sha256(json.dumps([about, str(spark._jvm.java.util.UUID.randomUUID())]).encode()).hexdigest()[:16]}"
    df.write.mode("errorifexists").parquet(f"{root}/{folder}")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    number = (versions(spark, root) or [0])[-1] + 1
    while not _create(spark, f"{root}/_pointers/{number}", json.dumps({"folder": folder, "schema": ddl, "about": about}, sort_keys=True)):
        number += 1
    return number


def upserted(stored: DataFrame, estimated: DataFrame, keys: list[str], *, keep: bool = True) -> DataFrame:
    """Stored rows with the estimated ones put in their place: one row a key, ``origin`` tells whose it is.

    With ``keep`` false stored rows that no estimate replaces go, as when an overlay is cleared first.  Columns are the estimate's and the stored
    table's own; a column that one side lacks is null there.
    """
    new = estimated.withColumn("origin", F.lit("estimated"))
    if not keep:
        return new
    old = stored.join(estimated.select(*keys).distinct(), keys, "left_anti").withColumn("origin", F.lit("stored"))
    return old.unionByName(new, allowMissingColumns=True)


def install_overlay(spark: SparkSession, root: str, estimated: DataFrame, keys: tuple[str, ...] = ("source", "target"), *, nodes: DataFrame | None = None, keep: bool = True) -> int:
    """Merges estimated edges into the latest version (if any) and publishes the next; edges to unknown ``nodes`` stay out."""
    known = estimated
    if nodes is not None:
        for k in keys:
            known = known.join(nodes.select(F.col("node").alias(k)), k, "left_semi")
    have = versions(spark, root)
    merged = upserted(read_version(spark, root).drop("origin"), known, list(keys), keep=keep) if have else known.withColumn("origin", F.lit("estimated"))
    return publish(merged, root, base=str(have[-1]) if have else "")


def fingerprint(spark: SparkSession, paths: list[str]) -> list[list]:
    """Names, sizes and times of the files of some tables: what a result depends on, told without reading them."""
    out = []
    for path in paths:
        fs, p = _fs(spark, path)
        files = fs.listFiles(p, True)
        while files.hasNext():
            f = files.next()
            out.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
    return sorted(out)


def cached(spark: SparkSession, root: str, inputs: list[str], spec: dict, build: Callable[[], DataFrame]) -> DataFrame:
    """The result of ``build`` for these inputs and this spec, from the store if it is there.

    Its address is a hash of the inputs' fingerprint and the spec, so a changed file misses.  What is read back is
    checked against the checksum kept with it; a broken or half-written result is built again.
    """
    key = hashlib.sha256(json.dumps([fingerprint(spark, inputs), spec], sort_keys=True).encode()).hexdigest()[:32]
    base = f"{root}/{key}"
    fs, p = _fs(spark, f"{base}/about")
    if fs.exists(p):
        about = _read(spark, f"{base}/about")
        found = spark.read.schema(about["schema"]).parquet(f"{base}/rows")
        if checksum(found) == about["sum"]:
            return found
        fs.delete(p, False)
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{base}/about.claim"), False)  # of a broken result or a dead writer
    df = build()
    df.write.mode("overwrite").parquet(f"{base}/rows")
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    found = spark.read.schema(ddl).parquet(f"{base}/rows")
    _create(spark, f"{base}/about", json.dumps({"schema": ddl, "spec": spec, "sum": checksum(found)}, sort_keys=True))
    return found
