"""Connected components of a graph of links, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


def components(edges: DataFrame, scratch: c.Scratch, name: str) -> DataFrame:
    """Smallest node reachable from each node of ``edges(a, b)``, as (node, label).

    Alternates large stars (every node ties its larger neighbours to its smallest one) and small stars (every node ties
    its smaller neighbours and itself to the smallest), until all links point at the smallest node of their
    component: a logarithmic number of rounds, also on chains.  Nodes with very many links are dealt out by
    :func:`common.dealt`; only one count and one sum a round reach the driver.
    """
    links = scratch.table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}-links")
    before = None
    while True:
        both = scratch.table(links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v"))), f"{name}-both")
        near = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("n"))
        large = c.dealt(both.where("v > u"), near, ["u"], F.col("v"), scratch, f"{name}-near")
        large = scratch.table(large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), f"{name}-large")
        scratch.drop(f"{name}-both", f"{name}-links", f"{name}-near")
        near = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = c.dealt(large, near, ["u"], F.col("v"), scratch, f"{name}-low")
        tied = small.select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
        links = scratch.table(tied.where("u <> v").distinct(), f"{name}-links")
        scratch.drop(f"{name}-large", f"{name}-low")
        now = links.agg(F.count("*"), F.sum(F.col("v").cast("decimal(38,0)")), F.sum(F.col("u").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    found = links.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct()
    return scratch.table(found.union(roots), f"{name}-labels")
