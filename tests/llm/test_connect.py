"""Components end in few rounds, and hot keys are dealt without losing rows."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from ripplenet.llm import common as c
from ripplenet.llm.connect import components


def test_a_chain_of_1000_nodes_ends_in_few_rounds(spark):
    order = list(range(1000))
    random.Random(4).shuffle(order)
    chains = [(i, i + 1) for i in range(999)] + [(5000 + a, 5000 + b) for a, b in zip(order, order[1:], strict=False)] + [(9000, 9001), (9001, 9000), (9002, 9002)]
    scratch = c.Scratch(spark, "chains")
    rounds = 0
    table = scratch.table

    def counted(df, name, keep=False):
        nonlocal rounds
        rounds += name == "t-large"
        return table(df, name, keep)

    scratch.table = counted
    got = {r.node: r.label for r in components(spark.createDataFrame(chains, "a long, b long"), scratch, "t").collect()}
    want = {i: 0 for i in range(1000)} | {5000 + i: 5000 for i in range(1000)} | {9000: 9000, 9001: 9000}
    assert got == want and rounds <= 15
    assert components(spark.createDataFrame([], "a long, b long"), c.Scratch(spark, "none"), "t").count() == 0


def test_hot_keys_are_dealt_and_whole(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"), "id")
    keyed = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("lo"))
    got = c.dealt(rows, keyed, ["k"], F.col("id"), c.Scratch(spark, "dealt"), "keyed")
    assert got.count() == 20_000 and got.columns == ["k", "id", "lo"]
    assert got.where("k = -1").agg(F.max("lo"), F.count("*")).first() == (0, 6667)
    assert c.dealt(rows.limit(0), keyed.limit(0), ["k"], F.col("id"), c.Scratch(spark, "dealt"), "keyed", "left").count() == 0
