"""Shards: equal texts stay together, bytes stay even."""

from __future__ import annotations

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from ripplenet.llm import hilbert, queries


def laws(rows, shards):
    """Asserts the contract on (doc_id, size, text_crc32, curve, shard, slot) rows; gives the shards' bytes."""
    size, slots, places, groups = Counter(), defaultdict(list), defaultdict(list), defaultdict(list)
    for r in rows:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        places[r.shard].append(r.curve)
        groups[r.text_crc32, r.size].append(r)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and 0 <= min(size) and max(size) < shards
    seen = sorted(places)
    assert all(max(places[a]) <= min(places[b]) for a, b in zip(seen, seen[1:], strict=False))  # runs along the curve
    quarter, units = sum(size.values()) / shards / 4, [0]
    for (_, width), g in groups.items():
        fits = len(g) * width <= quarter
        units.append(len(g) * width if fits else width)
        assert len({r.curve for r in g}) == 1
        if fits:
            assert len({r.shard for r in g}) == 1
        else:
            at = sorted((r.shard, r.slot) for r in g)  # adjacent all the same
            assert all(b == (a[0], a[1] + 1) or (b[1] == 0 and b[0] > a[0]) for a, b in zip(at, at[1:], strict=False))
    mean = sum(size.values()) / shards
    assert all(abs(size[i] - mean) <= max(units) for i in range(shards))
    return size


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_registered_shards_keep_equal_texts_together(spark, sf):
    rows = queries.op2_hilbert_shards(spark, f"/root/testdata/{sf}").collect()
    assert len(rows) == spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").count()
    laws(rows, 40)


def test_a_third_of_all_rows_with_one_text(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, F.lit("the same text again and again")).otherwise(F.concat(F.lit("text "), F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")), F.col("id"))).alias("text"),
        F.concat(F.lit("l"), F.col("id") % 4).alias("lang"),
        F.concat(F.lit("s"), F.col("id") % 7).alias("source"),
    )
    size = laws(hilbert.hilbert_shards(docs, shards=12, rows_a_part=64).collect(), 12)
    assert max(size.values()) < 1.1 * min(size.values())
