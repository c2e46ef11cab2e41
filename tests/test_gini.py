"""The Gini coefficient where merchants times all they moved is no longer a 64-bit number."""

from __future__ import annotations

import duckdb
from conftest import SF
from pyspark.sql import functions as F

from ripplenet.plans import aggregates, registry


def test_gini_of_large_amounts(spark, tmp_path):
    con = duckdb.connect()
    for t in ("customer", "supplier", "part", "orders", "lineitem"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        if t == "lineitem":
            rows = rows.withColumn("l_extendedprice", F.col("l_extendedprice") * 10_000_000)
        rows.write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    n, moved = spark.read.parquet(f"{SF}/part.parquet").selectExpr("count(distinct p_brand)").first()[0], aggregates.roles(aggregates.Network(spark, str(tmp_path)))[2].agg(F.sum("throughput_minor")).first()[0]
    assert n * moved > 2**63
    assert aggregates.gini(spark, str(tmp_path)).first().gini == con.execute(registry.oracle_sql()["gini"]).fetchone()[0]
