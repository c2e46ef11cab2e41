"""The payment network over the driver tables, as DataFrames and as SQL.

``Network`` holds the four tables every operator works on: merchants, payments (the fact table,
never pre-aggregated), obligations and the learned overlay of dependency edges.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e

SECTORS = ("retail", "manufacturing", "logistics", "services", "finance")
TIERS = ("large", "medium", "small")


def _pick(key: str, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.col(key) % len(names) + 1).cast("int"))


class Network:
    """Lazily derived tables of one dataset."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def derived(self, **tables: DataFrame) -> Network:
        """The same network with some of its tables replaced."""
        out = Network(self.spark, self.dir)
        out.__dict__.update(tables)  # cached properties
        return out

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        """Line items with their order and the customer's nation."""
        orders = self.read("orders").join(self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        items = self.read("lineitem")
        return items.join(orders.withColumnRenamed("o_orderkey", "l_orderkey"), "l_orderkey").withColumns(
            {
                "amount_minor": F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long"),
                "shipped": e.hours("l_shipdate"),
                "ordered": e.hours("o_orderdate"),
                "line": F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
            }
        )

    @cached_property
    def trade(self) -> DataFrame:
        return self._layer("trade", self.lines, F.concat(F.lit("N"), "c_nationkey"), F.concat(F.lit("S"), "l_suppkey"), F.col("amount_minor"), F.col("shipped"))

    @cached_property
    def supply(self) -> DataFrame:
        part = self.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_retailprice")
        amount = F.round(F.col("l_quantity") * F.col("p_retailprice") * 25).cast("long")
        return self._layer("supply", self.lines.join(part, "l_partkey"), F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("B"), F.substring("p_brand", 7, 9)), amount, F.col("shipped") + 24 * F.col("l_linenumber"))

    @cached_property
    def levy(self) -> DataFrame:
        supplier = self.read("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
        amount = F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * F.col("l_tax") * 100).cast("long")
        rows = self._layer("levy", self.lines.join(supplier, "l_suppkey"), F.concat(F.lit("S"), "l_suppkey"), F.concat(F.lit("N"), "s_nationkey"), amount, F.col("shipped") + 1)
        return rows.where("amount_minor > 0")

    @cached_property
    def exogenous(self) -> DataFrame:
        orders = self.read("orders").join(self.read("customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
        rows = orders.withColumn("line", F.col("o_orderkey").cast("string"))
        return self._layer("exogenous", rows, F.lit(e.SINK), F.concat(F.lit("N"), "c_nationkey"), F.round(F.col("o_totalprice") * 100).cast("long"), e.hours("o_orderdate"))

    @staticmethod
    def _layer(name: str, rows: DataFrame, payer: Column, payee: Column, amount: Column, t: Column) -> DataFrame:
        return rows.select(
            F.concat(F.lit(f"{name}-"), "line").alias("event_id"), F.lit(name).alias("layer"), payer.alias("payer"), payee.alias("payee"), amount.alias("amount_minor"), t.alias("t")
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self.trade.union(self.supply).union(self.levy).union(self.exogenous)

    @cached_property
    def inner(self) -> DataFrame:
        """Payments between merchants."""
        return self.trade.union(self.supply).union(self.levy)

    @cached_property
    def merchants(self) -> DataFrame:
        nations = self.read("customer").groupBy(F.col("c_nationkey").alias("key")).agg(F.sum(F.round(F.greatest("c_acctbal", F.lit(0)) * 100).cast("long")).alias("opening_minor"))
        nations = nations.select(F.concat(F.lit("N"), "key").alias("merchant_id"), F.col("key").cast("long").alias("key"), "opening_minor", F.lit(0).alias("level"))
        suppliers = self.read("supplier").select(
            F.concat(F.lit("S"), "s_suppkey").alias("merchant_id"), F.col("s_suppkey").alias("key"), F.round(F.greatest("s_acctbal", F.lit(0)) * 100).cast("long").alias("opening_minor"), F.lit(1).alias("level")
        )
        brands = self.read("part").select(F.substring("p_brand", 7, 9).alias("b")).distinct()
        brands = brands.select(F.concat(F.lit("B"), "b").alias("merchant_id"), F.col("b").cast("long").alias("key"), F.lit(1_000_000).cast("long").alias("opening_minor"), F.lit(2).alias("level"))
        return nations.union(suppliers).union(brands).select(
            "merchant_id",
            _pick("key", SECTORS).alias("sector"),
            _pick("key", TIERS).alias("tier"),
            "opening_minor",
            F.expr("opening_minor div 10").alias("floor_minor"),
            F.expr("opening_minor div 5").alias("credit_minor"),
            (F.col("key") % 3 + 1).alias("weight"),
            "level",
        )

    @cached_property
    def obligations(self) -> DataFrame:
        o = F.col("o_orderstatus")
        paid = F.when(o == "F", F.col("amount_minor")).when(o == "P", F.expr("amount_minor div 2")).otherwise(F.lit(0))
        return self.lines.select(
            F.col("line").alias("obligation_id"),
            F.concat(F.lit("N"), "c_nationkey").alias("debtor"),
            F.concat(F.lit("S"), "l_suppkey").alias("creditor"),
            "amount_minor",
            paid.cast("long").alias("paid_minor"),
            F.col("ordered").alias("issued_t"),
            (F.col("ordered") + 720).alias("due_t"),
            F.when(o == "F", F.greatest("shipped", "ordered")).alias("settled_t"),
            F.when(o == "F", "settled").when(o == "P", "partial").otherwise("pending").alias("status"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"),
        )

    @cached_property
    def pairs(self) -> DataFrame:
        """Count and value per ordered pair of merchants."""
        return self.inner.groupBy("payer", "payee").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total_minor"))

    @cached_property
    def edges(self) -> DataFrame:
        """Overlay: the three strongest payees of each payer, with their share of its outflow."""
        w = Window.partitionBy("payer")
        rank = F.row_number().over(w.orderBy(F.desc("total_minor"), "payee"))
        share = F.col("total_minor") / F.sum("total_minor").over(w)
        rows = self.pairs.withColumns({"pass_through": share, "rank": rank}).where("rank <= 3")
        return rows.select(F.col("payer").alias("source"), F.col("payee").alias("target"), "n", "total_minor", "pass_through")


#: The same tables for DuckDB, as the head of a query.
SQL = """
WITH lines AS (
  SELECT l.*, o.o_orderstatus, o.o_orderpriority, c.c_nationkey,
    CAST(round(l_extendedprice*(1-l_discount)*100) AS BIGINT) AS amount_minor,
    (epoch_us(l_shipdate) - 788918400000000)/3.6e9 AS shipped,
    (epoch_us(o_orderdate) - 788918400000000)/3.6e9 AS ordered,
    concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS line
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN customer c ON o.o_custkey = c.c_custkey),
trade AS (SELECT 'trade-' || line AS event_id, 'trade' AS layer, 'N' || c_nationkey AS payer, 'S' || l_suppkey AS payee, amount_minor, shipped AS t FROM lines),
supply AS (SELECT 'supply-' || line AS event_id, 'supply' AS layer, 'S' || l_suppkey AS payer, 'B' || substr(p_brand, 7) AS payee,
  CAST(round(l_quantity*p_retailprice*25) AS BIGINT) AS amount_minor, shipped + 24*l_linenumber AS t FROM lines JOIN part ON l_partkey = p_partkey),
levy AS (SELECT * FROM (SELECT 'levy-' || line AS event_id, 'levy' AS layer, 'S' || l_suppkey AS payer, 'N' || s_nationkey AS payee,
  CAST(round(l_extendedprice*(1-l_discount)*l_tax*100) AS BIGINT) AS amount_minor, shipped + 1 AS t FROM lines JOIN supplier ON l_suppkey = s_suppkey) WHERE amount_minor > 0),
exogenous AS (SELECT 'exogenous-' || o_orderkey AS event_id, 'exogenous' AS layer, 'external_sink' AS payer, 'N' || c_nationkey AS payee,
  CAST(round(o_totalprice*100) AS BIGINT) AS amount_minor, (epoch_us(o_orderdate) - 788918400000000)/3.6e9 AS t FROM orders JOIN customer ON o_custkey = c_custkey),
inner_payments AS (SELECT * FROM trade UNION ALL SELECT * FROM supply UNION ALL SELECT * FROM levy),
payments AS (SELECT * FROM inner_payments UNION ALL SELECT * FROM exogenous),
base AS (
  SELECT 'N' || c_nationkey AS merchant_id, CAST(c_nationkey AS BIGINT) AS key, CAST(sum(CAST(round(greatest(c_acctbal,0)*100) AS BIGINT)) AS BIGINT) AS opening_minor, 0 AS level FROM customer GROUP BY c_nationkey
  UNION ALL SELECT 'S' || s_suppkey, s_suppkey, CAST(round(greatest(s_acctbal,0)*100) AS BIGINT), 1 FROM supplier
  UNION ALL SELECT DISTINCT 'B' || substr(p_brand, 7), CAST(substr(p_brand, 7) AS BIGINT), 1000000, 2 FROM part),
merchants AS (SELECT merchant_id, (['retail','manufacturing','logistics','services','finance'])[key % 5 + 1] AS sector, (['large','medium','small'])[key % 3 + 1] AS tier,
  opening_minor, opening_minor // 10 AS floor_minor, opening_minor // 5 AS credit_minor, key % 3 + 1 AS weight, level FROM base),
obligations AS (
  SELECT line AS obligation_id, 'N' || c_nationkey AS debtor, 'S' || l_suppkey AS creditor, amount_minor,
    CAST(CASE o_orderstatus WHEN 'F' THEN amount_minor WHEN 'P' THEN amount_minor // 2 ELSE 0 END AS BIGINT) AS paid_minor,
    ordered AS issued_t, ordered + 720 AS due_t, CASE WHEN o_orderstatus = 'F' THEN greatest(shipped, ordered) END AS settled_t,
    CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'P' THEN 'partial' ELSE 'pending' END AS status, CAST(substr(o_orderpriority, 1, 1) AS INT) AS priority
  FROM lines),
pairs AS (SELECT payer, payee, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor FROM inner_payments GROUP BY ALL),
edges AS (SELECT payer AS source, payee AS target, n, total_minor, pass_through FROM (
  SELECT *, total_minor / sum(total_minor) OVER (PARTITION BY payer) AS pass_through, row_number() OVER (PARTITION BY payer ORDER BY total_minor DESC, payee) AS rank FROM pairs) WHERE rank <= 3)
"""
