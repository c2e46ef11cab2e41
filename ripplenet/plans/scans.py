"""Scans, filters and listings over the payment network."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import relational as r
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network

STATUS_SQL = """CASE WHEN status IN ('cancelled','restructured') THEN status
  WHEN NOT (amount_minor > paid_minor) AND settled_t <= due_t THEN 'settled' WHEN NOT (amount_minor > paid_minor) THEN 'settled_late'
  WHEN due_t + 48 < {at} THEN 'defaulted' WHEN paid_minor > 0 THEN 'partial' ELSE 'pending' END"""
OPEN_SQL = "greatest(amount_minor - paid_minor, 0)"


@query(SQL + "SELECT * FROM merchants")
def merchants_frame(spark, d):
    return Network(spark, d).merchants


@query(SQL + "SELECT event_id, layer, payer, payee, amount_minor, round(t, 6) AS t FROM payments")
def payments_frame(spark, d):
    return Network(spark, d).payments.withColumn("t", F.round("t", 6))


@query(SQL + "SELECT obligation_id, debtor, creditor, amount_minor, paid_minor, round(issued_t,6) AS issued_t, round(due_t,6) AS due_t, round(settled_t,6) AS settled_t, status, priority FROM obligations")
def obligations_frame(spark, d):
    o = Network(spark, d).obligations
    return o.withColumns({c: F.round(c, 6) for c in ("issued_t", "due_t", "settled_t")})


@query(SQL + "SELECT source, target, n, total_minor, round(pass_through, 9) AS pass_through FROM edges")
def edges_frame(spark, d):
    return Network(spark, d).edges.withColumn("pass_through", F.round("pass_through", 9))


@query(SQL + "SELECT event_id, payer, payee, amount_minor, t FROM payments WHERE t >= 10000 AND t < 10500")
def event_time_range(spark, d):
    return Network(spark, d).payments.where((F.col("t") >= 10000) & (F.col("t") < 10500)).select("event_id", "payer", "payee", "amount_minor", "t")


@query(SQL + "SELECT event_id, amount_minor, t FROM inner_payments WHERE payer = 'N3' AND payee = 'S7'")
def edge_history(spark, d):
    return Network(spark, d).inner.where("payer = 'N3' AND payee = 'S7'").select("event_id", "amount_minor", "t").orderBy("t", "event_id")


@query(SQL + "SELECT event_id, CASE WHEN payer = 'N5' THEN 'out' ELSE 'in' END AS direction, amount_minor, t FROM payments WHERE payer = 'N5' OR payee = 'N5'")
def merchant_events(spark, d):
    p = Network(spark, d).payments.where("payer = 'N5' OR payee = 'N5'")
    return p.select("event_id", F.when(F.col("payer") == "N5", "out").otherwise("in").alias("direction"), "amount_minor", "t")


@query(SQL + "SELECT event_id, payer, payee, amount_minor, t FROM payments WHERE t >= 5000 ORDER BY t, event_id, amount_minor LIMIT 100 OFFSET 50")
def event_page(spark, d):
    p = Network(spark, d).payments.where("t >= 5000").select("event_id", "payer", "payee", "amount_minor", "t")
    return r.page(p, [F.col("t"), F.col("event_id"), F.col("amount_minor")], 50, 100)


@query(SQL + "SELECT merchant_id, sector, tier, opening_minor, count(*) OVER () AS total FROM merchants WHERE sector = 'finance' AND tier IN ('large','medium') ORDER BY merchant_id LIMIT 10 OFFSET 2")
def merchant_listing(spark, d):
    m = Network(spark, d).merchants.where("sector = 'finance' AND tier IN ('large', 'medium')")
    total = m.agg(F.count("*").alias("total"))
    return r.page(m.select("merchant_id", "sector", "tier", "opening_minor"), [F.col("merchant_id")], 2, 10).join(F.broadcast(total))


@query(SQL + f"SELECT obligation_id, creditor, {OPEN_SQL} AS outstanding_minor, due_t FROM obligations WHERE debtor = 'N2' AND due_t >= 20000 AND due_t < 30000")
def payables_due_between(spark, d):
    o = Network(spark, d).obligations.where("debtor = 'N2' AND due_t >= 20000 AND due_t < 30000")
    return o.select("obligation_id", "creditor", e.outstanding().alias("outstanding_minor"), "due_t").orderBy("due_t", "obligation_id")


@query(SQL + f"SELECT obligation_id, debtor, {OPEN_SQL} AS outstanding_minor, due_t FROM obligations WHERE creditor = 'S3' AND amount_minor > paid_minor")
def open_receivables(spark, d):
    o = Network(spark, d).obligations.where((F.col("creditor") == "S3") & e.is_open())
    return o.select("obligation_id", "debtor", e.outstanding().alias("outstanding_minor"), "due_t").orderBy("due_t", "obligation_id")


@query(SQL + "SELECT source, target, n FROM edges WHERE n >= 5 AND pass_through >= 0.005 ORDER BY pass_through DESC, source, target LIMIT 50")
def thresholded_graph(spark, d):
    g = Network(spark, d).edges.where("n >= 5 AND pass_through >= 0.005")
    return g.orderBy(F.desc("pass_through"), "source", "target").limit(50).select("source", "target", "n")


@query(SQL + "SELECT DISTINCT 'out' AS side, source AS merchant, target AS neighbour FROM edges UNION ALL SELECT DISTINCT 'in', target, source FROM edges")
def neighbours(spark, d):
    g = Network(spark, d).edges
    out = g.select(F.lit("out").alias("side"), F.col("source").alias("merchant"), F.col("target").alias("neighbour")).distinct()
    return out.union(g.select(F.lit("in"), "target", "source").distinct())


@query(SQL + "SELECT layer, count(*) FILTER (payer = 'external_sink' OR payee = 'external_sink') AS n_off, count(*) FILTER (NOT (payer = 'external_sink' OR payee = 'external_sink')) AS n_in FROM payments GROUP BY layer")
def sink_predicate(spark, d):
    off = e.off_network("payer", "payee")
    return Network(spark, d).payments.groupBy("layer").agg(F.count_if(off).alias("n_off"), F.count_if(~off).alias("n_in"))


@query(SQL + "SELECT debtor, count(*) FILTER (amount_minor > paid_minor) AS n_open, count(*) FILTER (amount_minor > paid_minor AND due_t < 30000) AS n_overdue, count(*) FILTER (amount_minor > paid_minor AND due_t + 48 < 30000) AS n_defaulted FROM obligations GROUP BY debtor")
def obligation_predicates(spark, d):
    o = Network(spark, d).obligations
    return o.groupBy("debtor").agg(
        F.count_if(e.is_open()).alias("n_open"), F.count_if(e.is_overdue(30000.0)).alias("n_overdue"), F.count_if(e.is_defaulted(30000.0)).alias("n_defaulted")
    )


@query(SQL + f"SELECT {STATUS_SQL.format(at=40000)} AS state, count(*) AS n, CAST(sum({OPEN_SQL}) AS BIGINT) AS outstanding_minor FROM obligations GROUP BY 1")
def status_resolution(spark, d):
    o = Network(spark, d).obligations
    return o.groupBy(e.status(40000.0).alias("state")).agg(F.count("*").alias("n"), F.sum(e.outstanding()).alias("outstanding_minor"))


@query(SQL + """, paid AS (SELECT *, least(amount_minor, paid_minor + 100000) AS p2 FROM obligations WHERE amount_minor > paid_minor)
SELECT obligation_id, p2 AS paid_minor, amount_minor - p2 AS outstanding_minor, due_t AS original_due_t, due_t + 48 AS due_t FROM paid""")
def apply_payment(spark, d):
    o = Network(spark, d).obligations.where(e.is_open())
    paid = F.least(F.col("amount_minor"), F.col("paid_minor") + 100000)
    return o.select("obligation_id", paid.alias("paid_minor"), (F.col("amount_minor") - paid).alias("outstanding_minor"), F.col("due_t").alias("original_due_t"), (F.col("due_t") + 48).alias("due_t"))


@query(SQL + """, w AS (SELECT payer, payee, amount_minor, t FROM payments WHERE t < 40000 AND t >= 40000 - 2000)
SELECT payer, payee, count(*) AS n, CAST(sum(amount_minor) AS BIGINT) AS total_minor, min(t) AS first_t, max(t) AS last_t FROM w GROUP BY ALL""")
def observed_window(spark, d):
    p = Network(spark, d).payments.where(e.observed(40000.0, 2000.0))
    return p.groupBy("payer", "payee").agg(F.count("*").alias("n"), F.sum("amount_minor").alias("total_minor"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query(SQL + f"""SELECT obligation_id, CASE WHEN settled_t < 40000 THEN paid_minor ELSE 0 END AS paid_minor, {STATUS_SQL.format(at=40000).replace('paid_minor', '(CASE WHEN settled_t < 40000 THEN paid_minor ELSE 0 END)')} AS state
FROM obligations WHERE issued_t < 40000""")
def state_roll_forward(spark, d):
    o = Network(spark, d).obligations.where(e.observed(40000.0, t="issued_t"))
    o = o.withColumn("paid_minor", F.when(F.col("settled_t") < 40000, F.col("paid_minor")).otherwise(F.lit(0)))
    return o.select("obligation_id", "paid_minor", e.status(40000.0).alias("state"))


@query(SQL + "SELECT merchant_id, sector, tier, 0 AS opening_minor, 0 AS floor_minor, 0 AS credit_minor, 1 AS weight, level FROM merchants")
def latent_scrub(spark, d):
    m = Network(spark, d).merchants
    return m.withColumns({**{c: F.lit(0) for c in ("opening_minor", "floor_minor", "credit_minor")}, "weight": F.lit(1)})


@query(SQL + """, due AS (SELECT debtor, CAST(sum(greatest(amount_minor-paid_minor,0)) AS BIGINT) AS payable FROM obligations GROUP BY debtor)
SELECT merchant_id, tier, opening_minor, coalesce(payable, 0) AS payable FROM merchants LEFT JOIN due ON debtor = merchant_id ORDER BY due.payable DESC NULLS LAST, merchant_id LIMIT 40 OFFSET 5""")
def merchant_page(spark, d):
    n = Network(spark, d)
    due = n.obligations.groupBy(F.col("debtor").alias("merchant_id")).agg(F.sum(e.outstanding()).alias("payable"))
    m = n.merchants.join(due, "merchant_id", "left").select("merchant_id", "tier", "opening_minor", "payable")
    return r.page(m, [F.desc_nulls_last("payable"), F.col("merchant_id")], 5, 40).na.fill(0)


@query(SQL + """, flow AS (SELECT m, CAST(sum(a) AS BIGINT) AS throughput FROM (SELECT payer AS m, amount_minor AS a FROM inner_payments UNION ALL SELECT payee, amount_minor FROM inner_payments) GROUP BY m)
SELECT merchant_id, sector, throughput, row_number() OVER (ORDER BY throughput DESC, merchant_id) AS rank FROM merchants JOIN flow ON m = merchant_id WHERE sector = 'retail' ORDER BY throughput DESC, merchant_id LIMIT 8""")
def find_merchants(spark, d):
    n = Network(spark, d)
    flow = n.inner.select(F.col("payer").alias("merchant_id"), "amount_minor").union(n.inner.select("payee", "amount_minor")).groupBy("merchant_id").agg(F.sum("amount_minor").alias("throughput"))
    found = n.merchants.where("sector = 'retail'").join(flow, "merchant_id").select("merchant_id", "sector", "throughput")
    top = found.orderBy(F.desc("throughput"), "merchant_id").limit(8)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("throughput"), "merchant_id")).cast("long"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, event_type FROM events WHERE event_type IN ('purchase','error') AND value > 50")
def json_extraction(spark, d):
    v = Network(spark, d).read("events").where("event_type IN ('purchase', 'error') AND value > 50")
    return v.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")


@query("SELECT max(epoch_us(ts)) AS newest_micros, count(*) AS n, event_type FROM events GROUP BY event_type")
def import_watermark(spark, d):
    v = Network(spark, d).read("events")
    return v.groupBy("event_type").agg(F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("newest_micros"), F.count("*").alias("n"))


@query("SELECT o_orderkey AS order_id, concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS payment_id, l_quantity AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag <> 'R'")
def order_expansion(spark, d):
    n = Network(spark, d)
    kept = n.read("lineitem").where("l_returnflag <> 'R'").withColumnRenamed("l_orderkey", "order_id")
    return n.read("orders").select(F.col("o_orderkey").alias("order_id")).join(kept, "order_id").select("order_id", F.concat_ws("-", "order_id", "l_partkey", "l_suppkey", "l_linenumber").alias("payment_id"), F.col("l_quantity").alias("quantity"))


@query(SQL + """, facts AS (SELECT l_orderkey AS k, max(shipped) AS last_t FROM lines GROUP BY l_orderkey)
SELECT obligation_id, coalesce(o.settled_t, f.last_t) AS settled_t FROM obligations o LEFT JOIN facts f ON f.k = CAST(split_part(o.obligation_id, '-', 1) AS BIGINT) AND o.status = 'partial'""")
def point_update(spark, d):
    n = Network(spark, d)
    facts = n.read("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max(e.hours("l_shipdate")).alias("last_t"))
    o = n.obligations.withColumn("k", F.when(F.col("status") == "partial", F.split_part("obligation_id", F.lit("-"), F.lit(1)).cast("long")))
    return o.join(facts, "k", "left").select("obligation_id", F.coalesce("settled_t", "last_t").alias("settled_t"))


@query(SQL + "SELECT merchant_id, sector FROM merchants")
def graph_payload_round_trip(spark, d):
    m = Network(spark, d).merchants.select("merchant_id", "sector")
    text = m.select(F.to_json(F.struct("merchant_id", "sector")).alias("j"))
    return text.select(F.from_json("j", m.schema).alias("x")).select("x.*")
