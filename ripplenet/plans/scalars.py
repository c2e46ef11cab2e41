"""Scalar laws applied to the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.functions import rules
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network


@query("""SELECT event_id, round(ln(1 + greatest(value, 0)), 9) AS log0, round(least(greatest(value, 0) / greatest(value - 50, 1), 5), 9) AS ratio, round(greatest(value - 30, 0) / 24, 9) AS lateness, round(exp(-0.01 * value), 9) AS discount,
 round(1 / (1 + exp(-least(greatest((value - 50) / 10, -50), 50))), 9) AS logistic, round(ln(p / (1 - p)), 9) AS logit FROM (SELECT *, least(greatest(value / 100, 1e-6), 1 - 1e-6) AS p FROM events)""")
def scalar_scores(spark, d):
    v = F.col("value")
    return Network(spark, d).read("events").select(
        "event_id", F.round(e.log0(v), 9).alias("log0"), F.round(e.bounded_ratio(v, v - 50, 5), 9).alias("ratio"), F.round(e.lateness(v - 30), 9).alias("lateness"), F.round(e.discount(v, 0.01), 9).alias("discount"),
        F.round(e.logistic((v - 50) / 10), 9).alias("logistic"), F.round(e.logit(v / 100), 9).alias("logit"),
    )


@query("SELECT event_id, round(exp(m + s*s/2), 6) AS mean, round(exp(m), 6) AS median, round((exp(s*s) - 1) * exp(2*m + s*s), 6) AS variance, round(ln(value) - ln(1 + 0.49)/2, 9) AS mu, round(sqrt(ln(1 + 0.49)), 9) AS sigma FROM (SELECT event_id, value, value / 50 AS m, 0.3 AS s FROM events WHERE value > 0)")
def lognormal_law(spark, d):
    v = Network(spark, d).read("events").where("value > 0").select("event_id", "value", (F.col("value") / 50).alias("m"), F.lit(0.3).alias("s"))
    mu, sigma = e.lognormal_from_mean_cv("value", F.lit(0.7))
    return v.select("event_id", F.round(e.lognormal_mean("m", "s"), 6).alias("mean"), F.round(e.lognormal_median("m"), 6).alias("median"), F.round(e.lognormal_variance("m", "s"), 6).alias("variance"), F.round(mu, 9).alias("mu"), F.round(sigma, 9).alias("sigma"))


@query()
def lognormal_cdf_and_quantile(spark, d):
    v = Network(spark, d).read("events").where("value > 0")
    return v.select("event_id", F.round(e.lognormal_cdf("value", F.lit(3.0), F.lit(0.8)), 6).alias("cdf"), F.round(e.lognormal_quantile(e.clip(F.col("value") / 101, 0.01, 0.99), F.lit(3.0), F.lit(0.8), cap=500.0), 4).alias("quantile"))


@query("SELECT event_id, round(CASE WHEN value - 20 >= 0 THEN 0.5 / 48 * exp(-(value - 20) / 48) ELSE 0 END, 12) AS kernel, round(greatest(1 + 0.3 * sin(2*pi()*value/168) + 0.2 * sin(2*pi()*value/720), 0.05), 9) AS season FROM events")
def kernel_and_season(spark, d):
    v = Network(spark, d).read("events")
    return v.select("event_id", F.round(e.hawkes_kernel(F.col("value") - 20, F.lit(0.5), F.lit(1 / 48)), 12).alias("kernel"), F.round(e.seasonality("value"), 9).alias("season"))


@query(SQL + "SELECT merchant_id, opening_minor + credit_minor - floor_minor AS buffer, greatest(-(opening_minor - floor_minor - 100000), 0) AS deficit, CASE WHEN level < 2 THEN round((opening_minor + credit_minor - floor_minor) / (1000.0 * weight), 6) END AS autonomy FROM merchants")
def balance_sheet(spark, d):
    b = e.buffer("opening_minor", "credit_minor", "floor_minor")
    burn = F.when(F.col("level") < 2, 1000.0 * F.col("weight"))
    return Network(spark, d).merchants.select("merchant_id", b.alias("buffer"), e.deficit(F.col("opening_minor") - F.col("floor_minor") - 100000).alias("deficit"), F.round(e.autonomy_hours(b, burn), 6).alias("autonomy"))


@query(SQL + """SELECT obligation_id, kind, round(CASE kind WHEN 'injection' THEN amount_minor WHEN 'credit_line' THEN 0.6 * amount_minor WHEN 'acceleration' THEN 0.0005 * 4 * amount_minor WHEN 'extension' THEN 0.0004 * 4 * amount_minor ELSE 0.01 * amount_minor END, 4) AS cost,
 CASE WHEN kind IN ('acceleration','extension') THEN 96.0 WHEN kind = 'restructure' THEN 672.0 ELSE 168.0 END AS hours FROM (SELECT *, (['injection','credit_line','acceleration','extension','restructure'])[priority] AS kind FROM obligations)""")
def action_costs(spark, d):
    kinds = F.array(*map(F.lit, ("injection", "credit_line", "acceleration", "extension", "restructure")))
    o = Network(spark, d).obligations.select("obligation_id", "amount_minor", F.element_at(kinds, F.col("priority")).alias("kind"))
    return o.select("obligation_id", "kind", F.round(e.action_cost("kind", F.col("amount_minor").cast("double"), F.lit(96.0)), 4).alias("cost"), e.action_duration("kind", F.lit(96.0), 168.0).alias("hours"))


@query("SELECT event_id, round(CASE WHEN dur <= 0 THEN CASE WHEN value >= 20 AND value < 30 THEN 2.0 ELSE 0 END ELSE 2.0 * greatest(least(30, value + dur) - greatest(20, value), 0) / nullif(dur, 0) END, 9) AS mass FROM (SELECT event_id, value, CAST(event_id % 3 * 8 AS DOUBLE) AS dur FROM events)")
def shock_mass_in_tick(spark, d):
    v = Network(spark, d).read("events").select("event_id", "value", (F.col("event_id") % 3 * 8).cast("double").alias("dur"))
    return v.select("event_id", F.round(e.shock_mass(F.lit(20.0), F.lit(30.0), F.col("value"), F.col("dur"), F.lit(2.0)), 9).alias("mass"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(round_even(l_extendedprice * l_discount * 100, 0) AS BIGINT) AS half_even_minor, CAST(round_even(l_extendedprice * l_discount * 100, 0) AS BIGINT) / 100 AS major FROM lineitem")
def money_rounding(spark, d):
    m = e.to_minor(F.col("l_extendedprice") * F.col("l_discount"))
    return Network(spark, d).read("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", m.alias("half_even_minor"), e.to_major(m).alias("major"))


@query("SELECT c_custkey, CAST(CASE WHEN c_mktsegment = 'BUILDING' THEN round_even(x, 0) ELSE round_even(x, 2) END AS DOUBLE) AS scaled FROM (SELECT *, CAST(c_acctbal AS DECIMAL(18,6)) AS x FROM customer)")
def decimal_money(spark, d):
    c = Network(spark, d).read("customer").withColumn("cur", F.when(F.col("c_mktsegment") == "BUILDING", "JPY").otherwise("USD"))
    return c.select("c_custkey", e.scaled_money("c_acctbal", "cur").cast("double").alias("scaled"))


@query("SELECT o_orderkey, (epoch_us(o_orderdate) - 788918400000000)/3.6e9 AS hours, CASE o_orderstatus WHEN 'F' THEN 'settled' WHEN 'O' THEN 'pending' ELSE 'unknown' END AS status FROM orders")
def time_and_status_mapping(spark, d):
    known = F.create_map(*[F.lit(x) for x in ("F", "settled", "O", "pending")])
    return Network(spark, d).read("orders").select("o_orderkey", e.hours("o_orderdate").alias("hours"), F.coalesce(F.try_element_at(known, F.col("o_orderstatus")), F.lit("unknown")).alias("status"))


@query("""SELECT event_id, CASE WHEN event_type IS NULL THEN 'no_id' WHEN value IS NULL THEN 'no_amount' WHEN value <= 1 THEN 'non_positive_amount' WHEN event_type IN ('error') THEN 'unsettled_status' WHEN user_id % 50 = 0 THEN 'unknown_party' WHEN user_id % 7 = event_id % 7 THEN 'self_payment' ELSE 'accepted' END AS reason FROM events""")
def record_validation(spark, d):
    v = Network(spark, d).read("events")
    reason = (
        F.when(F.col("event_type").isNull(), "no_id").when(F.col("value").isNull(), "no_amount").when(F.col("value") <= 1, "non_positive_amount").when(F.col("event_type").isin("error"), "unsettled_status")
        .when(F.col("user_id") % 50 == 0, "unknown_party").when(F.col("user_id") % 7 == F.col("event_id") % 7, "self_payment").otherwise("accepted")
    )
    return v.select("event_id", reason.alias("reason"))


@query("SELECT event_id, substr(sha256('{\"event_id\":' || event_id || ',\"user_id\":' || user_id || '}'), 1, 32) AS payload_hash, substr(sha256('plan|' || event_id), 1, 40) AS idempotency_key, CAST(('0x' || substr(sha256('7|late|' || event_id), 9, 8)) AS BIGINT) / 4294967296.0 AS u FROM events")
def hashes_and_common_random_numbers(spark, d):
    v = Network(spark, d).read("events")
    payload = F.substring(F.sha2(F.to_json(F.struct("event_id", "user_id")), 256), 1, 32)
    return v.select("event_id", payload.alias("payload_hash"), e.content_id(F.lit("plan"), "event_id", length=40).alias("idempotency_key"), e.uniform(F.lit("7"), F.lit("late"), F.col("event_id").cast("string")).alias("u"))


@query("SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('%.2fB', x/1e9) WHEN x >= 1e6 THEN printf('%.2fM', x/1e6) WHEN x >= 1e3 THEN printf('%.2fK', x/1e3) ELSE printf('%.2f', x) END AS label FROM (SELECT o_orderkey, floor(o_totalprice) * 64 AS x FROM orders)")
def money_formatting(spark, d):
    return Network(spark, d).read("orders").select("o_orderkey", e.compact_money(F.floor("o_totalprice") * 64.0).alias("label"))


ASK = "('delay ' || n_name || ' by ' || (n_nationkey * 7) || ' hours at ' || (n_regionkey + 0.5) || 'x')"


@query(f"SELECT n_nationkey, CAST(regexp_extract(q, 'by ([0-9]+) hours', 1) AS INT) AS hours, CAST(regexp_extract(q, 'at ([0-9.]+)x', 1) AS DOUBLE) AS size, CASE WHEN CAST(regexp_extract(q, 'at ([0-9.]+)x', 1) AS DOUBLE) BETWEEN 0.5 AND 4 AND CAST(regexp_extract(q, 'by ([0-9]+) hours', 1) AS INT) <= 120 THEN 'ok' ELSE 'refused' END AS verdict FROM (SELECT n_nationkey, {ASK} AS q FROM nation)")
def what_if_parser(spark, d):
    q = F.concat(F.lit("delay "), "n_name", F.lit(" by "), (F.col("n_nationkey") * 7).cast("string"), F.lit(" hours at "), (F.col("n_regionkey") + 0.5).cast("string"), F.lit("x"))
    n = Network(spark, d).read("nation").withColumn("q", q)
    n = n.withColumns({"hours": F.regexp_extract("q", r"by ([0-9]+) hours", 1).cast("int"), "size": F.regexp_extract("q", r"at ([0-9.]+)x", 1).cast("double")})
    return n.select("n_nationkey", "hours", "size", F.when(F.col("size").between(0.5, 4) & (F.col("hours") <= 120), "ok").otherwise("refused").alias("verdict"))


@query("SELECT event_id, len(list_filter(regexp_extract_all(props || ' 17', '[0-9]+'), lambda x: NOT list_contains(regexp_extract_all(props, '[0-9]+'), x))) AS n_ungrounded FROM events")
def grounding_check(spark, d):
    nums = lambda c: F.regexp_extract_all(c, F.lit("([0-9]+)"), 1)
    return Network(spark, d).read("events").select("event_id", F.size(F.array_except(nums(F.concat("props", F.lit(" 17"))), nums(F.col("props")))).cast("long").alias("n_ungrounded"))


RULE = "log(abs(value)) * 2 + user / (event_id + 1) - (value > 50)"


@query("SELECT event_id, round(ln(1 + abs(value)) * 2 + CASE WHEN event_id + 1 = 0 THEN 0 ELSE user_id / (event_id + 1) END - CASE WHEN value > 50 THEN 1 ELSE 0 END, 9) AS score FROM events")
def rule_formula(spark, d):
    v = Network(spark, d).read("events")
    score = rules.compile_rule(RULE, {"value": F.col("value"), "user": F.col("user_id").cast("double"), "event_id": F.col("event_id").cast("double")})
    return v.select("event_id", F.round(score, 9).alias("score"))
