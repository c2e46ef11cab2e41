"""Records around decisions: leverage, probe targets, request bounds, lag bands, traces, reconciliation, rule admission."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import graph as g
from ripplenet.operators import rule_search as s
from ripplenet.plans.graphs import R
from ripplenet.plans.ingestion import updates
from ripplenet.plans.joins import LAGS, response_lags
from ripplenet.plans.registry import query
from ripplenet.sources.network import SQL, Network
from ripplenet.streaming import ingest as i

END = 40168.0
#: The normal quantile at 0.9.
Z90 = 1.2815515655446004


@query(SQL + f"""SELECT merchant_id, round(coalesce(live, 0) / greatest(opening_minor + credit_minor - floor_minor, 1), 6) AS leverage FROM merchants
LEFT JOIN (SELECT debtor, sum(amount_minor - paid_minor) AS live FROM obligations WHERE amount_minor > paid_minor AND due_t <= {END} GROUP BY debtor) ON debtor = merchant_id""")
def leverage(spark, d):
    """Live obligations due within the horizon over the merchant's own buffer."""
    n = Network(spark, d)
    live = n.obligations.where(e.is_open() & (F.col("due_t") <= END)).groupBy(F.col("debtor").alias("merchant_id")).agg(F.sum(e.outstanding()).alias("live"))
    buf = F.greatest(e.buffer("opening_minor", "credit_minor", "floor_minor"), F.lit(1))
    return n.merchants.join(live, "merchant_id", "left").select("merchant_id", F.round(F.coalesce("live", F.lit(0)) / buf, 6).alias("leverage"))


@query(SQL + "SELECT (SELECT count(*) FROM inner_payments) AS n_events, (SELECT count(*) FROM edges) AS n_edges, round((SELECT count(*) FROM inner_payments) / greatest(1, (SELECT count(*) FROM edges)), 6) AS events_per_edge")
def observations_per_edge(spark, d):
    """What a learner of dependencies has to go by."""
    n = Network(spark, d)
    both = n.inner.agg(F.count("*").alias("n_events")).join(F.broadcast(n.edges.agg(F.count("*").alias("n_edges"))))
    return both.withColumn("events_per_edge", F.round(F.col("n_events") / F.greatest(F.lit(1), F.col("n_edges")), 6))


@query(R + """, w AS (SELECT source AS root, target AS node, 1 AS hops FROM edges UNION SELECT root, target, hops + 1 FROM w JOIN edges ON source = node WHERE hops < 3)
SELECT root AS merchant_id, count(DISTINCT node) AS n_reached FROM w WHERE node <> root GROUP BY root ORDER BY n_reached DESC, merchant_id LIMIT 12""")
def probe_targets(spark, d):
    """The merchants that reach most others within three hops."""
    n = Network(spark, d)
    own = n.edges.select(F.col("source").alias("root"), F.col("source").alias("node")).distinct()
    reached = g.reach(n.edges, own, 3).groupBy(F.col("root").alias("merchant_id")).agg(F.count("*").alias("n_reached"))
    return reached.orderBy(F.desc("n_reached"), "merchant_id").limit(12)


@query(SQL + """, q AS (SELECT event_id, 'N' || user_id % 30 AS m, user_id % 7 AS n_origins, value / 20 AS multiple, CAST(event_id % 180 AS DOUBLE) AS onset FROM events)
SELECT event_id, CASE WHEN merchant_id IS NULL THEN 'unknown_merchant' WHEN n_origins > 5 THEN 'too_many' WHEN multiple < 0.5 OR multiple > 4 THEN 'multiple' WHEN onset < 0 OR onset >= 168 THEN 'onset' ELSE 'ok' END AS verdict FROM q LEFT JOIN merchants ON merchant_id = m""")
def what_if_bounds(spark, d):
    """Requests for an analysis, and the first bound that each breaks."""
    n = Network(spark, d)
    q = n.read("events").select("event_id", F.concat(F.lit("N"), F.col("user_id") % 30).alias("m"), (F.col("user_id") % 7).alias("n_origins"), (F.col("value") / 20).alias("multiple"), (F.col("event_id") % 180).cast("double").alias("onset"))
    known = n.merchants.select(F.col("merchant_id").alias("m"), F.lit(True).alias("known"))
    return q.join(known, "m", "left").select("event_id", e.request_verdict("known", "n_origins", "multiple", "onset").alias("verdict"))


@query(SQL + LAGS + f""", law AS (SELECT m, avg(ln(lag)) AS mu, stddev_samp(ln(lag)) AS sd FROM lags WHERE lag > 0 AND lag <= 720 GROUP BY m)
SELECT merchant_id, round(coalesce(band, 12), 6) AS lag_band FROM merchants LEFT JOIN (SELECT target, avg(greatest(1, exp(mu + {Z90} * sd) - exp(mu - {Z90} * sd)) / 2) AS band FROM edges JOIN law ON m = source GROUP BY target) ON target = merchant_id""")
def incoming_lag_band(spark, d):
    """Half the spread between the lag deciles, averaged over the incoming edges; 12 hours without any."""
    n = Network(spark, d)
    ln = F.log("lag")
    law = response_lags(n).where("lag > 0").groupBy(F.col("m").alias("source")).agg(F.avg(ln).alias("mu"), F.stddev_samp(ln).alias("sd"))
    spread = F.exp(F.col("mu") + Z90 * F.col("sd")) - F.exp(F.col("mu") - Z90 * F.col("sd"))
    band = n.edges.join(law, "source").groupBy(F.col("target").alias("merchant_id")).agg(F.avg(F.greatest(F.lit(1.0), spread) / 2).alias("band"))
    return n.merchants.select("merchant_id").join(band, "merchant_id", "left").select("merchant_id", F.round(F.coalesce("band", F.lit(12.0)), 6).alias("lag_band"))


@query("""SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS caused_by,
 CASE WHEN event_type = 'error' THEN 'constrained' WHEN event_type = 'purchase' THEN 'settled' ELSE 'delivered' END AS kind FROM events""")
def recorded_trace(spark, d):
    """Recorded events of a run in order, each with the one before."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    kind = F.when(F.col("event_type") == "error", "constrained").when(F.col("event_type") == "purchase", "settled").otherwise("delivered")
    v = Network(spark, d).read("events")
    return v.select("user_id", "event_id", F.row_number().over(w).cast("long").alias("sequence"), F.lag("event_id").over(w).alias("caused_by"), kind.alias("kind"))


CUT = 1_705_300_000_000_000


@query(f"""WITH u AS (SELECT CAST(user_id AS VARCHAR) AS record, epoch_us(ts) AS us, event_id, CASE event_type WHEN 'click' THEN 'submitted' WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'held' WHEN 'purchase' THEN 'succeeded' ELSE 'failed' END AS state FROM events),
k AS (SELECT *, CASE state WHEN 'submitted' THEN 2 WHEN 'pending' THEN 3 WHEN 'held' THEN 4 ELSE 5 END AS r FROM u),
a AS (SELECT record, arg_min(state, (-r, us, event_id)) AS state FROM k WHERE us < {CUT} GROUP BY record), b AS (SELECT record, arg_min(state, (-r, us, event_id)) AS state FROM k WHERE us >= {CUT} GROUP BY record)
SELECT a.record, a.state AS before, CASE WHEN a.state IN ('succeeded', 'failed') OR b.state IS NULL THEN a.state ELSE b.state END AS after, CASE WHEN a.state IN ('succeeded', 'failed') THEN 'final' WHEN b.state IS NULL THEN 'unresolved' ELSE 'reconciled' END AS source FROM a LEFT JOIN b USING (record)""")
def reconciled_records(spark, d):
    """Open records read against later facts: final ones stay, the others take the facts' state or stay open.

    The ledger is what the events before the cut tell; the facts are all events after it.
    """
    u = updates(spark, d)
    ledger = i.fold_states(u.where(F.col("at") < CUT)).select("record", F.col("state").alias("before"))
    facts = i.fold_states(u.where(F.col("at") >= CUT)).select("record", F.col("state").alias("fact"))
    return i.reconcile(ledger, facts)


@query("""WITH t AS (SELECT event_id, event_type || ':' || json_extract_string(props, '$.k') AS text, event_type IN ('click', 'view') AND CAST(json_extract(props, '$.k') AS BIGINT) < 20 AS weak FROM events),
k AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY event_id) AS nth FROM t) SELECT event_id, CASE WHEN weak THEN 'weak_clues' WHEN nth > 1 THEN 'already_tried' ELSE 'admitted' END AS verdict FROM k""")
def rule_admission(spark, d):
    """Proposed rules: those of weak clues alone and repeats are refused, the first of a text is admitted."""
    k = F.get_json_object("props", "$.k")
    v = Network(spark, d).read("events").select("event_id", F.concat_ws(":", "event_type", k).alias("text"), (F.col("event_type").isin("click", "view") & (k.cast("long") < 20)).alias("weak"))
    first = v.groupBy("text").agg(F.min("event_id").alias("first"))
    verdict = F.when(F.col("weak"), "weak_clues").when(F.col("event_id") > F.col("first"), "already_tried").otherwise("admitted")
    return v.join(first, "text").select("event_id", verdict.alias("verdict"))


@query(SQL + "SELECT priority AS scenario, count(*) AS n_obligations, count(DISTINCT debtor) AS n_debtors, CAST(sum(greatest(amount_minor - paid_minor, 0)) AS BIGINT) AS open_minor, round(max(due_t), 6) AS last_due FROM obligations GROUP BY priority")
def scenario_summary(spark, d):
    """One line a stored scenario: its book, whom it touches, and when it ends."""
    o = Network(spark, d).obligations
    return o.groupBy(F.col("priority").alias("scenario")).agg(F.count("*").alias("n_obligations"), F.countDistinct("debtor").alias("n_debtors"), F.sum(F.greatest(e.outstanding(), F.lit(0))).alias("open_minor"), F.round(F.max("due_t"), 6).alias("last_due"))


CLUE_SQL = """, cl AS (SELECT debtor AS scenario, creditor AS candidate, ln(1 + sum(amount_minor - paid_minor)) AS owed, count(*) / 10 AS n, min(due_t) / 10000 AS due, avg(priority) AS urgency, CAST(sum(CASE WHEN priority <= 2 THEN amount_minor - paid_minor ELSE 0 END) AS DOUBLE) / 1e6 AS outcome
 FROM obligations WHERE amount_minor > paid_minor GROUP BY ALL)
"""
CLUES = ["owed", "n", "due", "urgency"]
#: Rules of the registered generation: each weight by a rule of its place.
RULES = [[((7 * i + 13 * k) % 11 - 5) / 5 for k in range(len(CLUES))] for i in range(24)]


def clue_rows(n: Network):
    """Open dues of each debtor by creditor: what rules rank, and the urgent part as the recorded outcome."""
    left = e.outstanding()
    urgent = F.sum(F.when(F.col("priority") <= 2, left).otherwise(0)).cast("double") / 1e6
    per = n.obligations.where(e.is_open()).groupBy(F.col("debtor").alias("scenario"), F.col("creditor").alias("candidate"))
    return per.agg(F.log1p(F.sum(left)).alias("owed"), (F.count("*") / 10).alias("n"), (F.min("due_t") / 10000).alias("due"), F.avg("priority").alias("urgency"), urgent.alias("outcome"))


@query(SQL + CLUE_SQL + ", r AS (SELECT range AS rule FROM range(24)), s AS (SELECT rule, scenario, candidate, outcome, round(" + " + ".join(f"((7 * rule + {13 * k}) % 11 - 5) / 5 * {c}" for k, c in enumerate(CLUES)) + """, 9) AS score FROM cl, r),
p AS (SELECT rule, scenario, arg_min(candidate, (-score, candidate)) AS candidate, arg_min(outcome, (-score, candidate)) AS outcome FROM s GROUP BY ALL),
b AS (SELECT rule, string_agg(scenario || ':' || candidate, ',' ORDER BY scenario) AS behaviour, avg(outcome) AS value, count(*) AS n FROM p GROUP BY rule)
SELECT CAST(rule AS INTEGER) AS rule, round(value, 6) AS value, n, CAST(min(rule) OVER (PARTITION BY behaviour) AS INTEGER) AS same_as FROM b""")
def rule_generation(spark, d):
    """The value of each rule of one generation, and the first rule that behaves as it does."""
    found = s.scored(s.picks(clue_rows(Network(spark, d)), CLUES, RULES))
    return found.select("rule", F.round("value", 6).alias("value"), "n", F.min("rule").over(Window.partitionBy("behaviour")).alias("same_as"))


@query()
def rule_search(spark, d):
    """Eight generations of the search over all debtors: best value, behaviours and best weights of each."""
    made = s.search(clue_rows(Network(spark, d)), CLUES, seed=7)
    return spark.createDataFrame([(g.number, round(g.best, 6), g.behaviours, g.rule) for g in made], "generation int, best double, behaviours int, rule array<double>")
