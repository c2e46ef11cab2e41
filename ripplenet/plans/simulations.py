"""Replays over the network's obligations due in one week."""

from __future__ import annotations

from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators import simulate as s
from ripplenet.plans.registry import query
from ripplenet.sources.network import Network

START = 40000.0
RULES = s.Rules(start=START, horizon=96.0, tick=24.0)


def network(n: Network):
    nodes = n.merchants.select(
        F.col("merchant_id").alias("m"), F.col("opening_minor").cast("double").alias("cash"), F.col("credit_minor").cast("double").alias("credit"), F.col("floor_minor").cast("double").alias("floor"), F.lit(0.0).alias("net"), "weight"
    )
    due = n.obligations.where(F.col("due_t").between(START, START + RULES.horizon) & e.is_open())
    book = due.groupBy(F.col("obligation_id").alias("oid"), "debtor", "creditor", "due_t", "priority").agg(F.sum(e.outstanding()).cast("double").alias("amount"))
    return s.cut(nodes), s.cut(book)


def _shocks(spark, rows):
    return spark.createDataFrame(rows, "run string, m string, t double, drain double")


def _actions(spark, rows=()):
    return spark.createDataFrame(list(rows), "run string, kind string, m string, oid string, amount double, t double, shift double")


def _runs(spark, names):
    return spark.createDataFrame([(x,) for x in names], "run string")


def week(spark, d):
    """Baseline, one shock, and the shock under two plans."""
    nodes, book = network(Network(spark, d))
    shock = [(r, "N1", START, 1e8) for r in ("shock", "cash", "credit")]
    plans = [("cash", "injection", "N1", None, 5e7, START, 0.0), ("credit", "credit_line", "N1", None, 8e7, START + 24, 0.0)]
    state, owed = s.replay(nodes.drop("weight"), book, _runs(spark, ["calm", "shock", "cash", "credit"]), _shocks(spark, shock), _actions(spark, plans), RULES)
    return nodes, state, owed


@query()
def replay_outcomes(spark, d):
    _, state, _ = week(spark, d)
    return state.select("run", "m", F.round("cash", 2).alias("cash"), "constrained_t", "defaulted_t", "hop", F.round("min_buffer", 2).alias("min_buffer"))


@query()
def counterfactual_gains(spark, d):
    nodes, state, owed = week(spark, d)
    scores = s.damage(state, owed, nodes, RULES)
    return s.gains(scores, "shock").join(scores, "run").select("run", F.round("disruption", 2).alias("disruption"), F.round("prevented", 2).alias("prevented"), F.round("share", 6).alias("share"), "n_affected", "n_defaulted", "max_hop")


@query()
def systemic_importance(spark, d):
    """Unit shock to every nation, all replays in one batch; marginal disruption against the baseline."""
    n = Network(spark, d)
    nodes, book = network(n)
    hit = nodes.where("m like 'N%'")
    runs = hit.select(F.concat(F.lit("hit-"), "m").alias("run")).union(_runs(spark, ["calm"]))
    shocks = hit.select(F.concat(F.lit("hit-"), "m").alias("run"), "m", F.lit(START).alias("t"), F.col("cash").alias("drain"))
    state, owed = s.replay(nodes.drop("weight"), book, runs, shocks, _actions(spark), RULES)
    scores = s.damage(state, owed, nodes, RULES)
    calm = scores.where("run = 'calm'").agg(F.max("disruption").alias("calm"))
    marginal = F.greatest(F.col("disruption") - F.col("calm"), F.lit(0.0))
    out = scores.where("run <> 'calm'").join(F.broadcast(calm)).select(F.substring("run", 5, 9).alias("merchant_id"), marginal.alias("marginal"), "n_affected", "max_hop")
    top = out.agg(F.max("marginal").alias("top"))
    return out.join(F.broadcast(top)).select("merchant_id", F.round("marginal", 2).alias("marginal"), F.round(F.coalesce(F.try_divide(F.col("marginal"), F.col("top")), F.lit(0.0)), 6).alias("importance"), "n_affected", "max_hop")


@query()
def value_of_speed(spark, d):
    """The same injection, each day later."""
    nodes, book = network(Network(spark, d))
    delays = [0, 24, 48, 72]
    shock = [(f"wait-{x}", "N1", START, 1e8) for x in delays] + [("none", "N1", START, 1e8)]
    plans = [(f"wait-{x}", "injection", "N1", None, 9e7, START + x, 0.0) for x in delays]
    state, owed = s.replay(nodes.drop("weight"), book, _runs(spark, [*(f"wait-{x}" for x in delays), "none"]), _shocks(spark, shock), _actions(spark, plans), RULES)
    return s.gains(s.damage(state, owed, nodes, RULES), "none").select("run", F.round("prevented", 2).alias("prevented"), F.round("share", 6).alias("share"))
