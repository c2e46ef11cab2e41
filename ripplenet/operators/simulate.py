"""Liquidity replays: all runs of a batch advance together, one tick at a time.

A run is one (scenario, plan) pair over the same network.  State is two tables, nodes and book, keyed by run;
a tick is a few joins on (run, merchant) and one fold per debtor over what falls due, so thousands of
runs are rows of the same jobs.  Each tick's state is written to the checkpoint folder.

Per tick: interventions and shocks, arrivals of the tick before, net inflow, settlement by
(priority, due time, larger first, id), default after the grace period.  An obligation is paid in full if the
money reaches, in part if at least ``partial`` of it can be paid, else missed; later ones still get what is left.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.graph import cut


@dataclass(frozen=True)
class Rules:
    start: float = 0.0
    horizon: float = 168.0
    tick: float = 24.0
    grace: float = 48.0
    partial: float = 0.10


def _sum_by(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum(value).alias(name))


def replay(nodes: DataFrame, book: DataFrame, runs: DataFrame, shocks: DataFrame, actions: DataFrame, rules: Rules = Rules()) -> tuple[DataFrame, DataFrame]:
    """Final (nodes, book) of every run.

    nodes(m, cash, credit, floor, net): balances and net inflow per hour; book(oid, debtor, creditor, amount, due_t,
    priority); runs(run); shocks(run, m, t, drain); actions(run, kind, m, oid, amount, t, shift) with kinds injection,
    credit_line, extension and acceleration.  Money is double.  Runs without shocks or actions are baselines.
    """
    shifts = actions.where("kind in ('extension', 'acceleration')").groupBy("run", "oid").agg(F.sum(F.when(F.col("kind") == "extension", F.col("shift")).otherwise(-F.col("shift"))).alias("move"))
    hit = shocks.select("run", "m").distinct().withColumn("shocked", F.lit(True))
    state = runs.join(nodes).join(hit, ["run", "m"], "left").select(
        "run", "m", "cash", "credit", "floor", "net", F.coalesce("shocked", F.lit(False)).alias("shocked"), F.lit(None).cast("double").alias("constrained_t"),
        F.lit(None).cast("double").alias("defaulted_t"), F.lit(None).cast("int").alias("hop"), F.lit(0.0).alias("arrived"), (F.col("cash") + F.col("credit") - F.col("floor")).alias("min_buffer"),
    )
    owed = runs.join(book).join(shifts, ["run", "oid"], "left").select(
        "run", "oid", "debtor", "creditor", "amount", F.col("amount").alias("left"), (F.col("due_t") + F.coalesce("move", F.lit(0.0))).alias("due_t"), "priority",
        F.lit(None).cast("double").alias("settled_t"), F.lit(False).alias("failed"),
    )
    state, owed = cut(state), cut(owed)
    at = rules.start
    while at < rules.start + rules.horizon:
        state, owed = _tick(state, owed, shocks, actions, at, min(at + rules.tick, rules.start + rules.horizon), rules)
        at += rules.tick
    return state, owed


def _tick(state: DataFrame, owed: DataFrame, shocks: DataFrame, actions: DataFrame, t0: float, t1: float, rules: Rules) -> tuple[DataFrame, DataFrame]:
    now = (F.col("t") >= t0) & (F.col("t") < t1)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    drain = _sum_by(shocks.where(now), ["run", "m"], "drain", "drain")
    cash_in = _sum_by(actions.where(now & (F.col("kind") == "injection")), ["run", "m"], "amount", "cash_in")
    line_in = _sum_by(actions.where(now & (F.col("kind") == "credit_line")), ["run", "m"], "amount", "line_in")
    starved = owed.where("failed and left > 0").join(state.select("run", F.col("m").alias("debtor"), "hop"), ["run", "debtor"]).groupBy("run", F.col("creditor").alias("m")).agg((F.min("hop") + 1).alias("from_hop"))
    ready = state.join(drain, ["run", "m"], "left").join(cash_in, ["run", "m"], "left").join(line_in, ["run", "m"], "left").join(starved, ["run", "m"], "left")
    ready = ready.withColumns({"cash": F.col("cash") + F.col("net") * (t1 - t0) + F.col("arrived") + zero("cash_in") - zero("drain"), "credit": F.col("credit") + zero("line_in")})

    due = owed.where((F.col("left") > 0) & (F.col("due_t") < t1))
    queue = due.groupBy("run", F.col("debtor").alias("m")).agg(F.array_sort(F.collect_list(F.struct("priority", "due_t", (-F.col("left")).alias("minus"), "oid", "creditor"))).alias("queue"))
    ready = ready.join(queue, ["run", "m"], "left").withColumn("avail", F.greatest(F.col("cash") + F.col("credit") - F.col("floor"), F.lit(0.0)))
    empty = F.array().cast("array<struct<oid:string,creditor:string,pay:double,rest:double>>")

    def settle(acc, x):
        need = -x["minus"]
        pay = F.when(acc["money"] >= need, need).when(acc["money"] >= rules.partial * need, acc["money"]).otherwise(0.0)
        entry = F.struct(x["oid"].alias("oid"), x["creditor"].alias("creditor"), pay.alias("pay"), (need - pay).alias("rest"))
        return F.struct((acc["money"] - pay).alias("money"), F.concat(acc["pays"], F.array(entry)).alias("pays"))

    fold = F.aggregate(F.col("queue"), F.struct(F.col("avail").alias("money"), empty.alias("pays")), settle)
    ready = cut(ready.withColumn("fold", F.when(F.col("queue").isNotNull(), fold)).drop("queue"))
    pays = ready.select("run", F.explode("fold.pays").alias("p")).select("run", "p.*")

    owed2 = owed.join(pays.select("run", "oid", "pay", "rest"), ["run", "oid"], "left").select(
        "run", "oid", "debtor", "creditor", "amount", F.coalesce("rest", "left").alias("left"), "due_t", "priority",
        F.when(F.col("settled_t").isNull() & (F.col("rest") <= 0), t1).otherwise(F.col("settled_t")).alias("settled_t"), (F.col("failed") | F.coalesce(F.col("rest") > 0, F.lit(False))).alias("failed"),
    )
    owed2 = cut(owed2)
    arrivals = _sum_by(pays, ["run", "creditor"], "pay", "arrived").withColumnRenamed("creditor", "m")
    broke = owed2.where((F.col("left") > 0) & (F.col("due_t") + rules.grace < t1)).select("run", F.col("debtor").alias("m")).distinct().withColumn("broke", F.lit(True))
    short = F.exists(F.coalesce("fold.pays", empty), lambda p: p.rest > 0)
    paid = F.col("cash") - F.coalesce(F.col("avail") - F.col("fold.money"), F.lit(0.0))
    draw = F.least(F.greatest(F.col("floor") - paid, F.lit(0.0)), F.col("credit"))
    fresh = short & F.col("constrained_t").isNull()
    nxt = ready.drop("arrived").join(arrivals, ["run", "m"], "left").join(broke, ["run", "m"], "left").select(
        "run", "m", (paid + draw).alias("cash"), (F.col("credit") - draw).alias("credit"), "floor", "net", "shocked",
        F.when(fresh, t0).otherwise(F.col("constrained_t")).alias("constrained_t"), F.coalesce("defaulted_t", F.when(F.col("broke"), t1)).alias("defaulted_t"),
        F.when(fresh, F.when(F.col("shocked"), 0).otherwise(F.coalesce("from_hop", F.lit(0)))).otherwise(F.col("hop")).alias("hop"),
        zero("arrived").alias("arrived"), F.least("min_buffer", paid + F.col("credit") - F.col("floor")).alias("min_buffer"),
    )
    return cut(nxt), owed2


def damage(state: DataFrame, owed: DataFrame, weights: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """(run, disruption, delayed_value, n_affected, n_defaulted, max_hop): weighted delay, defaults and shortfall."""
    end = rules.start + rules.horizon
    late = F.greatest(F.coalesce("settled_t", F.lit(end)) - F.col("due_t"), F.lit(0.0)) / 24.0
    late = F.when(F.col("failed"), late).otherwise(0.0)
    per = owed.groupBy("run", F.col("debtor").alias("m")).agg(F.sum(F.when(F.col("settled_t").isNull(), F.col("left")).otherwise(F.col("amount")) * late).alias("delay"), F.sum(F.when(F.col("failed"), F.col("amount")).otherwise(0.0)).alias("value"))
    j = state.join(per, ["run", "m"], "left").join(weights.select("m", "weight"), "m")
    hit = F.col("constrained_t").isNotNull()
    score = F.col("weight") * (F.coalesce("delay", F.lit(0.0)) + F.when(F.col("defaulted_t").isNotNull(), 500_000.0).otherwise(0.0) + 0.02 * F.greatest(-F.col("min_buffer"), F.lit(0.0)))
    return j.groupBy("run").agg(F.sum(score).alias("disruption"), F.sum(F.coalesce("value", F.lit(0.0))).alias("delayed_value"), F.count_if(hit).alias("n_affected"), F.count("defaulted_t").alias("n_defaulted"), F.max("hop").alias("max_hop"))


def gains(scores: DataFrame, baseline: str) -> DataFrame:
    """(run, prevented, share) against a reference run."""
    ref = scores.where(F.col("run") == baseline).agg(F.max("disruption").alias("ref"))
    prevented = F.col("ref") - F.col("disruption")
    return scores.join(F.broadcast(ref)).select("run", prevented.alias("prevented"), F.coalesce(F.try_divide(prevented, F.col("ref")), F.lit(0.0)).alias("share"))
