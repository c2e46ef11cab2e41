"""Interventions: candidates, feasibility, subsets, selection.

Plans are rows.  Subsets grow by self-joins on ordered ids, all of one size are scored in one batch, and duplicates
of a plan are dropped before anything is replayed.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e
from ripplenet.operators.relational import placed

MULTIPLES = (0.6, 1.0, 1.5)
#: Actions that a search over sets accepts; it refuses more, for it never drops any.
MOST_ACTIONS = 2000
#: Sets that one task decodes and scores; actions whose sets give the first bound.
SETS_A_TASK, SEED_ACTIONS = 1 << 20, 12


def injections(exposed: DataFrame, multiples: tuple[float, ...] = MULTIPLES, least: float = 1000.0) -> DataFrame:
    """(kind, m, amount, cost) of cash sized by the shortfall, and a credit line at 1."""
    cash = exposed.withColumn("x", F.explode(F.array(*map(F.lit, multiples)))).select(F.lit("injection").alias("kind"), "m", (F.col("shortfall") * F.col("x")).alias("amount"))
    line = exposed.select(F.lit("credit_line").alias("kind"), "m", F.col("shortfall").cast("double").alias("amount"))
    both = cash.union(line).where(F.col("amount") >= least)
    return both.withColumn("cost", e.action_cost("kind", "amount", F.lit(0.0)))


def action_id(*parts: str) -> Column:
    return F.concat(F.lit("a-"), e.content_id(*parts, length=12))


def violations(rules: dict[str, Column]) -> Column:
    """Names of the rules that a row breaks."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in rules.items()]))


#: What each factor weighs once all are scaled to [0, 1] over the pool.
FACTORS = {"disruption": 1.0, "urgency": 0.5, "centrality": 0.5, "leverage": 0.75, "log_cost": -0.25}


def scored_actions(actions: DataFrame, nodes: DataFrame, horizon: float, *, weights: dict[str, float] = FACTORS, price: float = 1.0) -> DataFrame:
    """(id, m, cost, the factors, score, benefit) of feasible actions.

    ``actions`` holds (id, m, cost); ``nodes`` (m, probability, hit_t, at_risk, centrality, leverage), one row a merchant: the chance to be
    hit and when, what its dependants owe, its place in the network and its dues over its buffer.  Merchants without a row count as never hit.
    Factors are scaled over the pool before they are weighed (a constant one gives 0); the extremes are one row.  ``benefit`` bounds what an action is worth: it
    protects no more than the value behind it, less ``price`` times its cost.
    """
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    raw = {
        "disruption": zero("probability") * zero("at_risk"),
        "urgency": 1 / (1 + F.greatest(F.coalesce("hit_t", F.lit(horizon)), F.lit(0.0)) / 24),
        "centrality": zero("centrality"),
        "leverage": zero("leverage"),
        "log_cost": F.log1p(F.greatest("cost", F.lit(0.0))),
    }
    rows = actions.join(nodes, "m", "left").select("id", "m", "cost", *[f.alias(x) for x, f in raw.items()])
    ends = rows.agg(*[f(x).alias(f"{n}_{x}") for x in raw for n, f in (("lo", F.min), ("hi", F.max))])
    score = F.lit(0.0)
    for x, w in weights.items():
        reach = F.col(f"hi_{x}") - F.col(f"lo_{x}")
        score = score + w * F.when(reach < 1e-12, 0.0).otherwise((F.col(x) - F.col(f"lo_{x}")) / reach)
    benefit = F.greatest("disruption", "leverage") - price * F.col("cost")
    return rows.join(F.broadcast(ends)).select("id", "m", "cost", *raw, F.round(score, 9).alias("score"), benefit.alias("benefit"))


def retained_actions(scored: DataFrame, limit: int, per_merchant: int = 1) -> DataFrame:
    """The scored actions with ``place``, null for those that are not retained.

    Two rankings, by score and by benefit, are taken from in turn until ``limit`` are found; a merchant holds at most ``per_merchant`` of them.
    An action counts where it first comes up: at 2a - 1 as a-th by score or 2b as b-th by benefit.  Places come from ranges of the orders.
    """
    both = placed(placed(scored, [F.desc("score"), F.col("id")], "a"), [F.desc("benefit"), F.col("id")], "b")
    turn = both.withColumn("turn", F.least(2 * F.col("a") - 1, 2 * F.col("b")))
    nth = F.row_number().over(Window.partitionBy("m").orderBy("turn"))  # the actions of one merchant: kinds times sizes
    fits = placed(turn.withColumn("nth", nth).where(F.col("nth") <= per_merchant).select("id", "turn"), [F.col("turn")])
    return scored.join(fits.where(F.col("place") <= limit).select("id", "place"), "id", "left")


def subsets(actions: DataFrame, most: int) -> DataFrame:
    """(plan, size, members) of every set of up to ``most`` actions with one action a merchant.

    ``actions`` are (id, m) rows that are feasible one by one; the number of sets is bounded by the pool that the caller
    states, which is checked before anything is replayed.
    """
    one = actions.select(F.array("id").alias("members"), F.array("m").alias("ms"), F.col("id").alias("last"))
    out, level = one, one
    nxt = actions.select(F.col("id").alias("next"), F.col("m").alias("next_m"))
    for _ in range(most - 1):
        grown = level.join(nxt, F.col("next") > F.col("last")).where(~F.array_contains("ms", F.col("next_m")))
        level = grown.select(F.concat("members", F.array("next")).alias("members"), F.concat("ms", F.array("next_m")).alias("ms"), F.col("next").alias("last"))
        out = out.union(level)
    return out.select(F.concat_ws("+", "members").alias("plan"), F.size("members").alias("size"), "members")


def pairwise_value(plans: DataFrame, gains: DataFrame, overlaps: DataFrame) -> DataFrame:
    """(plan, value, cost): single gains less pairwise overlaps."""
    each = plans.select("plan", F.explode("members").alias("id")).join(gains, "id").groupBy("plan").agg(F.sum("gain").alias("gain"), F.sum("cost").alias("cost"))
    pairs = plans.select("plan", F.explode("members").alias("a"), "members").select("plan", "a", F.explode("members").alias("b")).where("a < b")
    lost = pairs.join(overlaps, ["a", "b"]).groupBy("plan").agg(F.sum("overlap").alias("lost"))
    return each.join(lost, "plan", "left").select("plan", (F.col("gain") - F.coalesce("lost", F.lit(0.0))).alias("value"), "cost")


def robust(worlds: DataFrame, kappa: float = 0.5, penalty: float = 0.0, tail: float | None = None) -> DataFrame:
    """(plan, mean, spread, score): mean plus kappa times the spread over worlds (deviation or tail mean)."""
    spread = F.stddev_pop("disruption")
    if tail is not None:
        worst = F.slice(F.sort_array(F.collect_list("disruption"), asc=False), 1, F.greatest(F.ceil(F.count("*") * tail), F.lit(1)).cast("int"))
        spread = F.aggregate(worst, F.lit(0.0), lambda a, x: a + x) / F.size(worst) - F.avg("disruption")
    g = worlds.groupBy("plan").agg(F.avg("disruption").alias("mean"), spread.alias("spread"), F.max("cost").alias("cost"))
    return g.select("plan", "mean", "spread", (F.col("mean") + kappa * F.col("spread") + penalty * F.col("cost")).alias("score"))


def greedy(actions: DataFrame, evaluate: Callable[[DataFrame], DataFrame], rounds: int, *, per_cost: bool = True) -> list[str]:
    """Ids picked one a round: the best gain (per cost) over the plan so far; stops when nothing helps.

    ``evaluate`` scores a batch of (plan, members) rows as (plan, value); a round is one batch of all candidates.
    """
    picked: list[str] = []
    best = 0.0
    for _ in range(rounds):
        left = actions.where(~F.col("id").isin(picked)) if picked else actions
        trial = left.select("id", "cost", F.array_sort(F.array(*map(F.lit, picked), "id")).alias("members")).withColumn("plan", F.concat_ws("+", "members"))
        scored = trial.join(evaluate(trial.select("plan", "members").dropDuplicates(["plan"])), "plan").withColumn("gain", F.col("value") - best)
        key = F.col("gain") / F.greatest("cost", F.lit(1.0)) if per_cost else F.col("gain")
        top = scored.where("gain > 1e-9").withColumn("key", key).orderBy(F.desc("key"), "id").first()
        if top is None:
            break
        picked.append(top["id"])
        best = top["value"]
    return picked


def decoded(places: np.ndarray, size: int, n: int) -> np.ndarray:
    """The sets of ``size`` numbers below n at these places of the order by greatest member, next greatest and so on."""
    out = np.empty((len(places), size), np.int64)
    left = places.copy()
    for at in range(size, 0, -1):
        table = np.array([math.comb(c, at) for c in range(n + 1)], np.int64)
        out[:, size - at] = np.searchsorted(table, left, "right") - 1
        left = left - table[out[:, size - at]]
    return out


class Pool:
    """Actions by falling gain, what any two of them overlap, and the values of sets of them."""

    def __init__(self, actions: DataFrame, overlap: Callable[[np.ndarray, np.ndarray], np.ndarray]):
        rows = actions.select("id", "m", "gain", "cost").limit(MOST_ACTIONS + 1).collect()
        if len(rows) > MOST_ACTIONS:
            raise ValueError(f"a search over sets takes at most {MOST_ACTIONS} actions")
        rows.sort(key=lambda r: (-r.gain, r.id))
        self.ids = [r.id for r in rows]
        self.gain, self.cost = (np.array([getattr(r, c) for r in rows], float) for c in ("gain", "cost"))
        names = sorted({r.m for r in rows})
        self.owner = np.array([names.index(r.m) for r in rows], np.int64)
        self.lost = overlap(self.gain[:, None], self.gain[None, :]) if rows else np.zeros((0, 0))

    def values(self, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, cost, whether no merchant acts twice) of each row of members."""
        value, fine = self.gain[sets].sum(1), np.ones(len(sets), bool)
        for i in range(sets.shape[1]):
            for j in range(i):
                value = value - self.lost[sets[:, j], sets[:, i]]
                fine &= self.owner[sets[:, j]] != self.owner[sets[:, i]]
        return value, self.cost[sets].sum(1), fine

    def reach(self, size: int, least: float) -> int:
        """Actions that a set of this size worth ``least`` can have: with falling gains and no negative overlap a later
        greatest member brings at most its own gain beside the first ones'."""
        n = len(self.ids)
        if n == 0 or self.lost.min() < 0:
            return n
        bound = self.gain + np.maximum(self.gain, 0)[: size - 1].sum()
        return int(np.searchsorted(-bound, -least, "right"))

    def seed(self, most: int, keep: int) -> float:
        """Value that the ``keep`` best plans reach for sure, from the sets of the first few actions."""
        n = min(len(self.ids), SEED_ACTIONS)
        found = [np.zeros(0)]
        for size in range(1, most + 1):
            value, _, fine = self.values(decoded(np.arange(math.comb(n, size)), size, n))
            found.append(value[fine])
        best = np.sort(np.concatenate(found))[::-1]
        return float(best[keep - 1]) if len(best) >= keep else -math.inf


def best_sets(spark: SparkSession, pool: Pool, most: int, keep: int | None = None, first: int | None = None) -> DataFrame:
    """(plan, members, size, value, cost) of the sets of up to ``most`` actions, one a merchant: all, or the ``keep`` best.

    Sets aren't built by joins: a set is a place in a range of numbers, and each task decodes and scores the places of its own
    stretch.  Where only the best are asked for, stretches beyond a bound on gains are left out: none of them
    can hold one.  ``first`` limits the search to the first actions by gain.  Order: value descending, then cost, size and plan.
    """
    n = len(pool.ids) if first is None else min(first, len(pool.ids))
    least = -math.inf if keep is None else pool.seed(most, keep) if first is None else -math.inf
    counts = [math.comb(min(n, pool.reach(size, least - 1e-9)), size) for size in range(1, most + 1)]
    ends = np.cumsum(counts)

    def score(batches):
        for batch in batches:
            places = batch.column(0).to_numpy()
            for at, end in enumerate(ends):
                low, size = end - counts[at], at + 1
                own = places[(places >= low) & (places < end)] - low
                if not len(own):
                    continue
                sets = decoded(own, size, n)
                value, cost, fine = pool.values(sets)
                rows = np.flatnonzero(fine & (value >= least - 1e-9))
                if keep is not None and len(rows) > keep:
                    cut = np.partition(value[rows], -keep)[-keep]
                    rows = rows[value[rows] >= cut]  # ties stay; the order decides later
                members = [sorted(pool.ids[i] for i in sets[r]) for r in rows]
                columns = ["+".join(m) for m in members], members, [size] * len(rows), value[rows], cost[rows]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.list_(pa.string()), pa.int32(), pa.float64(), pa.float64()), strict=True)], ["plan", "members", "size", "value", "cost"])

    total = int(ends[-1]) if len(ends) else 0
    tasks = max(1, -(-total // SETS_A_TASK), min(spark.sparkContext.defaultParallelism, total // 4096))
    found = spark.range(0, total, 1, tasks).mapInArrow(score, "plan string, members array<string>, size int, value double, cost double")
    return found if keep is None else found.orderBy(F.desc("value"), "cost", "size", "plan").limit(keep)
