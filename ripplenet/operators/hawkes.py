"""Marked Hawkes fits for every edge at once.

A payment of an edge is either background or was set off by one of the payer's earlier receipts.  How likely a receipt
is depends on the time since (an exponential kernel) and, among the receipts of one payment, on how well the
amounts fit (a log-normal ratio around the pass-through).  Fitting is expectation-maximisation: a round
weighs each payment's possible receipts, adds up per edge, and updates the edge's law.

Plan (:func:`marked_flows`): all rows of a source meet in a task, which finds a payment's latest receipts by their places in the order of
time and fits the source's edges to the end; nothing but one law an edge leaves it.  Sources of more rows than a task may hold
are for :func:`marked_hawkes`: a payment's latest receipts are found once, by their places in one range-sorted order, and are kept as short arrays beside it; the
kernel's width only decides how many of them count, so a moving width needs no new join.  A round is
one join of payments with their edge's law, numpy over batches of payments that return sums per edge, and one
aggregation.  Edges that have settled leave the loop.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, LongType, StructField, StructType

from ripplenet.operators import flows as fl
from ripplenet.operators.graph import cut
from ripplenet.operators.relational import latest_marks

#: Receipts looked at per payment, and the kernel's reach in mean lags.
MAX_PARENTS, REACH = 64, 8.0
ALPHA_MAX, SIGMA_LEAST, SIGMA_MOST = 5.0, 0.15, 2.5
SUMS = ("resp", "ratio", "ratio2", "lag", "lag2", "loglam", "pairs")
LAW = ("mu", "alpha", "beta", "theta", "sigma", "lag_mu", "lag_sigma", "lag_weight", "excited", "background", "log_likelihood")
#: Payments whose receipts are laid out as one matrix, as whole edges; it should stay in a core's cache.
BLOCK = 1024


def _weigh(batches):
    """Sums over payments of one edge, per batch, with the responsibilities of the edge's present law."""
    for batch in batches:
        if not batch.num_rows:
            continue
        edge = batch.column(0).to_numpy()
        laws = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3, 8)], 1)
        lists = batch.column(1)
        ends = lists.offsets.to_numpy()
        kid = np.repeat(np.arange(len(edge)), np.diff(ends))
        dt, ratio = (batch.column(i).values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]] for i in (1, 2))
        near = dt <= REACH / np.maximum(laws[kid, 2], 1e-9)
        kid, dt, ratio = kid[near], dt[near], ratio[near]
        mu, alpha, beta, theta, sigma = laws[kid].T
        timing = alpha * beta * np.exp(-beta * dt)
        z = (ratio - np.log(theta)) / sigma
        weight = timing * np.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))
        n = len(edge)
        timed, weighed = np.bincount(kid, timing, n), np.bincount(kid, weight, n)
        rate = laws[:, 0] + timed
        excited = np.divide(timed, rate, out=np.zeros(n), where=rate > 0)
        share = np.divide(weight, weighed[kid], out=np.zeros(len(kid)), where=weighed[kid] > 0)
        resp = share * excited[kid]
        lag = np.log(dt)
        edges, at = np.unique(edge, return_inverse=True)
        of = at[kid]
        sums = [np.bincount(of, x, len(edges)) for x in (resp, resp * ratio, resp * ratio**2, resp * lag, resp * lag**2)]
        sums += [np.bincount(at, np.log(np.maximum(rate, 1e-300)), len(edges)), np.bincount(of, minlength=len(edges)).astype(float)]
        yield pa.RecordBatch.from_arrays([pa.array(edges), *map(pa.array, sums)], ["edge", *SUMS])


def _updated(window: float) -> dict[str, Column]:
    """The law after a round, from the sums of an edge."""
    old = F.col
    told = old("resp") > 1e-9
    mean, lag_mean = old("ratio") / old("resp"), old("lag") / old("resp")
    spread = lambda square, m, least: F.sqrt(F.greatest(old(square) / old("resp") - m * m, F.lit(least)))
    excited = old("resp")
    mu = F.greatest((old("n_out") - excited) / max(window, 1.0), F.lit(1e-12))
    alpha = F.least(F.greatest(excited / F.greatest(old("n_in"), F.lit(1)), F.lit(0.0)), F.lit(ALPHA_MAX))
    sigma = F.least(F.greatest(spread("ratio2", mean, 1e-6), F.lit(SIGMA_LEAST)), F.lit(SIGMA_MOST))
    lag_mu, lag_sigma = F.when(told, lag_mean).otherwise(old("lag_mu")), F.when(told, spread("lag2", lag_mean, 1e-6)).otherwise(old("lag_sigma"))
    weight = F.when(told, excited).otherwise(old("lag_weight"))
    return {
        "mu": mu,
        "alpha": alpha,
        "theta": F.when(told, F.exp(mean)).otherwise(old("theta")),
        "sigma": F.when(told, sigma).otherwise(old("sigma")),
        "lag_mu": lag_mu,
        "lag_sigma": lag_sigma,
        "lag_weight": weight,
        "excited": excited,
        "background": old("n_out") - excited,
        "log_likelihood": old("loglam") - (mu * window + alpha * old("n_in")),
        "beta": F.when(weight > 1, 1 / F.greatest(F.exp(lag_mu + 0.5 * lag_sigma * lag_sigma), F.lit(1e-3))).otherwise(old("beta")),
    }


def marked_hawkes(
    kids: DataFrame,
    receipts: DataFrame,
    window: float,
    *,
    beta: float = 1 / 48,
    theta: float = 0.4,
    sigma: float = 0.8,
    alpha: float = 0.5,
    rounds: int = 40,
    tolerance: float = 1e-6,
) -> DataFrame:
    """One row per edge: its fitted law.

    kids(source, target, t, amount): payments of the edges; receipts(source, t, amount, tie): receipts of the payers.
    Returns (source, target, n_out, n_in, mu, alpha, beta, theta, sigma, probability, lag_mu, lag_sigma, lag_weight,
    excited, background, log_likelihood, rounds, converged).  ``theta`` is the pass-through (geometric mean of the
    ratios), ``sigma`` their log spread; ``beta`` is refitted to the mean lag each round.  A payer without receipts has a pass-through of 0 and
    converges never; an edge none of whose payments has a receipt in reach stays as it is.
    """
    rate = F.greatest(F.col("n_out") / max(window, 1.0), F.lit(1e-12))
    edges = kids.groupBy("source", "target").agg(F.count("*").alias("n_out")).join(receipts.groupBy("source").agg(F.count("*").alias("n_in")), "source", "left").na.fill(0)
    start = {"mu": rate, "alpha": F.lit(alpha), "beta": F.lit(beta), "theta": F.lit(max(theta, 1e-4)), "sigma": F.lit(min(max(sigma, SIGMA_LEAST), SIGMA_MOST))}
    start |= {"lag_mu": F.lit(math.log(1 / max(beta, 1e-9))), "lag_sigma": F.lit(1.0), "lag_weight": F.lit(0.0), "excited": F.lit(0.0), "background": F.col("n_out").cast("double")}
    start |= {"log_likelihood": F.lit(None).cast("double"), "rounds": F.lit(0), "converged": F.lit(False), "moving": F.col("n_in") > 0}
    law = cut(cut(edges).withColumn("edge", F.monotonically_increasing_id()).withColumns(start))
    fields = law.columns

    marks = receipts.select("source", F.col("t").alias("t_in"), "amount", "tie")
    pairs = latest_marks(kids.select("source", "target", "t", "amount"), marks, "source", "t", "t_in", MAX_PARENTS, ["amount", "tie"])
    ratio = F.log(F.greatest("amount", F.lit(1e-9)) / F.greatest("mark.amount", F.lit(1e-9)))
    fed = pairs.groupBy("point", "source", "target").agg(F.collect_list((F.col("t") - F.col("mark.t_in")).cast("double")).alias("dt"), F.collect_list(ratio).alias("ratio"))
    fed = fed.select("source", "target", "dt", "ratio")
    alone = kids.groupBy("source", "target").agg(F.count("*").alias("n")).join(fed.groupBy("source", "target").agg(F.count("*").alias("fed")), ["source", "target"], "left")
    alone = alone.select("source", "target", (F.col("n") - F.coalesce("fed", F.lit(0))).alias("alone"))  # payments before any receipt
    numbers = law.select("source", "target", "edge")
    fed = cut(fed.join(numbers, ["source", "target"]).select("edge", "dt", "ratio"))
    alone = cut(alone.join(numbers, ["source", "target"]).select("edge", "alone"))

    for at in range(1, rounds + 1):
        now = law.where("moving").select("edge", "mu", "alpha", "beta", "theta", "sigma")
        weighed = fed.join(now, "edge").mapInArrow(_weigh, "edge long, " + ", ".join(f"{s} double" for s in SUMS))
        sums = weighed.groupBy("edge").agg(*[F.sum(s).alias(s) for s in SUMS])
        met = law.join(sums, "edge", "left").join(alone, "edge").withColumn("loglam", F.col("loglam") + F.col("alone") * F.log("mu"))
        new = _updated(window)
        fed_now = F.col("moving") & (F.coalesce("pairs", F.lit(0.0)) > 0)
        change = sum((F.abs(new[x] - F.col(x)) for x in ("mu", "alpha", "theta", "sigma")), F.lit(0.0))
        step = {x: F.when(fed_now, v).otherwise(F.col(x)) for x, v in new.items()}
        step |= {"rounds": F.when(F.col("moving"), F.lit(at)).otherwise(F.col("rounds")), "converged": F.col("converged") | (fed_now & (change < tolerance)), "moving": fed_now & (change >= tolerance)}
        law = cut(met.select(*[step.get(x, F.col(x)).alias(x) for x in fields]))
        if law.where("moving").isEmpty():
            break
    none = F.col("n_in") == 0
    settled = {"alpha": F.when(none, 0.0).otherwise(F.col("alpha")), "theta": F.when(none, 0.0).otherwise(F.col("theta"))}
    return law.withColumns(settled).withColumn("probability", F.least(F.lit(1.0), F.col("alpha"))).drop("edge", "moving")


class _Block:
    """Payments of some edges, edge by edge, and their latest receipts as rows of matrices, the latest first."""

    def __init__(self, t, a, last, base, edge, u, p):
        self.t, self.a, self.last, self.base, self.edge, self.u, self.p = t, a, last, base, edge, u, p
        self.width = 0
        self.lay(8)

    def lay(self, width: int) -> None:
        if width <= self.width:
            return
        self.width = min(MAX_PARENTS, max(width, 2 * self.width))
        at = self.last[:, None] - 1 - np.arange(self.width)
        there = at >= self.base[:, None]
        at[~there] = 0
        self.dt = np.where(there, self.t[:, None] - self.u[at], np.inf) if len(self.u) else np.full(at.shape, np.inf)
        self.ratio = np.where(there, self.a[:, None] - self.p[at], 0.0) if len(self.u) else np.zeros(at.shape)
        self.lag = np.log(np.where(there, self.dt, 1.0))
        self.ratio2, self.lag2 = self.ratio**2, self.lag**2
        self.far = np.where(there, self.dt, 0.0).max(1, initial=0.0)
        self.used = int(max(1, there.any(0).sum()))
        self.room = np.empty((2, *at.shape))

    def near(self, reach: np.ndarray) -> tuple[int, bool]:
        """Lays out all receipts up to ``reach`` before each payment; how many columns hold them, and whether all that is in these is near."""
        while self.width < MAX_PARENTS and (self.dt[:, -1] <= reach).any():
            self.lay(self.width + 1)
        if (self.far <= reach).all():
            return self.used, True
        return int(max(1, (self.dt <= reach[:, None]).any(0).sum())), False

    def keep(self, kids: np.ndarray) -> None:
        for x in ("t", "a", "last", "base", "edge", "dt", "ratio", "lag", "ratio2", "lag2", "far"):
            setattr(self, x, getattr(self, x)[kids])
        self.room = np.empty((2, *self.dt.shape))

    def sums(self, law: dict[str, np.ndarray]) -> np.ndarray:
        """SUMS by edge, with the edges' present law."""
        n, of = len(law["mu"]), self.edge
        mu, alpha, beta, theta, sigma = (law[x][of] for x in ("mu", "alpha", "beta", "theta", "sigma"))
        reach = REACH / np.maximum(beta, 1e-9)
        w, all_near = self.near(reach)
        dt, ratio, (power, weight) = self.dt[:, :w], self.ratio[:, :w], self.room[:, :, :w]
        np.multiply(dt, -beta[:, None], out=power)
        if not all_near:
            power[dt > reach[:, None]] = -np.inf
        scale = 1 / (sigma * math.sqrt(2))
        np.multiply(ratio, scale[:, None], out=weight)
        weight -= (np.log(theta) * scale)[:, None]
        np.multiply(weight, weight, out=weight)
        np.subtract(power, weight, out=weight)
        np.exp(weight, out=weight)
        timed = np.exp(power, out=power).sum(1) * (alpha * beta)
        weighed = weight.sum(1)
        rate = mu + timed
        excited = np.divide(timed, rate, out=np.zeros(len(of)), where=rate > 0)
        share = np.divide(excited, weighed, out=np.zeros(len(of)), where=weighed > 0)
        each = [share * weighed, *(share * np.einsum("ij,ij->i", weight, x[:, :w]) for x in (ratio, self.ratio2, self.lag, self.lag2))]
        each += [np.log(np.maximum(rate, 1e-300)), (dt[:, 0] <= reach).astype(float)]  # the last: whether any is in reach
        return np.stack([np.bincount(of, x, n) for x in each])


def _settle(block: _Block, law: dict[str, np.ndarray], n_out: np.ndarray, n_in: np.ndarray, window: float, rounds: int, tolerance: float) -> None:
    """Fits a block's edges, in place; :func:`_updated` in numpy."""
    moving = n_in > 0
    law["rounds"], law["converged"], law["told"] = np.zeros(len(moving), np.int32), np.zeros(len(moving), bool), np.zeros(len(moving), bool)
    for at in range(1, rounds + 1):
        on = moving[block.edge]
        if not moving.any():
            break
        if on.sum() < 0.8 * len(on):
            block.keep(on)
        resp, ratio, ratio2, lag, lag2, loglam, pairs = block.sums(law)
        fed = moving & (pairs > 0)
        told = resp > 1e-9
        some = np.where(told, resp, 1.0)
        mean, lag_mean = ratio / some, lag / some
        new = {"mu": np.maximum((n_out - resp) / max(window, 1.0), 1e-12), "alpha": np.minimum(np.maximum(resp / np.maximum(n_in, 1), 0.0), ALPHA_MAX)}
        new["theta"] = np.where(told, np.exp(mean), law["theta"])
        new["sigma"] = np.where(told, np.clip(np.sqrt(np.maximum(ratio2 / some - mean * mean, 1e-6)), SIGMA_LEAST, SIGMA_MOST), law["sigma"])
        new["lag_mu"] = np.where(told, lag_mean, law["lag_mu"])
        new["lag_sigma"] = np.where(told, np.sqrt(np.maximum(lag2 / some - lag_mean * lag_mean, 1e-6)), law["lag_sigma"])
        new["lag_weight"] = np.where(told, resp, law["lag_weight"])
        new["excited"], new["background"] = resp, n_out - resp
        new["log_likelihood"] = loglam - (new["mu"] * window + new["alpha"] * n_in)
        with np.errstate(over="ignore"):
            new["beta"] = np.where(new["lag_weight"] > 1, 1 / np.maximum(np.exp(new["lag_mu"] + 0.5 * new["lag_sigma"] ** 2), 1e-3), law["beta"])
        change = sum(np.abs(new[x] - law[x]) for x in ("mu", "alpha", "theta", "sigma"))
        for x in LAW:
            law[x] = np.where(fed, new[x], law[x])
        law["rounds"][moving] = at
        law["told"] |= fed
        law["converged"] |= fed & (change < tolerance)
        moving = fed & (change >= tolerance)


def marked_flows(flows: DataFrame, window: float, *, beta: float = 1 / 48, theta: float = 0.4, sigma: float = 0.8, alpha: float = 0.5, rounds: int = 40, tolerance: float = 1e-6) -> DataFrame:
    """:func:`marked_hawkes` of flows(source, target, t, amount, t_in, paid, kind), in one exchange; see :mod:`ripplenet.operators.flows`.

    Receipts of one time and amount have one lag and one ratio, so no further order is needed.
    """
    kinds = flows.schema
    numbers = [StructField("n_out", LongType()), StructField("n_in", LongType()), *(StructField(x, DoubleType()) for x in LAW), StructField("rounds", IntegerType()), StructField("converged", BooleanType())]
    schema = StructType([StructField("source", kinds["source"].dataType), StructField("target", kinds["target"].dataType), *numbers])

    def run(batch, ends):
        source, target, kind = batch.column(0), batch.column(1), batch.column(6).to_numpy(zero_copy_only=False)
        t, amount, t_in, paid = (fl.numbers(batch.column(i)) for i in range(2, 6))
        a, p = np.log(np.fmax(amount, 1e-9)), np.log(np.fmax(paid, 1e-9))
        code, targets = fl.codes(target)
        of = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
        named = np.asarray(source.is_valid())
        into = named & ((kind & fl.RECEIPT) > 0)
        n_into = np.bincount(of[into], minlength=len(ends) - 1)
        got = np.flatnonzero(into & ~np.isnan(t_in))
        got = got[np.lexsort((np.where(np.isnan(paid[got]), -np.inf, paid[got]), t_in[got], of[got]))]
        u, p, starts = t_in[got], p[got], np.searchsorted(of[got], np.arange(len(ends)))
        pays = np.flatnonzero(named & ((kind & fl.PAYMENT) > 0) & (code >= 0))
        if not len(pays):
            return
        pays = pays[np.lexsort((code[pays], of[pays]))]
        base = starts[of[pays]]
        last = base.copy()
        for k, (x, y) in enumerate(zip(starts[:-1], starts[1:], strict=True)):
            own = slice(*np.searchsorted(of[pays], [k, k + 1]))
            last[own] += np.searchsorted(u[x:y], t[pays[own]], "left")
        last[np.isnan(t[pays])] = base[np.isnan(t[pays])]
        head = np.flatnonzero(np.r_[True, (np.diff(of[pays]) != 0) | (np.diff(code[pays]) != 0)])
        n_out = np.diff(np.r_[head, len(pays)])
        n_in = n_into[of[pays[head]]]
        out = {x: np.empty(len(head)) for x in LAW} | {"rounds": np.empty(len(head), np.int32), "converged": np.empty(len(head), bool), "told": np.empty(len(head), bool)}
        low = 0
        while low < len(head):
            high = max(low + 1, int(np.searchsorted(head, head[low] + BLOCK, "right")) - 1) if head[-1] + n_out[-1] - head[low] > BLOCK else len(head)
            kids = slice(head[low], head[high - 1] + n_out[high - 1])
            n = n_out[low:high].astype(float)
            law = {"mu": np.maximum(n / max(window, 1.0), 1e-12), "alpha": alpha, "beta": beta, "theta": max(theta, 1e-4), "sigma": min(max(sigma, SIGMA_LEAST), SIGMA_MOST), "lag_mu": math.log(1 / max(beta, 1e-9)), "lag_sigma": 1.0, "lag_weight": 0.0, "excited": 0.0, "background": n, "log_likelihood": np.nan}
            law = {x: np.broadcast_to(np.asarray(v, float), n.shape).copy() for x, v in law.items()}
            edge = np.repeat(np.arange(high - low), n_out[low:high])
            _settle(_Block(t[pays[kids]], a[pays[kids]], last[kids], base[kids], edge, u, p), law, n, n_in[low:high], window, rounds, tolerance)
            for x, v in law.items():
                out[x][low:high] = v
            low = high
        for x in ("alpha", "theta"):
            out[x][n_in == 0] = 0.0
        first = pays[head]
        columns = [source.take(pa.array(first)), targets.take(pa.array(code[first])), pa.array(n_out.astype(np.int64)), pa.array(n_in.astype(np.int64))]
        columns += [pa.array(out[x], mask=~out["told"] if x == "log_likelihood" else None) for x in LAW] + [pa.array(out["rounds"]), pa.array(out["converged"])]
        yield pa.RecordBatch.from_arrays(columns, schema.names)

    fit = fl.per_source(flows.select("source", "target", "t", "amount", "t_in", "paid", "kind"), run, schema)
    return fit.withColumn("probability", F.least(F.lit(1.0), F.col("alpha")))
