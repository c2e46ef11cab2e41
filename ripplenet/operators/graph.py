"""Iterative graph operators as loops of joins over an edge table.

Every round is one join and one aggregation; its result is checkpointed, so that lineage and plans
stay short and a lost executor costs one round.  Frontiers, not whole states, are joined where possible.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.functions import exprs as e


def cut(df: DataFrame) -> DataFrame:
    """Materialises in the folder that executors share; a temporary one only where none is set and the master is local."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ripplenet-"))
    return df.checkpoint()


def reach(edges: DataFrame, start: DataFrame, max_hops: int, *, upstream: bool = False) -> DataFrame:
    """(root, node, hops): nodes within ``max_hops`` of each root, at their least distance, roots excluded.

    ``start`` holds (root, node) pairs, for instance every merchant as its own root.
    """
    a, b = ("target", "source") if upstream else ("source", "target")
    step = cut(edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct())
    seen = cut(start.select("root", "node", F.lit(0).alias("hops")).distinct())
    frontier = seen
    for hop in range(1, max_hops + 1):
        found = frontier.join(step, "node").select("root", F.col("next").alias("node")).distinct()
        frontier = cut(found.join(seen, ["root", "node"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen.where("hops > 0")


def multi_source_hops(edges: DataFrame, nodes: DataFrame, origins: DataFrame, cap: int) -> DataFrame:
    """(node, hops) from the nearest origin; ``cap`` where none is nearer."""
    start = origins.select(F.lit("").alias("root"), "node")
    near = reach(edges, start, cap - 1).select("node", "hops").union(origins.select("node", F.lit(0)))
    near = near.groupBy("node").agg(F.min("hops").alias("hops"))
    return nodes.select("node").join(near, "node", "left").select("node", F.coalesce("hops", F.lit(cap)).alias("hops"))


def exposure(edges: DataFrame, nodes: DataFrame, origins: DataFrame, rounds: int = 3) -> DataFrame:
    """(node, exposure): synchronous diffusion of 1 at the origins along pass-through, clipped at 1, origins pinned."""
    pinned = nodes.select("node").join(origins.select("node", F.lit(1.0).alias("pin")), "node", "left")
    state = cut(pinned.select("node", "pin", F.coalesce("pin", F.lit(0.0)).alias("exposure")))
    flow = cut(edges.select(F.col("source").alias("node"), "target", "pass_through"))
    for _ in range(rounds):
        got = state.join(flow, "node").groupBy(F.col("target").alias("node")).agg(F.sum(F.col("exposure") * F.col("pass_through")).alias("got"))
        state = cut(state.select("node", "pin").join(got, "node", "left").select("node", "pin", F.coalesce("pin", F.least(F.coalesce("got", F.lit(0.0)), F.lit(1.0))).alias("exposure")))
    return state.select("node", "exposure")


def pagerank(edges: DataFrame, nodes: DataFrame, rounds: int = 20, damping: float = 0.85, *, reverse: bool = False) -> DataFrame:
    """(node, rank) of the weighted power method; the mass of nodes without out-edges is spread evenly."""
    a, b = ("target", "source") if reverse else ("source", "target")
    links = edges.select(F.col(a).alias("node"), F.col(b).alias("to"), "weight")
    out = links.groupBy("node").agg(F.sum("weight").alias("out"))
    links = cut(links.join(out, "node").select("node", "to", (F.col("weight") / F.col("out")).alias("share")))
    n = nodes.count()
    base = nodes.select("node").join(out, "node", "left").select("node", F.col("out").isNull().alias("dangling"))
    state = cut(base.withColumn("rank", F.lit(1.0 / max(n, 1))))
    for _ in range(rounds):
        lost = state.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        got = state.join(links, "node").groupBy(F.col("to").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        rank = (1 - damping) / n + damping * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        state = cut(state.select("node", "dangling").join(got, "node", "left").join(F.broadcast(lost)).select("node", "dangling", rank.alias("rank")))
    return state.select("node", "rank")


def katz(edges: DataFrame, nodes: DataFrame, alpha: float = 0.1, rounds: int = 60) -> DataFrame:
    """(node, katz) of unweighted edges, scaled to unit length."""
    state = cut(nodes.select("node", F.lit(1.0).alias("x")))
    links = cut(edges.select(F.col("source").alias("node"), F.col("target").alias("to")))
    for _ in range(rounds):
        got = state.join(links, "node").groupBy(F.col("to").alias("node")).agg(F.sum("x").alias("got"))
        state = cut(state.select("node").join(got, "node", "left").select("node", (1 + alpha * F.coalesce("got", F.lit(0.0))).alias("x")))
    norm = state.agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return state.join(F.broadcast(norm)).select("node", (F.col("x") / F.col("norm")).alias("katz"))


def cycles(edges: DataFrame, max_length: int) -> DataFrame:
    """(path) of every simple cycle up to a length, once, written from its smallest node."""
    step = cut(edges.select(F.col("source").alias("last"), F.col("target").alias("next")).distinct())
    paths = edges.select(F.col("source").alias("first"), F.col("target").alias("last"), F.array("source", "target").alias("path")).where("first < last").distinct()
    found = None
    for _ in range(max_length - 1):
        grown = paths.join(step, "last")
        closed = grown.where(F.col("next") == F.col("first")).select("path")
        found = closed if found is None else found.union(closed)
        paths = cut(grown.where((F.col("next") > F.col("first")) & ~F.array_contains("path", F.col("next"))).select("first", F.col("next").alias("last"), F.concat("path", F.array("next")).alias("path")))
        if paths.isEmpty():
            break
    return found


def causal_chain(events: DataFrame, leaves: DataFrame, max_depth: int = 64) -> DataFrame:
    """(leaf, depth, event_id) along ``caused_by`` up to the root; a chain that returns to itself ends there."""
    parent = events.select("event_id", "caused_by")
    at = cut(leaves.select(F.col("event_id").alias("leaf"), F.lit(0).alias("depth"), "event_id"))
    out = at
    for depth in range(1, max_depth + 1):
        up = at.join(parent, "event_id").where("caused_by is not null").select("leaf", F.lit(depth).alias("depth"), F.col("caused_by").alias("event_id"))
        at = cut(up.join(out.select("leaf", "event_id"), ["leaf", "event_id"], "left_anti").select("leaf", "depth", "event_id"))
        if at.isEmpty():
            break
        out = out.union(at)
    return out


def linear_threshold(edges: DataFrame, buffers: DataFrame, shocks: DataFrame, rounds: int = 6, min_transmit: float = 1.0) -> DataFrame:
    """(node, shortfall, hop): synchronous propagation of excess over buffers along normalised shares.

    In each round the nodes that newly exceed their buffer pass the excess on, each edge at most its live
    obligation; a node's inflow adds up over rounds.  The rounds are synchronous: a frontier does not see what it
    sends in the same round.
    """
    state = buffers.join(shocks, "node", "left").select("node", "buffer", F.coalesce("shock", F.lit(0.0)).alias("load"), F.lit(0.0).alias("sent"), F.when(F.col("shock") > F.col("buffer"), 0).alias("hop"))
    state = cut(state)
    total = edges.groupBy("source").agg(F.sum("pass_through").alias("out"))
    share = cut(edges.join(total, "source").select(F.col("source").alias("node"), "target", (F.col("pass_through") / F.col("out")).alias("share"), "live"))
    for hop in range(1, rounds + 1):
        excess = F.greatest(F.col("load") - F.col("buffer"), F.lit(0.0)) - F.col("sent")
        active = state.withColumn("excess", excess).where(F.col("excess") >= min_transmit).select("node", "excess")
        sent = active.join(share, "node").select("target", F.least(F.col("excess") * F.col("share"), F.col("live")).alias("got"))
        sent = sent.where(F.col("got") >= min_transmit).groupBy(F.col("target").alias("node")).agg(F.sum("got").alias("got"))
        nxt = state.join(active, "node", "left").join(sent, "node", "left").select(
            "node", "buffer", (F.col("load") + F.coalesce("got", F.lit(0.0))).alias("load"), (F.col("sent") + F.coalesce("excess", F.lit(0.0))).alias("sent"), "hop"
        )
        state = cut(nxt.withColumn("hop", F.when(F.col("hop").isNull() & (F.col("load") > F.col("buffer")), hop).otherwise(F.col("hop"))))
    return state.select("node", F.greatest(F.col("load") - F.col("buffer"), F.lit(0.0)).alias("shortfall"), "hop")


def noisy_or(edges: DataFrame, nodes: DataFrame, origins: DataFrame, rounds: int = 6) -> DataFrame:
    """(node, probability): chance that a node is hit, each edge passing it on with ``p``; synchronous rounds."""
    pinned = nodes.select("node").join(origins.select("node", F.lit(1.0).alias("pin")), "node", "left")
    state = cut(pinned.select("node", "pin", F.coalesce("pin", F.lit(0.0)).alias("probability")))
    link = cut(edges.select(F.col("source").alias("node"), "target", "p"))
    for _ in range(rounds):
        miss = F.log1p(-F.least(F.col("probability") * F.col("p"), F.lit(1 - 1e-12)))
        got = state.join(link, "node").groupBy(F.col("target").alias("node")).agg((1 - F.exp(F.sum(miss))).alias("got"))
        state = cut(state.select("node", "pin").join(got, "node", "left").select("node", "pin", F.coalesce("pin", "got", F.lit(0.0)).alias("probability")))
    return state.select("node", "probability")


def timed_cascade(links: DataFrame, nodes: DataFrame, shocks: DataFrame, horizon: float, max_hops: int = 6) -> DataFrame:
    """(node, probability, hit_t, hop): who is hit within the horizon, when at the earliest, and over how many edges.

    links(source, target, q, mu, sigma): chance that an edge passes a hit on, and its log-normal lag; shocks(node, t).
    A hit at time t passes with q times the lag's chance to end before the horizon; messages to one node combine as independent ones, round
    after round on what it has, and the earliest mean arrival becomes its time.  Rounds are synchronous and end when no
    probability grows by more than 1e-9, also on cycles.
    """
    start = shocks.groupBy("node").agg(F.min("t").alias("hit_t"))
    state = cut(nodes.select("node").join(start, "node", "left").select("node", F.when(F.col("hit_t").isNotNull(), 1.0).otherwise(0.0).alias("p"), "hit_t", F.when(F.col("hit_t").isNotNull(), 0).alias("hop")))
    link = cut(links.select(F.col("source").alias("node"), "target", "q", "mu", "sigma"))
    for hop in range(1, max_hops + 1):
        left = horizon - F.coalesce("hit_t", F.lit(0.0))
        sent = state.where((F.col("p") > 1e-6) & (left > 0)).join(link, "node")
        sent = sent.withColumn("f", F.col("p") * F.col("q") * e.lognormal_cdf(left, "mu", "sigma")).where("f > 1e-6")
        arrival = F.coalesce("hit_t", F.lit(0.0)) + F.exp(F.col("mu") + F.col("sigma") * F.col("sigma") / 2)
        got = sent.groupBy(F.col("target").alias("node")).agg(
            F.sum(F.log1p(-F.least("f", F.lit(1 - 1e-12)))).alias("miss"), F.min(F.when(arrival <= horizon, arrival)).alias("arrival")
        )
        grown = 1 - (1 - F.col("p")) * F.exp("miss")
        gain = F.coalesce(grown > F.col("p") + 1e-9, F.lit(False))
        new = state.join(got, "node", "left").select(
            "node", F.when(gain, grown).otherwise(F.col("p")).alias("p"), F.least("hit_t", "arrival").alias("hit_t"), F.when(F.col("hop").isNull() & F.col("miss").isNotNull(), F.lit(hop)).otherwise(F.col("hop")).alias("hop"), gain.alias("gain")
        )
        new = cut(new)
        state = new.drop("gain")
        if new.where("gain").isEmpty():
            break
    return state.select("node", F.col("p").alias("probability"), "hit_t", "hop")
