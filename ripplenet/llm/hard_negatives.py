"""Hard-negative mining by exact integer inner products behind an orthogonal rotation.

The second-moment matrix of all vectors gives an orthogonal basis whose leading components hold most of every inner
product.  For a block of anchors against a block of rows, products over the leading components are summed step by step.
What is missing lies within the product of the two residual norms, plus a slack for rounding; a pair whose bounds can't
reach the wanted places is dropped at once, and only survivors get their integer product.  Bounds decide what is looked at, never
what is returned.

Plan: rows are packed into blocks where they are read; the anchors' blocks, a fiftieth of the rows, are dealt to each block of
rows and stream past it, so a task holds one block of either kind.  Each meeting returns the first few per anchor; these meet in a grouped top-k.
Blocks have a fixed size, so no label, id or copied vector makes a task larger.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Rows of a packed block, anchors of one, anchors handled together in a kernel.
ROWS, ANCHORS, TOGETHER = 8192, 512, 128
#: Leading shares of the components after which pairs are dropped.
STEPS = (0.25, 0.5)
#: Quantised components are held within this, so that 64 bits hold every product.
LIMIT = 1 << 22
PACKED = "block long, n int, ids binary, labels binary, vectors binary, needs binary"
SCALE = 256.0


def quantised(vector: Column, scale: float = SCALE) -> Column:
    """floor(scale * x) of each component, within LIMIT; null unless all are finite."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    whole = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    held = F.transform(doubles, lambda x: F.floor(F.least(F.greatest(F.lit(scale) * x, F.lit(-float(LIMIT))), F.lit(float(LIMIT)))))
    return F.when(whole, held)


def _matrix(lists, dim: int) -> np.ndarray:
    """Rows of integers; a shorter vector ends in zeros."""
    out = np.zeros((len(lists), dim), np.int64)
    ends = lists.offsets.to_numpy()
    sizes = np.diff(ends)
    flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def _moments(dim: int):
    def run(batches):
        total = np.zeros((dim, dim))
        for batch in batches:
            x = _matrix(batch.column(0), dim).astype(float)
            total += x.T @ x
        if total.any():
            i, j = np.indices((dim, dim))
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], ["i", "j", "v"])

    return run


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Orthogonal basis, leading component first, of the second moments of all rows: dim x dim numbers whatever the rows."""
    sums = rows.select("q").mapInArrow(_moments(dim), "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect()
    moments = np.zeros((dim, dim))
    for r in sums:
        moments[r.i, r.j] = r.v
    return np.linalg.eigh(moments / max(np.trace(moments), 1.0))[1][:, ::-1].copy()


def _pack(dim: int, size: int, needs: int):
    """Blocks of rows sorted by label; with ``needs`` each anchor carries that many positives' scores."""

    def run(batches):
        from pyspark import TaskContext

        task, made, held = TaskContext.get().partitionId(), 0, []

        def block(columns):
            nonlocal made
            order = np.argsort(columns[1], kind="stable")
            values = [x[order] for x in columns]
            made += 1
            out = [pa.array([(task << 32) + made]), pa.array([len(order)], pa.int32()), *(pa.array([v.tobytes()]) for v in values)]
            return pa.RecordBatch.from_arrays(out, ["block", "n", "ids", "labels", "vectors", "needs"])

        for batch in batches:
            scores = np.full((batch.num_rows, needs), -1, np.int64)
            if needs:
                for i, found in enumerate(batch.column(3).to_pylist()):
                    scores[i, : len(found)] = found
            held.append([batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dim), scores])
            while sum(len(h[0]) for h in held) >= size:
                joined = [np.concatenate(x) for x in zip(*held, strict=True)]
                yield block([x[:size] for x in joined])
                held = [[x[size:] for x in joined]]
        if held and sum(len(h[0]) for h in held):
            yield block([np.concatenate(x) for x in zip(*held, strict=True)])

    return run


class Block:
    """A packed block, rotated: leading parts, residual norms after each step, bounds of its rounding errors."""

    def __init__(self, n: int, ids: bytes, labels: bytes, vectors: bytes, needs: bytes, basis: np.ndarray):
        dim = len(basis)
        self.ids, self.labels = np.frombuffer(ids, np.int64), np.frombuffer(labels, np.int64)
        self.q = np.frombuffer(vectors, np.int64).reshape(n, dim)
        self.needs = np.frombuffer(needs, np.int64).reshape(n, -1)
        self.floats = self.q.astype(float)
        self.y = self.floats @ basis
        self.ends = sorted({max(1, round(s * dim)) for s in STEPS} & set(range(1, dim)))
        squares = self.y**2
        self.norm = np.sqrt(squares.sum(1))
        self.rest = [np.sqrt(squares[:, e:].sum(1)) for e in self.ends]

    def kinds(self) -> list[tuple[int, int, int]]:
        """(label, first row, end): rows are sorted by label."""
        starts = np.flatnonzero(np.r_[True, self.labels[1:] != self.labels[:-1]]) if len(self.labels) else np.zeros(0, int)
        return [(int(self.labels[a]), int(a), int(b)) for a, b in zip(starts, [*starts[1:], len(self.labels)], strict=True)]


def _bounded(a: Block, i: slice, b: Block, j: slice, low, high):
    """Pairs (row of a, row of b, product) whose product may matter.

    After each step ``low(lower, upper)`` gives per anchor the least product still wanted, ``high`` the greatest;
    what can't lie between them is dropped.
    """
    dim, start = a.q.shape[1], 0
    part = np.zeros((i.stop - i.start, j.stop - j.start))
    # A rotated component is off by dim roundings of the norm at most, the whole vector by the root of dim times that.
    slack = (16 * dim**1.5 * np.finfo(float).eps) * np.multiply.outer(a.norm[i], b.norm[j]) + 1e-6
    alive = None
    for step, end in enumerate(a.ends):
        part += a.y[i, start:end] @ b.y[j, start:end].T
        wide = np.multiply.outer(a.rest[step][i], b.rest[step][j]) + slack
        upper = part + wide
        lower = part - wide
        alive = (upper >= low(lower, upper)) & (lower <= high)
        start = end
        if alive.sum() * 8 < alive.size:  # few enough to look at one by one
            break
    x, y = np.nonzero(alive) if alive is not None else map(np.ravel, np.indices(part.shape))
    x, y, out = x + i.start, y + j.start, [np.zeros(0, np.int64)]
    for s in range(0, len(x), 1 << 16):
        out.append(np.einsum("ij,ij->i", a.q[x[s : s + (1 << 16)]], b.q[y[s : s + (1 << 16)]]))
    return x, y, np.concatenate(out)


def _leading(values: np.ndarray, k: int) -> np.ndarray:
    """k-th largest of each row, as a column; minus infinity where a row has fewer."""
    if values.shape[1] < k:
        return np.full((len(values), 1), -np.inf)
    return np.partition(values, -k, axis=1)[:, [-k]]


def _first(keys: list[np.ndarray], scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the first k per key, by score descending and id ascending."""
    order = np.lexsort((ids, -scores, *keys[::-1]))
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[order][1:] != key[order][:-1]
    starts = np.flatnonzero(new)
    return order[np.arange(len(order)) - np.repeat(starts, np.diff([*starts, len(order)])) < k]


def _positives(k: int):
    def meet(a: Block, b: Block):
        where = {label: (s, e) for label, s, e in b.kinds()}
        for label, s, e in a.kinds():
            if label not in where:
                continue
            j = slice(*where[label])
            for t in range(s, e, TOGETHER):
                i = slice(t, min(t + TOGETHER, e))
                self_ = a.ids[i][:, None] == b.ids[j][None, :]

                def low(lower, upper, self_=self_):
                    return _leading(np.where(self_, -np.inf, lower), k)

                x, y, score = _bounded(a, i, b, j, low, np.inf)
                other = a.ids[x] != b.ids[y]
                x, y, score = x[other], y[other], score[other]
                top = _first([x], score, b.ids[y], k)
                yield a.ids[x[top]], np.zeros(len(top), np.int64), b.ids[y[top]], score[top]

    return meet


def _negatives(k: int, least: int, most: int):
    def meet(a: Block, b: Block):
        for label, s, e in a.kinds():
            for t in range(s, e, TOGETHER):
                i = slice(t, min(t + TOGETHER, e))
                needs = a.needs[i]
                lo, hi = -(-least * needs // 100), most * needs // 100  # 100 * score within both, for integers
                lo = np.where(needs < 0, 1, lo)
                hi = np.where(needs < 0, 0, hi)
                some = hi >= lo
                if not some.any():
                    continue
                ceiling = np.where(some, hi, -1).max(1, keepdims=True)

                def low(lower, upper, lo=lo, hi=hi, some=some):
                    """Least over the bands of their k-th product that is surely inside."""
                    out = np.full((len(lo), 1), np.inf)
                    for n in range(lo.shape[1]):
                        inside = (lower >= lo[:, [n]]) & (upper <= hi[:, [n]])
                        kth = np.maximum(_leading(np.where(inside, lower, -np.inf), k), lo[:, [n]])
                        out = np.minimum(out, np.where(some[:, [n]], kth, np.inf))
                    return out

                found = [_bounded(a, i, b, slice(u, v), low, ceiling) for other, u, v in b.kinds() if other != label]
                if not found:
                    continue
                x, y, score = map(np.concatenate, zip(*found, strict=True))
                for n in range(lo.shape[1]):
                    fits = np.flatnonzero((score >= lo[x - t, n]) & (score <= hi[x - t, n]))
                    fx, fy, fs = x[fits], y[fits], score[fits]
                    top = _first([fx], fs, b.ids[fy], k)
                    yield a.ids[fx[top]], np.full(len(top), n, np.int64), b.ids[fy[top]], fs[top]

    return meet


def _stream(basis: np.ndarray, meet):
    """Rows' blocks and, after each, the anchors' blocks dealt to it."""

    def run(batches):
        rows = None
        for batch in batches:
            for at in range(batch.num_rows):
                kind, *packed = (x[at].as_py() for x in batch.columns[1:])
                block = Block(*packed, basis)
                if kind == 0:
                    rows = block
                    continue
                found = [np.concatenate(x) for x in zip(*meet(block, rows), strict=True)]
                if found and len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], ["anchor_id", "band", "vec_id", "score"])

    return run


def _meet(rows: DataFrame, anchors: DataFrame, basis: np.ndarray, meet) -> DataFrame:
    """Every block of anchors meets every block of rows: (anchor_id, band, vec_id, score)."""
    pages = rows.count()
    if not pages:
        anchors = anchors.limit(0)
    packed = ("n", "ids", "labels", "vectors", "needs")
    dealt = anchors.select(F.explode(F.sequence(F.lit(1), F.lit(max(pages, 1)))).alias("page"), F.lit(1).alias("kind"), *packed)
    both = rows.select("page", F.lit(0).alias("kind"), *packed).union(dealt)
    ordered = both.repartition("page").sortWithinPartitions("page", "kind")
    return ordered.mapInArrow(_stream(basis, meet), "anchor_id long, band long, vec_id long, score long")


def _top(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def mine_negatives(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_every: int = 50,
    positives: int = 5,
    negatives: int = 3,
    least: int = 50,
    most: int = 95,
    scale: float = SCALE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) per hard negative.

    Scores are integer inner products of ``floor(scale * x)``, each component held within LIMIT.  Anchors are the rows whose id
    ``anchor_every`` divides; positives the first rows of the anchor's label, negatives the first of other labels with
    least * positive <= 100 * negative <= most * positive; higher scores come first, then smaller ids.

    Rows without an id or label and vectors that are null or hold a null or non-finite component take no part; an
    empty vector has products of zero, a shorter one ends in zeros.  Of the rows that repeat an id the least by (label, vector) stands.  A negative score
    of a positive admits no negative.  Tables without anchors or pairs give no rows; other columns are ignored.
    """
    scratch = c.Scratch(vectors.sparkSession, "negatives")
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("q"))
    whole = read.where("vec_id is not null and label is not null and q is not null")
    one = whole.groupBy("vec_id").agg(F.min(F.struct("label", "q")).alias("row")).select("vec_id", "row.*")
    one = scratch.table(one, "one")
    n, dim = one.agg(F.count("*"), F.coalesce(F.max(F.size("q")), F.lit(1))).first()
    dim = max(dim, 1)
    basis = rotation(one, dim)

    full = one.select("vec_id", "label", "q").coalesce(max(1, -(-n // ROWS)))  # no small blocks
    rows = scratch.table(full.mapInArrow(_pack(dim, ROWS, 0), PACKED), "rows")
    page = F.row_number().over(Window.orderBy("block"))  # a number per packed block, not per row
    rows = rows.join(F.broadcast(rows.select("block", page.alias("page"))), "block")
    asked = one.where(F.col("vec_id") % anchor_every == 0)
    plain = scratch.table(asked.select("vec_id", "label", "q").mapInArrow(_pack(dim, ANCHORS, 0), PACKED), "asked")
    near = _top(_meet(rows, plain, basis, _positives(positives)), ["anchor_id"], positives)
    near = scratch.table(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).cast("long").alias("band")), "positives")

    needs = near.groupBy("anchor_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("band", "positive_score"))), lambda x: x.positive_score).alias("needs"))
    needing = asked.join(needs.withColumnRenamed("anchor_id", "vec_id"), "vec_id").select("vec_id", "label", "q", "needs")
    needing = scratch.table(needing.mapInArrow(_pack(dim, ANCHORS, positives), PACKED), "needing")
    far = _top(_meet(rows, needing, basis, _negatives(negatives, least, most)), ["anchor_id", "band"], negatives)
    out = far.join(near, ["anchor_id", "band"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
