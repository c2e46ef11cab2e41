"""Near-duplicate groups: SuperMinHash signatures, banding, verification, union-find.

A document is the set of its distinct k-word shingles.  For every element a pseudo-random
permutation of the m signature slots is drawn lazily; at step j it offers the value
``j + uniform`` to its j-th slot (Ertl 2017).  Values of later steps are larger than
any of earlier steps, so a document stops as soon as all its slots are filled.

Plan: one scan makes (set size, 128-bit set fingerprint, band keys) per document; equal
sets collapse to one class, aggregated map-side, before anything else; classes meet in
bands; each meets the band's smallest class, and pairs are confirmed on the full
sets; a band's members that are then still outside the leader's component are compared exactly
with blocks of all its members.  No pairs are listed, no bucket is capped and no signature
estimate decides.  A row of that comparison holds a whole block, so Python workers get them in small batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as c
from .connect import components

#: Steps work on so many elements at a time.
CHUNK = 20_000
#: Elements of a block of sets that a late member is compared with.
BLOCK = 1 << 16
UNSET = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; fewer words count as one shingle."""
    n = len(words)
    if not n:
        return words
    width = min(k, n)
    out = np.full(n - width + 1, c.salted(width), np.uint64)
    for i in range(width):
        out = c.mix(out ^ words[i : n - width + 1 + i]) + c.GOLDEN
    return np.unique(out)


def superminhash(elements: np.ndarray, owner: np.ndarray, n: int, m: int) -> np.ndarray:
    """Signatures (n, m) of the n sets whose elements are given with their owner's number.

    A value holds the step in its upper and the uniform draw in its lower 32 bits.
    """
    sig = np.full(n * m, UNSET, np.uint64)
    for a in range(0, len(elements), CHUNK):
        _offer(elements[a : a + CHUNK], owner[a : a + CHUNK], sig, m)
    return sig.reshape(n, m)


def _offer(e: np.ndarray, doc: np.ndarray, sig: np.ndarray, m: int) -> None:
    perm = None
    for j in range(m):
        x = c.mix(e + c.salted(2 * j + 1))
        k = (j + (((x & np.uint64(0xFFFFFFFF)) * np.uint64(m - j)) >> np.uint64(32))).astype(np.int64)
        value = (np.uint64(j) << np.uint64(32)) | (x >> np.uint64(32))
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(e))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * m + slot, value)
        first, last = doc[0], doc[-1]
        part = sig[first * m : (last + 1) * m].reshape(-1, m)
        # all slots hold values of this step or earlier ones: nothing later can be smaller
        done = part.max(axis=1) < np.uint64(j + 1) << np.uint64(32)
        keep = ~done[doc - first]
        if not keep.any():
            return
        if not keep.all():
            e, doc = e[keep], doc[keep]
            perm = perm[keep] if perm is not None else None
            k = k[keep]
        if perm is None:
            perm = np.broadcast_to(np.arange(m, dtype=np.uint16), (len(e), m)).copy()
            perm[np.arange(len(e)), k] = 0


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(c.mix(np.arange(1, bands + 1, dtype=np.uint64) * c.GOLDEN), parts.shape[:2]).copy()
    for i in range(rows):
        key = c.mix(key ^ parts[:, :, i]) + c.GOLDEN
    return key


def _tokens(raw: bytes, cache: c.WordHashes) -> np.ndarray:
    return cache.of(raw.lower().split())  # bytes: lower() is A-Z only, split() is \x20\x09-\x0D only


def _signatures(k: int, bands: int, rows: int):
    def run(batches):
        cache = c.WordHashes()
        for ids, raws in c.slices(batches):
            sets = [shingles(_tokens(raw, cache), k) for raw in raws]
            n = np.array([len(s) for s in sets])
            flat = np.concatenate(sets) if n.sum() else np.zeros(0, np.uint64)
            owner = np.repeat(np.arange(len(sets)), n)
            full = n > 0
            prints = []
            for salt in (3, 7):
                total = np.zeros(len(sets), np.uint64)
                if len(flat):
                    starts = np.r_[0, np.cumsum(n)[:-1]][full]
                    total[full] = np.add.reduceat(c.mix(flat + c.salted(salt)), starts)
                prints.append(c.signed(total))
            keys = band_keys(superminhash(flat, owner, len(sets), bands * rows)[full], bands, rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(n), *map(pa.array, prints), c.lists(c.signed(keys.ravel()), np.where(full, bands, 0))],
                ["doc_id", "n", "fp1", "fp2", "bands"],
            )

    return run


def _sets(k: int):
    def run(batches):
        cache = c.WordHashes()
        for ids, raws in c.slices(batches):
            sets = [np.sort(c.signed(shingles(_tokens(raw, cache), k))) for raw in raws]  # in signed order, as searched
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), c.lists(np.concatenate(sets), np.array([len(s) for s in sets]))], ["id", "members"]
            )

    return run


def _against(percent: int):
    """Links of one set with a block of others, both exact; sets in signed order.

    A task gives only links that join what its earlier links have not joined: components stay the same, and
    the rows grow with the members, not with the pairs.
    """

    def run(batches):
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            found = []
            for i, own, others in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                own = own.values.to_numpy()
                reps, members = (others.values.field(k) for k in range(2))
                n = members.value_lengths().to_numpy()
                flat = members.flatten().to_numpy()
                at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                shared = np.add.reduceat((own[at] == flat).astype(np.int64), np.r_[0, np.cumsum(n)[:-1]])
                ok = 100 * shared >= percent * (len(own) + n - shared)
                for r in reps.to_numpy()[ok].tolist():
                    a, b = find(i), find(r)
                    if a != b:
                        root[max(a, b)] = min(a, b)
                        found.append((min(i, r), max(i, r)))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in range(2)], ["a", "b"])

    return run


def _linked(na: Column, nb: Column, shared: Column, percent: int) -> Column:
    return 100 * shared >= percent * (na + nb - shared)


def near_duplicates(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle_words: int = 5,
    percent: int = 80,
    bands: int = 48,
    rows: int = 6,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every document.

    Words are runs outside ``\\x20\\x09-\\x0D`` of the text with A-Z lower-cased.  Documents
    link where 100 * intersection >= percent * union of their shingle sets.  ``component_id``
    is the smallest id reachable over links; ``kept`` marks that document.  Null, empty and
    blank texts have no shingles, link with nothing and are kept.  Equal texts share a component, rows
    that repeat an id too; a row without an id joins the component of its text and is never kept unless its text stands alone.  Other columns are ignored.  A pair of similarity s
    escapes the bands with probability (1 - s**rows)**bands: 5e-7 at 0.8 by default.
    """
    spark: SparkSession = docs.sparkSession
    scratch = c.Scratch(spark, "neardup", c.BATCH_BYTES)
    raw = c.text_bytes(docs, id_col, text_col)
    sig = scratch.table(raw.mapInArrow(_signatures(shingle_words, bands, rows), "doc_id long, n long, fp1 long, fp2 long, bands array<long>"), "sig")
    shingled = sig.where("n > 0")
    classes = scratch.table(
        shingled.groupBy("fp1", "fp2", "n").agg(F.min("doc_id").alias("rep")),
        "classes",
    )
    spread = shingled.join(classes.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select(
        F.col("doc_id").alias("rep"), "n", F.explode("bands").alias("band")
    )
    crowded = spread.groupBy("band").agg(F.min(F.struct("rep", "n")).alias("lead"), F.max("rep").alias("last")).where("lead.rep < last")
    met = scratch.table(spread.join(crowded.select("band", "lead"), "band"), "met")

    near = 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")  # sizes alone rule the others out
    first = scratch.table(
        met.where(F.col("rep") > F.col("lead.rep"))
        .select(F.col("lead.rep").alias("a"), F.col("rep").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"))
        .where(near)
        .distinct(),
        "first",
    )
    wanted = met.select(F.col("rep").alias("doc_id")).distinct()
    sets = scratch.table(raw.join(wanted, "doc_id", "left_semi").mapInArrow(_sets(shingle_words), "id long, members array<long>"), "sets")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        left = sets.select(F.col("id").alias("a"), F.col("members").alias("ma"))
        right = sets.select(F.col("id").alias("b"), F.col("members").alias("mb"))
        shared = F.size(F.array_intersect("ma", "mb"))
        return scratch.table(pairs.join(left, "a").join(right, "b").where(_linked(F.col("na"), F.col("nb"), shared, percent)).select("a", "b"), name)

    links = confirmed(first, "links")
    labels = components(links, scratch, "c1")
    # bands that still hold several components: their members outside the leader's component meet all others
    lead = F.col("lead.rep")
    placed = met.join(labels, met.rep == labels.node, "left").select("band", "rep", "n", F.coalesce("label", "rep").alias("label"), (lead == F.col("rep")).alias("leads"))
    mixed = placed.groupBy("band").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count("*").alias("size"), F.max(F.when(F.col("leads"), F.col("label"))).alias("g"))
    mixed = mixed.where("lo < hi and size > 2").select("band", "g")
    open_ = scratch.table(placed.join(mixed, "band").select("g", "rep", "n", "label").distinct(), "open")
    cuts = open_.groupBy("g").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    filed = open_.join(cuts, "g").join(sets.withColumnRenamed("id", "rep"), "rep")
    blocks = filed.groupBy("g", F.pmod(F.xxhash64("rep"), "blocks").cast("int").alias("block")).agg(F.collect_list(F.struct("rep", "members")).alias("others"))
    late = filed.where("label <> g").select("g", F.col("rep").alias("id"), F.col("members").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    pairs = late.join(blocks, ["g", "block"]).select("id", "own", "others").mapInArrow(_against(percent), "a long, b long")
    more = scratch.table(pairs.distinct(), "more")
    if not more.isEmpty():
        labels = components(links.union(more), scratch, "c2")
    ids = classes.join(labels, classes.rep == labels.node, "left").select("fp1", "fp2", "n", F.coalesce("label", "rep").alias("component_id"))
    out = sig.join(ids, ["fp1", "fp2", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")
    )
    out = scratch.table(out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())), "result", keep=True)
    scratch.clear()
    return out
