"""Exact removal of repeated byte strings by prefix-free parsing.

Rolling-hash triggers cut every text into phrases: the trigger of a window of
``length`` bytes is the smallest rolling hash among its first ``span`` gram positions, so equal
windows carry the same trigger at the same offset, and every window has one.  A window is then
a phrase suffix (from its start to the trigger) followed by a prefix of the parse
behind the trigger.  The corpus order is needed only to depth ``length``: suffixes that agree
so far are neighbours, and the class of such neighbours is what is counted.

1. dictionary and parse: each trigger occurrence has a key K (the bytes behind the trigger that
   all its windows share) and a class C (all bytes its windows cover).  Occurrences aggregate
   map-side per (K, C).  A class met twice settles all its windows at once - in highly
   repetitive text nearly everything; a key met once settles them the other way.
2. suffixes: only keys under which classes differ, one of them met once, are expanded: one
   representative per class gives the fingerprints of its phrase suffixes with the parse prefix,
   weighted by the class's count; those of total weight two or more are repeated.

No text, group or dictionary passes through one task or the driver; fingerprints of 96 bits
stand for the suffixes' bytes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

EMPTY_SHA = hashlib.sha256(b"").hexdigest()
#: Bytes of texts that are hashed side by side; more than the starts that one trigger governs.
CHUNK_BYTES, WIDEST = 1 << 17, 4096


def sliding_argmin(keys: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` keys the place of its smallest (the first of equals)."""
    n = len(keys)
    tagged = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(n, dtype=np.uint64)
    blocks = -(-n // span)
    padded = np.full(blocks * span, 0xFFFFFFFFFFFFFFFF, np.uint64)
    padded[:n] = tagged
    padded = padded.reshape(blocks, span)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - span + 1
    return (np.minimum(behind[:windows], ahead[span - 1 : span - 1 + windows]) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def triggers(data: np.ndarray, offsets: np.ndarray, length: int, gram: int, span: int) -> tuple[c.Windows, np.ndarray, np.ndarray, np.ndarray]:
    """Trigger places in the texts between ``offsets`` and the first and last start of the windows that each governs; windows never cross texts."""
    windows = c.Windows(c.byte_values(data))
    at = sliding_argmin(windows.every(len(data) - length + span, gram), span)
    place = np.flatnonzero(np.arange(length, length + len(at)) <= np.repeat(offsets[1:], np.diff(offsets))[: len(at)])
    at = at[place]
    edge = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # a trigger lies in the text of its windows, so it changes between texts
    return windows, at[edge], place[edge], place[np.r_[edge[1:] - 1, len(at) - 1]]


def _parse(length: int, gram: int, span: int):
    shared = length - span + 1

    def run(batches):
        for batch in batches:
            for docs, texts in c.chunks(batch, CHUNK_BYTES):
                data, offsets = c.binary_parts(texts)
                if np.diff(offsets).max() < length:
                    continue
                w, at, lo, hi = triggers(data, offsets, length, gram, span)
                key = w.hashes(at, at + shared)
                whole = c.mix(w.hashes(lo, hi + length) ^ c.mix(((at - lo) * WIDEST + hi - lo).astype(np.uint64)))
                text = np.searchsorted(offsets, lo, "right") - 1
                spot = (lo - offsets[text]) * WIDEST + hi - lo
                yield pa.RecordBatch.from_arrays([pa.array(c.signed(key)), pa.array(c.signed(whole)), docs.take(pa.array(text)), pa.array(spot)], ["k", "cls", "doc_id", "spot"])

    return run


def _suffixes(length: int):
    """Fingerprints of the windows that the listed trigger occurrences of a text govern."""

    def run(batches):
        for batch in batches:
            jobs, done = batch.column(2), 0
            for docs, texts in c.chunks(batch, CHUNK_BYTES):
                data, offsets = c.binary_parts(texts)
                values = c.byte_values(data)
                first, second = c.Windows(values), c.Windows(values, c.BASES[1])
                mine = jobs.slice(done, len(docs))
                done += len(docs)
                text = np.repeat(np.arange(len(docs)), mine.value_lengths().to_numpy())
                spot, n = (x.to_numpy() for x in mine.flatten().flatten())
                lo, width = offsets[text] + spot // WIDEST, spot % WIDEST
                inside = lo + width + length <= offsets[text + 1]  # another text may bear the same id
                text, lo, n, count = text[inside], lo[inside], n[inside], width[inside] + 1
                x = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
                text, weight = np.repeat(text, count), np.repeat(n, count)
                for a in range(0, len(x), 1 << 17):
                    s, t = x[a : a + (1 << 17)], text[a : a + (1 << 17)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.signed(first.hashes(s, s + length))), pa.array((second.hashes(s, s + length) >> np.uint64(32)).astype(np.uint32).view(np.int32))]
                        + [docs.take(pa.array(t)), pa.array((s - offsets[t]).astype(np.int32)), pa.array(weight[a : a + len(s)].astype(np.int32))],
                        ["h1", "h2", "doc_id", "x", "weight"],
                    )

    return run


def _cut(batches):
    for batch in batches:
        out = []
        for doc, raw, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = raw.as_py()
            lo, hi = c.runs(*(np.minimum(spans.values.field(i).to_numpy().astype(np.int64), len(raw)) for i in range(2)))
            edges = np.r_[0, np.c_[lo, hi].ravel(), len(raw)]
            digest = hashlib.sha256()
            for a, b in zip(edges[::2], edges[1::2], strict=True):
                digest.update(raw[a:b])
            out.append((doc, int((hi - lo).sum()), digest.hexdigest(), lo.tolist(), hi.tolist()))
        types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
        names = ["doc_id", "removed", "cut_sha", "span_starts", "span_ends"]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)


def remove_repeated_bytes(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = 200, gram: int = 24, span: int = 128
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept_sha256, span_starts, span_ends) per document.

    A byte goes if a string of ``length`` bytes that covers it also starts at any other place,
    the same document included; matches never cross documents; strings are judged on the
    input.  Spans are the maximal removed byte runs, half-open.  Null counts as empty; texts
    shorter than ``length`` keep all; equal texts of that length or more lose all bytes.  Rows that repeat
    an id and its text are equal documents, one row each; other ids must be unique (of several texts under one id
    only one is cut); a row without an id is judged as a whole text only, and keeps what is no copy; other columns are ignored.
    """
    if not gram <= length - span + 1 or span >= WIDEST:
        raise ValueError("each window must hold a whole gram behind its trigger")
    scratch = c.Scratch(docs.sparkSession, "prefixfree")
    raw = c.text_bytes(docs, id_col, text_col)
    base = scratch.table(
        raw.select("doc_id", F.coalesce(F.octet_length("raw"), F.lit(0)).cast("long").alias("n_bytes"), F.sha2(F.coalesce("raw", F.lit(b"")), 256).alias("sha")),
        "base",
    )
    copies = base.where(F.col("n_bytes") >= length).groupBy("sha").agg(F.count("*").alias("n")).where("n > 1")
    whole = scratch.table(c.dealt(base, copies, ["sha"], F.col("doc_id"), scratch, "copies").select("doc_id").distinct(), "whole")

    parse = raw.mapInArrow(_parse(length, gram, span), "k long, cls long, doc_id long, spot long")
    spot = F.when(F.col("doc_id").isNotNull(), F.col("spot"))
    one = [F.first("doc_id", ignorenulls=True).alias("doc_id"), F.first(spot, ignorenulls=True).alias("spot")]  # both of the first row with an id
    classes = parse.groupBy("k", "cls").agg(F.count("*").alias("n"), *one)
    # the spots are read here, too, so that both uses of the classes are the same exchange and texts are parsed once for them
    per_key = F.struct(F.sum("n").alias("n"), F.count("*").alias("classes"), F.min("n").alias("least"), F.min(F.coalesce("doc_id", "spot")).alias("any"))
    keys = classes.groupBy("k").agg(per_key.alias("key")).where("key.n > 1 and key.any is not null")
    classes = scratch.table(classes.join(keys, "k").select("k", "cls", "n", "doc_id", "spot", ((F.col("key.classes") > 1) & (F.col("key.least") == 1)).alias("open")), "classes")

    lo = F.shiftrightunsigned("spot", 12).cast("int")
    end = lo + F.pmod("spot", F.lit(WIDEST)).cast("int") + length
    settled = c.dealt(parse, classes.where("n > 1").select("k", "cls", "n"), ["k", "cls"], F.col("doc_id"), scratch, "twice").join(whole, "doc_id", "left_anti")
    settled = scratch.table(settled.groupBy("doc_id").agg(F.collect_list(F.struct(lo.alias("lo"), end.alias("end"))).alias("spans")), "settled")
    jobs = scratch.table(
        classes.where("open").groupBy("doc_id").agg(F.collect_list(F.struct("spot", F.least("n", F.lit(2)).cast("int").alias("n"))).alias("jobs")),
        "jobs",
    )
    ids = settled.select("doc_id").union(jobs.select("doc_id")).distinct()
    affected = scratch.table(raw.join(ids, "doc_id", "left_semi"), "affected")

    scratch.drop("classes")

    # the windows are made twice rather than written: they are many times the text
    windows = affected.join(jobs, "doc_id").mapInArrow(_suffixes(length), "h1 long, h2 int, doc_id long, x int, weight int")
    repeated = windows.groupBy("h1", "h2").agg(F.sum("weight").alias("w"), F.count("*").alias("n")).where("w > 1").select("h1", "h2", "n")
    found = (
        c.dealt(windows.where("weight = 1"), repeated, ["h1", "h2"], F.col("doc_id"), scratch, "repeated")
        .join(whole, "doc_id", "left_anti")
        .groupBy("doc_id")
        .agg(F.collect_list(F.struct(F.col("x").alias("lo"), (F.col("x") + length).alias("end"))).alias("spans"))
    )
    spans = settled.union(found).groupBy("doc_id").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    cut = affected.join(spans, "doc_id").mapInArrow(_cut, "doc_id long, removed long, cut_sha string, span_starts array<long>, span_ends array<long>")
    full, empty = F.col("full").isNotNull(), F.array().cast("array<long>")
    out = (
        base.join(whole.withColumn("full", F.lit(True)), "doc_id", "left")
        .join(cut.dropDuplicates(["doc_id"]), "doc_id", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(full, F.col("n_bytes")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(full, EMPTY_SHA).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(full, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("span_starts", empty)).alias("span_starts"),
            F.when(full, F.array("n_bytes")).otherwise(F.coalesce("span_ends", empty)).alias("span_ends"),
        )
    )
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
