"""Exact substring deduplication with difference-cover anchors.

A set D is a difference cover modulo v if every residue is a difference of two members.
For any two positions i, j some shift 0 <= s < v puts both i + s and j + s on
D modulo v.  Two equal windows of L words therefore share an anchor of L - v + 1 words
that starts on a cover position in both texts.  Only anchors are hashed over the whole
corpus (|D| / v of all positions); where one recurs in another text, it extends:
the full windows around it are hashed and meet their smallest document.

Plan: anchors aggregate map-side per hash to (smallest, largest content id), so a hot
passage is one row per task; equal texts share one content id and act through their smallest
document.  Windows do the same.  No group of occurrences is ever gathered, no pairs are made, and the
rows of a hot anchor or window are dealt over many tasks where they meet its owner.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

#: Perfect difference set of order 5: each residue modulo 31 is a difference exactly once.
PERIOD, COVER = 31, (1, 5, 11, 24, 25, 27)
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def covers(period: int, cover: tuple[int, ...]) -> bool:
    return {(a - b) % period for a in cover for b in cover} == set(range(period))


def _content_id(words: list[bytes]) -> int:
    return xxhash.xxh3_64_intdigest(b" ".join(words)) - (1 << 63)


def _base(batches):
    for ids, raws in c.slices(batches):
        words = [raw.split() for raw in raws]
        joined = [b" ".join(w) for w in words]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(w) for w in words], pa.int64()),
                pa.array([xxhash.xxh3_64_intdigest(x) - (1 << 63) for x in joined], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in joined]),
            ],
            ["doc_id", "n_words", "cid", "sha"],
        )


def _anchors(length: int, period: int, cover: tuple[int, ...]):
    width = length - period + 1

    def run(batches):
        cache = c.WordHashes()
        for _, raws in c.slices(batches):
            hashes, cids, places = [], [], []
            for raw in raws:
                words = raw.split()
                if len(words) < length:
                    continue
                at = np.arange(0, len(words) - width + 1, period)[:, None] + np.array(cover)
                at = at[at <= len(words) - width]
                hashes.append(c.Windows(cache.of(words)).hashes(at, at + width))
                places.append(at)
                cids.append(np.full(len(at), _content_id(words), np.int64))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c.signed(np.concatenate(hashes))), pa.array(np.concatenate(cids)), pa.array(np.concatenate(places).astype(np.int32))],
                    ["h", "cid", "pos"],
                )

    return run


def _windows(length: int, period: int):
    def run(batches):
        cache = c.WordHashes()
        for batch in batches:
            for doc, raw, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                values = cache.of(raw.as_py().split())
                last = len(values) - length
                at = np.sort(at.values.to_numpy().astype(np.int64))
                lo, hi = c.runs(np.maximum(at - period + 1, 0), np.minimum(at, last) + 1)
                keep = hi > lo
                starts = np.concatenate([np.arange(a, b) for a, b in zip(lo[keep], hi[keep], strict=True)] or [np.zeros(0, np.int64)])
                for a in range(0, len(starts), 1 << 17):
                    s = starts[a : a + (1 << 17)]
                    h1 = c.Windows(values).hashes(s, s + length)
                    h2 = c.Windows(values, c.BASES[1]).hashes(s, s + length)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c.signed(h1)), pa.array((h2 >> np.uint64(32)).view(np.int64).astype(np.int32, casting="unsafe")), pa.array(np.full(len(s), doc, np.int64)), pa.array(s.astype(np.int32))],
                        ["h1", "h2", "doc_id", "pos"],
                    )

    return run


def _cut(length: int):
    def run(batches):
        for batch in batches:
            out = []
            for doc, raw, at in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                words = raw.as_py().split()
                at = at.values.to_numpy().astype(np.int64)
                lo, hi = c.runs(at, at + length)
                kept, done = [], 0
                for a, b in zip(lo, hi, strict=True):
                    kept += words[done:a]
                    done = b
                kept += words[done:]
                text = b" ".join(kept)
                out.append((doc, len(words) - len(kept), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "replace"), lo.tolist(), hi.tolist()))
            names = ["doc_id", "removed", "cut_sha", "cut_text", "span_starts", "span_ends"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names)

    return run


def remove_repeated_windows(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = 50,
    period: int = PERIOD,
    cover: tuple[int, ...] = COVER,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text, span_starts, span_ends) per document.

    Words are runs outside ``\\x20\\x09-\\x0D``, unchanged.  A word goes if a window of ``length``
    words that covers it also starts in a document of smaller id; windows are judged
    on the input.  Spans are half-open word ranges.  ``kept_text`` (kept words joined by one
    space) is null where nothing was removed: the input text stands.  Null, empty and short texts
    have no windows; equal texts after the smallest id lose all words.  Rows that repeat
    an id and its text are one document, given once a row; other ids must be unique (of several texts under one id only one
    is cut); a row without an id comes after all others and goes only as a copy; other columns are ignored.
    """
    if not covers(period, cover) or length < period:
        raise ValueError("cover must be a difference cover of a period no longer than the window")
    scratch = c.Scratch(docs.sparkSession, "diffcover")
    raw = c.text_bytes(docs, id_col, text_col)
    base = scratch.table(raw.mapInArrow(_base, "doc_id long, n_words long, cid long, sha string"), "base")
    firsts = base.where(F.col("n_words") >= length).groupBy("sha").agg(F.min("doc_id").alias("first"), F.min("cid").alias("cid"), F.count("*").alias("n"))

    anchors = raw.mapInArrow(_anchors(length, period, cover), "h long, cid long, pos int")
    shared = anchors.groupBy("h").agg(F.min("cid").alias("lo"), F.max("cid").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("h", "n")
    hits = c.dealt(anchors, shared, ["h"], F.col("cid"), scratch, "shared").groupBy("cid").agg(F.collect_set("pos").alias("at"))
    hits = scratch.table(hits.join(firsts.select("cid", "first"), "cid").select(F.col("first").alias("doc_id"), "at"), "hits")
    affected = scratch.table(raw.join(hits, "doc_id").select("doc_id", "raw", "at").dropDuplicates(["doc_id"]), "affected")

    windows = affected.mapInArrow(_windows(length, period), "h1 long, h2 int, doc_id long, pos int")
    owners = windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("owner < hi").drop("hi")
    late = c.dealt(windows, owners, ["h1", "h2"], F.col("doc_id"), scratch, "owners").where("doc_id > owner").groupBy("doc_id").agg(F.collect_list("pos").alias("at"))
    cut = affected.select("doc_id", "raw").join(late, "doc_id").mapInArrow(
        _cut(length), "doc_id long, removed long, cut_sha string, cut_text string, span_starts array<long>, span_ends array<long>"
    )
    copy = F.coalesce(F.col("first") < F.col("doc_id"), F.col("first").isNotNull())  # a null id comes last
    empty = F.array().cast("array<long>")
    out = (
        c.dealt(base, firsts.where("n > 1").select("sha", "first", "n"), ["sha"], F.col("doc_id"), scratch, "firsts", how="left")
        .join(cut, "doc_id", "left")
        .select(
            "doc_id",
            "n_words",
            F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
            F.when(copy, EMPTY_SHA).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
            F.when(copy, "").otherwise(F.col("cut_text")).alias("kept_text"),
            F.when(copy, F.array(F.lit(0).cast("long"))).otherwise(F.coalesce("span_starts", empty)).alias("span_starts"),
            F.when(copy, F.array("n_words")).otherwise(F.coalesce("span_ends", empty)).alias("span_ends"),
        )
    )
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
