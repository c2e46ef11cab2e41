"""Phrase mining with vertical position bitmaps.

Texts of one language are cut into shards of SHARD positions.  A shard is stored upside down: for each word the
positions where it stands, as a compressed bitmap of (container of eight positions, mask) entries.  Ends of pieces hold a
position of their own which no word has.  To extend a phrase by a word, its bitmap is shifted by one position and ANDed with the
word's, container by container; the bits left are the longer phrase's ends, and their number its occurrences in the shard.
Extension is depth-first: a block of first words is followed to the longest phrases before the next block starts,
so a task holds one shard and one block's bitmaps.  Counts are summed over shards.

Plan: counts of words first.  A phrase is no more frequent than its words, so only words of the least support get a number, and each shard learns
the numbers of its own words by a join.  Pairs are counted next, then triples through frequent pairs only: these
are marked in a bitmap of fixed size, which passes all of them and few others, so it can be sent to every task whatever
the corpus.  A hot word or phrase is one row per shard everywhere.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as c

#: Positions of a shard; entries of prefix bitmaps that are extended together; bits of the sieve of frequent pairs.
SHARD, TOGETHER, SIEVE_BITS = 1 << 19, 1 << 17, 1 << 24
#: Marks that end a piece, and what stands for them between words: no word can hold it.
ENDS, STOP = b".,;:!?\n\x0b\x0c\r", b"."
_FOLD = bytes(ord(STOP) if b in ENDS else b for b in range(256))
ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _words(raw: bytes) -> list[bytes]:
    """Words with A-Z lower-cased, and STOP between pieces."""
    return raw.lower().translate(_FOLD).replace(STOP, b" . ").split()


def _vertical(tokens: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Per word the number of its entries, and all entries (container << 8 | mask) by word and container; words are 1 .. size."""
    at = np.flatnonzero(tokens)
    order = np.argsort(tokens[at], kind="stable")
    word, at = tokens[at][order].astype(np.int64), at[order]
    box = at >> 3
    new = np.ones(len(at), bool)
    new[1:] = (word[1:] != word[:-1]) | (box[1:] != box[:-1])
    starts = np.flatnonzero(new)
    mask = np.add.reduceat(1 << (at & 7), starts) if len(starts) else np.zeros(0, np.int64)
    return np.bincount(word[starts], minlength=size + 1)[1:], box[starts] << 8 | mask


def _shards(shard: int):
    """One row per shard: its words, their counts, and the entries of their bitmaps."""

    def run(batches):
        task, made, open_, size = TaskContext.get().partitionId(), 0, {}, Counter()

        def row(lang, ids, tokens):
            nonlocal made
            made += 1
            flat = np.concatenate(tokens)
            entries, bits = _vertical(flat, len(ids))
            counts = np.bincount(flat, minlength=len(ids) + 1)[1:]
            columns = [[(task << 32) + made], [lang], [list(ids)], [counts], [entries.astype(np.int32).tobytes()], [bits.tobytes() if len(flat) >> 3 >= 1 << 23 else bits.astype(np.int32).tobytes()]]
            types = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, types, strict=True)], ["shard", "lang", "words", "counts", "entries", "bits"])

        for batch in batches:
            for lang, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = _words(raw.as_py() or b"")
                while words:
                    ids, tokens = open_.setdefault(lang, ({}, []))
                    room = shard - size[lang]
                    cut = len(words)
                    if cut > room:  # a longer text goes on in the next shard, after the end of a piece
                        try:
                            cut = words.index(STOP, room) + 1
                        except ValueError:
                            pass
                    part, words = words[:cut], words[cut:]
                    tokens.append(np.fromiter((0 if w == STOP else ids.setdefault(w, len(ids) + 1) for w in part), np.int32, len(part)))
                    tokens.append(np.zeros(1, np.int32))
                    size[lang] += len(part) + 1
                    if size[lang] >= shard:
                        yield row(lang, *open_.pop(lang))
                        size[lang] = 0
        for lang, (ids, tokens) in open_.items():
            if ids:
                yield row(lang, ids, tokens)

    return run


class Index:
    """A shard's entries by container, for the words that have a number."""

    def __init__(self, places, numbers, entries: bytes, bits: bytes):
        sizes = np.frombuffer(entries, np.int32)
        ends = np.cumsum(sizes)
        wide = np.int64 if len(bits) > 4 * ends[-1] else np.int32
        packed = np.frombuffer(bits, wide).astype(np.int64)
        order = np.argsort(numbers, kind="stable")
        self.numbers, places = numbers[order], places[order]
        sizes, starts = sizes[places], (ends - sizes)[places]
        self.first = np.r_[0, np.cumsum(sizes)]
        packed = packed[_spread(starts, sizes)]
        self.word = np.repeat(np.arange(len(places)), sizes)
        self.box, self.mask = packed >> 8, (packed & 255).astype(np.uint8)
        by_box = np.argsort(self.box, kind="stable")
        self.at = np.searchsorted(self.box[by_box], np.arange(self.box.max(initial=0) + 3))
        self.word_at, self.mask_at = self.word[by_box], self.mask[by_box]

    def blocks(self):
        """Ranges of words with about TOGETHER entries each: (entries of their bitmaps)."""
        w = 0
        while w < len(self.numbers):
            e = max(w + 1, int(np.searchsorted(self.first, self.first[w] + TOGETHER, "right")) - 1)
            yield slice(int(self.first[w]), int(self.first[e]))
            w = e

    def extend(self, phrase: np.ndarray, box: np.ndarray, mask: np.ndarray):
        """Bitmaps of all phrases with one word more, entry by entry: (entry of the phrase, word, container, mask)."""
        over = np.flatnonzero(mask & 128)
        source = np.r_[np.arange(len(phrase)), over]
        box = np.r_[box, box[over] + 1]
        mask = np.r_[mask << 1, np.ones(len(over), np.uint8)]
        some = (mask != 0) & (box < len(self.at) - 1)
        source, box, mask = source[some], box[some], mask[some]
        starts, ends = self.at[box], self.at[box + 1]
        with_ = _spread(starts, ends - starts)
        of = np.repeat(np.arange(len(source)), ends - starts)
        both = mask[of] & self.mask_at[with_]
        hit = np.flatnonzero(both)
        of = of[hit]
        return source[of], self.word_at[with_[hit]], box[of], both[hit]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0] .. starts[0] + sizes[0] - 1, then the next."""
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


def _counted(keys: list[np.ndarray], mask: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Bits per key."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    starts = np.flatnonzero(new)
    counts = np.add.reduceat(ONES[mask[order]].astype(np.int64), starts) if len(starts) else np.zeros(0, np.int64)
    return [k[order][starts] for k in keys], counts


def _pair_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Place of a pair of numbers in the sieve."""
    return (c.mix(a.astype(np.uint64) * c.GOLDEN + b.astype(np.uint64)) & np.uint64(SIEVE_BITS - 1)).astype(np.int64)


def _phrases(sieve: np.ndarray | None):
    """Counts of pairs per shard or, through the pairs in the sieve, of triples."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                places, numbers = (batch.column(i)[at].values.to_numpy() for i in (0, 1))
                index = Index(places, numbers, batch.column(2)[at].as_py(), batch.column(3)[at].as_py())
                for block in index.blocks():
                    first, box, mask = index.word[block], index.box[block], index.mask[block]
                    of, second, box, mask = index.extend(first, box, mask)
                    keys = [first[of], second]
                    if sieve is not None:
                        keys, box, mask = _sieved(index, sieve, keys, box, mask)
                        of, third, box, mask = index.extend(keys[0], box, mask)
                        keys = [keys[0][of], keys[1][of], third]
                        keep, _, mask = _sieved(index, sieve, keys[1:], box, mask, keys[0])
                        keys = [keep[-1], *keep[:-1]]
                    keys, counts = _counted(keys, mask)
                    names = ["p", "q", "s"][: len(keys)] + ["n"]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in [*(index.numbers[k] for k in keys), counts]], names)

    return run


def _sieved(index: Index, sieve: np.ndarray, pair: list[np.ndarray], box, mask, *more):
    places = _pair_bits(index.numbers[pair[0]], index.numbers[pair[1]])
    keep = np.flatnonzero(sieve[places >> 3] >> (places & 7).astype(np.uint8) & 1)
    return [k[keep] for k in (*pair, *more)], box[keep], mask[keep]


def _marks(batches):
    for batch in batches:
        places = np.unique(_pair_bits(batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        yield pa.RecordBatch.from_arrays([pa.array(places >> 3), pa.array((1 << (places & 7)).astype(np.int32))], ["byte", "mask"])


def _sieve(pairs: DataFrame) -> np.ndarray:
    """The frequent pairs in SIEVE_BITS bits: as many bytes at most reach the driver, whatever the pairs."""
    marks = pairs.select("p", "q").mapInArrow(_marks, "byte long, mask int").groupBy("byte").agg(F.bit_or("mask").alias("mask"))
    sieve = np.zeros(SIEVE_BITS >> 3, np.uint8)
    for batch in marks.toArrow().to_batches():
        sieve[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return sieve


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 * a * a / (left * right)), exact in 38 digits for counts below 10^15."""
    return F.expr(f"(cast({a} as decimal(15, 0)) * cast({a} as decimal(15, 0)) * 1000000BD) div (cast({left} as decimal(15, 0)) * cast({right} as decimal(15, 0)))")


def mine_phrases(
    docs: DataFrame,
    *,
    text_col: str = "text",
    lang_col: str = "lang",
    support: int = 10,
    absorbed: int = 50,
    top: int = 2000,
    shard: int = SHARD,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of two or three words.

    A-Z are lower-cased; pieces end at ``[.,;:!?\\x0A-\\x0D]``, words are ``[^\\x20\\x09]+``.  ``a`` counts the phrase in all pieces,
    ``l`` and ``r`` its parts at the cut of the lowest score (ties: the first), ``n`` all words of the language.  Phrases
    below ``support`` are no candidates; a pair within a triple of ``absorbed`` per cent of its occurrences or more goes.  Order: score and
    ``a`` descending, then the phrase's bytes.

    A null language is ``und``; null, empty and blank texts have no words.  A repeated row counts again, a text of any length
    is cut at pieces only (a longer piece makes a longer shard).  Tables without candidates give no rows; other columns are ignored.
    """
    scratch = c.Scratch(docs.sparkSession, "phrases")
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("binary").alias("raw"))
    shards = scratch.table(texts.mapInArrow(_shards(shard), "shard long, lang string, words array<binary>, counts array<long>, entries binary, bits binary"), "shards")

    local = shards.select("shard", "lang", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("shard", "lang", "place", F.col("x.words").cast("string").alias("word"), F.col("x.counts").alias("f"))
    sizes = shards.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda s, x: s + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = scratch.table(local.groupBy("lang", "word").agg(F.sum("f").alias("f")).where(F.col("f") >= support), "counts")
    words = scratch.table(words.withColumn("number", F.monotonically_increasing_id()), "words")
    known = local.select("shard", "lang", "place", "word").join(words.select("lang", "word", "number"), ["lang", "word"])
    known = known.groupBy("shard").agg(F.collect_list("place").alias("places"), F.collect_list("number").alias("numbers"))  # a shard's own words at most
    ready = shards.select("shard", "entries", "bits").join(known, "shard").select("places", "numbers", "entries", "bits")
    ready = scratch.table(ready, "ready")

    def counted(kernel, keys):
        found = ready.mapInArrow(kernel, ", ".join(f"{k} long" for k in [*keys, "n"]))
        return found.groupBy(*keys).agg(F.sum("n").alias("a")).where(F.col("a") >= support)

    pairs = scratch.table(counted(_phrases(None), ["p", "q"]), "pairs")
    triples = scratch.table(counted(_phrases(_sieve(pairs)), ["p", "q", "s"]), "triples")

    def side(key, name):
        return words.select(F.col("number").alias(key), F.col("word").alias(f"{name}_word"), F.col("f").alias(f"{name}_f"), F.col("lang").alias(f"{name}_lang"))

    named = pairs.join(side("p", "p"), "p").join(side("q", "q").drop("q_lang"), "q")
    named = scratch.table(named, "named")
    inside = triples.select("p", "q", "a").union(triples.select(F.col("q").alias("p"), F.col("s").alias("q"), "a")).groupBy("p", "q").agg(F.max("a").alias("longer"))
    two = named.join(inside, ["p", "q"], "left").where(F.expr(f"coalesce(100 * longer < {absorbed} * a, true)"))
    two = two.select(F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_word", "q_word").alias("phrase"), "a", F.col("p_f").alias("l"), F.col("q_f").alias("r"), _score("a", "p_f", "q_f").alias("score"))

    head = named.select("p", "q", F.col("p_lang").alias("lang"), F.concat_ws(" ", "p_word", "q_word").alias("start"), F.col("p_f").alias("l1"), F.col("a").alias("l2"))
    tail = named.select(F.col("p").alias("q"), F.col("q").alias("s"), F.col("q_word").alias("last"), F.col("a").alias("r1"), F.col("q_f").alias("r2"))
    three = triples.join(head, ["p", "q"]).join(tail, ["q", "s"]).withColumn("score1", _score("a", "l1", "r1")).withColumn("score2", _score("a", "l2", "r2"))
    later = F.col("score2") < F.col("score1")
    three = three.select("lang", F.concat_ws(" ", "start", "last").alias("phrase"), "a", F.when(later, F.col("l2")).otherwise(F.col("l1")).alias("l"), F.when(later, F.col("r2")).otherwise(F.col("r1")).alias("r"), F.least("score1", "score2").alias("score"))

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    spread = two.union(three).withColumn("slot", F.pmod(F.xxhash64("phrase"), F.lit(c.SALTS)))  # first in each of SALTS parts, then in all
    best = spread.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slot").orderBy(*order))).where(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    out = best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out
