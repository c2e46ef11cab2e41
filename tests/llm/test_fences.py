"""Fences follow the language and source they belong to."""

from __future__ import annotations

import numpy as np

from ripplenet.llm import quality_rules


def test_two_sources_judge_one_text_differently(spark):
    """Half of the words of code forums hold symbols, none of the news: one text with some symbols passes there only."""
    rng = np.random.default_rng(2)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    text = lambda symbols: " ".join(word() + "#" * int(i < symbols) for i in range(100))
    rows = [(i, text(0), "en", "news") for i in range(300)] + [(300 + i, text(rng.integers(30, 70)), "en", "code") for i in range(300)]
    one = text(40)
    rows += [(900, one, "en", "news"), (901, one, "en", "code")]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not got[900].kept and got[901].kept
    assert got[900].max_symbols < 400 < got[901].max_symbols
    assert sum(got[i].kept for i in range(600)) >= 594


def test_a_fence_follows_the_part_of_a_source_that_holds_symbols(spark):
    """Where a fifth of the documents hold symbols one more such text passes; where two of a hundred do, all of them fail."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(map(chr, rng.integers(97, 123, rng.integers(3, 9))))
    text = lambda symbols: " ".join(word() + "#" * int(i < symbols) for i in range(100))
    shares = {"prose": 0, "news": 2, "forum": 20}
    rows = [(1000 * k + i, text(rng.integers(30, 70) if i % 100 < share else 0), "en", source) for k, (source, share) in enumerate(shares.items()) for i in range(600)]
    got = {r.doc_id: r for r in quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    kept = lambda k, low, high: [got[1000 * k + i].kept for i in range(600) if low <= i % 100 < high]
    assert not any(kept(1, 0, 2)) and all(kept(2, 0, 20))
    assert sum(kept(0, 0, 100)) >= 594 and sum(kept(1, 2, 100)) >= 582 and sum(kept(2, 20, 100)) >= 475
    assert got[0].max_symbols < 300 < 700 < got[2000].max_symbols


def test_repeated_and_null_rows_are_judged_one_by_one(spark):
    long = "some plain words of a normal text that goes on " * 3 + " ".join(f"w{i}" for i in range(60))
    rows = [(1, long, None, None), (1, long, None, None), (None, None, "en", "s"), (2, "", "en", None)]
    got = quality_rules.quality_verdicts(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in got) == [(0, False), (1, True), (1, True), (2, False)]
