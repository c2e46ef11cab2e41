"""Triggers of many texts side by side, and how often texts are parsed."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa

from ripplenet.llm import common, prefix_free

LENGTH, GRAM, SPAN = 200, 24, 128


def brute_triggers(raw: bytes) -> list[tuple[int, int, int]]:
    """(trigger, first, last start) of one text, start by start."""
    w, out = common.Windows(common.byte_values(raw)), []
    for start in range(len(raw) - LENGTH + 1):
        keys = [int(w.hashes(np.array([i]), np.array([i + GRAM]))[0]) >> 32 for i in range(start, start + SPAN)]
        at = start + keys.index(min(keys))
        if out and out[-1][0] == at:
            out[-1] = (at, out[-1][1], start)
        else:
            out.append((at, start, start))
    return out


def test_triggers_of_texts_side_by_side_are_those_of_each():
    rng = random.Random(7)
    raws = [bytes(rng.choices(b"ab cd.\n", k=k)) for k in (0, 199, 200, 340, 5, 0, 260, 201)] + [b"x" * 230, b"x" * 230, b""]
    data, offsets = common.binary_parts(pa.array(raws, pa.binary()))
    _, at, lo, hi = prefix_free.triggers(data, offsets, LENGTH, GRAM, SPAN)
    want = [(a + o, x + o, y + o) for raw, o in zip(raws, offsets.tolist(), strict=False) for a, x, y in brute_triggers(raw)]
    assert list(zip(at.tolist(), lo.tolist(), hi.tolist(), strict=True)) == want


def test_texts_are_parsed_once_for_the_classes(spark, monkeypatch):
    """The classes and their keys come from one exchange; the second parse of all texts took 86 of 617 task seconds in CHECK_r03."""
    plans, write = [], common.Scratch.table

    def table(self, df, name, keep=False):
        if name == "classes":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(self, df, name, keep)

    monkeypatch.setattr(common.Scratch, "table", table)
    docs = spark.createDataFrame([(i, f"{i} " + "a common passage of some length " * 20) for i in range(8)], "doc_id long, text string")
    out = {r.doc_id: r.n_removed for r in prefix_free.remove_repeated_bytes(docs).collect()}
    assert all(n > 600 for n in out.values())
    final = plans[0].split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1 and "ReusedExchange" in final


def test_windows_of_a_row_without_an_id_leave_a_place_with_one(spark):
    """Of the places of a class one with an id stands for it, whatever their order."""
    shared = "".join(random.Random(3).choices("abcdefgh ", k=330))
    rows = [(None, "no id " + shared), (1, "one " + shared), (2, "two " + shared[:260] + " and on")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: (r.n_removed, r.span_starts) for r in prefix_free.remove_repeated_bytes(docs).collect()}
    assert out[1] == (330, [4]) or out[1] == (331, [3])
    assert out[2][0] >= 260
