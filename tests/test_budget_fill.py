"""The budget is offered to every open obligation, in ranked order."""

from __future__ import annotations

import pyarrow as pa
from conftest import SF

from ripplenet.functions import exprs as e
from ripplenet.plans import ordered
from ripplenet.sources.network import Network

BUDGET = 300_000_000


def test_budget_fill_matches_a_fold_over_all_rows(spark):
    o = Network(spark, SF).obligations.where(e.is_open())
    rows = o.select("debtor", "priority", "due_t", "amount_minor", "obligation_id", e.outstanding().alias("need")).collect()
    want = {}
    for r in sorted(rows, key=lambda r: (-r.priority, r.due_t, -r.amount_minor, r.obligation_id, r.need)):
        left, n = want.get(r.debtor, (BUDGET, 0))
        want[r.debtor] = (left - r.need, n + 1) if r.need <= left else (left, n)
    got = {r.debtor: (r.left_minor, r.n_picks) for r in ordered.greedy_budget_fill(spark, SF).collect()}
    assert got == want


def test_money_left_is_carried_over_batches():
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array([x[0] for x in rows]), pa.array([x[1] for x in rows], pa.int64())], ["debtor", "need"])
    out = ordered.funded(10)([batch([("a", 6), ("a", 5)]), batch([("a", 4), ("b", 11)]), batch([("b", 3)])])
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == [("a", 0, 2), ("b", 7, 1)]
