"""The same seed gives the same search, the best never falls, rules that pick alike are one behaviour."""

from __future__ import annotations

import numpy as np
import pytest

from ripplenet.operators import rule_search as s

CLUES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    made = [(f"s{i}", f"m{j}", *map(float, rng.normal(size=3))) for i in range(12) for j in range(15)]
    made = [(x[0], x[1], 2 * x[2] - x[3] + 0.1 * i % 1, *x[2:4], None if i % 50 == 0 else x[4]) for i, x in enumerate(made)]
    return spark.createDataFrame(made, "scenario string, candidate string, outcome double, a double, b double, c double")


def test_picks_and_behaviours_equal_plain_loops(rows):
    rules = [[1.0, 0.0, 0.0], [2.0, 0.0, 0.0], [0.0, 0.0, 0.0], [0.5, -1.0, 0.3]]
    table = rows.toPandas()
    got = {(r.rule, r.scenario): (r.candidate, r.outcome) for r in s.picks(rows, CLUES, rules).collect()}
    for i, w in enumerate(rules):
        for name, part in table.groupby("scenario"):
            best = min(part.itertuples(), key=lambda r: (-round(sum(x * (0 if np.isnan(v) else v) for x, v in zip(w, (r.a, r.b, r.c), strict=True)), 9), r.candidate))
            assert got[i, name] == (best.candidate, best.outcome)
    told = {r.rule: r for r in s.scored(s.picks(rows, CLUES, rules)).collect()}
    assert told[0].behaviour == told[1].behaviour and len({r.behaviour for r in told.values()}) == 3
    assert all(r.n == 12 for r in told.values())


def test_a_search_repeats_and_never_falls(rows):
    first = s.search(rows, CLUES, seed=3, size=12, generations=5, parents=4)
    again = s.search(rows.repartition(5), CLUES, seed=3, size=12, generations=5, parents=4)
    assert [(g.rule, g.behaviours) for g in first] == [(g.rule, g.behaviours) for g in again]
    values = [g.best for g in first]
    assert values == sorted(values) and values[-1] > values[0]
    assert [g.rule for g in s.search(rows, CLUES, seed=4, size=12, generations=1)] != [first[0].rule]
    assert s.search(rows.limit(0), CLUES, seed=1, size=4, generations=2) == []
    with pytest.raises(ValueError, match="at most"):
        s.picks(rows, CLUES, [[0.0] * 3] * (s.MOST_RULES + 1))
