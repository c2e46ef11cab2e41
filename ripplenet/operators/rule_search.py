"""Search for ranking rules on recorded outcomes.

A rule is a vector of weights over clues; in each scenario it picks the candidate of the highest weighted sum, and is worth the
mean outcome recorded for its picks.  A population is scored in one pass: every row of clues meets
all rules (their number is a parameter), and one aggregation finds the picks.  Rules that pick alike everywhere are one behaviour.
New rules come from crossing and shifting the best distinct ones, by hashes of (seed, generation, place), so a seed gives the same search anywhere.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripplenet.operators.graph import cut

#: Rules that one pass takes.
MOST_RULES = 500


def _number(*key: object) -> float:
    """A number in [0, 1) that depends on the key alone."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, key)).encode()).digest()[:8], "big") / 2**64


def population(seed: int, size: int, clues: int) -> list[list[float]]:
    """First generation: weights between -1 and 1."""
    return [[round(2 * _number(seed, 0, i, k) - 1, 6) for k in range(clues)] for i in range(size)]


def picks(rows: DataFrame, clues: list[str], rules: list[list[float]], *, scenario: str = "scenario", candidate: str = "candidate", outcome: str = "outcome") -> DataFrame:
    """(rule, scenario, candidate, outcome): each rule's pick; equal sums go to the smaller candidate, null clues count as 0."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"a pass takes at most {MOST_RULES} rules")
    scores = []
    for i, w in enumerate(rules):
        total = F.lit(0.0)
        for c, x in zip(clues, w, strict=True):
            total = total + F.lit(float(x)) * F.coalesce(F.col(c), F.lit(0.0))
        scores.append(F.struct(F.lit(i).alias("rule"), F.round(total, 9).alias("score")))
    each = rows.select(scenario, candidate, outcome, F.explode(F.array(*scores)).alias("s"))
    best = F.min_by(F.struct(candidate, outcome), F.struct((-F.col("s.score")).alias("a"), candidate)).alias("pick")
    return each.groupBy(F.col("s.rule").alias("rule"), scenario).agg(best).select("rule", scenario, "pick.*")


def scored(picked: DataFrame, *, scenario: str = "scenario", candidate: str = "candidate", outcome: str = "outcome") -> DataFrame:
    """(rule, value, n, behaviour): mean recorded outcome, scenarios, and a sum of hashes of what was picked where."""
    told = F.sum(F.xxhash64(F.col(scenario).cast("string"), F.col(candidate).cast("string")).cast("decimal(38,0)")).cast("string")
    return picked.groupBy("rule").agg(F.avg(outcome).alias("value"), F.count("*").alias("n"), told.alias("behaviour"))


@dataclass
class Generation:
    number: int
    best: float
    behaviours: int
    rule: list[float]


def _next(parents: list[list[float]], seed: int, generation: int, size: int, step: float) -> list[list[float]]:
    """The parents, and children of two of them each, some weights shifted."""
    out = list(parents)
    for i in range(size - len(parents)):
        a, b = (parents[int(_number(seed, generation, i, side) * len(parents))] for side in ("a", "b"))
        child = [x if _number(seed, generation, i, k, "cross") < 0.5 else y for k, (x, y) in enumerate(zip(a, b, strict=True))]
        out.append([round(x + step * (2 * _number(seed, generation, i, k, "shift") - 1) * (_number(seed, generation, i, k, "whether") < 0.5), 6) for k, x in enumerate(child)])
    return out


def search(rows: DataFrame, clues: list[str], *, seed: int, size: int = 40, generations: int = 8, parents: int = 10, step: float = 0.5) -> list[Generation]:
    """One entry a generation: its best value, distinct behaviours and best rule.  The best value never falls, for parents stay.

    ``rows`` holds (scenario, candidate, outcome) and the clues.  One job a generation; what reaches the driver is one row a rule.
    """
    rows = cut(rows.select("scenario", "candidate", "outcome", *clues))
    rules, out = population(seed, size, len(clues)), []
    for number in range(1, generations + 1):
        found = sorted(scored(picks(rows, clues, rules)).collect(), key=lambda r: (-r.value, r.rule))
        seen: dict[str, int] = {}
        for r in found:
            seen.setdefault(r.behaviour, r.rule)
        if not seen:
            break
        out.append(Generation(number, found[0].value, len(seen), rules[found[0].rule]))
        rules = _next([rules[i] for i in list(seen.values())[:parents]], seed, number, size, step)
    return out
