"""Mixing to target weights with soft memberships.

A classifier fitted on a labelled table predicts every document's posterior over domains.  Document
rates r >= 0 are fitted so that the expected tokens of each domain, sum of r * tokens * posterior, come
close to the targets: least squares, by projected gradients.  A step needs the residual of each
domain only; it is one aggregation over (tokens, posterior) rows, and every document then moves
against the residuals weighted with its posterior.

Where rates have no upper bound, the totals that any rates can reach form a cone over the posteriors.  Its point next to the
targets is found first, one posterior a round, and proven by the optimality condition over all documents.
Documents that the condition excludes have rate 0; one projected step brings the others to that very point.

Only DataFrame functions are used (numpy solves the k x k system of the domains on the driver).  Words are
never shuffled: a broadcast join with the classifier's words (at most ``max_words``) and partial sums
per document come first.
"""

from __future__ import annotations

import itertools
import logging
import math
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as c

log = logging.getLogger(__name__)
#: So many steps stand in one expression; rates are written to a table then.
STEPS = 8
#: With bounded rates the descent ends when two rounds lower the objective by less than this part of it.
STALL = 0.05
#: Without a bound it ends within this share of all tokens of the best totals.
CLOSE = 1e-6
#: Tokens are summed as whole numbers of this part of a token.
SHARE_UNIT = 10_000
#: Posteriors are rounded to so many digits; documents with equal ones move together.
DIGITS = 4
#: Log-odds are summed as whole numbers of this unit, so that sums don't depend on their order.
UNIT = 1_000_000


def tokens(text: Column) -> Column:
    """Letter runs, lower-cased, and runs of other signs that are no white space."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{M}]+|[^\p{L}\p{M}\s]+)"), 1)


def fraction_of(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 52)) / F.lit(float(1 << 52))


def fit_words(
    docs: DataFrame, labels: DataFrame, scratch: c.Scratch, *, max_labelled: int, max_words: int, min_docs: int, min_odds: float, smoothing: float
) -> tuple[list[str], list[float], DataFrame]:
    """Domains, their log-odds without any word, and (word, w0, w1, ...) of the words that tell domains apart.

    Bernoulli naive Bayes in the labelled sample, one document of each family of near copies: a
    word that is missing speaks as well as one that is there.  A word tells if its likelihood
    ratio (G statistic of the 2 x 2 table of word and domain) exceeds ``2 * ln(tests)``, which less than one
    of so many words without any bond would do by chance, so the cut adapts to the sample; and if its log odds inside the domain and outside differ by ``min_odds``,
    for many words that differ a little, as those of a language do, depend on each other.  About
    ``max_labelled`` labelled rows are taken, by a hash of the id, and the ``max_words`` words of highest ratio.
    """
    labels = labels.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    n = labels.count()
    sample = labels.where(fraction_of(F.col("doc_id"), "sample") < 0.9 * max_labelled / max(n, 1)) if n > 0.9 * max_labelled else labels
    rows = docs.join(F.broadcast(sample), "doc_id").where(F.col("text").isNotNull())  # at most about max_labelled rows
    bags = rows.select("domain", F.array_distinct(tokens(F.col("text"))).alias("words")).where(F.size("words") > 0)
    # near copies agree in the three words of smallest hash: one of each family speaks for it
    smallest = F.slice(F.array_sort(F.transform("words", lambda w: F.xxhash64(w))), 1, 3)
    family = bags.select(smallest.alias("family"), F.struct("domain", F.array_sort("words").alias("words")).alias("bag")).groupBy("family").agg(F.min("bag").alias("bag"))
    bags = scratch.table(family.select("bag.domain", "bag.words"), "bags")
    sizes = {r.domain: r.n for r in bags.groupBy("domain").agg(F.count("*").alias("n")).collect()}  # one row a domain
    domains, total = sorted(sizes), sum(sizes.values())
    if not domains:
        return [], [], bags
    words = bags.select("domain", F.explode("words").alias("word"))
    counts = words.groupBy("word").agg(F.count("*").alias("n"), *[F.sum((F.col("domain") == d).cast("long")).alias(f"n{i}") for i, d in enumerate(domains)])
    counts = scratch.table(counts.where((F.col("n") >= min_docs) & (F.col("n") < total)), "counts")
    tests = max(counts.count() * len(domains), 2)

    def told(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    logit = lambda seen, of: F.log((seen + smoothing * F.col("n") / total) / (of - seen + smoothing * (1 - F.col("n") / total)))
    ratios, odds = [], []
    for i, d in enumerate(domains):
        inside, rest, share = F.col(f"n{i}"), total - sizes[d], sizes[d] / total
        outside = F.col("n") - inside
        cells = [(inside, F.col("n") * share), (outside, F.col("n") * (1 - share))]
        cells += [(sizes[d] - inside, (total - F.col("n")) * share), (rest - outside, (total - F.col("n")) * (1 - share))]
        strong = F.abs(logit(inside, sizes[d]) - logit(outside, rest)) >= min_odds
        ratios.append(F.when(strong, 2 * reduce(lambda x, y: x + y, [told(a, b) for a, b in cells])).otherwise(0.0))
        odds.append((inside + smoothing * F.col("n") / total) / (sizes[d] + smoothing))
    ratio = F.round(F.greatest(F.lit(0.0), *ratios), 6)
    model = counts.withColumn("ratio", ratio).where(F.col("ratio") > 2 * math.log(tests)).orderBy(F.desc("ratio"), "word").limit(max_words)
    unit = lambda x: F.round(x * UNIT).cast("long")
    model = model.select("word", *[unit(F.log(p / (1 - p))).alias(f"w{i}") for i, p in enumerate(odds)], *[unit(F.log(1 - p)).alias(f"without{i}") for i, p in enumerate(odds)])
    model = scratch.table(model, "words")
    base = model.agg(*[F.coalesce(F.sum(f"without{i}"), F.lit(0)).alias(f"b{i}") for i in range(len(domains))]).first()
    return domains, [math.log(sizes[d] / total) + base[i] / UNIT for i, d in enumerate(domains)], model.select("word", *[f"w{i}" for i in range(len(domains))])


def posteriors(docs: DataFrame, base: list[float], model: DataFrame) -> DataFrame:
    """(doc_id, tokens, p0, p1, ...) for every row; ``base`` holds the log-odds of a text without any of the words."""
    k = range(len(base))
    bags = docs.select("doc_id", tokens(F.col("text")).alias("words"))
    flat = bags.select("doc_id", F.size("words").cast("long").alias("tokens"), F.explode_outer(F.array_distinct("words")).alias("word"))
    flat = flat.join(F.broadcast(model), "word", "left")  # at most max_words rows
    sums = flat.groupBy("doc_id").agg(F.max("tokens").alias("tokens"), *[F.coalesce(F.sum(f"w{i}"), F.lit(0)).alias(f"s{i}") for i in k])
    sums = sums.select("doc_id", "tokens", *[(F.col(f"s{i}") / F.lit(float(UNIT)) + F.lit(base[i])).alias(f"l{i}") for i in k])
    top = F.greatest(*[F.col(f"l{i}") for i in k]) if len(base) > 1 else F.col("l0")
    odds = sums.select("doc_id", "tokens", *[F.exp(F.col(f"l{i}") - top).alias(f"e{i}") for i in k])
    norm = reduce(lambda x, y: x + y, [F.col(f"e{i}") for i in k])
    return odds.select("doc_id", "tokens", *[F.round(F.col(f"e{i}") / norm, DIGITS).alias(f"p{i}") for i in k])


def _rounded(x: Column) -> Column:
    """Exact partial sums, in whole ten-thousandths: they don't depend on the order of rows."""
    return F.sum(F.round(x * SHARE_UNIT).cast("long")) / F.lit(float(SHARE_UNIT))


def rate_after(moves: list[list[float]], max_rate: float | None, start: Column | None = None) -> Column:
    """Rate of a document (columns p0, p1, ...) after these steps from rate 1 or ``start``."""
    rate = F.lit(1.0) if start is None else start
    for move in moves:
        shift = reduce(lambda x, y: x + y, [F.col(f"p{i}") * F.lit(m) for i, m in enumerate(move)])
        rate = F.greatest(rate - shift, F.lit(0.0))
        rate = rate if max_rate is None else F.least(rate, F.lit(float(max_rate)))
    return rate


def _solved(hess: list[list[float]], residual: list[float]) -> list[float]:
    """The step that would clear the residuals if no further rate met a bound; rows are domains."""
    h = np.array(hess)
    return np.linalg.lstsq(h + 1e-9 * np.trace(h) * np.eye(len(h)), np.array(residual), rcond=None)[0].tolist()


def nonnegative(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """x >= 0 of least |a x - b|, by an active set; a few columns."""
    x, used = np.zeros(a.shape[1]), []
    for _ in range(10 * a.shape[1]):
        pull = a.T @ (b - a @ x)
        pull[used] = 0
        if not len(pull) or pull.max() <= 1e-14:
            break
        used = [*used, int(pull.argmax())]
        while used:
            z = np.zeros(len(x))
            z[used] = np.linalg.lstsq(a[:, used], b, rcond=None)[0]
            if z[used].min() > 0:
                x = z
                break
            back = min(x[j] / (x[j] - z[j]) for j in used if z[j] <= 0)
            x = x + back * (z - x)
            used = [j for j in used if x[j] > 1e-15]
            x[[j for j in range(len(x)) if j not in used]] = 0
    return x


def best_totals(points: DataFrame, targets: list[float], weights: list[float] | None = None) -> tuple[list[float], list[float]]:
    """Totals next to the targets that rates >= 0 can reach, and the price of each domain there.

    The distance is that of :func:`fit_moves`.  A round solves for a few posteriors on the driver, then asks all points for the one of the lowest price,
    sum of price * posterior: one row.  If none is negative, no rates do better; points of positive price can't have any rate.
    """
    k = range(len(targets))
    first = points.agg(F.sum("tokens").alias("all"), *[_rounded(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{i}")).alias(f"h{i}") for i in k]).first()
    total = float(first["all"] or 0)
    if not total:
        return [0.0] * len(targets), [0.0] * len(targets)
    scale = np.sqrt([(weights[i] if weights else 1.0) / max((first[f"h{i}"] or 0.0) / total, 1e-9) for i in k])
    goal = scale * np.array(targets) / total
    columns, rates = np.zeros((len(targets), 0)), np.zeros(0)
    while True:
        price = scale * (columns @ rates - goal)
        price[np.abs(price) < 1e-12 * np.abs(scale * goal).max(initial=1e-300)] = 0
        names = [f"p{i}" for i in k]
        dot = reduce(lambda x, y: x + y, [F.col(n) * F.lit(float(x)) for n, x in zip(names, price, strict=True)])
        low = points.where("tokens > 0").agg(F.min(F.struct(dot.alias("dot"), *names)).alias("low")).first()["low"]
        new = scale * np.array([low[n] for n in names])
        if low["dot"] >= -1e-10 * np.abs(price).max() or (columns == new[:, None]).all(0).any():
            break
        columns = np.c_[columns[:, rates > 0], new]
        rates = nonnegative(columns, goal)
    return (columns @ rates / scale * total).tolist(), price.tolist()


def excluded(price: list[float]) -> Column:
    """Whether the best totals leave no rate to a document: its posterior has a positive price."""
    dot = reduce(lambda x, y: x + y, [F.col(f"p{i}") * F.lit(float(x)) for i, x in enumerate(price)])
    return dot > 1e-9 * max(map(abs, price))


def step_to(points: DataFrame, goal: list[float], total: float, tolerance: float = CLOSE, rounds: int = 60) -> tuple[list[float], list[float]]:
    """The one projected step from rate 1 that brings the expected totals to ``goal``, and what is left of each, as a share of ``total``.

    Of all rates that reach the goal those after this step, max(0, 1 - sum of step * posterior), are the nearest to 1 in squares weighted by tokens, so the step
    is found by Newton's method on its k numbers: a round takes the sums for several lengths of the next correction in one aggregation and keeps the best.
    """
    k = range(len(goal))
    grid = [(i, j) for i in k for j in k if i <= j]
    names = [*[f"p{i}" for i in k], "tokens"]

    def tried(steps: list[list[float]]) -> list[tuple[float, np.ndarray, np.ndarray]]:
        """Dual objective, totals and the Hessian over positive rates after each step."""
        rows = points.select(*names, *[rate_after([step], None).alias(f"r{at}") for at, step in enumerate(steps)])
        sums = []
        for at in range(len(steps)):
            rate = F.col(f"r{at}")
            sums.append(F.sum(rate * rate * F.col("tokens")).alias(f"d{at}"))
            sums += [_rounded(rate * F.col("tokens") * F.col(f"p{i}")).alias(f"t{at}_{i}") for i in k]
            sums += [_rounded(F.when(rate > 0, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)).alias(f"h{at}_{i}_{j}") for i, j in grid]
        got = rows.agg(*sums).first()
        out = []
        for at, step in enumerate(steps):
            expected = np.array([got[f"t{at}_{i}"] or 0.0 for i in k]) / total
            hess = np.array([[(got[f"h{at}_{min(i, j)}_{max(i, j)}"] or 0.0) / total for j in k] for i in k])
            out.append(((got[f"d{at}"] or 0.0) / total / 2 + float(np.dot(step, goal)) / total, expected, hess))
        return out

    step, want = [0.0] * len(goal), np.array(goal) / total
    cost, expected, hess = tried([step])[0]
    for _ in range(rounds):
        off = expected - want
        if np.abs(off).max() < tolerance:
            break
        scale = np.sqrt(np.maximum(np.diag(hess), 1e-300))
        inner = hess / np.outer(scale, scale) + 1e-12 * np.eye(len(goal))
        towards = np.linalg.lstsq(inner, off / scale, rcond=None)[0] / scale
        options = [[float(x + m * d) for x, d in zip(step, towards, strict=True)] for m in (1, 0.5, 0.25, 1 / 16, 1 / 256)]
        results = tried(options)
        close = [i for i, x in enumerate(results) if np.abs(x[1] - want).max() < tolerance]
        best = close[0] if close else min(range(len(options)), key=lambda i: (results[i][0], i))
        if not close and results[best][0] >= cost:
            break
        step, (cost, expected, hess) = options[best], results[best]
    return step, (expected - want).tolist()


def fit_moves(points: DataFrame, targets: list[float], *, max_rate: float | None, rounds: int | None, tolerance: float, scratch: c.Scratch | None = None, weights: list[float] | None = None, stall: float | None = STALL) -> tuple[list[list[float]], list[float]]:
    """Steps of the descent, and the residual of each domain as a share of all tokens.

    ``points`` are (p0, p1, ..., tokens), summed over equal posteriors, for these move alike.  Minimises
    sum over domains of weight * (expected - target)^2 / h, h being the domain's sum of tokens * p^2, over
    0 <= rate <= max_rate, from rate 1, until every residual is below the tolerance or, where no rates reach the
    targets, the objective hardly falls any more (by less than ``stall``; None: not at all).  A round tries several projected steps in one aggregation and takes the
    best: the plain gradient (steps divide by a document's tokens; the size is one over the largest row sum of
    the scaled Hessian, so it never climbs), and the gradient scaled by the inverse Hessian of the
    rates that meet no bound.  One row of sums a round reaches the driver.
    """
    k = range(len(targets))
    grid = [(i, j) for i in k for j in k if i <= j]

    def tried(rows: DataFrame, steps: list[list[list[float]]]) -> list[tuple[list[float], list[list[float]]]]:
        """Expected tokens and the Hessian of unbound rates after each further step."""
        names = [*[f"p{i}" for i in k], "tokens"]
        rows = rows.select(*names, *[rate_after(step, max_rate, F.col("rate")).alias(f"r{at}") for at, step in enumerate(steps)])
        sums = []
        for at in range(len(steps)):
            rate = F.col(f"r{at}")
            loose = rate > 0 if max_rate is None else (rate > 0) & (rate < max_rate)
            sums += [_rounded(rate * F.col("tokens") * F.col(f"p{i}")).alias(f"t{at}_{i}") for i in k]
            sums += [_rounded(F.when(loose, F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).otherwise(0.0)).alias(f"h{at}_{i}_{j}") for i, j in grid]
        got = rows.agg(*sums).first()
        return [
            ([got[f"t{at}_{i}"] or 0.0 for i in k], [[(got[f"h{at}_{min(i, j)}_{max(i, j)}"] or 0.0) / total for j in k] for i in k])
            for at in range(len(steps))
        ]

    first = points.agg(F.sum("tokens").alias("all"), *[_rounded(F.col("tokens") * F.col(f"p{i}") * F.col(f"p{j}")).alias(f"h{i}_{j}") for i, j in grid]).first()
    total = float(first["all"] or 0) or 1.0
    whole = [[(first[f"h{min(i, j)}_{max(i, j)}"] or 0.0) / total for j in k] for i in k]
    scale = [max(whole[i][i], 1e-9) / (weights[i] if weights else 1.0) for i in k]
    safe = 1 / max(1e-9, *[sum(whole[i][j] / math.sqrt(scale[i] * scale[j]) for j in k) for i in k])
    off = lambda expected: [(x - t) / total for x, t in zip(expected, targets, strict=True)]
    cost = lambda residual: sum(r * r / h for r, h in zip(residual, scale, strict=True))
    points = points.withColumn("rate", F.lit(1.0))
    expected, hess = tried(points, [[]])[0]
    residual, moves, pending = off(expected), [], []
    costs = [cost(residual)]
    for _ in itertools.count() if rounds is None else range(rounds):
        if max(map(abs, residual)) < tolerance:
            break
        plain = [safe * r / h for r, h in zip(residual, scale, strict=True)]
        options = [[x * m for x in plain] for m in (1, 8)]
        options += [[x * m for x in _solved(h, residual)] for h in (hess, whole) for m in (1, 0.4)]
        results = tried(points.withColumn("rate", rate_after(pending, max_rate, F.col("rate"))), [[o] for o in options])
        best = min(range(len(options)), key=lambda i: (cost(off(results[i][0])), i))
        now = off(results[best][0])
        if cost(now) >= cost(residual):
            break
        log.debug("step %d: option %d, residuals %s", len(moves), best, now)
        moves.append(options[best])
        pending.append(options[best])
        residual, hess = now, results[best][1]
        costs.append(cost(now))
        if stall is not None and len(costs) > 2 and costs[-1] > costs[-3] * (1 - stall):
            break
        if scratch and len(pending) == STEPS:
            points, pending = scratch.table(points.withColumn("rate", rate_after(pending, max_rate, F.col("rate"))), "rates"), []
    return moves, residual


def mix_to_targets(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float],
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_id_col: str = "doc_id",
    domain_col: str = "domain",
    relative: bool = False,
    max_rate: float | None = None,
    weights: dict[str, float] | None = None,
    rounds: int | None = None,
    tolerance: float = 5e-4,
    max_labelled: int = 20_000,
    max_words: int = 50_000,
    min_docs: int = 2,
    min_odds: float = 2.0,
    smoothing: float = 1.0,
) -> DataFrame:
    """(doc_id, tokens, domain, posterior, rate, copies, residual, met) for every document.

    ``targets`` gives each domain its weight in the mixture's tokens (as many as there are now) or, if
    ``relative``, the factor on the domain's present expected tokens; domains without one get 0, or
    stay as they are.  Rates have no upper bound unless ``max_rate`` sets one; where
    not all targets can be met, domains of higher ``weights`` (1 by default) come closer to theirs.  ``posterior`` maps domains to
    probabilities, ``rate`` is the fitted number of uses, ``copies`` its draw: the whole part and one more
    with the chance of the rest, by a hash of the id.  ``residual`` maps each domain to its expected tokens less
    the target, as a share of all tokens, and ``met`` says whether all of these are below the tolerance: both are the
    same in every row, and targets out of reach are also logged as a warning.
    The classifier is fitted on about ``max_labelled`` labelled documents.  Null and empty texts have no
    tokens.  Without usable labels all documents keep rate 1, an empty posterior and residual, and
    ``met`` is false.  Repeated ids with different texts are judged as one bag of words; a null id is an id like
    others; a label's repeats count once; other columns are ignored.
    """
    scratch = c.Scratch(docs.sparkSession, "mixing")
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    known = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(domain_col).cast("string").alias("domain"))
    domains, base, model = fit_words(slim, known, scratch, max_labelled=max_labelled, max_words=max_words, min_docs=min_docs, min_odds=min_odds, smoothing=smoothing)
    if not domains:
        scratch.clear()
        log.warning("no labelled document: all rates stay 1")
        none = F.create_map().cast("map<string,double>")
        sizes = slim.select("doc_id", F.size(tokens(F.col("text"))).cast("long").alias("tokens")).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
        return sizes.select("*", F.lit(None).cast("string").alias("domain"), none.alias("posterior"), F.lit(1.0).alias("rate"), F.lit(1).alias("copies"), none.alias("residual"), F.lit(False).alias("met"))
    rows = scratch.table(posteriors(slim, base, model), "posteriors")
    now = rows.agg(F.sum("tokens").alias("all"), *[_rounded(F.col("tokens") * F.col(f"p{i}")).alias(f"t{i}") for i in range(len(domains))]).first()
    if relative:
        goals = [targets.get(d, 1.0) * (now[f"t{i}"] or 0.0) for i, d in enumerate(domains)]
    else:
        weight = sum(targets.get(d, 0.0) for d in domains) or 1.0
        goals = [targets.get(d, 0.0) / weight * float(now["all"] or 0) for d in domains]
    names = [f"p{i}" for i in range(len(domains))]
    points = scratch.table(rows.groupBy(*names).agg(F.sum("tokens").alias("tokens")), "points")
    by_domain = [(weights or {}).get(d, 1.0) for d in domains]
    price = [0.0] * len(domains)
    if max_rate is None:
        best, price = best_totals(points, goals, by_domain)
        free = points.where(~excluded(price))
        whole = float(now["all"] or 0) or 1.0
        step, left = step_to(free, best, whole)
        moves = [step]
        residual = [x + (b - g) / whole for x, b, g in zip(left, best, goals, strict=True)]
    else:
        moves, residual = fit_moves(points, goals, max_rate=max_rate, rounds=rounds, tolerance=tolerance, scratch=scratch, weights=by_domain)
    met = max(map(abs, residual)) < tolerance
    log.log(logging.INFO if met else logging.WARNING, "after %d steps, expected less target as a share of all tokens: %s", len(moves), dict(zip(domains, residual, strict=True)))
    rated = rows.withColumn("rate", F.lit(1.0))
    for at in range(0, len(moves), STEPS):
        rated = rated.withColumn("rate", rate_after(moves[at : at + STEPS], max_rate, F.col("rate")))
        rated = scratch.table(rated, "rated") if at + STEPS < len(moves) else rated
    rated = rated.withColumn("rate", F.when(excluded(price), 0.0).otherwise(F.round("rate", 6)))
    best = F.greatest(*[F.col(f"p{i}") for i in range(len(domains))]) if len(domains) > 1 else F.col("p0")
    named = F.coalesce(*[F.when(F.col(f"p{i}") == best, F.lit(d)) for i, d in enumerate(domains)])
    posterior = F.create_map(*[x for i, d in enumerate(domains) for x in (F.lit(d), F.col(f"p{i}"))])
    copies = F.floor("rate") + (fraction_of(F.col("doc_id"), "copies") < F.col("rate") - F.floor("rate")).cast("int")
    left = F.create_map(*[x for d, r in zip(domains, residual, strict=True) for x in (F.lit(d), F.lit(round(r, 9)))])
    out = rated.select("doc_id", "tokens", named.alias("domain"), posterior.alias("posterior"), "rate", copies.cast("int").alias("copies"), left.alias("residual"), F.lit(met).alias("met"))
    out = scratch.table(out, "result", keep=True)
    scratch.clear()
    return out


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from 0/1 columns ``quality`` and ``toxic``; toxic comes first."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "good")
    return labels.select("doc_id", domain.alias("domain"))
