"""Column factories: money, time, obligations, laws and scores.

Everything here is a plain column expression, so it stays inside generated code and can be
pushed down or folded.  Money is in whole minor units; time is hours since 1995-01-01 UTC.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH_MICROS = 788_918_400_000_000
SINK = "external_sink"
# Periods of a recurrence in hours, edges of hit-time buckets, rates of action costs.
PERIODS = (("daily", 24), ("weekly", 168), ("biweekly", 336), ("monthly", 720), ("quarterly", 2184))
HIT_EDGES = (0, 6, 12, 24, 48, 72, 120, 168)
CREDIT_RATE, ACCELERATION_RATE, EXTENSION_RATE, RESTRUCTURE_RATE = 0.6, 0.0005, 0.0004, 0.01


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


# money and time
def hours(ts: Column | str) -> Column:
    return (F.unix_micros(col(ts).cast("timestamp")) - EPOCH_MICROS) / F.lit(3.6e9)


def to_minor(major: Column | str) -> Column:
    """Half-even, as money is stored."""
    return F.bround(col(major) * 100, 0).cast("long")


def to_major(minor: Column | str) -> Column:
    return col(minor) / F.lit(100.0)


def scaled_money(amount: Column | str, currency: Column | str, whole_currencies: tuple[str, ...] = ("JPY", "KRW", "HUF", "TWD")) -> Column:
    """Decimal amount at its currency's scale, half-even."""
    x = col(amount).cast("decimal(28,6)")
    return F.when(col(currency).isin(*whole_currencies), F.bround(x, 0)).otherwise(F.bround(x, 2)).cast("decimal(24,2)")


def compact_money(x: Column | str) -> Column:
    """1.23K, 4.56M, 7.89B, else two decimals."""
    v = col(x)
    a = F.abs(v)
    part = lambda d, s: F.concat(F.format_string("%.2f", v / F.lit(d)), F.lit(s))
    return F.when(a >= 1e9, part(1e9, "B")).when(a >= 1e6, part(1e6, "M")).when(a >= 1e3, part(1e3, "K")).otherwise(F.format_string("%.2f", v))


# obligations
def outstanding(amount: Column | str = "amount_minor", paid: Column | str = "paid_minor") -> Column:
    return F.greatest(col(amount) - col(paid), F.lit(0))


def is_open(amount: Column | str = "amount_minor", paid: Column | str = "paid_minor") -> Column:
    return outstanding(amount, paid) > 0


def is_overdue(at: float | Column, due: Column | str = "due_t") -> Column:
    return is_open() & (col(due) < at)


def is_defaulted(at: float | Column, grace: float = 48.0, due: Column | str = "due_t") -> Column:
    return is_open() & (col(due) + grace < at)


def status(at: float | Column, grace: float = 48.0) -> Column:
    """Cancelled and restructured stick; else by payment and due time."""
    sticky = F.col("status").isin("cancelled", "restructured")
    return (
        F.when(sticky, F.col("status"))
        .when(~is_open() & (F.col("settled_t") <= F.col("due_t")), "settled")
        .when(~is_open(), "settled_late")
        .when(is_defaulted(at, grace), "defaulted")
        .when(F.col("paid_minor") > 0, "partial")
        .otherwise("pending")
    )


def off_network(payer: Column | str, payee: Column | str) -> Column:
    return (col(payer) == SINK) | (col(payee) == SINK)


def observed(origin: float, lookback: float | None = None, t: Column | str = "t") -> Column:
    """The one temporal cut: origin - lookback <= t < origin."""
    before = col(t) < origin
    return before if lookback is None else before & (col(t) >= origin - lookback)


# balance sheet
def buffer(balance: Column | str, credit: Column | str, floor: Column | str) -> Column:
    return col(balance) + col(credit) - col(floor)


def deficit(buffer_: Column | str) -> Column:
    return F.greatest(-col(buffer_), F.lit(0))


def cover_ratio(buffer_: Column | str, receivable: Column | str, payable: Column | str) -> Column:
    """Null where nothing is payable."""
    return F.when(col(payable) > 0, (col(buffer_) + col(receivable)) / col(payable))


def autonomy_hours(buffer_: Column | str, burn: Column | str) -> Column:
    """Hours until the buffer is burnt; null (never) for no net burn."""
    return F.when(col(burn) > 0, F.greatest(col(buffer_), F.lit(0)) / col(burn))


# scalar laws
def log0(x: Column | str) -> Column:
    return F.log1p(F.greatest(col(x), F.lit(0.0)))


def bounded_ratio(n: Column | str, d: Column | str, cap: float) -> Column:
    return F.least(F.greatest(col(n), F.lit(0.0)) / F.greatest(col(d), F.lit(1.0)), F.lit(float(cap)))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high)))


def logistic(x: Column | str, limit: float = 50.0) -> Column:
    return 1 / (1 + F.exp(-clip(col(x), -limit, limit)))


def logit(p: Column | str, eps: float = 1e-6) -> Column:
    q = clip(col(p), eps, 1 - eps)
    return F.log(q / (1 - q))


def lateness(delay: Column | str, unit: float = 24.0) -> Column:
    return F.greatest(col(delay), F.lit(0.0)) / F.lit(unit)


def discount(t: Column | str, rate: float) -> Column:
    return F.exp(-F.lit(rate) * col(t))


def lognormal_mean(mu: Column | str, sigma: Column | str, floor: Column | str | float = 0.0) -> Column:
    return col(floor) + F.exp(col(mu) + col(sigma) * col(sigma) / 2)


def lognormal_median(mu: Column | str, floor: Column | str | float = 0.0) -> Column:
    return col(floor) + F.exp(col(mu))


def lognormal_variance(mu: Column | str, sigma: Column | str) -> Column:
    s2 = col(sigma) * col(sigma)
    return (F.exp(s2) - 1) * F.exp(2 * col(mu) + s2)


def lognormal_from_mean_cv(mean: Column | str, cv: Column | str) -> tuple[Column, Column]:
    s2 = F.log1p(col(cv) * col(cv))
    return F.log(col(mean)) - s2 / 2, F.sqrt(s2)


def normal_cdf(z: Column | str) -> Column:
    """Standard normal distribution function, error below 7.5e-8 (Abramowitz and Stegun 26.2.17)."""
    x = F.abs(col(z))
    k = 1 / (1 + 0.2316419 * x)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    tail = F.exp(-x * x / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(col(z) >= 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column | str) -> Column:
    """Its inverse, error below 4.5e-4 (Abramowitz and Stegun 26.2.23)."""
    q = F.least(col(p), 1 - col(p))
    u = F.sqrt(-2 * F.log(q))
    z = u - (2.515517 + u * (0.802853 + u * 0.010328)) / (1 + u * (1.432788 + u * (0.189269 + u * 0.001308)))
    return F.when(col(p) >= 0.5, z).otherwise(-z)


def lognormal_cdf(x: Column | str, mu: Column | str, sigma: Column | str, floor: Column | str | float = 0.0) -> Column:
    u = col(x) - col(floor)
    return F.when(u > 0, normal_cdf((F.log(u) - col(mu)) / col(sigma))).otherwise(F.lit(0.0))


def spread_cdf(probability: Column | str, tau: Column | str, end: Column | str | float, log_sigma: Column | str | float) -> Column:
    """Chance of an event by ``end`` from its chance at all and its predicted time: log-normal around that time, 0 where there is none."""
    late = F.log(F.greatest(col(end), F.lit(1e-9))) - F.log(F.greatest(col(tau), F.lit(1e-9)))
    return F.coalesce(col(probability) * normal_cdf(late / F.greatest(col(log_sigma), F.lit(1e-3))), F.lit(0.0))


def lognormal_quantile(p: Column | str, mu: Column | str, sigma: Column | str, floor: Column | str | float = 0.0, cap: float = math.inf) -> Column:
    return F.least(col(floor) + F.exp(col(mu) + col(sigma) * normal_quantile(p)), F.lit(cap))


def hawkes_kernel(u: Column | str, alpha: Column | str, beta: Column | str) -> Column:
    return F.when(col(u) >= 0, col(alpha) * col(beta) * F.exp(-col(beta) * col(u))).otherwise(0.0)


def seasonality(t: Column | str, weekly: float = 0.3, monthly: float = 0.2) -> Column:
    angle = lambda period: 2 * math.pi * col(t) / period
    return F.greatest(1 + weekly * F.sin(angle(168.0)) + monthly * F.sin(angle(720.0)), F.lit(0.05))


def shock_mass(t0: Column, t1: Column, onset: Column, duration: Column, magnitude: Column) -> Column:
    """Share of a shock that falls in [t0, t1): all of an impulse, or by overlap."""
    impulse = F.when((onset >= t0) & (onset < t1), magnitude).otherwise(0.0)
    overlap = F.greatest(F.least(t1, onset + duration) - F.greatest(t0, onset), F.lit(0.0))
    return F.when(duration <= 0, impulse).otherwise(magnitude * overlap / F.nullif(duration, F.lit(0.0)))


def action_cost(kind: Column | str, amount: Column | str, shift_hours: Column | str) -> Column:
    days = col(shift_hours) / 24
    return (
        F.when(col(kind) == "injection", col(amount))
        .when(col(kind) == "credit_line", CREDIT_RATE * col(amount))
        .when(col(kind) == "acceleration", ACCELERATION_RATE * days * col(amount))
        .when(col(kind) == "extension", EXTENSION_RATE * days * col(amount))
        .when(col(kind) == "restructure", RESTRUCTURE_RATE * col(amount))
    )


def action_duration(kind: Column | str, shift_hours: Column | str, horizon: float) -> Column:
    return F.when(col(kind).isin("acceleration", "extension"), col(shift_hours)).when(col(kind) == "restructure", F.lit(672.0)).otherwise(F.lit(horizon))


def recurrence(median_gap: Column | str, tolerance: float = 0.3) -> Column:
    out = F.when(col(median_gap).isNull(), "one_off")
    for name, period in PERIODS:
        out = out.when(F.abs(col(median_gap) - period) <= tolerance * period, name)
    return out.otherwise("irregular")


# keyed randomness
def uniform(*keys: Column | str) -> Column:
    """A number in [0, 1) that depends on the keys alone, the same in any order of work."""
    digest = F.sha2(F.concat_ws("|", *[col(k) if isinstance(k, str) else k for k in keys]), 256)
    return F.conv(F.substring(digest, 9, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def content_id(*parts: Column | str, length: int = 16) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[col(p) for p in parts]), 256), 1, length)


def request_verdict(known: Column | str, n_origins: Column | str, multiple: Column | str, onset: Column | str, *, most: int = 5, low: float = 0.5, high: float = 4.0, horizon: float = 168.0) -> Column:
    """First bound of an on-demand analysis that a request breaks, or ``ok``."""
    return (
        F.when(~F.coalesce(col(known), F.lit(False)), "unknown_merchant")
        .when(col(n_origins) > most, "too_many")
        .when(~col(multiple).between(low, high), "multiple")
        .when((col(onset) < 0) | (col(onset) >= horizon), "onset")
        .otherwise("ok")
    )
