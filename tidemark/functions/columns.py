"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Scales a median absolute deviation to a standard deviation of a normal distribution.
MAD_SCALE = 1.4826


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch of a timestamp, with or without zone, whatever the session's zone."""
    name = ts if isinstance(ts, str) else ts._jc.toString()
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})")


def rounded(x: Column, digits: int = 6) -> Column:
    """Rounded, without a negative zero.  A small part of the last digit is added first, so that decimal
    values half way between two results don't depend on their last bit."""
    return F.round(x + F.lit(3.1 * 10.0 ** -(digits + 3)), digits) + F.lit(0.0)


def half_up(x: Column, digits: int) -> Column:
    """x to so many digits as binary arithmetic has it: scaled, rounded half away from zero, scaled back.

    ``round`` looks at the shortest decimal that stands for x, so that halves that only arithmetic makes fall otherwise.
    """
    scale = F.lit(10.0**digits)
    return F.round(x * scale, 0) / scale


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x within lo and hi; null stays null (least and greatest pass nulls by)."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def fold_sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def median(xs: Column) -> Column:
    """Median of an array of doubles, null if it is empty."""
    s = F.array_sort(xs)
    n = F.size(xs)
    return F.when(n > 0, (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2)


def deviations(xs: Column, centre: Column) -> Column:
    return F.transform(xs, lambda x: F.abs(x - centre))


def entity_id(site: Column, device: Column, role: Column, labels: Column) -> Column:
    """``site:device:role[:sub]``; sub is the first label present of interface, tunnel and peer."""
    sub = F.coalesce(*(F.nullif(F.try_element_at(labels, F.lit(k)), F.lit("")) for k in ("interface", "tunnel", "peer")))
    return F.concat_ws(":", site, device, role, sub)


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def normal_cdf(z: Column) -> Column:
    """Standard normal distribution function, by the complementary error function's Chebyshev fit (error below 1.2e-7)."""
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1 / (1 + 0.5 * x)
    # Coefficients of the fit, constant term first.
    terms = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
    poly: Column = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = F.lit(c) + t * poly
    tail = 0.5 * t * F.exp(-x * x + poly)
    return F.when(z >= 0, 1 - tail).otherwise(tail)


def quantile(x: Column | str, q: float, accuracy: int | None = None) -> Column:
    """Aggregate: the quantile of a group, linear between values.

    Exact, it keeps a count of each distinct value of the group.  For groups whose values may not fit
    into memory give ``accuracy``: the rank is then off by one part in so many, in bounded memory.
    """
    return F.percentile(x, F.lit(q)) if accuracy is None else F.percentile_approx(x, q, accuracy).cast("double")
