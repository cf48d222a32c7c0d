"""Column expressions on numbers: missing values, ratios, clips, bins, entropies, dates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def known(c: Column | str) -> Column:
    """The number, or null for NaN: inside the engine missing is always null."""
    return F.nanvl(col(c).cast("double"), F.lit(None).cast("double"))


def number(c: Column | str) -> Column:
    """Text to a number; null where it is none (or NaN)."""
    return F.nanvl(col(c).try_cast("double"), F.lit(None).cast("double"))


def finite(c: Column | str, most: float = 3.4028234663852886e38) -> Column:
    """Null for NaN and infinities, and clipped to the range of a 32-bit float."""
    x = known(c)
    return F.when(F.abs(x) == float("inf"), F.lit(None)).otherwise(clip(x, -most, most))


def clip(c: Column | str, low, high) -> Column:
    """Null stays null (least and greatest alone would skip it)."""
    x = col(c)
    return F.when(x.isNotNull(), F.greatest(F.least(x, col(high) if isinstance(high, str | Column) else F.lit(high)), col(low) if isinstance(low, str | Column) else F.lit(low)))


def ratio(a: Column | str, b: Column | str, guard: float = 1e-9) -> Column:
    """a / (b + guard)."""
    return col(a) / (col(b) + F.lit(guard))


def day_difference(later: Column | str, earlier: Column | str, low: int = 0, high: int = 365) -> Column:
    """Whole days between two timestamps, rounded down (so earlier on the same day is -1), then clipped."""
    seconds = F.unix_timestamp(col(later).cast("timestamp")) - F.unix_timestamp(col(earlier).cast("timestamp"))
    return clip(F.floor(seconds / 86400), low, high)


def right_closed_bin(c: Column | str, edges: Sequence[float], labels: Sequence) -> Column:
    """The label of the interval (edge, next edge] that the value is in; null outside."""
    x, out = col(c), None
    for low, high, label in zip(edges, edges[1:], labels, strict=False):
        inside = (x > low) & (x <= high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def entropy(p: Column | str) -> Column:
    """Shannon entropy (nats) of a two-class probability."""
    x = clip(p, 1e-9, 1 - 1e-9)
    return -(x * F.log(x) + (1 - x) * F.log(1 - x))


def ramp(step: Column | str, total: float, steepness: float = 10.0) -> Column:
    """2 / (1 + exp(-k t)) - 1: the weight of an adversarial loss after a share t of the steps."""
    return F.lit(2.0) / (F.lit(1.0) + F.exp(-F.lit(steepness) * col(step) / F.lit(float(total)))) - F.lit(1.0)


def log_yield(n: Column | str, of: Column | str) -> Column:
    """log(1 + n) / log(1 + N)."""
    return F.try_divide(F.log1p(col(n)), F.log1p(col(of)))


def correlation(a: Column | str, b: Column | str) -> Column:
    """Pearson's correlation as an aggregate; null where either doesn't vary (the built-in one raises an error then)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
