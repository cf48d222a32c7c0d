"""Ranks, running sums and quantiles in which no task sees all values of a column.

Rows are counted per value first. The values are then parted into ranges of like size (their edges come from a small
approximate aggregate and only decide who works on what), each range is summed up by itself, and what lies before a range
is a running sum over the ranges, of which there are few.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: values of a range, about, and ranges at most
VALUES, RANGES = 100_000, 1000


def range_of(df: DataFrame, value: Column) -> Column:
    """The number of the range that a value lies in; 0 for null. There is a range for every VALUES rows of ``df``, up to
    RANGES; their edges are approximate quantiles."""
    levels = [i / RANGES for i in range(1, RANGES)]
    n, found = df.agg(F.count(value), F.percentile_approx(value, levels, 10 * RANGES)).first()
    ranges = min(RANGES, -(-n // VALUES))
    if ranges < 2:
        return F.lit(0)
    edges = sorted({found[round(i * RANGES / ranges) - 1] for i in range(1, ranges)})
    if len(edges) < 32:
        return sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))
    return F.coalesce(F.size(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: value > e)), F.lit(0))


def running(counts: DataFrame, by: Sequence[str], value: str, sums: Sequence[str], descending: bool = False) -> DataFrame:
    """``counts`` with ``<c>_upto`` for each c of ``sums``, its running sum in the order of ``value`` within ``by``, and
    ``<c>_all``, its sum. Values differ within ``by`` (see ``counted``)."""
    part = range_of(counts, F.col(value))
    placed = counts.withColumn("_part", -part if descending else part)
    up = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy(*by, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])  # a row for each range
    every = Window.partitionBy(*by)
    before = [F.coalesce(F.sum(f"_s_{c}").over(up), F.lit(0)).alias(f"_b_{c}") for c in sums]
    per = per.select(*[F.col(k).alias(f"_k_{k}") for k in by], F.col("_part").alias("_q"), *before, *[F.sum(f"_s_{c}").over(every).alias(f"{c}_all") for c in sums])
    same = F.col("_part") == F.col("_q")
    for k in by:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = placed.join(per if by else F.broadcast(per), same)
    own = Window.partitionBy(*by, "_part").orderBy(F.col(value).desc() if descending else F.col(value)).rowsBetween(Window.unboundedPreceding, 0)
    return both.select(*counts.columns, *[(F.col(f"_b_{c}") + F.sum(c).over(own)).alias(f"{c}_upto") for c in sums], *[f"{c}_all" for c in sums])


def counted(values: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """``by, value, n``: each distinct value once."""
    return values.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def quantiles(values: DataFrame, by: Sequence[str], levels: Sequence[float], value: str = "value") -> DataFrame:
    """``by, level, value``: exact quantiles with linear interpolation; nulls are skipped."""
    c = running(counted(values.where(F.col(value).isNotNull()), by, value), by, value, ["n"])
    first, last = F.col("n_upto") - F.col("n"), F.col("n_upto") - 1
    spots = F.transform(F.array(*[F.lit(float(q)) for q in levels]), lambda q: F.struct(q.alias("level"), ((F.col("n_all") - 1) * q).alias("h")))
    here = F.filter(spots, lambda x: F.floor(x["h"]).between(first, last) | F.ceil(x["h"]).between(first, last))
    hits = c.select(*by, F.col(value).alias("_v"), first.alias("_a"), last.alias("_z"), F.explode(here).alias("_x"))
    low, high, h = F.floor("_x.h"), F.ceil("_x.h"), F.col("_x.h")
    ends = hits.groupBy(*by, F.col("_x.level").alias("level")).agg(
        F.max(F.when(low.between(F.col("_a"), F.col("_z")), F.col("_v"))).alias("_low"), F.max(F.when(high.between(F.col("_a"), F.col("_z")), F.col("_v"))).alias("_high"), F.max(h).alias("_h")
    )
    share = F.col("_h") - F.floor("_h")
    mixed = F.when(share == 0, F.col("_low").cast("double")).otherwise((1 - share) * F.col("_low") + share * F.col("_high"))
    return ends.select(*by, "level", mixed.alias(value))


def quantile_arrays(values: DataFrame, by: Sequence[str], levels: Sequence[float], name: str) -> DataFrame:
    """``by, name``: the quantiles of each group as an array in the order of ``levels`` (ascending)."""
    each = quantiles(values, by, levels)
    return each.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("level", "value"))), lambda x: x["value"]).alias(name))


def median(df: DataFrame, value: str | Column, by: Sequence[str] = (), name: str = "_m") -> DataFrame:
    """``by, name``: the median of each group; a group without values has no row."""
    value = F.col(value) if isinstance(value, str) else value
    return quantiles(df.select(*by, value.cast("double").alias("value")), list(by), [0.5]).select(*by, F.col("value").alias(name))


def positions(df: DataFrame, order: Sequence[str | Column], name: str = "position") -> DataFrame:
    """``df`` with each row's place from 0 in ``order``. Ranges are those of the first of ``order``, which is
    a column or an expression, ascending, and should vary."""
    first = F.col(order[0]) if isinstance(order[0], str) else order[0]
    placed = df.withColumn("_part", range_of(df, first))
    up = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    per = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(F.col("_part").alias("_q"), F.coalesce(F.sum("_n").over(up), F.lit(0)).alias("_before"))
    both = placed.join(F.broadcast(per), F.col("_part") == F.col("_q"))  # a row for each range
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return both.withColumn(name, place).drop("_part", "_q", "_before")
