"""What columns and tables are like: counts, quantiles, histograms, thresholds, quality gates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.numeric import known
from lakeweave.functions.text import is_cryptic_name
from lakeweave.operators import order

DECILES = tuple(i / 10 for i in range(1, 10))


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """``column, n_rows, n_values, n_distinct`` of each column, in one pass; NaN counts as missing.

    Exact distinct counts of several columns would expand the rows once for each; they are gathered per column in
    long form instead, so the aggregation is combined before it moves.
    """
    columns = list(columns or df.columns)
    text = {c: F.col(c).cast("string") for c in columns}
    numeric = {c for c, kind in df.dtypes if kind in ("double", "float")}
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.when(~F.isnan(c), text[c]).alias("v") if c in numeric else text[c].alias("v")) for c in columns])
    long = df.select(F.explode(pairs).alias("p")).groupBy("p.column", "p.v").agg(F.count(F.lit(1)).alias("n"))
    some = F.col("v").isNotNull()
    return long.groupBy("column").agg(F.sum("n").alias("n_rows"), F.coalesce(F.sum(F.when(some, F.col("n"))), F.lit(0)).alias("n_values"), F.count("v").alias("n_distinct"))


def prune_columns(df: DataFrame, least_values: float = 0.7) -> DataFrame:
    """Without all-null, constant and sparse columns (less than ``least_values`` of the rows have a value)."""
    rows = column_profile(df).collect()  # one row per column
    keep = {r["column"] for r in rows if r["n_distinct"] > 1 and r["n_values"] >= least_values * r["n_rows"]}
    return df.select(*[c for c in df.columns if c in keep])


def top_values(df: DataFrame, column: str, k: int = 3) -> DataFrame:
    """The ``k`` most frequent values with their counts and rank; ties in order of the value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    top = counts.orderBy(F.col("n").desc(), "value").limit(k)  # k rows; ranking them costs nothing
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("n").desc(), "value")).cast("long"))


def quantiles(df: DataFrame, columns: Sequence[str], levels: Sequence[float] = DECILES, by: Sequence[str] = ()) -> DataFrame:
    """``column, level, value`` (and the keys ``by``): exact quantiles with linear interpolation, nulls and NaN skipped."""
    return order.quantiles(long_numbers(df, columns, by), [*by, "column"], levels).select(*by, "column", "value", "level")


def long_numbers(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``column, value`` (and ``by``), a row for each number; nulls and NaN have none."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), known(c).alias("value")) for c in columns])
    return df.select(*by, F.explode(pairs).alias("p")).select(*by, "p.column", "p.value").where("value is not null")


def histogram(values: DataFrame, by: Sequence[str] = ("column",), most_bins: int = 256) -> DataFrame:
    """``by, bin, n, total, low, width, bins``: equal bins from the minimum to the maximum, the last one closed.

    As many bins as distinct values, ``most_bins`` at most. ``total`` is the sum of the values in the bin.
    """
    counts = order.counted(values, by)  # equal values are one row before anything moves
    stats = counts.groupBy(*by).agg(F.min("value").alias("low"), F.max("value").alias("high"), F.sum("n").alias("rows"), F.count("value").alias("distinct"))
    stats = stats.withColumn("bins", F.least(F.lit(most_bins), F.col("distinct"))).withColumn("width", (F.col("high") - F.col("low")) / F.col("bins"))
    placed = counts.join(stats, list(by))
    at = F.when(F.col("width") > 0, F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.col("bins") - 1)).otherwise(F.lit(0))
    return placed.withColumn("bin", at.cast("long")).groupBy(*by, "bin", "low", "width", "bins", "rows", "distinct").agg(F.sum("n").alias("n"))


def otsu(values: DataFrame, by: Sequence[str] = ("column",), most_bins: int = 256, least_rows: int = 10) -> DataFrame:
    """``by, threshold, method``: the bin centre that parts the values best (largest w0 w1 (m0 - m1)^2, first of equals).

    Columns with fewer than ``least_rows`` values get their median. Windows run over at most ``most_bins`` rows a column.
    """
    bins = histogram(values, by, most_bins)
    centre = F.col("low") + (F.col("bin") + 0.5) * F.col("width")
    up = Window.partitionBy(*by).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy(*by)
    b = bins.withColumn("centre", centre).withColumn("w0", F.sum("n").over(up)).withColumn("s0", F.sum(F.col("n") * F.col("centre")).over(up))
    b = b.withColumn("w1", F.sum("n").over(every) - F.col("w0")).withColumn("s1", F.sum(F.col("n") * F.col("centre")).over(every) - F.col("s0"))
    gap = F.col("s0") / F.col("w0") - F.col("s1") / F.col("w1")
    b = b.withColumn("between", F.when((F.col("w0") > 0) & (F.col("w1") > 0), F.round(F.col("w0") * F.col("w1") * gap * gap, 3)))
    best = b.where("between is not null").groupBy(*by).agg(F.min_by("centre", F.struct(-F.col("between"), F.col("bin"))).alias("cut"))
    medians = order.quantiles(values, by, [0.5]).select(*by, F.col("value").alias("median"))
    medians = medians.join(values.groupBy(*by).agg(F.count("value").alias("rows")), list(by))
    both = medians.join(best, list(by), "left")
    few = (F.col("rows") < least_rows) | F.col("cut").isNull()
    return both.select(*by, F.when(few, F.col("median")).otherwise(F.col("cut")).alias("threshold"), F.when(few, F.lit("median_fallback")).otherwise(F.lit("otsu")).alias("method"))


def table_stats(manifest: DataFrame) -> DataFrame:
    """One row about all tables of a manifest: number, and least, median, most and mean rows and columns."""
    out = [F.count(F.lit(1)).alias("n_tables"), F.sum("n_rows").cast("long").alias("total_rows")]
    for c, what in (("n_rows", "rows"), ("n_cols", "cols")):
        out += [F.min(c).cast("long").alias(f"min_{what}"), F.round(F.percentile(c, 0.5), 6).alias(f"median_{what}"), F.max(c).cast("long").alias(f"max_{what}"), F.round(F.avg(c), 6).alias(f"mean_{what}")]
    return manifest.agg(*out)


def quality_gate(manifest: DataFrame, rows: tuple[int, int] = (30, 10_000), cols: tuple[int, int] = (3, 50), numeric: float = 0.3) -> DataFrame:
    """Tables within the bounds on rows and columns, with enough numeric columns (``n_numeric``)."""
    return manifest.where(F.col("n_rows").between(*rows) & F.col("n_cols").between(*cols) & (F.col("n_numeric") / F.col("n_cols") >= numeric))


def readable_headers(columns: DataFrame, most_cryptic: float = 0.5) -> DataFrame:
    """``table_id, cryptic_share, readable`` from ``table_id, name``."""
    share = F.avg(is_cryptic_name("name").cast("double"))
    return columns.groupBy("table_id").agg(F.round(share, 6).alias("cryptic_share"), (share <= most_cryptic).alias("readable"))


def proxy_quality(values: DataFrame, by: Sequence[str] = ("column",), positive_rate: Column | None = None) -> DataFrame:
    """``by, quality``: the product of variety, spread and balance of a proxy column.

    Variety: distinct values over a fifth of the rows, 1 at most and for two values. Spread: std / |mean| over 0.5,
    1 at most. Balance: 1 - 2 max(0, |rate - 0.5| - 0.25), 0.1 at least, for the share of values above the median.
    """
    medians = order.quantiles(values, by, [0.5]).select(*by, F.col("value").alias("_m"))
    with_median = values.join(medians, list(by))
    rate = positive_rate if positive_rate is not None else F.avg((F.col("value") > F.col("_m")).cast("double"))
    stats = with_median.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("d"), F.stddev_samp("value").alias("std"), F.avg("value").alias("mean"), rate.alias("rate"))
    variety = F.when(F.col("d") <= 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col("d") / (0.2 * F.col("n"))))
    spread = F.least(F.lit(1.0), F.col("std") / (F.abs("mean") + 1e-9) / 0.5)
    balance = F.greatest(F.lit(0.1), 1 - 2 * F.greatest(F.lit(0.0), F.abs(F.col("rate") - 0.5) - 0.25))
    return stats.select(*by, F.round(variety * spread * balance, 6).alias("quality"), F.round("rate", 6).alias("rate"))


def row_coverage(df: DataFrame, columns: Sequence[str]) -> Column:
    """The share of non-null cells in ``columns`` over all rows (an aggregate)."""
    return F.avg(reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns]) / len(columns))
