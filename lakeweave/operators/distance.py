"""Distances between the distributions of columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.numeric import correlation
from lakeweave.operators import order
from lakeweave.operators.profile import DECILES


def ks_matrix(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left_column, right_column, ks``: the largest gap between the empirical distributions of each pair of columns.

    Both sides are ``column, value`` in long form. Each is first counted per value; a pair's steps are the values of
    both, and running sums of the counts give both distributions at each step. Nothing but counts meets.
    """
    a = left.groupBy(F.col("column").alias("left_column"), "value").agg(F.count(F.lit(1)).alias("n"))
    b = right.groupBy(F.col("column").alias("right_column"), "value").agg(F.count(F.lit(1)).alias("n"))
    names_a, names_b = a.select("left_column").distinct(), b.select("right_column").distinct()  # one row per column
    steps = a.join(F.broadcast(names_b)).select("left_column", "right_column", "value", F.col("n").alias("a"), F.lit(0).cast("long").alias("b"))
    steps = steps.unionByName(b.join(F.broadcast(names_a)).select("left_column", "right_column", "value", F.lit(0).cast("long").alias("a"), F.col("n").alias("b")))
    steps = steps.groupBy("left_column", "right_column", "value").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    pair = Window.partitionBy("left_column", "right_column")
    up = pair.orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    gap = F.abs(F.sum("a").over(up) / F.sum("a").over(pair) - F.sum("b").over(up) / F.sum("b").over(pair))
    return steps.withColumn("gap", gap).groupBy("left_column", "right_column").agg(F.round(F.max("gap"), 6).alias("ks"))


def _with_span(values: DataFrame, levels: Sequence[float]) -> DataFrame:
    """``column, b, span``: the quantiles and the range of each column."""
    spans = values.groupBy("column").agg((F.max("value") - F.min("value")).alias("span"))
    return order.quantile_arrays(values, ["column"], levels, "b").join(spans, "column")


def quantile_distance(left: DataFrame, right: DataFrame, levels: Sequence[float] = (0.1, 0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """``left_column, right_column, distance``: mean gap of the quantiles over the range of the right side's; null if that is 0."""
    levels = [float(x) for x in levels]
    a = order.quantile_arrays(left, ["column"], levels, "a").withColumnRenamed("column", "left_column")
    b = _with_span(right, levels).withColumnRenamed("column", "right_column")
    gaps = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(levels)
    return a.crossJoin(b).select("left_column", "right_column", F.round(F.when(F.col("span") > 0, gaps / F.col("span")), 6).alias("distance"))


def distribution_similarity(left: DataFrame, right: DataFrame, levels: Sequence[float] = DECILES) -> DataFrame:
    """``column, similarity`` for the columns of the same name: 1 - mean gap of the deciles over the right side's range, 0 at least."""
    levels = [float(x) for x in levels]
    a, b = order.quantile_arrays(left, ["column"], levels, "a"), _with_span(right, levels)
    gaps = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(levels)
    return a.join(b, "column").select("column", F.round(F.greatest(F.lit(0.0), 1 - gaps / (F.col("span") + 1e-9)), 6).alias("similarity"))


def table_similarity(left: DataFrame, right: DataFrame, levels: Sequence[float] = DECILES) -> DataFrame:
    """``table_id, dist_sim`` of tables (``table_id, column, value``) that share column names with the right side:
    1 - mean gap of the deciles over the right side's range, over the shared columns, 0 at least."""
    levels = [float(x) for x in levels]
    a, b = order.quantile_arrays(left, ["table_id", "column"], levels, "a"), _with_span(right, levels)
    gaps = F.aggregate(F.zip_with("a", "b", lambda x, y: F.abs(x - y)), F.lit(0.0), lambda s, x: s + x) / len(levels)
    each = a.join(b, "column").select("table_id", (gaps / (F.col("span") + 1e-9)).alias("_d"))
    return each.groupBy("table_id").agg(F.round(F.greatest(F.lit(0.0), 1 - F.avg("_d")), 6).alias("dist_sim"))


def average_rank(value: Column | str, *by: str) -> Column:
    """Ranks from 1, ties at their mean, within the keys ``by``."""
    value = F.col(value) if isinstance(value, str) else value
    ordered, tied = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(ordered) + (F.count(F.lit(1)).over(tied) - 1) / 2.0


def ranked(values: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by, value, n, rank``: every distinct value once, with the mean rank of its rows.

    Sums run over counts of values by ranges, so neither a common value nor a single column is one task's work.
    """
    counts = order.running(order.counted(values, by), by, "value", ["n"])
    return counts.select(*by, "value", "n", (F.col("n_upto") - (F.col("n") - 1) / 2.0).alias("rank"))


def spearman_matrix(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``a, b, rho`` for each pair a < b: the correlation of the mean ranks, over the rows where every column has a value."""
    rows = df.select(*columns).dropna()
    wide = rows
    for c in columns:  # ranks of distinct values meet the rows again
        ranks = ranked(rows.select(F.col(c).alias("value")), []).select(F.col("value").alias(c), F.col("rank").alias(f"_r_{c}"))
        wide = wide.join(ranks, c)
    pairs = [(a, b) for i, a in enumerate(sorted(columns)) for b in sorted(columns)[i + 1 :]]
    found = wide.agg(*[correlation(f"_r_{a}", f"_r_{b}").alias(f"{a}|{b}") for a, b in pairs])
    rows_of = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), 6).alias("rho")) for a, b in pairs])
    return found.select(F.explode(rows_of).alias("p")).select("p.*")


def structure_alignment(left: DataFrame, right: DataFrame) -> DataFrame:
    """``alignment``: the cosine of two Spearman matrices (``a, b, rho``) over their common pairs; diagonals count as 1."""
    both = left.withColumnRenamed("rho", "x").join(right.withColumnRenamed("rho", "y"), ["a", "b"]).dropna()
    sides = both.select("a", "x", "y").unionByName(both.select(F.col("b").alias("a"), "x", "y"))
    n = sides.agg(F.countDistinct("a").alias("n"), (F.sum(F.col("x") * F.col("y"))).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    return n.select(F.round((F.col("xy") + F.col("n")) / F.sqrt((F.col("xx") + F.col("n")) * (F.col("yy") + F.col("n"))), 6).alias("alignment"))


def quantile_correlation(left: DataFrame, right: DataFrame, levels: Sequence[float] = DECILES) -> DataFrame:
    """``column, correlation`` of the inner deciles of columns that meet under one name."""
    levels = [float(x) for x in levels]
    a, b = order.quantile_arrays(left, ["column"], levels, "a"), order.quantile_arrays(right, ["column"], levels, "b")
    each = a.join(b, "column").select("column", F.explode(F.arrays_zip("a", "b")).alias("q"))
    return each.groupBy("column").agg(F.round(correlation("q.a", "q.b"), 6).alias("correlation"))
