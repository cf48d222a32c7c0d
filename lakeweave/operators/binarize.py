"""Turning columns into 0/1 labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import AFFIRMATIVE, lookup_key
from lakeweave.operators.order import quantiles


def binarize(value: Column | str, threshold: Column, low: Column, high: Column | None = None, direction: Column | None = None) -> Column:
    """1 from the threshold on, missing values counting as the threshold.

    Where the threshold is the minimum, only values above it are 1 (else every row would be). NEGATIVE directions
    mirror that: 1 up to the threshold, or below it where it is the maximum.
    """
    value = F.col(value) if isinstance(value, str) else value
    x = F.coalesce(value, threshold)
    up = F.when(threshold <= low, x > threshold).otherwise(x >= threshold)
    if direction is None:
        return up.cast("int")
    down = F.when(threshold >= high, x < threshold).otherwise(x <= threshold) if high is not None else x <= threshold
    return F.when(F.upper(F.trim(direction)) == "NEGATIVE", down).otherwise(up).cast("int")


def median_binarize(df: DataFrame, value: str, by: list[str] = [], label: str = "label") -> DataFrame:  # noqa: B006
    """``label`` by the median (of each group); groups of a single class are dropped."""
    middle = quantiles(df, by, [0.5], value).select(*by, F.col(value).alias("_m"))
    ends = df.groupBy(*by).agg(F.min(value).alias("_low"), F.max(value).alias("_high")).where("_low < _high")
    both = df.join(middle.join(ends, by), by) if by else df.join(F.broadcast(middle)).join(F.broadcast(ends))
    return both.withColumn(label, binarize(value, F.col("_m"), F.col("_low"))).drop("_m", "_low", "_high")


def affirmative_binarize(value: Column | str, words: tuple[str, ...] = AFFIRMATIVE) -> Column:
    """1 for values that mean yes."""
    return lookup_key(value).isin(*words).cast("int")


def categorical_binarize(similarities: DataFrame, gap: float = 0.15, least: float = 0.25) -> DataFrame:
    """``column, value, label, method`` from ``column, value, similarity`` to the concept (and ``direction``, if there is one).

    If a column's best similarity reaches ``least``, values within ``gap`` of it are 1; otherwise values that mean yes.
    NEGATIVE columns mirror that. Columns with fewer than 2 or more than 15 values, or of a single class, are dropped.
    """
    best = similarities.groupBy("column").agg(F.max("similarity").alias("_best"), F.count(F.lit(1)).alias("_n")).where("_n between 2 and 15")
    both = similarities.join(best, "column")
    near = F.col("_best") >= least
    label = F.when(near, (F.col("similarity") >= F.col("_best") - gap).cast("int")).otherwise(affirmative_binarize("value"))
    both = both.withColumn("_up", label).withColumn("method", F.when(near, "categorical_semantic").otherwise("categorical_affirmative"))
    mirrored = F.upper(F.trim(F.coalesce("direction", F.lit("")))) == "NEGATIVE" if "direction" in similarities.columns else F.lit(False)
    both = both.withColumn("label", F.when(mirrored, 1 - F.col("_up")).otherwise(F.col("_up")))
    classes = both.groupBy("column").agg(F.min("label").alias("_a"), F.max("label").alias("_b")).where("_a < _b").select("column")
    return both.join(classes, "column", "left_semi").select("column", "value", "label", "method")
