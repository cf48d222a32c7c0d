"""Samples that are the same in every run: by hash, by stride, by class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seeded(key: Column | str, seed: int = 42) -> Column:
    """A pseudo-random order of rows that depends on the key and the seed alone."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(key.cast("string"), F.lit(f"#{seed}")))


def uniform(key: Column | str, seed: int = 42) -> Column:
    """A number in [0, 1) that depends on the key and the seed alone."""
    return F.conv(F.substring(seeded(key, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows, the first in seeded order."""
    return df.orderBy(seeded(key, seed), key).limit(n)


def stride_sample(df: DataFrame, row_id: str, most: int, rows: int | None = None) -> DataFrame:
    """Every k-th row (by a gapless row id from 0), for the smallest k that leaves ``most`` rows or fewer."""
    rows = df.count() if rows is None else rows
    return df.where(F.col(row_id) % max(1, -(-rows // most)) == 0)


def stratified_sample(df: DataFrame, label: str, key: str, share: float, seed: int = 42) -> DataFrame:
    """The first rows of each class in seeded order, ``share`` of the class (rounded)."""
    order = Window.partitionBy(label).orderBy(seeded(key, seed), key)
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    both = df.join(F.broadcast(counts), label).withColumn("_r", F.row_number().over(order))  # one row per class
    return both.where(F.col("_r") <= F.round(F.col("_n") * share)).drop("_n", "_r")


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Two parts by a hash of the key: no sort, and each row's side never depends on the others."""
    first = uniform(F.col(key), seed) < share
    return df.where(first), df.where(~first)


def bootstrap(df: DataFrame, key: str, replicas: int = 20, seed: int = 42) -> DataFrame:
    """Each row with ``replica`` and ``times``: how often it is in each resample (Poisson with mean 1, by hash)."""
    u = uniform(F.concat_ws("/", F.col(key).cast("string"), F.col("replica").cast("string")), seed)
    steps = F.lit(0)
    p = total = 0.36787944117144233
    for k in range(1, 8):
        steps = F.when(u >= total, F.lit(k)).otherwise(steps)
        p /= k
        total += p
    return df.withColumn("replica", F.explode(F.sequence(F.lit(0), F.lit(replicas - 1)))).withColumn("times", steps).where("times > 0")
