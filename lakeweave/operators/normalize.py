"""Bringing columns of different tables to one scale."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def standardized(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(x - mean) / (sample std + 1e-9), column by column."""
    stats = df.agg(*[x for c in columns for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))])
    both = df.join(F.broadcast(stats))
    return both.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / (F.col(f"_s_{c}") + 1e-9) for c in columns}).select(*df.columns)


def to_range_of(df: DataFrame, target: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each column moved linearly from its own range to the target's."""
    own, other = (x.agg(*[y for c in columns for y in (F.min(c).alias(f"{p}l_{c}"), F.max(c).alias(f"{p}h_{c}"))]) for x, p in ((df, "_a"), (target, "_b")))
    both = df.join(F.broadcast(own)).join(F.broadcast(other))
    share = {c: (F.col(c) - F.col(f"_al_{c}")) / (F.col(f"_ah_{c}") - F.col(f"_al_{c}") + 1e-9) for c in columns}
    return both.withColumns({c: F.col(f"_bl_{c}") + share[c] * (F.col(f"_bh_{c}") - F.col(f"_bl_{c}")) for c in columns}).select(*df.columns)


def label_encoded(df: DataFrame, column: str, out: str) -> DataFrame:
    """The place of a value among the sorted distinct values, from 0; null for null."""
    codes = df.select(column).dropna().distinct()
    codes = codes.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("long"))  # a row per value
    return df.join(codes, column, "left")


def quantile_transformed(df: DataFrame, columns: Sequence[str], fitted_on: DataFrame | None = None, normal: bool = False, landmarks: int = 1000) -> DataFrame:
    """Each value's place in its column's distribution (0 to 1, or as a standard normal), nulls kept.

    Up to ``landmarks`` quantiles are the landmarks; between them places are interpolated, and a value that repeats
    gets the middle of its places. Constant columns become 0.5 (0). Landmarks are a bounded array in the plan.
    """
    source = fitted_on if fitted_on is not None else df
    counted = source.agg(*[F.count(c).alias(c) for c in columns]).first()
    fitted = {}
    for c in columns:
        n = max(2, min(landmarks, counted[c] or 0))
        got = source.agg(F.percentile(c, [i / (n - 1) for i in range(n)])).first()[0]
        fitted[c] = np.array(got if got is not None else [0.0, 0.0], float)

    def place(c: str):
        marks = fitted[c]
        at = np.linspace(0, 1, len(marks))

        @F.pandas_udf("double")
        def run(values: pd.Series) -> pd.Series:
            x = values.to_numpy(float)
            if marks[0] == marks[-1]:
                p = np.full(len(x), 0.5)
            else:
                p = 0.5 * (np.interp(x, marks, at) - np.interp(-x, -marks[::-1], -at[::-1]))
            if normal:
                p = _normal(np.clip(p, 1e-7, 1 - 1e-7))
            return pd.Series(p).where(values.notna())

        return run(F.col(c).cast("double"))

    return df.withColumns({c: place(c) for c in columns})


def _normal(p):
    """The inverse of the standard normal distribution, by Newton steps on its series-free form."""
    x = np.sign(p - 0.5) * np.sqrt(np.maximum(0, -2 * np.log(2 * np.minimum(p, 1 - p)))) * 0.8
    erf = np.vectorize(math.erf)
    for _ in range(30):
        x = x - np.clip((0.5 * (1 + erf(x / math.sqrt(2))) - p) * math.sqrt(2 * math.pi) * np.exp(np.minimum(x * x / 2, 50)), -0.5, 0.5)
    return x
