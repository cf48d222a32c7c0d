"""Ranking, top-k and gates on scores."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import lookup_key
from lakeweave.functions.vectors import dot, unit
from lakeweave.operators.order import median, positions, running


def top_k(df: DataFrame, score: str, k: int, *ties: str) -> DataFrame:
    """The k rows with the highest score and their ``rank``; ties in order of ``ties``."""
    order = [F.col(score).desc(), *ties]
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def dynamic_top_k(df: DataFrame, score: str, *ties: str, share: float = 0.5, least: int = 3, most: int = 20) -> DataFrame:
    """Rows with at least ``share`` of the highest score, but no fewer than ``least`` and no more than ``most``."""
    top = top_k(df, score, most, *ties)
    best = top.agg(F.max(score).alias("_best"))
    return top.join(F.broadcast(best)).where((F.col(score) >= share * F.col("_best")) | (F.col("rank") <= least)).drop("_best")


def score_gate(df: DataFrame, score: str, floor: float = 0.05, share: float = 0.35) -> DataFrame:
    """Rows whose score reaches the floor and ``share`` of the highest score."""
    best = df.agg(F.max(score).alias("_best"))
    return df.join(F.broadcast(best)).where(F.col(score) >= F.greatest(F.lit(floor), share * F.col("_best"))).drop("_best")


def median_gap_gate(df: DataFrame, score: str, gap: float = 0.10, floor: float = 0.05) -> DataFrame:
    """Rows whose score is not more than ``gap`` below the median, and above the floor; rows without a score pass."""
    middle = median(df, score)
    return df.join(F.broadcast(middle), F.lit(True), "left").where(F.col(score).isNull() | (F.col(score) >= F.greatest(F.col("_m") - gap, F.lit(floor)))).drop("_m")


def rate_gate(df: DataFrame, rate: str, low: float = 0.05, high: float = 0.95) -> DataFrame:
    return df.where(F.col(rate).between(low, high))


def cap_per_group(df: DataFrame, key: str, k: int, *order: str) -> DataFrame:
    """The first k rows of each group; keys are compared trimmed and in lower case.

    A window with a row-number limit keeps k rows per group and task before the shuffle.
    """
    w = Window.partitionBy("_key").orderBy(*order)
    return df.withColumn("_key", lookup_key(key)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_key", "_n")


def balanced_top(df: DataFrame, label: str, confidence: str, share: float, *ties: str, least: int = 5) -> DataFrame:
    """The most confident rows of each class: max(least, floor(rows * share / 2)) of each, by all rows."""
    rows = df.agg(F.count(F.lit(1)).alias("_rows"))
    w = Window.partitionBy(label).orderBy(F.col(confidence).desc(), *ties)
    n = F.greatest(F.lit(least), F.floor(F.col("_rows") * share / 2))
    return df.join(F.broadcast(rows)).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_rows", "_n")


def cumulative_batches(df: DataFrame, order: Sequence[str | Column], batches: int = 10) -> DataFrame:
    """Each row with ``batch`` (1 to ``batches``, equal runs in order); the rows up to t are those with batch <= t."""
    placed = positions(df, order, "_place")
    n = placed.agg(F.count(F.lit(1)).alias("_rows"))
    size, more = F.floor(F.col("_rows") / batches), F.col("_rows") % batches  # the first batches have a row more
    start = more * (size + 1)
    batch = F.when(F.col("_place") < start, F.floor(F.col("_place") / (size + 1))).otherwise(more + F.floor((F.col("_place") - start) / F.greatest(size, F.lit(1))))
    return placed.join(F.broadcast(n)).withColumn("batch", (batch + 1).cast("long")).drop("_place", "_rows")


def percent_rank_label(df: DataFrame, value: str, at: float = 0.5) -> DataFrame:
    """``label`` 1 where the mean rank over the number of rows reaches ``at``."""
    from lakeweave.operators.distance import ranked

    ranks = ranked(df.select(F.col(value).alias("value")).dropna(), [])
    n = ranks.agg(F.sum("n").alias("_rows"))
    labels = ranks.join(F.broadcast(n)).select("value", (F.col("rank") / F.col("_rows") >= at).cast("int").alias("label"))
    return df.join(labels, F.col(value) == F.col("value"), "left").drop("value")


def weighted_median(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """The first value at which the running weight reaches half of the group's."""
    counts = running(df.groupBy(*by, value).agg(F.sum(weight).alias("_w")), by, value, ["_w"])
    return counts.where(F.col("_w_upto") >= 0.5 * F.col("_w_all") - 1e-12).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def filter_power_set(df: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """``combination, n_kept``: rows that pass each of the 2^n combinations of gates, in one pass.

    A row's passed gates are a bit mask; combinations are counted per mask, of which there are 2^n.
    """
    mask = sum((F.coalesce(g, F.lit(False)).cast("int") * (1 << i) for i, g in enumerate(gates.values())), F.lit(0))
    masks = df.groupBy(mask.alias("_mask")).agg(F.count(F.lit(1)).alias("n"))
    names = list(gates)
    combos = F.explode(F.sequence(F.lit(0), F.lit((1 << len(names)) - 1)))
    named = F.concat_ws("+", *[F.when(F.col("_combo").bitwiseAND(F.lit(1 << i)) > 0, F.lit(n)) for i, n in enumerate(names)])
    kept = F.when(F.col("_mask").bitwiseAND(F.col("_combo")) == F.col("_combo"), F.col("n")).otherwise(0)
    return masks.withColumn("_combo", combos).groupBy("_combo").agg(F.sum(kept).cast("long").alias("n_kept")).select(F.when(F.col("_combo") == 0, F.lit("none")).otherwise(named).alias("combination"), "n_kept")


def mmr(candidates: DataFrame, key: str, score: str, vector: str, k: int = 20, trade: float = 0.7) -> list:
    """Keys of a diverse top-k: each next one maximises trade * score - (1 - trade) * highest cosine to those chosen.

    Every candidate is looked at in each of k passes; the driver holds the chosen rows only. Ties: score, then key.
    """
    rows = candidates.select(key, F.col(score).cast("double").alias("_s"), F.col(vector).cast("array<double>").alias("_v")).persist()
    keys, chosen = [], []
    while len(keys) < k:
        held = np.array(chosen)

        @F.pandas_udf("double")
        def value(s: pd.Series, v: pd.Series) -> pd.Series:
            if not len(held) or not len(v):
                return trade * s
            x = np.stack(v.to_list())
            x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return pd.Series(np.round(trade * s.to_numpy() - (1 - trade) * (x @ held.T).max(1), 12))

        left = rows.where(~F.col(key).isin(keys)) if keys else rows
        best = left.withColumn("_value", value("_s", "_v")).orderBy(F.col("_value").desc(), F.col("_s").desc(), key).first()
        if best is None:
            break
        v = np.array(best["_v"], float)
        keys.append(best[key])
        chosen.append(v / max(np.linalg.norm(v), 1e-12))
    rows.unpersist()
    return keys


def greedy_distinct(names: list[str], vectors: np.ndarray, most: float = 0.95) -> list[str]:
    """Names in order, without those whose cosine to an earlier kept one reaches ``most``."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    kept: list[int] = []
    for i in range(len(names)):
        if not kept or (v[kept] @ v[i]).max() < most:
            kept.append(i)
    return [names[i] for i in kept]


def greedy_clusters(names: list[str], vectors: np.ndarray, least: float = 0.72) -> list[list[str]]:
    """Each name joins the first cluster whose first member is similar enough, or starts one."""
    v = vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)
    heads: list[int] = []
    out: list[list[str]] = []
    for i, name in enumerate(names):
        sims = v[heads] @ v[i] if heads else np.empty(0)
        hit = np.flatnonzero(sims >= least)
        if len(hit):
            out[hit[0]].append(name)
        else:
            heads.append(i)
            out.append([name])
    return out


def semantic_gate(proxies: DataFrame, concepts: DataFrame, least: float = 0.40) -> DataFrame:
    """``table_id, similarity`` of the sources whose proxy's name is near one of the concepts (``vector`` each).

    A source without a proxy vector stays, with a null similarity. Concepts are one target's list of names.
    """
    goal = concepts.select(unit("vector").alias("_c"))
    met = proxies.select("table_id", unit("vector").alias("_v")).join(F.broadcast(goal), how="left")
    best = met.groupBy("table_id").agg(F.round(F.max(dot("_v", "_c")), 6).alias("similarity"))
    return best.where(F.col("similarity").isNull() | (F.col("similarity") >= least))


def self_auc_gate(scores: DataFrame, least: float = 0.60) -> DataFrame:
    """Sources whose own features tell their labels well enough; one that couldn't be judged stays."""
    return scores.where(F.col("self_auc").isNull() | (F.col("self_auc") >= least))


def weighted_mean(df: DataFrame, by: Sequence[str], value: str, weight: str) -> DataFrame:
    """``by, weighted_mean`` over rows with a value; null where the weights add up to nothing."""
    w = F.when(F.col(value).isNotNull(), F.col(weight))
    return df.groupBy(*by).agg(F.try_divide(F.sum(F.col(value) * w), F.sum(w)).alias("weighted_mean"))
