"""Scores of predictions and the tables made of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import order

#: fixed values: the order in which levels are reported; others follow
LEVELS = ("baseline_a", "baseline_b", "baseline_c", "level0", "level2", "level2_lsc", "level5", "level55", "level6", "level_ot", "level_qbc", "ensemble", "source_ensemble", "vla", "stacking", "routed", "oracle")


def auc(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, auc``: the rank-sum AUC with ties at half; null with a single class.

    Rows are counted per score first, and sums run over ranges of scores, so a single group isn't one task's work.
    """
    pos, neg = (F.sum(F.when(F.col(label) == k, 1).otherwise(0)) for k in (1, 0))
    counts = df.where(F.col(label).isNotNull() & F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(pos.alias("_p"), neg.alias("_n"))
    won = order.running(counts, by, "_s", ["_n"]).withColumn("_won", F.col("_p") * (F.col("_n_upto") - F.col("_n") / 2.0))
    return won.groupBy(*by).agg(F.round(F.try_divide(F.sum("_won"), F.sum("_p").cast("double") * F.sum("_n")), 6).alias("auc"))


def confusion(label: str, prediction: str) -> dict[str, Column]:
    """Aggregates ``accuracy`` and ``f1`` (0 where it is undefined)."""
    y, p = F.col(label), F.col(prediction)
    hit = F.sum(F.when((y == 1) & (p == 1), 1).otherwise(0))
    wrong = F.sum(F.when(y != p, 1).otherwise(0))
    return {"accuracy": F.round(F.avg((y == p).cast("double")), 6), "f1": F.round(F.coalesce(F.try_divide(2.0 * hit, 2.0 * hit + wrong), F.lit(0.0)), 6)}


def prior_threshold(df: DataFrame, score: str, prior: float, by: Sequence[str] = ()) -> DataFrame:
    """``by, threshold``: the largest score at which the share of rows at or above it exceeds the prior.

    A row is positive from the threshold on. With one score for all rows every row is positive.
    """
    counts = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("_n"))
    reached = order.running(counts, by, score, ["_n"], descending=True).where(F.col("_n_upto") / F.col("_n_all") > prior)
    return reached.groupBy(*by).agg(F.max(score).alias("threshold"))


def level_metrics(predictions: DataFrame, prior: float | None = None) -> DataFrame:
    """``level, accuracy, f1, auc`` from ``level, label, p1, scored``; the threshold is 0.5 or matches a prior."""
    rows = predictions.where("scored")
    if prior is None:
        rows = rows.withColumn("prediction", (F.col("p1") >= 0.5).cast("int"))
    else:
        at = prior_threshold(rows, "p1", prior, ["level"])
        rows = rows.join(F.broadcast(at), "level").withColumn("prediction", (F.col("p1") >= F.col("threshold")).cast("int"))
    c = confusion("label", "prediction")
    return rows.groupBy("level").agg(*[v.alias(k) for k, v in c.items()]).join(auc(rows, "label", "p1", ["level"]), "level")


def with_deltas(metrics: DataFrame, baseline: str, names: Sequence[str] = ("accuracy", "f1", "auc"), key: str = "level") -> DataFrame:
    """Each metric less the baseline's, and ``place`` in the reporting order (unlisted levels last, none is lost)."""
    base = metrics.where(F.col(key) == baseline).select(*[F.col(m).alias(f"_b_{m}") for m in names])
    out = metrics.join(F.broadcast(base), how="left").withColumns({f"{m}_delta": F.round(F.col(m) - F.col(f"_b_{m}"), 6) for m in names})
    places = F.array(*[F.lit(x) for x in LEVELS])
    return out.drop(*[f"_b_{m}" for m in names]).withColumn("place", F.coalesce(F.nullif(F.array_position(places, F.col(key)), F.lit(0)), F.lit(len(LEVELS) + 1)))


def pivot(df: DataFrame, rows: str, columns: str, values: Sequence, value: str, how: str = "first") -> DataFrame:
    """A table of ``value`` by two keys; the second key's values are given, so nothing is run to find them."""
    return df.groupBy(rows).pivot(columns, list(values)).agg({"first": F.first, "mean": F.avg}[how](value))


def best_row(df: DataFrame, by: Sequence[str], what: str, value: str, excluded: Sequence[str] = ()) -> DataFrame:
    """``by, best, best_value``: the key of the highest value (ties: the first by name)."""
    rows = df.where(~F.col(what).isin(*excluded)) if excluded else df
    return rows.where(F.col(value).isNotNull()).groupBy(*by).agg(F.min_by(what, F.struct(-F.col(value), F.col(what))).alias("best"), F.max(value).alias("best_value"))


def gap_closed(best: Column | str, base: Column | str, oracle: Column | str) -> Column:
    """(best - base) / (oracle - base); null where the gap is below a millionth."""
    best, base, oracle = (F.col(x) if isinstance(x, str) else x for x in (best, base, oracle))
    return F.when(F.abs(oracle - base) >= 1e-6, (best - base) / (oracle - base))


def over_seeds(metrics: DataFrame, by: Sequence[str], names: Sequence[str]) -> DataFrame:
    """Mean and population standard deviation over seeds."""
    return metrics.groupBy(*by).agg(*[x for m in names for x in (F.round(F.avg(m), 6).alias(f"{m}_mean"), F.round(F.stddev_pop(m), 6).alias(f"{m}_std"))])
