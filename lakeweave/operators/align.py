"""Discovery scores, and source tables in the target's schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import GENERIC_LABELS, lookup_key


def discovery_scores(parts: DataFrame, target_rate: float | None = None, dist_weight: float = 0.3, label_weight: float = 0.4, rate_weight: float = 0.15, least: float = 0.0) -> DataFrame:
    """``table_id, discovery_score`` from ``table_id, schema_sim, dist_sim, label_sim, label_name, positive_rate``.

    (1 - lw) ((1 - dw) schema + dw dist) + lw label, less what the positive rates differ; labels that say nothing count 0.
    """
    label = F.when(lookup_key("label_name").isin(*GENERIC_LABELS), F.lit(0.0)).otherwise(F.coalesce("label_sim", F.lit(0.0)))
    content = (1 - dist_weight) * F.coalesce("schema_sim", F.lit(0.0)) + dist_weight * F.coalesce("dist_sim", F.lit(0.0))
    score = (1 - label_weight) * content + label_weight * label
    if target_rate is not None:
        score = score * F.greatest(F.lit(0.0), 1 - rate_weight * F.abs(F.col("positive_rate") - target_rate))
    return parts.select("table_id", F.round(score, 6).alias("discovery_score")).where(F.col("discovery_score") >= least)


def alignment_gates(matches: DataFrame, cells: DataFrame, n_target: int, least_columns: int = 4, least_coverage: float = 0.40, least_sim: float = 0.0) -> DataFrame:
    """``table_id, n_matched, coverage`` of the tables with enough matched columns and non-null cells in them."""
    kept = matches.where(F.col("sim") >= least_sim)
    counts = kept.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_matched"))
    rows = cells.join(counts.select("table_id"), "table_id", "left_semi").groupBy("table_id").agg(F.countDistinct("row_id").alias("_rows"))
    filled = cells.where("value is not null").join(kept.select("table_id", F.col("src_col").alias("col")), ["table_id", "col"], "left_semi")
    filled = filled.groupBy("table_id").agg(F.count(F.lit(1)).alias("_cells"))
    out = counts.join(rows, "table_id").join(filled, "table_id", "left")
    out = out.withColumn("coverage", F.round(F.coalesce("_cells", F.lit(0)) / (F.col("_rows") * n_target), 6))
    return out.where((F.col("n_matched") >= least_columns) & (F.col("coverage") >= least_coverage)).select("table_id", "n_matched", "coverage")


def align_tables(cells: DataFrame, matches: DataFrame, columns: Sequence[str], fill: dict[str, float] | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """``table_id, row_id, carry`` and the target's columns, for all tables in one plan.

    ``cells`` (table_id, row_id, col, value and ``carry``) meet the mapping, then one pivot over the known columns makes
    the rows. Unmatched columns are null, or the given fill (the target's mean).
    """
    named = cells.join(matches.select("table_id", F.col("src_col").alias("col"), "tgt_col"), ["table_id", "col"])
    wide = named.groupBy("table_id", "row_id", *carry).agg(*[F.max(F.when(F.col("tgt_col") == c, F.col("value"))).alias(c) for c in columns])
    return wide.fillna(fill) if fill else wide


def with_fallbacks(matches: DataFrame, cells: DataFrame, n_target: int, least_columns: int = 4, least_coverage: float = 0.40, least_sim: float = 0.35) -> DataFrame:
    """The tables that pass the gates; with fewer than two, the gates are eased: one column, then any similarity."""
    steps = ((min(least_columns, n_target), least_coverage, least_sim), (1, 0.0, least_sim), (1, 0.0, -1.0))
    out = None
    for columns, coverage, sim in steps:
        out = alignment_gates(matches, cells, n_target, columns, coverage, sim)
        if out.limit(2).count() >= 2:
            break
    return out


def perturbed(df: DataFrame, rename: dict[str, str], dropped: Sequence[str] = (), binned: dict[str, Sequence[float]] | None = None) -> DataFrame:
    """A table under another schema, for tests of matching: columns renamed, dropped, or cut into right-closed bins."""
    from lakeweave.functions.numeric import right_closed_bin

    for c, edges in (binned or {}).items():
        df = df.withColumn(c, right_closed_bin(c, edges, [float(i) for i in range(len(edges) - 1)]))
    return df.drop(*dropped).withColumnsRenamed(rename)
