"""An index of a lake's column names, and the tables it suggests for a target."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.vectors import dot, unit
from lakeweave.operators.matching import NameEncoder, encode_names


def build_index(columns: DataFrame, encoder: NameEncoder, path: str) -> None:
    """Stores ``name_dim`` (name_id, name, unit vector) and ``table_col`` (table_id, pos, name_id): names are encoded once."""
    names = encode_names(columns, encoder).select(F.xxhash64("name").alias("name_id"), "name", unit("vector").alias("vector"))
    names.write.mode("overwrite").parquet(f"{path}/name_dim")
    columns.select("table_id", "pos", F.xxhash64("name").alias("name_id")).write.mode("overwrite").parquet(f"{path}/table_col")


def candidates(names: DataFrame, table_col: DataFrame, label: DataFrame, target: DataFrame, k: int = 20, least: float = 0.70, match: float = 0.60, multiple: int = 3) -> DataFrame:
    """``table_id, label_score, coverage, score``: the ``multiple`` x k best tables with a column for the label.

    ``label`` and ``target`` hold ``name, vector`` of the concept and of the target's columns: a few rows, broadcast
    and compared with each distinct name once. The score is label_score x (1 + the share of target columns that have a
    near column in the table).
    """
    n = target.count()
    hit = names.join(F.broadcast(label.select(unit("vector").alias("_l")))).groupBy("name_id").agg(F.max(dot("vector", "_l")).alias("_label"))
    near = names.join(F.broadcast(target.select(F.col("name").alias("_t"), unit("vector").alias("_v"))), dot("vector", "_v") >= match)
    covered = table_col.join(near.select("name_id", "_t"), "name_id").groupBy("table_id").agg(F.countDistinct("_t").alias("_n"))
    scores = table_col.join(hit, "name_id").groupBy("table_id").agg(F.max("_label").alias("label_score")).where(F.col("label_score") >= least)
    both = scores.join(covered, "table_id", "left").withColumn("coverage", F.round(F.coalesce("_n", F.lit(0)) / max(1, n), 6))
    both = both.select("table_id", F.round("label_score", 6).alias("label_score"), "coverage", F.round(F.col("label_score") * (1 + F.col("coverage")), 6).alias("score"))
    return both.orderBy(F.col("score").desc(), "table_id").limit(multiple * k)
