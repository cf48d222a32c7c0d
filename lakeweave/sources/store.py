"""Results that are kept: sinks, and stages that are not computed twice."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def save(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Overwrites a folder with the rows as Parquet, CSV (with a header) or JSON."""
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if kind == "csv" else writer).format(kind).save(path)


def stage_path(root: str, name: str, parameters: dict) -> str:
    """Where a stage's result lies: its name and a hash of every parameter, so other parameters never meet it."""
    told = json.dumps(parameters, sort_keys=True, default=str)
    return f"{root}/{name}-{hashlib.sha256(told.encode()).hexdigest()[:16]}"


def stage(spark: SparkSession, root: str, name: str, parameters: dict, compute: Callable[[], DataFrame]) -> DataFrame:
    """The stage's rows from its folder if it is complete there, else computed and written first."""
    path = stage_path(root, name, parameters)
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
