"""The composed run over a lake that the given tables make: every supplier's line items are a table of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import adapt
from lakeweave.plans import experiments, pipeline
from lakeweave.plans.registry import Tables, query
from lakeweave.sources import lake

FEATURES = ("ordered quantity", "discount rate", "sales tax rate", "line number", "shipping month")
_CONCEPT = "price rating"


def _rows(t: Tables) -> DataFrame:
    """Line items with their features, and what is left of the quantity after discount and tax as the proxy of what is asked."""
    item = t.lineitem
    made = [F.col("l_quantity"), F.col("l_discount"), F.col("l_tax"), F.col("l_linenumber"), F.month("l_shipdate")]
    named = [c.cast("double").alias(n) for c, n in zip(made, FEATURES, strict=True)]
    return item.select("l_suppkey", (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row_id"), *named, F.round(F.col("l_quantity") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).cast("double").alias(_CONCEPT))


def lake_and_target(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(manifest, cells, target): nine tenths of the suppliers are tables, the rows of the others are the target.

    Cells and target are read from the line items whenever they are used: a copy would be many times as large."""
    rows = _rows(t)
    names = [*FEATURES, _CONCEPT]
    pairs = F.array(*[F.struct(F.lit(n).alias("col"), F.col(n).alias("value")) for n in names])
    own = rows.where(F.col("l_suppkey") % 10 != 0)
    cells = own.select(F.concat(F.lit("supplier_"), F.col("l_suppkey").cast("string")).alias("table_id"), "row_id", F.explode(pairs).alias("p")).select("table_id", "row_id", "p.col", "p.value").where("value is not null")
    target = rows.where(F.col("l_suppkey") % 10 == 0).drop("l_suppkey")
    middle = target.agg(F.avg(_CONCEPT)).first()[0] or 0.0
    target = target.withColumn("label", (F.col(_CONCEPT) > middle).cast("int")).drop(_CONCEPT)
    return adapt.stored(lake.manifest_of(cells)), cells, target


def _experiment() -> pipeline.Experiment:
    return pipeline.Experiment(_CONCEPT, (_CONCEPT,), k=20, table=-1.0, context=-1.0, rest=-1.0, share=0.0, least_columns=3)


@query(None)
def lake_run(t: Tables) -> DataFrame:
    """Discovery, alignment, adaptation and evaluation in one, with the oracle's level."""
    manifest, cells, target = lake_and_target(t)
    return experiments.run(t.spark, manifest, cells, target, FEATURES, _experiment())["metrics"]


@query(None)
def lake_discovery(t: Tables) -> DataFrame:
    """What became of every table: its proxy, threshold, rate and discovery score."""
    manifest, cells, target = lake_and_target(t)
    found = pipeline.discover(t.spark, manifest, cells, target, FEATURES, _experiment())
    return found["lake"].join(found["scores"], "table_id", "left")


@query(None)
def semi_supervised_curve(t: Tables) -> DataFrame:
    """AUC of four methods with a tenth of the target's labels."""
    from lakeweave.plans.model_queries import adaptation_tables

    sources, target, features = adaptation_tables(t)
    return experiments.semi_supervised(sources, target, features, fractions=(0.1,), seeds=(0,), methods=("target_only", "pooled", "fine_tuned", "blended"))


@query(None)
def cold_start_weeks(t: Tables) -> DataFrame:
    """Labels that arrive in five parts."""
    from lakeweave.plans.model_queries import adaptation_tables

    sources, target, features = adaptation_tables(t)
    scores = {r["table_id"]: 0.1 for r in sources.select("table_id").distinct().collect()}  # a row per source
    return experiments.cold_start(sources, target, features, scores, weeks=5)
