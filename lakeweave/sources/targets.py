"""Targets: loaders that make features and a 0/1 ``label`` of raw tables, by name."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.numeric import day_difference, number
from lakeweave.functions.text import lookup_key
from lakeweave.operators.normalize import label_encoded
from lakeweave.operators.order import median

LOADERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def target(name: str):
    def register(f):
        LOADERS[name] = f
        return f

    return register


def load(spark: SparkSession, name: str, path: str) -> DataFrame:
    return LOADERS[name](spark, path)


def positive(column: str, values: Sequence[str] | None = None, df: DataFrame | None = None):
    """1 for the given values (trimmed, any case), or for the rarer one of the values of ``df``."""
    if values is None:
        rare = df.where(F.col(column).isNotNull()).groupBy(lookup_key(column).alias("v")).count().orderBy("count", "v").first()
        values = [rare["v"]] if rare else []
    return lookup_key(column).isin(*[v.strip().lower() for v in values]).cast("int")


def generic(df: DataFrame, label: str, values: Sequence[str] | None = None, most_missing: float = 0.3) -> DataFrame:
    """Any table with a label column: sparse columns go, then rows with missing values; text is encoded by sorted order."""
    labelled = df.withColumn("label", positive(label, values, df)).drop(*([label] if label != "label" else []))
    shares = labelled.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in labelled.columns]).first()
    out = labelled.select(*[c for c in labelled.columns if c == "label" or (shares[c] or 0) <= most_missing]).dropna()
    for c, kind in out.dtypes:
        if kind == "string":
            out = label_encoded(out, c, f"_e_{c}").drop(c).withColumnRenamed(f"_e_{c}", c)
    return out


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path) if path.endswith(("parquet", "pq")) else spark.read.option("header", True).csv(path)


@target("adult")
def adult(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path)
    label = "class" if "class" in df.columns else "income"
    return generic(df, label, [">50K", ">50K."])


@target("bank")
def bank(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path)
    return generic(df, "y" if "y" in df.columns else "Class", ["yes", "2"])


@target("nyhouse")
def nyhouse(spark: SparkSession, path: str) -> DataFrame:
    """Houses at or above the median price."""
    df = _read(spark, path).withColumn("PRICE", number("PRICE"))
    middle = median(df, "PRICE")
    return generic(df.join(F.broadcast(middle)).withColumn("label", (F.col("PRICE") >= F.col("_m")).cast("string")).drop("PRICE", "_m"), "label", ["true"])


@target("obesity")
def obesity(spark: SparkSession, path: str) -> DataFrame:
    """Counties at or above the median of the outcome."""
    df = _read(spark, path)
    outcome = next(c for c in df.columns if "obes" in c.lower())
    middle = median(df, number(outcome))
    return generic(df.join(F.broadcast(middle)).withColumn("label", (number(outcome) >= F.col("_m")).cast("string")).drop(outcome, "_m"), "label", ["true"])


@target("noshow")
def noshow(spark: SparkSession, path: str) -> DataFrame:
    """Missed appointments; the days between booking and visit, 0 to 365, are a feature."""
    df = _read(spark, path).where(number("Age") >= 0)
    df = df.withColumn("days_ahead", day_difference("AppointmentDay", "ScheduledDay"))
    df = df.drop("PatientId", "AppointmentID", "Neighbourhood", "ScheduledDay", "AppointmentDay")
    return generic(df, "No-show", ["yes"])


@target("stroke")
def stroke(spark: SparkSession, path: str) -> DataFrame:
    df = _read(spark, path).drop("id")
    return generic(df.withColumn("bmi", number("bmi")), "stroke", ["1"])


@target("titanic")
def titanic(spark: SparkSession, path: str) -> DataFrame:
    return generic(_read(spark, path).drop("boat", "body", "name", "ticket", "cabin", "home.dest"), "survived", ["1"])


#: fixed values: the names of the census codes
CENSUS = {
    "AGEP": "age", "COW": "class_of_worker", "SCHL": "education_level", "MAR": "marital_status", "OCCP": "occupation_code",
    "POBP": "place_of_birth", "RELP": "relationship_status", "WKHP": "hours_worked_weekly", "SEX": "sex", "RAC1P": "race_code",
}


def census(spark: SparkSession, path: str, most_rows: int | None = None, income: str = "PINCP", above: float = 50_000) -> DataFrame:
    """Persons of a census extract: readable names, label by income; all of them, or a sample that every run repeats."""
    df = _read(spark, path)
    rows = df.select(*[number(c).alias(n) for c, n in CENSUS.items() if c in df.columns], (number(income) > above).cast("int").alias("label")).dropna()
    return rows if most_rows is None else rows.orderBy(F.xxhash64(*rows.columns)).limit(most_rows)


#: fixed values: the label's column, under any of its names, and the values that count as 1, of targets that need no more
RECIPES = {
    "breastcancer": (("class", "diagnosis", "target"), ("malignant", "m", "2", "1")),
    "churn": (("churn", "class"), ("yes", "1", "true")),
    "credit": (("class",), ("good", "1")),
    "crime": (("violentcrimesperpop", "class"), ()),
    "diabetes": (("class", "outcome"), ("tested_positive", "1", "pos")),
    "heart": (("class", "target"), ("present", "1", "2")),
    "turnover": (("left", "class"), ("left", "1", "true")),
}


def recipe(spark: SparkSession, path: str, names: Sequence[str], values: Sequence[str]) -> DataFrame:
    """A table whose label is in the first of ``names`` that it has (in any case; ``label`` before all).

    With ``values``, these are 1; without, numbers at or above the median.
    """
    df = _read(spark, path)
    there = {c.strip().lower(): c for c in df.columns}
    found = next((there[n] for n in ("label", *names) if n in there), None)
    if found is None:
        raise ValueError(f"none of {('label', *names)} is a column of {path}")
    if values:
        return generic(df, found, values)
    middle = median(df, number(found))
    return generic(df.join(F.broadcast(middle)).withColumn("_l", (number(found) >= F.col("_m")).cast("string")).drop(found, "_m"), "_l", ["true"])


for _name, (_names, _values) in RECIPES.items():
    LOADERS[_name] = lambda spark, path, names=_names, values=_values: recipe(spark, path, names, values)
