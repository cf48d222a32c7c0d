"""Sources behind a network: catalogues, downloads and model replies, each behind a client that can be swapped."""

from __future__ import annotations

import glob
import json
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lakeweave.functions.text import reply_confidence, reply_direction, reply_prediction


class CatalogSource(DataSource):
    """``spark.read.format("lake_catalog")``: dataset entries of a paged catalogue.

    Option ``pages``: JSON lists of entries, as a catalogue's pages saved for offline use: local files or globs, with commas
    between them; each page is a partition. Entries without two numeric columns are left out before anything is downloaded.
    Pages in a store that only Spark reads: ``read_catalog``.
    """

    @classmethod
    def name(cls) -> str:
        return "lake_catalog"

    def schema(self) -> str:
        return "dataset_id string, name string, n_rows long, n_cols long, n_numeric long, url string"

    def reader(self, schema) -> DataSourceReader:
        return _CatalogReader(self.options)


_ENTRY = "dataset_id string, name string, n_rows long, n_cols long, n_numeric long, url string"


def read_catalog(spark: SparkSession, pages: str | list[str], least_numeric: int = 2) -> DataFrame:
    """The same entries from any path or glob that Spark reads; a page with another kind of JSON gives none."""
    return spark.read.schema(_ENTRY).json(pages, multiLine=True).where(F.col("n_numeric") >= least_numeric)


class _CatalogReader(DataSourceReader):
    def __init__(self, options):
        self.pages = [p for p in options.get("pages", "").split(",") if p]
        self.least = int(options.get("least_numeric", "2"))

    def partitions(self):
        found = [sorted(glob.glob(p)) if glob.has_magic(p) else [p] for p in self.pages]
        return [InputPartition(p) for pages in found for p in pages]

    def read(self, partition):
        with open(partition.value, encoding="utf-8") as f:
            for e in json.load(f):
                if (e.get("n_numeric") or 0) >= self.least:
                    yield (e.get("dataset_id"), e.get("name"), e.get("n_rows"), e.get("n_cols"), e.get("n_numeric"), e.get("url"))


def replies(prompts: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``key, reply`` of ``key, prompt``: a client called on the executors, a null reply where it fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for prompt in batch["prompt"]:
                try:
                    out.append(ask(prompt))
                except Exception:  # noqa: BLE001  a client may fail in any way
                    out.append(None)
            yield pd.DataFrame({"key": batch["key"], "reply": out})

    return prompts.select(F.col("key").cast("string"), "prompt").mapInPandas(run, "key string, reply string")


def zero_shot(rows: DataFrame, features: Sequence[str], question: str, ask: Callable[[str], str], most: int = 200) -> DataFrame:
    """``row_id, level, p1, prediction, scored`` by a model's replies for ``most`` rows; the rest is not scored."""
    described = F.concat_ws("; ", *[F.concat(F.lit(f"{c}: "), F.coalesce(F.col(c).cast("string"), F.lit("unknown"))) for c in features])
    picked = rows.orderBy(F.xxhash64("row_id")).limit(most).select(F.col("row_id").cast("string").alias("key"), F.concat(F.lit(question + "\n"), described).alias("prompt"))
    told = replies(picked, ask).select(F.col("key"), reply_prediction("reply").alias("v"), reply_confidence("reply").alias("c"))
    p = F.when(F.col("v") == 1, F.col("c")).when(F.col("v") == 0, 1 - F.col("c"))
    both = rows.select("row_id").join(told, F.col("row_id").cast("string") == F.col("key"), "left").withColumn("p", p)
    return both.select("row_id", F.lit("llm").alias("level"), F.coalesce("p", F.lit(0.5)).alias("p1"), (F.coalesce("p", F.lit(0.0)) >= 0.5).cast("int").alias("prediction"), F.col("p").isNotNull().alias("scored"))


def new_directions(pairs: DataFrame, known: DataFrame, ask: Callable[[str], str]) -> DataFrame:
    """``label, col, direction`` of the pairs that the cache doesn't have; POSITIVE unless told otherwise."""
    keyed = pairs.select("label", F.lower(F.trim("col")).alias("col")).distinct()
    missing = keyed.join(known.select("label", F.lower(F.trim("col")).alias("col")), ["label", "col"], "left_anti")
    prompt = F.concat(F.lit("Does a high value of '"), F.col("col"), F.lit("' speak for '"), F.col("label"), F.lit("'? POSITIVE or NEGATIVE."))
    told = replies(missing.select(F.to_json(F.struct("label", "col")).alias("key"), prompt.alias("prompt")), ask)
    pair = F.from_json("key", "label string, col string")
    return told.select(pair["label"].alias("label"), pair["col"].alias("col"), reply_direction(F.coalesce("reply", F.lit(""))).alias("direction"))


def concepts_for(spark: SparkSession, label: str, cache: dict[str, list[str]], ask: Callable[[str], str] | None = None, graph: dict[str, list[str]] | None = None) -> list[str]:
    """Names for a label's concept: from the cache, a model's JSON list, a knowledge graph, or the label alone."""
    import re

    if label in cache:
        return cache[label]
    if ask is not None:
        found = re.search(r"\[.*?\]", ask(f"Column names for the concept '{label}' as a JSON list."), re.S)
        if found:
            try:
                return [label, *[str(x) for x in json.loads(found.group(0))]]
            except ValueError:
                pass
    return [label, *(graph or {}).get(label, [])]
