"""Reading a lake: directories, manifests, nested tables; and the long form that all tables share."""

from __future__ import annotations

import io
import logging
import zipfile
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.numeric import number
from lakeweave.functions.text import table_number
from lakeweave.operators.order import median

_LOG = logging.getLogger(__name__)

MANIFEST = T.StructType([
    T.StructField("version", T.IntegerType()),
    T.StructField("source", T.StringType()),
    T.StructField("tables", T.ArrayType(T.StructType([
        T.StructField("table_id", T.StringType()), T.StructField("n_rows", T.LongType()), T.StructField("n_cols", T.LongType()),
        T.StructField("columns", T.ArrayType(T.StringType())), T.StructField("path", T.StringType()),
    ]))),
])
CELLS = "table_id string, row_id long, col string, value double"
#: cells of columns of numbers have a value, those of columns of words a text
TYPED_CELLS = CELLS + ", text string"
#: a column is one of numbers if this share of its cells are
NUMBERS = 0.5


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """``table_id, n_rows, n_cols, columns, path`` of a manifest file (JSON over several lines)."""
    return spark.read.schema(MANIFEST).json(path, multiLine=True).select(F.explode("tables").alias("t")).select("t.*")


def write_manifest(tables: DataFrame, path: str, source: str = "") -> None:
    """The manifest as one JSON row; Spark's commit makes it appear whole or not at all."""
    row = tables.agg(F.collect_list(F.struct("table_id", "n_rows", "n_cols", "columns", "path")).alias("tables"))
    row.select(F.lit(1).alias("version"), F.lit(source).alias("source"), "tables").coalesce(1).write.mode("overwrite").json(path)


def columns_of(manifest: DataFrame) -> DataFrame:
    """``table_id, pos, name`` from a manifest: all that the concept scan needs, so no table is opened for it."""
    return manifest.select("table_id", F.posexplode("columns").alias("pos", "name"))


def distinct_headers(names: Sequence[str | None]) -> list[str]:
    """Headers that differ: a repeated name gets _1, _2 and so on, an empty one becomes col_<place>."""
    out, seen = [], {}
    for i, n in enumerate(names):
        n = (n or "").strip() or f"col_{i}"
        k = seen.get(n, 0)
        seen[n] = k + 1
        out.append(f"{n}_{k}" if k else n)
    return out


def _cells(name: str, df: pd.DataFrame, with_text: bool = False) -> pd.DataFrame:
    df.columns = distinct_headers([str(c) for c in df.columns])
    there = df.notna().sum()
    wide = df.apply(pd.to_numeric, errors="coerce")
    numbers = [c for c in df.columns if wide[c].notna().sum() >= (NUMBERS * there[c] if with_text else 0) and wide[c].notna().any()]
    long = wide[numbers].assign(row_id=range(len(wide))).melt("row_id", var_name="col", value_name="value").assign(table_id=name)
    if not with_text:
        return long[["table_id", "row_id", "col", "value"]]
    words = [c for c in df.columns if c not in numbers and there[c]]
    said = df[words].assign(row_id=range(len(df))).melt("row_id", var_name="col", value_name="text").assign(table_id=name)
    said["text"] = said["text"].map(lambda x: None if pd.isna(x) else str(x))
    return pd.concat([long.assign(text=None), said.assign(value=float("nan"))])[["table_id", "row_id", "col", "value", "text"]]


def read_directory(spark: SparkSession, path: str, most_rows: int | None = None, with_text: bool = False) -> DataFrame:
    """The cells (``CELLS``) of every CSV and Parquet file of a folder, also inside zip files; table_id is the stem.

    Schemas differ from file to file, so files are read as bytes, one at a time on the executors, and given out in long
    form. Unreadable files are skipped. Text that is no number is missing; ``with_text`` gives TYPED_CELLS, in which columns
    that aren't mostly numbers keep their words.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def tables(name: str, content: bytes) -> Iterator[tuple[str, pd.DataFrame]]:
        stem, _, kind = name.rsplit("/", 1)[-1].rpartition(".")
        try:
            if kind == "zip":
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in sorted(z.namelist()):
                        yield from tables(member, z.read(member))
            elif kind == "csv":
                yield stem, pd.read_csv(io.BytesIO(content))
            elif kind in ("parquet", "pq"):
                yield stem, pd.read_parquet(io.BytesIO(content))
        except Exception as e:  # noqa: BLE001  a broken file of a lake is skipped, whatever is wrong with it
            _LOG.warning("%s is skipped: %s", name, e)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                for stem, df in tables(name, content):
                    yield _cells(stem, df if most_rows is None else df.head(most_rows), with_text)

    if with_text:
        found = files.mapInPandas(run, TYPED_CELLS).withColumn("value", F.nanvl("value", F.lit(None)))
        return found.where("value is not null or text is not null")
    return files.mapInPandas(run, CELLS).where("value is not null")


def unreadable_files(spark: SparkSession, path: str) -> DataFrame:
    """``path, error`` of the files that ``read_directory`` would skip, those of kinds that it doesn't know included."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                kind = name.rsplit(".", 1)[-1]
                try:
                    if kind == "zip":
                        zipfile.ZipFile(io.BytesIO(content)).testzip()
                    elif kind == "csv":
                        pd.read_csv(io.BytesIO(content))
                    elif kind in ("parquet", "pq"):
                        pd.read_parquet(io.BytesIO(content))
                    else:
                        raise ValueError(f"no reader for .{kind}")
                except Exception as e:  # noqa: BLE001  whatever is wrong with it is what is asked for
                    out.append((name, f"{type(e).__name__}: {e}"[:500]))
            yield pd.DataFrame(out, columns=["path", "error"])

    return files.mapInPandas(run, "path string, error string")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE")
    return reader.schema(schema).csv(path) if schema else reader.csv(path)


def to_cells(df: DataFrame, table_id: str, row_id: str, columns: Sequence[str], with_text: bool = False) -> DataFrame:
    """A wide table in long form; missing values have no cell. ``with_text``: TYPED_CELLS, strings being words."""
    if with_text:
        words = {c for c in columns if isinstance(df.schema[c].dataType, T.StringType)}
        none = F.lit(None)
        triples = [F.struct(F.lit(c).alias("col"), (none if c in words else number(c)).cast("double").alias("value"), (F.col(c) if c in words else none).cast("string").alias("text")) for c in columns]
        long = df.select(F.lit(table_id).alias("table_id"), F.col(row_id).cast("long").alias("row_id"), F.explode(F.array(*triples)).alias("p"))
        return long.select("table_id", "row_id", "p.col", "p.value", "p.text").where("value is not null or text is not null")
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), number(c).alias("value")) for c in columns])
    long = df.select(F.lit(table_id).alias("table_id"), F.col(row_id).cast("long").alias("row_id"), F.explode(pairs).alias("p"))
    return long.select("table_id", "row_id", "p.col", "p.value").where("value is not null")


def parse_nested(tables: DataFrame, most_rows: int = 10_000, with_text: bool = False) -> DataFrame:
    """Cells of ``table_id, rows`` (an array of arrays of text, headers first).

    Rows are thinned by a stride to ``most_rows``; columns that are empty or constant, and text, are dropped.
    ``with_text`` gives TYPED_CELLS: columns that aren't mostly numbers keep their words.
    """
    headers = F.udf(distinct_headers, "array<string>")  # once a table
    named = tables.where(F.size("rows") > 1).select("table_id", headers(F.col("rows")[0]).alias("names"), F.slice("rows", 2, F.size("rows")).alias("rows"))
    step = F.greatest(F.lit(1), F.ceil(F.size("rows") / most_rows))
    rows = named.select("table_id", "names", step.alias("step"), F.posexplode("rows").alias("row_id", "r")).where(F.col("row_id") % F.col("step") == 0)
    cells = rows.select("table_id", F.col("row_id").cast("long").alias("row_id"), F.explode(F.arrays_zip(F.col("names").alias("col"), F.col("r").alias("text"))).alias("c"))
    cells = cells.where("c.col is not null").select("table_id", "row_id", "c.col", table_number("c.text").alias("value"), F.nullif(F.trim("c.text"), F.lit("")).alias("text"))
    if with_text:
        full = cells.where("text is not null")
        kinds = full.groupBy("table_id", "col").agg((F.count("value") >= NUMBERS * F.count(F.lit(1))).alias("_num"), F.min("text").alias("a"), F.max("text").alias("b"), F.min("value").alias("c"), F.max("value").alias("d"))
        kinds = kinds.where(F.when(F.col("_num"), F.col("c") < F.col("d")).otherwise(F.col("a") < F.col("b"))).select("table_id", "col", "_num")
        both = full.join(kinds, ["table_id", "col"])
        out = both.select("table_id", "row_id", "col", F.when(F.col("_num"), F.col("value")).alias("value"), F.when(~F.col("_num"), F.col("text")).alias("text"))
        return out.where("value is not null or text is not null")
    cells = cells.drop("text").where("value is not null")
    varied = cells.groupBy("table_id", "col").agg(F.min("value").alias("a"), F.max("value").alias("b")).where("a < b").select("table_id", "col")
    return cells.join(varied, ["table_id", "col"], "left_semi")


def parse_wiki(tables: DataFrame, least_rows: int = 5, least_columns: int = 2, with_text: bool = False) -> DataFrame:
    """Cells of ``table_id, tableHeaders, tableData`` (arrays of cells with a ``text``); short rows are padded with nothing."""
    texts = lambda r: F.transform(r, lambda c: c["text"])
    rows = F.concat(F.array(texts(F.col("tableHeaders")[0])), F.transform("tableData", texts))
    shaped = tables.where((F.size("tableData") >= least_rows) & (F.size(F.col("tableHeaders")[0]) >= least_columns))
    return parse_nested(shaped.select("table_id", rows.alias("rows")), with_text=with_text)


def column_types(cells: DataFrame) -> DataFrame:
    """``table_id, col, is_num``: whether a column's cells are numbers rather than words (all are, where cells have no text)."""
    text = F.col("text") if "text" in cells.columns else F.lit(None).cast("string")
    return cells.groupBy("table_id", "col").agg((F.count("value") >= F.count(text)).alias("is_num"))


def manifest_of(cells: DataFrame) -> DataFrame:
    """A manifest's rows from cells."""
    each = cells.groupBy("table_id", "col").agg(F.countDistinct("row_id").alias("n"))
    rows = cells.groupBy("table_id").agg(F.countDistinct("row_id").alias("n_rows"))
    names = each.groupBy("table_id").agg(F.count(F.lit(1)).alias("n_cols"), F.array_sort(F.collect_list("col")).alias("columns"))
    return rows.join(names, "table_id").select("table_id", "n_rows", "n_cols", "columns", F.lit(None).cast("string").alias("path"))


def within_budget(datasets: DataFrame, size: str, most_bytes: int, order: str) -> DataFrame:
    """The largest datasets (by ``order``) whose sizes add up to the budget."""
    from pyspark.sql import Window

    w = Window.orderBy(F.col(order).desc(), "table_id").rowsBetween(Window.unboundedPreceding, 0)
    return datasets.withColumn("_sum", F.sum(size).over(w)).where(F.col("_sum") <= most_bytes).drop("_sum")


def unlabelled_rows(manifest: DataFrame, cells: DataFrame, target_columns: Sequence[str], least_shared: int = 2, most_tables: int | None = None) -> DataFrame:
    """Cells of all tables that share names with the target (by metadata first), renamed, medians for missing values.
    ``most_tables``, if given, keeps those that share most names."""
    spark = cells.sparkSession
    wanted = spark.createDataFrame([(c, c.strip().lower()) for c in target_columns], "tgt_col string, k string")
    near = columns_of(manifest).withColumn("k", F.lower(F.trim("name"))).join(F.broadcast(wanted), "k").groupBy("table_id").agg(F.countDistinct("k").alias("n"))
    chosen = near.where(F.col("n") >= least_shared)
    chosen = (chosen if most_tables is None else chosen.orderBy(F.col("n").desc(), "table_id").limit(most_tables)).select("table_id")
    renamed = cells.join(chosen, "table_id", "left_semi").withColumn("k", F.lower(F.trim("col"))).join(F.broadcast(wanted), "k")
    wide = renamed.groupBy("table_id", "row_id").agg(*[F.max(F.when(F.col("tgt_col") == c, F.col("value"))).alias(c) for c in target_columns])
    values = wide.select("table_id", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).alias("v")) for c in target_columns])).alias("_p")).select("table_id", "_p.c", "_p.v")
    middle = median(values, "v", ["table_id", "c"]).groupBy("table_id").agg(*[F.max(F.when(F.col("c") == c, F.col("_m"))).alias(f"_m_{c}") for c in target_columns])
    return wide.join(middle, "table_id", "left").select("table_id", "row_id", *[F.coalesce(c, f"_m_{c}").alias(c) for c in target_columns])
