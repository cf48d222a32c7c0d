"""What the corpus operators share: words, shared storage, row positions and joins that survive hot keys."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: a word is a run of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"
#: a key counts as hot when it holds more than this share of the rows, so at most 1 / HOT_SHARE keys are hot
HOT_SHARE = 0.001


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session on one machine
    (a ``local`` master, as in tests) gets a new folder; on a cluster that is an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lakeweave-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path under the shared folder, in a folder of this application that is removed when the driver ends."""
    top = f"{shared_dir(spark)}/lakeweave-{spark.sparkContext.applicationId}"
    if top not in _swept:
        _swept.add(top)
        atexit.register(remove, spark, top)
    return f"{top}/{what}-{uuid.uuid4().hex}"


_swept: set[str] = set()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, if Spark still runs."""
    if spark.sparkContext._jsc is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame, what: str = "rows") -> DataFrame:
    """The rows, written once to the shared folder and read from there: lineage ends, and lost executors cost nothing."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def forget(*cuts: DataFrame) -> None:
    """Deletes what ``cut`` wrote for these frames, once nothing reads them any more."""
    for df in cuts:
        remove(df.sparkSession, df._cut_path)


def release(spark: SparkSession) -> None:
    """Has the driver collect its garbage, upon which Spark deletes the shuffle files of frames that nobody holds any more.
    Otherwise they stay until the driver's memory runs short, which may be after many times the input was shuffled."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def small_batches(spark: SparkSession, rows: int = 2000, most_bytes: int = 8_000_000) -> None:
    """Bounds Arrow batches of whole texts by rows and by bytes, so that a batch of very long texts stays small (a
    single longer text is a batch of its own). Lower settings of the session stay."""
    for name, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", most_bytes)):
        now = int(spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", most)


def fresh(*taken: str) -> Callable[[str], str]:
    """Names that clash with none of ``taken`` (compared as Spark does, without case): ``fresh(*df.columns)("size")``."""
    low = {c.lower() for c in taken}

    def name(wanted: str) -> str:
        while wanted.lower() in low:
            wanted = f"_{wanted}"
        low.add(wanted.lower())
        return wanted

    return name


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, everything else as it is."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def word_count(text: Column) -> Column:
    """Words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_order(df: DataFrame, *by: Column) -> DataFrame:
    """Rows with ``position``: gapless from 0 in the order of ``by``, without a single-task sort.

    Range-partitioned and sorted; each partition counts its rows, and the
    positions before it are a prefix sum over those counts (one per partition).
    Both the rows (unless they are a ``cut``) and the sorted rows are written, so that sampling for the ranges
    computes nothing twice and the counts are those of the rows.
    Ties get positions in any order; give a unique key last for a fixed one.
    """
    spark = df.sparkSession
    rows = cut((df if hasattr(df, "_cut_path") else cut(df)).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = rows.groupBy(part.alias("p")).count().collect()
    base, total = {}, 0
    for p, n in sorted((r["p"], r["count"]) for r in counts):
        base[p] = total
        total += n
    if not base:
        return rows.withColumn("position", F.lit(0).cast("long")).drop("_at")
    bases = spark.createDataFrame(list(base.items()), "_p long, _base long")
    local = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return rows.withColumn("_p", part).join(F.broadcast(bases), "_p").withColumn("position", F.col("_base") + local).drop("_p", "_base", "_at")


def join_hot(rows: DataFrame, keyed: DataFrame, on: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined to one row per key, where ``size`` counts the rows of a key and one key may hold a third of them.

    Keys over HOT_SHARE of ``total`` rows are at most 1 / HOT_SHARE in number: they are broadcast, and their rows
    never move. The rest meets by an ordinary join, in which no key has more than HOT_SHARE of the rows.
    Both frames may have any other columns, but none in common.
    """
    hot = F.col(size) > max(1, int(total * HOT_SHARE))
    others = [c for c in keyed.columns if c not in on]
    named = fresh(*rows.columns, *keyed.columns)
    mark, alias = named("hot"), {c: named(f"h_{c}") for c in keyed.columns}
    few = F.broadcast(keyed.where(hot).select(*[F.col(c).alias(alias[c]) for c in keyed.columns], F.lit(True).alias(mark)))
    condition = F.lit(True)
    for c in on:
        condition = condition & (F.col(c) == F.col(alias[c]))
    both = rows.join(few, condition, "left")
    first = both.where(F.col(mark)).select(*rows.columns, *[F.col(alias[c]).alias(c) for c in others])
    rest = both.where(F.col(mark).isNull()).select(*rows.columns)
    return first.unionByName(rest.join(keyed.where(~hot), on, how).select(*first.columns))


def running(*by: Column) -> Window:
    return Window.orderBy(*by).rowsBetween(Window.unboundedPreceding, Window.currentRow)
