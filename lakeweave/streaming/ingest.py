"""Tables that arrive: files into the lake's cells, and labels over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lakeweave.sources.lake import manifest_of, parse_nested


def ingest_tables(spark: SparkSession, path: str, out: str, checkpoint: str) -> StreamingQuery:
    """Nested tables (JSON lines of ``table_id, rows``) into ``out/cells`` and ``out/manifest``, each file once.

    What is there is taken and the query ends; the checkpoint lets the next run go on where this one ended. A batch
    that is repeated overwrites its own folder, so a restart leaves nothing twice.
    """
    stream = spark.readStream.schema("table_id string, rows array<array<string>>").json(path)

    def keep(batch: DataFrame, number: int) -> None:
        cells = parse_nested(batch)
        cells.write.mode("overwrite").parquet(f"{out}/cells/batch={number}")
        manifest_of(batch.sparkSession.read.parquet(f"{out}/cells/batch={number}")).write.mode("overwrite").parquet(f"{out}/manifest/batch={number}")

    return stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrival_counts(events: DataFrame, window: str = "1 day", late: str = "1 day") -> DataFrame:
    """Rows and mean value per type and window of event time; for a stream, with a watermark for late rows.

    The same function runs over a batch table.
    """
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    out = rows.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")
