"""Incremental ingest: a stream of landed files, deduplicated by content and upserted batch by batch.

Soft deletion needs the complete key set of a run and is never done in a
micro-batch. Windows over events at the end are an extra of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarry.plans.engine import Engine

LANDED = "source_id bigint, version_label string, path string, uri string, title string, content string, content_type string"


def landed(spark: SparkSession, folder: str) -> DataFrame:
    """Landed rows with the time of their file, then their content's hash, as the order of rows of one path."""
    rows = spark.readStream.schema(LANDED).parquet(folder)
    return rows.select("*", F.struct(F.col("_metadata.file_modification_time").alias("at"), F.sha2("content", 256).alias("hash")).alias("landed"))


def ingest_stream(spark: SparkSession, engine: Engine, folder: str, checkpoint: str, prefix: list[str]) -> StreamingQuery:
    """Upserts everything that has landed since the last run, then stops; of rows of one path the last landed. Replayed batches change nothing."""

    def upsert(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        for row in batch.select("source_id", "version_label").distinct().collect():  # sources of one batch
            own = batch.filter((F.col("source_id") == row.source_id) & (F.col("version_label") == row.version_label))
            engine.ingest(own.drop("source_id", "version_label"), row.source_id, row.version_label, prefix, complete=False, latest="landed")
        batch.unpersist()

    return landed(spark, folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def event_counts(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total): tumbling windows over events (ts, event_type, value), late rows up to ``delay``."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type")
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
