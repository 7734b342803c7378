"""Streaming forms of ingest and telemetry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import upsert


def event_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """JSON lines as they arrive below a folder."""
    return spark.readStream.schema(schema).json(folder)


def rate_alerts(events: DataFrame, minutes: int = 5, more_than: int = 3, late: str = "10 minutes", ts: str = "ts", kind: str = "event_type") -> DataFrame:
    """Windows in which a kind of event came more often than allowed; rows later than ``late`` are left out."""
    w = events.withWatermark(ts, late).groupBy(F.window(ts, f"{minutes} minutes").alias("w"), kind).agg(F.count("*").alias("n"))
    return w.filter(F.col("n") > more_than).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), kind, "n")


def append_events(events: DataFrame, path: str, checkpoint: str):
    return events.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def ingest_stream(spark: SparkSession, folder: str, checkpoint: str, manifest: Callable[[], DataFrame], save: Callable[[DataFrame], None]):
    """New and changed files into a manifest: each batch is upserted by its content hash."""
    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    rows = files.select(F.col("path").alias("source_file"), F.sha2("content", 256).alias("file_hash"), F.col("modificationTime").alias("processed_at"))
    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: save(upsert(manifest(), batch)))


def ingest_folder_stream(spark: SparkSession, folder: str, path: str, checkpoint: str, **options):
    """Files that arrive below ``folder`` into chunks, vectors and index tables under ``path``: a batch reads its own new files
    and adds one segment (``options`` as for :func:`corvane.plans.ingest.add`). A batch that comes again after a restart
    finds its files held and changes nothing."""
    from ..plans import ingest
    from ..sources.files import scanned

    files = spark.readStream.format("binaryFile").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(folder)
    return files.select("path", "content").writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: ingest.add(spark, scanned(batch), path, **options) and None)
