"""A folder into chunks, vectors and index tables: from nothing, or only what has changed.

The tables are segments (:mod:`corvane.operators.segments`): a change writes the chunks of its own files and their
postings, and tombstones of what they replace; nothing else is rewritten until segments are merged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.models import embed_texts
from ..functions.ontology import Ontology
from ..operators import cache, chunking, segments
from ..operators.segments import chunks, lexical, manifest, version
from ..shared import settle
from ..sources import files, tables

__all__ = ["chunks", "forget", "lexical", "manifest", "rebuild", "update", "version"]


def _chunks(found: DataFrame, settings: Settings, ontology: Ontology | None, embedder) -> DataFrame:
    docs = files.load(found).filter("error is null and trim(text) <> ''").withColumn("text", T.repair(F.col("text")))
    out = chunking.chunk(docs.select("source", "url", "text"), settings, ontology)
    return embed_texts(out.withColumn("doc_id", F.xxhash64("source", "chunk")), embedder)


def _manifest(found: DataFrame) -> DataFrame:
    return found.select(F.col("source").alias("source_file"), "file_hash", F.current_timestamp().alias("processed_at"))


def rebuild(spark: SparkSession, folder: str, path: str, settings: Settings | None = None, ontology: Ontology | None = None, embedder=None, cache_path: str | None = None) -> None:
    """A version that holds the folder as it is, in one segment."""
    # the folder is read once: manifest and chunks agree whatever changes meanwhile
    found = settle(files.scan(spark, folder), "files")
    segments.replace(spark, path, _chunks(found, settings or Settings(), ontology, embedder), _manifest(found))
    forget(spark, cache_path)


def forget(spark: SparkSession, cache_path: str | None) -> None:
    """Drop the cached answers of queries and agents below ``cache_path``: the index that they came from is replaced."""
    if cache_path:
        held = settle(cache.invalidate(cache.invalidate(tables.read_or_empty(spark, cache_path, cache.SCHEMA), "query")[0], "agent")[0], "cache")
        held.write.mode("overwrite").parquet(cache_path)


def update(spark: SparkSession, folder: str, path: str, settings: Settings | None = None, ontology: Ontology | None = None, embedder=None, cache_path: str | None = None) -> dict[str, int]:
    """Bring the tables up to date with the folder; counts of files by status. Nothing is written if nothing changed; else
    a segment is added and cached answers below ``cache_path`` are dropped."""
    if not version(spark, path):
        rebuild(spark, folder, path, settings, ontology, embedder, cache_path)
        return {"new": manifest(spark, path).count()}
    # listed and hashed once: the contents of changed files are read from what is written here
    found = settle(files.scan(spark, folder), "files")
    return _apply(spark, path, found, manifest(spark, path), settings, ontology, embedder, cache_path)


def add(spark: SparkSession, found: DataFrame, path: str, settings: Settings | None = None, ontology: Ontology | None = None, embedder=None, cache_path: str | None = None) -> dict[str, int]:
    """Bring the tables up to date with some files (as :func:`corvane.sources.files.scanned` gives them) and leave all others
    as they are: what is read and written grows with these files. Files that are held already change nothing."""
    found = settle(found, "files")
    known = manifest(spark, path).join(found.select(F.col("source").alias("source_file")), "source_file", "left_semi")
    return _apply(spark, path, found, known, settings, ontology, embedder, cache_path)


def _apply(spark: SparkSession, path: str, found: DataFrame, known: DataFrame, settings: Settings | None, ontology: Ontology | None, embedder, cache_path: str | None) -> dict[str, int]:
    """A segment of what differs between ``found`` and the manifest rows ``known``."""
    status = settle(tables.diff(found.select(F.col("source").alias("source_file"), "file_hash"), known), "status")
    counts = {r.status: r["n"] for r in status.groupBy("status").agg(F.count("*").alias("n")).collect()}
    if set(counts) <= {"unchanged"}:
        return counts
    changed, out = status.filter("status in ('new', 'modified')"), status.filter("status in ('deleted', 'modified')")
    fresh = found.join(changed.select(F.col("source_file").alias("source")), "source", "left_semi")
    if version(spark, path):
        gone = chunks(spark, path).select("doc_id", "text", "source").join(out.select(F.col("source_file").alias("source")), "source", "left_semi").drop("source")
    else:
        gone = spark.createDataFrame([], "doc_id long, text string")
    deleted = status.filter("status = 'deleted'").select("source_file", F.lit(None).cast("string").alias("file_hash"), F.current_timestamp().alias("processed_at"))
    segments.append(spark, path, _chunks(fresh, settings or Settings(), ontology, embedder), settle(gone, "gone"), _manifest(fresh).unionByName(deleted))
    forget(spark, cache_path)
    return counts
