"""A store of chunks and their lexical index that grows by immutable segments.

Each change is a segment: the chunks it adds, their index, tombstones of chunks that it takes out, and the manifest rows
of the files it is about. The segments of a store are listed in a folder a version; a version counts once its list is
whole, so readers never see half a change. When FAN segments of one level stand at the end they are merged into one of
the next level, so a chunk is rewritten once a level and what is written grows with the change.
"""

from __future__ import annotations

import dataclasses
import functools
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import list_names
from . import index as ix

FAN = 4
_MANIFEST = "source_file string, file_hash string, processed_at timestamp"


@dataclasses.dataclass(frozen=True)
class Segment:
    name: str
    number: int
    level: int


def version(spark: SparkSession, path: str) -> int:
    """The last whole version, 0 if there is none."""
    for name in sorted((n for n in list_names(spark, f"{path}/versions") if n.isdigit()), key=int, reverse=True):
        if "_SUCCESS" in list_names(spark, f"{path}/versions/{name}"):
            return int(name)
    return 0


def segments(spark: SparkSession, path: str, at: int | None = None) -> list[Segment]:
    """The segments of a version, oldest first."""
    at = version(spark, path) if at is None else at
    if not at:
        return []
    return [Segment(r.name, r.number, r.level) for r in spark.read.parquet(f"{path}/versions/{at}").orderBy("number").collect()]


def _commit(spark: SparkSession, path: str, held: list[Segment], at: int) -> None:
    rows = [(s.name, s.number, s.level) for s in held]
    spark.createDataFrame(rows, "name string, number long, level int").coalesce(1).write.mode("overwrite").parquet(f"{path}/versions/{at}")


def _folder(path: str, s: Segment) -> str:
    return f"{path}/segments/{s.name}"


def _union(spark: SparkSession, path: str, held: list[Segment], table: str) -> DataFrame:
    """A table of several segments, with ``range``: the first number of the row's segment."""
    parts = [spark.read.parquet(f"{_folder(path, s)}/{table}").withColumn("range", F.lit(s.number << ix.SEGMENT_BITS).cast("long")) for s in held]
    return functools.reduce(DataFrame.unionByName, parts)


def _live(spark: SparkSession, path: str, held: list[Segment]) -> DataFrame:
    rows = _union(spark, path, held, "chunks")
    gone = spark.read.parquet(*[f"{_folder(path, s)}/gone" for s in held]).select(F.col("doc_id").alias("_g"), "below")
    return rows.join(gone, (F.col("doc_id") == F.col("_g")) & (F.col("range") < F.col("below")), "left_anti").drop("range")


def chunks(spark: SparkSession, path: str) -> DataFrame:
    """All chunks that stand."""
    return _live(spark, path, segments(spark, path))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(source_file, file_hash, processed_at): the last row of each file that isn't a deletion."""
    held = segments(spark, path)
    if not held:
        return spark.createDataFrame([], _MANIFEST)
    return _last(_union(spark, path, held, "manifest")).filter("file_hash is not null")


def _last(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("source_file").orderBy(F.col("range").desc(), F.col("processed_at").desc())
    return rows.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "range")


def lexical(spark: SparkSession, path: str) -> ix.LexicalIndex:
    return ix.LexicalIndex.load(spark, *[_folder(path, s) for s in segments(spark, path)])


def append(spark: SparkSession, path: str, added: DataFrame, gone: DataFrame, rows: DataFrame, fan: int = FAN) -> int:
    """Add a segment and return the new version. ``added``: chunks with doc_id and text; ``gone``: (doc_id, text) of
    chunks that no longer stand; ``rows``: manifest rows, a null file_hash for a file that is deleted."""
    at = version(spark, path)
    held = segments(spark, path, at)
    new = Segment(uuid.uuid4().hex, max([s.number for s in held], default=0) + 1, 0)
    folder = _folder(path, new)
    added.write.parquet(f"{folder}/chunks")
    rows.select("source_file", "file_hash", "processed_at").write.parquet(f"{folder}/manifest")
    ix.write_segment(spark.read.parquet(f"{folder}/chunks").select("doc_id", "text"), folder, new.number, gone)
    held.append(new)
    while len(held) >= fan and len({s.level for s in held[-fan:]}) == 1:
        held[-fan:] = [_merge(spark, path, held[-fan:], first=len(held) == fan)]
    _commit(spark, path, held, at + 1)
    return at + 1


def replace(spark: SparkSession, path: str, added: DataFrame, rows: DataFrame) -> int:
    """A version of one segment that holds ``added`` alone; what stood before is no part of it."""
    at = version(spark, path)
    new = Segment(uuid.uuid4().hex, 1, 0)
    folder = _folder(path, new)
    added.write.parquet(f"{folder}/chunks")
    rows.select("source_file", "file_hash", "processed_at").write.parquet(f"{folder}/manifest")
    ix.write_segment(spark.read.parquet(f"{folder}/chunks").select("doc_id", "text"), folder, new.number)
    _commit(spark, path, [new], at + 1)
    return at + 1


def _merge(spark: SparkSession, path: str, old: list[Segment], first: bool) -> Segment:
    """One segment in place of neighbours. Sums add up; tombstones stay as long as older segments stand (``first``: none do)."""
    new = Segment(uuid.uuid4().hex, old[-1].number + 1, old[-1].level + 1)
    folder, folders = _folder(path, new), [_folder(path, s) for s in old]
    _live(spark, path, old).write.parquet(f"{folder}/chunks")
    last = _last(_union(spark, path, old, "manifest"))
    (last.filter("file_hash is not null") if first else last).write.parquet(f"{folder}/manifest")
    at = {name: spark.read.parquet(*[f"{f}/{name}" for f in folders]) for name in ("terms", "sums", "gone")}
    gone = at["gone"].groupBy("doc_id").agg(F.max("below").alias("below"))
    kept = (at["terms"].groupBy("term").agg(F.sum("df").alias("df")), at["sums"].agg(F.sum("n").alias("n"), F.sum("total").alias("total")), gone.filter(F.lit(not first)))
    ix.write_segment(spark.read.parquet(f"{folder}/chunks").select("doc_id", "text"), folder, new.number, kept=kept)
    return new
