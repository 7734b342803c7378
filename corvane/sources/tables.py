"""The two tables behind ingest, and the relations that keep them in step with a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import settle

CHUNKS = "id int, source_file string, chunk_text string, faiss_index long, created_at timestamp"
MANIFEST = "id int, source_file string, file_hash string, processed_at timestamp"


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path)
    if jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def diff(disk: DataFrame, manifest: DataFrame) -> DataFrame:
    """(source_file, status): new, deleted, modified or unchanged. Both sides: source_file, file_hash."""
    d, m = disk.select("source_file", F.col("file_hash").alias("d")), manifest.select("source_file", F.col("file_hash").alias("m"))
    status = F.when(F.col("m").isNull(), "new").when(F.col("d").isNull(), "deleted").when(F.col("d") != F.col("m"), "modified").otherwise("unchanged")
    return d.join(m, "source_file", "full_outer").select("source_file", status.alias("status"))


def upsert(manifest: DataFrame, incoming: DataFrame) -> DataFrame:
    """The latest row of each source_file; incoming rows win over equal times."""
    both = manifest.withColumn("_new", F.lit(0)).unionByName(incoming.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    w = Window.partitionBy("source_file").orderBy(F.col("processed_at").desc_nulls_last(), F.col("_new").desc())
    return both.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r", "_new")


def without(rows: DataFrame, keys: DataFrame, key: str = "source_file") -> DataFrame:
    return rows.join(keys.select(key).distinct(), key, "left_anti")


def number_rows(df: DataFrame, order: list[str], name: str = "faiss_index", start: int = 0) -> DataFrame:
    """Gapless numbers in ``order`` without one task that holds all rows: rows are range-sorted, a row's number is its
    place in its task plus the rows of earlier tasks."""
    spark = df.sparkSession
    placed = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    placed = settle(placed, "numbered")
    sizes = placed.groupBy(F.shiftright("_at", 33).alias("_task")).agg(F.count("*").alias("_n")).collect()  # a row a task
    base, rows = start, []
    for r in sorted(sizes, key=lambda r: r["_task"]):
        rows.append((r["_task"], base))
        base += r["_n"]
    bases = spark.createDataFrame(rows, "_task long, _base long")
    out = placed.withColumn("_task", F.shiftright("_at", 33)).join(F.broadcast(bases), "_task")
    return out.withColumn(name, F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_task", "_base", "_at")


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str] | None = None) -> DataFrame:
    """A table of a database, for those who keep the manifest in one."""
    return spark.read.jdbc(url, table, properties=properties or {})
