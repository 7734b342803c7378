"""What the operators share: tables, shared storage, ASCII folding and joins that survive hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..shared import shared_path
from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: The ASCII white space ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"
#: Most rows that :func:`skew_join` broadcasts.
HEAVY_KEYS = 1024
_BYTES_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, label: str, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` to shared storage and read it back: the lineage is cut and a lost executor loses nothing."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, label)
    writer = df.write
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files below a table made by :func:`materialise`."""
    spark, files = df.sparkSession, df.inputFiles()
    for folder in {f.split("/part-")[0] for f in files}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished jobs now, not at the driver's next garbage collection."""
    import gc

    gc.collect()
    spark._jvm.System.gc()


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only. An all-ASCII string takes the fast built-in, which does the same there."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def ascii_lower_bytes(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass").translate(_BYTES_LOWER)


def crc_mod(c: Column, n: int) -> Column:
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % n


def draw(rows: DataFrame, by: str, key: str, bound: int) -> DataFrame:
    """At most ``bound`` different keys of each value of ``by``, those least by a hash of ``key``; ``by`` holds a model's
    classes, so few values. One row a key, however often it is repeated.

    The classes' counts give each a share of the hash range that holds about twice the bound. Where repeated keys leave
    too few in it, the share grows and the rows are read again, so what comes to the driver stays near the bound.
    """
    whole, place = 1 << 30, F.pmod(F.xxhash64(key), F.lit(1 << 30))
    share = {value: min(whole, -(-2 * bound * whole // n)) for value, n in rows.groupBy(by).count().collect() if value is not None}
    drawn: dict = {}
    while share:
        chosen = F.lit(False)
        for value, s in share.items():
            chosen = chosen | ((F.col(by) == F.lit(value)) & (place < s))
        found: dict = {value: [] for value in share}
        for r in rows.filter(chosen).select(F.col(by).alias("b"), place.alias("p"), F.col(key).alias("k")).distinct().toLocalIterator():
            found[r.b].append((r.p, r.k))
        drawn |= {value: [k for _, k in sorted(xs)[:bound]] for value, xs in found.items()}
        share = {value: min(whole, 4 * s) for value, s in share.items() if s < whole and len(found[value]) < bound}
    schema = StructType([rows.schema[by], rows.schema[key]])
    return rows.sparkSession.createDataFrame([(value, k) for value, ks in drawn.items() for k in ks], schema)


def skew_join(rows: DataFrame, lookup: DataFrame, key: str, weight: str, total: int, spread: Column) -> DataFrame:
    """Left-join ``rows`` with ``lookup`` (unique ``key``; other columns new) where keys may be hot.

    ``weight`` is the number of rows that hold the key, at most ``total`` over all keys, so at most HEAVY_KEYS
    keys can reach ``total / HEAVY_KEYS`` rows: those go by a broadcast of that proven size. The rest meet in a
    shuffle where no key has more rows than that; rows already answered are spread over it by ``spread``.
    """
    bar = max(1.0, total / HEAVY_KEYS)
    values = [c for c in lookup.columns if c not in (key, weight)]
    heavy = lookup.filter(F.col(weight) > bar).select(F.col(key).alias("_hk"), F.struct(*values).alias("_hv"))
    # zero, but no literal: the optimiser would take a literal for a filter and deal the rows by the key alone
    zero = F.pmod(F.xxhash64(key), F.lit(1).cast("long"))
    light = lookup.filter(F.col(weight) <= bar).select(F.col(key).alias("_lk"), zero.alias("_ls"), F.struct(*values).alias("_lv"))
    out = rows.join(F.broadcast(heavy), F.col(key) == F.col("_hk"), "left").withColumn(
        "_salt", F.when(F.col("_hk").isNull() & F.col(key).isNotNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(spread))
    )
    out = out.join(light, (F.col(key) == F.col("_lk")) & (F.col("_salt") == F.col("_ls")), "left")
    picked = F.coalesce("_hv", "_lv")
    return out.select(*[F.col(c) for c in rows.columns], *[picked[c].alias(c) for c in values])


#: Rows and bytes of an Arrow batch where the session leaves Spark's defaults in place.
BATCH_ROWS, BATCH_BYTES = 2000, 32 << 20


def map_arrow(df: DataFrame, fn, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with batches small enough, by rows and by bytes, that very long texts stay in memory. The session's
    batch options are set if they have their default values; a choice of the user's own stands."""
    ship(df.sparkSession)
    for name, default, value in (("maxRecordsPerBatch", "10000", BATCH_ROWS), ("maxBytesPerBatch", "67108864b", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        if df.sparkSession.conf.get(name, default) in (None, default):
            df.sparkSession.conf.set(name, str(value))
    return df.mapInArrow(fn, schema)


def with_columns(df: DataFrame, added: str) -> StructType:
    """The schema of ``df`` with the columns of the DDL string ``added`` behind it."""
    return StructType([*df.schema.fields, *(StructType.fromDDL(added).fields if added else [])])


def free_name(df: DataFrame, base: str) -> str:
    """``base``, made longer until ``df`` has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base
