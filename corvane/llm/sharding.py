"""Operator 10, sharding: rendezvous hashing of stable record keys over weighted shards.

Every shard draws a number in (0, 1) for a record from an MD5 of key and shard; the record goes to the shard with
the largest ``-weight / ln(draw)``. Key and shards alone decide, so adding a shard moves records only into it.
Built-in functions only.

Defined cases: a null key hashes as the empty string; a null text has size 1 and the checksum of the empty text;
repeated rows keep a slot each; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, table

#: Records of metadata that one sorting task takes.
ROWS_PER_TASK = 200_000


def rendezvous(key: Column, weights: list[float]) -> Column:
    """Index of the shard that wins ``key``; equal scores go to the larger index."""
    name = F.coalesce(key.cast("string"), F.lit(""))

    def score(i: int, w: float) -> Column:
        draw = F.conv(F.substring(F.md5(F.concat(name, F.lit(f"/{i}"))), 1, 13), 16, 10).cast("double")
        return F.lit(-float(w)) / F.ln((draw + F.lit(0.5)) / F.lit(float(2**52)))

    return F.array_max(F.array(*[F.struct(score(i, w).alias("s"), F.lit(i).alias("i")) for i, w in enumerate(weights)]))["i"]


def assign_shards(df: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", new_weight: float = 1.0) -> DataFrame:
    """Size, checksum, shard, slot and next shard (with one shard more) of every record.

    Slots number each shard's records without gaps. The records' metadata is range-sorted by (shard, key) into
    tasks; a slot is the position in the task plus the count of the shard's records in earlier tasks, so no task
    ever holds a whole shard and the texts are not shuffled.
    """
    spark = df.sparkSession
    # the texts are read once; counting, ranging and numbering read what is written here
    meta = df.select(
        F.col(key).alias(key),
        (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        rendezvous(F.col(key), weights).alias("shard"),
        rendezvous(F.col(key), [*weights, new_weight]).alias("grown_shard"),
    )
    meta = materialise(meta, "shard-records")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-meta.count() // ROWS_PER_TASK))
    order = ["shard", key, "text_crc32", "size"]
    placed = materialise(
        meta.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()),
        "shards",
    )
    placed = placed.withColumn("_task", F.shiftright("_at", 33)).withColumn("_row", F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
    runs = placed.groupBy("shard", "_task").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = Window.partitionBy("shard").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # a range-sorted task starts a new shard at most once per shard: tasks + shards rows bound the broadcast
    runs = runs.select("shard", "_task", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return placed.join(F.broadcast(runs), ["shard", "_task"]).select(
        F.col(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_row") - F.col("_first") + F.col("_base")).cast("long").alias("slot"), "grown_shard",
    )


def op10_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over eight shards of equal weight."""
    return assign_shards(table(spark, sf_dir, "documents"), [1.0] * 8)


def _sql_shard(n: int) -> str:
    scores = ", ".join(
        f"struct_pack(s := -1.0 / ln((('0x' || substr(md5(coalesce(doc_id::varchar, '') || '/{i}'), 1, 13))::bigint::double + 0.5) / {2**52}.0), i := {i})"
        for i in range(n)
    )
    return f"list_max([{scores}]).i::int"


_SQL = f"""
with recursive steps(n, c, k) as (
  select n, n, 0 from range(256) r(n)
  union all
  select n, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from steps where k < 8
), crc as (select list(c order by n) as t from steps where k = 8),
d as (
  select doc_id, coalesce(text, '') as body, {_sql_shard(8)} as shard, {_sql_shard(9)} as grown_shard from documents
), sums as (
  select doc_id, shard, grown_shard, (strlen(body) + 1)::bigint as size,
    xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(strlen(body)), lambda i: ('0x' || substr(hex(encode(body)), 2 * i + 1, 2))::bigint)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295::bigint) as text_crc32
  from d, crc
)
select doc_id, size, text_crc32, 'key' as law, shard,
  (row_number() over (partition by shard order by doc_id, text_crc32, size) - 1)::bigint as slot, grown_shard
from sums
"""

QUERIES = {"op10_rendezvous_shards": op10_rendezvous_shards}
ORACLE_SQL = {"op10_rendezvous_shards": _SQL}
