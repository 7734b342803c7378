"""Operator 7, line dedup: levelled sorted runs of line keys, compacted as they grow.

A run is a table of line keys, bucketed and sorted by key, with the number of documents that hold each and the largest
of their ids. A new batch of documents is merge-joined with the runs, which tells the keys that they lack (``fresh``),
and is added as a run of its own. Once ``fan_in`` runs stand on one level they are merged into one of the next, so a
key is rewritten once a level. Batches may come in any order of ids, and runs may outlive a call and take the batches
of later ones. Built-in functions only.

A line's key is its MD5 after white space at both ends is stripped and A-Z lower-cased; lines shorter than
``min_chars`` code points have none. Keys of ``min_docs`` documents or more lose all lines except those of the
largest document id that holds them.

Defined cases: ids are whole numbers; rows of a batch with one id are one document, held with all their lines; rows
without an id are a document for each different text, and their id is smaller than any, so they keep a key that no other document holds;
ids that come again in a later batch are new documents; a null or empty text is one empty line and keeps it; repeated
rows are treated alike; an empty table gives an empty result; other columns pass through untouched.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, LOWER, UPPER, ascii_lower, free_shuffles, materialise, remove, skew_join, table

MIN_CHARS, MIN_DOCS = 40, 5
#: Batches of a first load, and runs of one level that are merged into one of the next.
BATCHES, FAN_IN = 4, 2


def split_lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keys(text: Column, min_chars: int = MIN_CHARS) -> Column:
    """One key a line, null for lines that are too short."""
    stripped = F.transform(split_lines(text), lambda x: F.when(F.length(x) >= min_chars, F.btrim(x, F.lit(BLANKS))))
    return F.transform(stripped, lambda x: F.when(F.length(x) >= min_chars, F.md5(ascii_lower(x))))


class LineRuns:
    """The levelled runs: ``key`` binary, ``docs`` long, ``keeper`` the largest id, ``fresh`` whether no earlier batch held
    the key. ``names`` are the tables to open the runs with in another session."""

    def __init__(self, spark: SparkSession, buckets: int | None = None, fan_in: int = FAN_IN, levels: list[list[str]] | None = None):
        self.spark, self.fan_in = spark, fan_in
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [list(x) for x in levels or []]

    def _write(self, df: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        df.write.format("parquet").bucketBy(self.buckets, "key").sortBy("key").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def _rows(self, names: list[str]) -> DataFrame:
        # The sum keeps the union from reading columnar batches: Spark 4.1 then takes it for partitioned by key although its
        # partitions are those of the tables end on end, and a group over it leaves a key once a table.
        parts = [self.spark.table(name).withColumn("docs", F.col("docs") + F.lit(0).cast("long")) for name in names]
        return functools.reduce(DataFrame.unionByName, parts)

    @property
    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """One row a key over the given runs."""
        rows = self._rows(names or self.names)
        return rows.groupBy("key").agg(F.sum("docs").alias("docs"), F.max("keeper").alias("keeper"), F.max("fresh").alias("fresh"))

    def add(self, batch: DataFrame) -> int:
        """Add (row, doc_id, keys array) of a batch; the number of its keys that the runs lacked."""
        anonymous = F.when(F.col("doc_id").isNull(), F.col("row"))
        held = batch.select("doc_id", anonymous.alias("row"), F.explode("keys").alias("key")).filter("key is not null").distinct()
        own = held.groupBy(F.unhex("key").alias("key")).agg(F.count("*").alias("docs"), F.max("doc_id").alias("keeper"))
        known = F.lit(False)
        for i, name in enumerate(self.names):
            keys = self.spark.table(name).select(F.col("key").alias(f"_k{i}"))
            own = own.join(keys.hint("merge"), F.col("key") == F.col(f"_k{i}"), "left")
            known = known | F.col(f"_k{i}").isNotNull()
        name = self._write(own.select("key", "docs", "keeper", (~known).alias("fresh")), 0)
        new = self.spark.table(name).filter("fresh").count()
        self._compact()
        return new

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(self.levels[level]) >= self.fan_in:
                old, self.levels[level] = self.levels[level], []
                self._write(self.merged(old), level + 1)
                for name in old:
                    self.spark.sql(f"drop table {name}")
            level += 1

    def drop(self) -> None:
        for name in self.names:
            self.spark.sql(f"drop table if exists {name}")
        self.levels = []


def dedup_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, runs: LineRuns | None = None
) -> DataFrame:
    """``docs`` with ``_n_lines``, ``_n_dropped`` and ``_kept`` (the lines that stay) added.

    ``runs`` of earlier calls count as well: their documents may hold a key's line in place of these, and the runs hold
    this call's keys afterwards. Without any, runs are made for this call and dropped at its end.

    The texts are cut into lines once for the keys and once for the result; what is shuffled in between are keys
    and positions. A first load is dealt to batches by a hash of the id.
    """
    spark = docs.sparkSession
    row = F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit(""))))
    digests = materialise(
        docs.select(
            F.unhex(row).alias("row"), F.col(doc_id).cast("long").alias("doc_id"), line_keys(F.col(text), min_chars).alias("keys"),
            F.pmod(F.xxhash64(F.col(doc_id).cast("long")), F.lit(batches)).cast("int").alias("batch"),
        ).filter(F.exists("keys", lambda k: k.isNotNull())),
        "line-keys", "batch",
    )
    held = runs or LineRuns(spark)
    try:
        for b in range(batches):
            held.add(digests.filter(F.col("batch") == b))
        merged = held.merged()
        total = merged.agg(F.sum("docs")).first()[0] or 0
        hot = materialise(merged.filter(F.col("docs") >= min_docs).select("key", "docs", "keeper"), "hot-lines")
    finally:
        if runs is None:
            held.drop()
    free_shuffles(spark)
    seen = digests.select("row", "doc_id", F.posexplode("keys").alias("pos", "key")).filter("key is not null").withColumn("key", F.unhex("key"))
    hits = skew_join(seen, hot.withColumn("found", F.lit(True)), "key", "docs", total, F.col("row"))
    drops = (
        hits.filter(F.col("found") & F.col("keeper").isNotNull() & F.coalesce(F.col("doc_id") < F.col("keeper"), F.lit(True)))
        .groupBy(F.col("row").alias("_row"))
        .agg(F.collect_set("pos").alias("_drops"))
    )
    drops = materialise(drops, "line-drops")
    remove(digests)
    free_shuffles(spark)
    # only documents that lose lines need to meet their drops; the rest is as before
    lines = split_lines(F.col(text))
    n = F.length(F.coalesce(F.col(text), F.lit(""))) - F.length(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), "\n", "")) + 1
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("_drops")), lambda i: F.get(lines, i)), "\n")
    return (
        docs.withColumn("_row", F.unhex(row))
        .join(drops, "_row", "left")
        .withColumn("_n_lines", n.cast("long"))
        .withColumn("_n_dropped", F.coalesce(F.size("_drops"), F.lit(0)).cast("long"))
        .withColumn("_kept", F.when(F.col("_drops").isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(kept))
        .drop("_row", "_drops")
    )


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents; a digest of what each keeps."""
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"))


_SQL = f"""
with cut as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, i, ls[i] as line from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from cut)),
keyed as (
  select doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') as k from lines
), hot as (
  select k, max(doc_id) as keeper from keyed where length(k) >= {MIN_CHARS} group by k having count(distinct doc_id) >= {MIN_DOCS}
), marked as (select y.doc_id, y.i, y.line, coalesce(y.doc_id < h.keeper, false) as dropped from keyed y left join hot h on y.k = h.k)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (where dropped))::bigint as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from marked group by doc_id
"""

QUERIES = {"op7_line_dedup": op7_line_dedup}
ORACLE_SQL = {"op7_line_dedup": _SQL}
