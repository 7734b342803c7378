"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and works on all rows that the one before kept; all but the last return the
columns of ``documents``. Null and empty texts have no language and leave in the first stage; an empty table passes
through as an empty table. Repeated rows are near-copies of each other, and one stays; of a group of near-copies the
smallest id stays, of rows that share it the one whose hash of id and text is least. Null ids come after all others.
Columns may have any names: stages carry them as one, and the last stage's own columns get an underscore where a name
is taken. ``ORACLE_SQL`` is None: SQL has no SimHash or Viterbi; each stage is tested against brute force instead.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm import decontaminate, language_id, line_dedup, pieces, simhash
from corvane.llm.common import free_name, shared_path, table


def pack(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns as one, so that no name of theirs meets a name that an operator uses."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", F.struct(*rest).alias("rest") if rest else F.lit(None).alias("rest"))


def unpack(rows: DataFrame, docs: DataFrame, **put: Column) -> list[Column]:
    """The columns of ``docs`` out of packed rows; ``put`` replaces some."""
    own = {"doc_id": F.col("doc_id"), "text": F.col("text")} | put
    return [(own[c] if c in own else F.col("rest").getField(c)).alias(c) for c in docs.columns]


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents whose language is rejected."""
    model = language_id.train(docs, F.lit(True))
    out = language_id.identify(pack(docs), model, accepted_only=True)
    return out.select(*unpack(out, docs))


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents repeat; documents stay, with what is left of their text."""
    out = line_dedup.dedup_lines(pack(docs)).withColumn("text", F.when(F.col("text").isNotNull(), F.col("_kept")))
    size = {"n_chars": F.length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.select(*unpack(out, docs, **size))


def stage_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near-copies."""
    out = simhash.keep_one(pack(docs))
    return out.select(*unpack(out, docs))


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    out = decontaminate.find_items(pack(docs), table(spark, sf_dir, "benchmark"), clean_only=True)
    return out.select(*unpack(out, docs))


def stage_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode each text into piece ids; ``text`` is what they decode to. Adds ``piece_ids``, ``n_pieces`` and ``exact``."""
    out = pieces.encode_texts(pack(docs))
    added = {"piece_ids": F.col("_ids"), "n_pieces": F.size("_ids").cast("long"), "exact": F.col("_exact")}
    return out.select(*unpack(out, docs, text=F.col("_decoded")), *[v.alias(free_name(docs, k)) for k, v in added.items()])


STAGES = [
    ("language", stage_language),
    ("lines", stage_lines),
    ("near_copies", stage_near_copies),
    ("benchmark", stage_benchmark),
    ("pieces", stage_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to shared storage and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
