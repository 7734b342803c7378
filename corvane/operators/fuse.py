"""Ranked lists into one: reciprocal rank fusion or concatenation, a cap by source, and diversity."""

from __future__ import annotations

import heapq
import math

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import spread
from ..shipping import ship


def reciprocal_rank(vector: DataFrame, lexical: DataFrame, k: int = 60) -> DataFrame:
    """(query_id, doc_id, rrf, vector_rank, lexical_rank, fused_rank): sum of 1 / (k + rank) over the lists.

    A union and one aggregation in place of a full outer join. Ties: vector rank, lexical rank, id.
    """
    v = vector.select("query_id", "doc_id", F.col("vector_rank"), F.lit(None).cast("int").alias("lexical_rank"))
    x = lexical.select("query_id", "doc_id", F.lit(None).cast("int").alias("vector_rank"), F.col("lexical_rank"))
    part = F.coalesce(1 / (k + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(1 / (k + F.col("lexical_rank")), F.lit(0.0))
    fused = v.unionByName(x).groupBy("query_id", "doc_id").agg(F.sum(part).alias("rrf"), F.min("vector_rank").alias("vector_rank"), F.min("lexical_rank").alias("lexical_rank"))
    w = Window.partitionBy("query_id").orderBy(F.col("rrf").desc(), F.col("vector_rank").asc_nulls_last(), F.col("lexical_rank").asc_nulls_last(), "doc_id")
    return fused.withColumn("fused_rank", F.row_number().over(w))


def concatenate(vector: DataFrame, lexical: DataFrame) -> DataFrame:
    """The vector list, then what the lexical list adds."""
    v = vector.select("query_id", "doc_id", F.lit(0).alias("list"), F.col("vector_rank").alias("r"))
    x = lexical.select("query_id", "doc_id", F.lit(1).alias("list"), F.col("lexical_rank").alias("r"))
    first = v.unionByName(x).groupBy("query_id", "doc_id").agg(F.min(F.struct("list", "r")).alias("at"))
    w = Window.partitionBy("query_id").orderBy("at", "doc_id")
    return first.select("query_id", "doc_id", F.col("at.list").alias("list"), F.row_number().over(w).alias("fused_rank"))


def cap_by(ranked: DataFrame, limit: int = 2, by: str = "source", rank: str = "fused_rank") -> DataFrame:
    """At most ``limit`` rows of each source and question, the best first; ``place`` counts what is left."""
    w = Window.partitionBy("query_id", by).orderBy(rank)
    kept = ranked.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit).drop("_n")
    return kept.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(rank)))


def mmr_order(relevance: list[float], texts: list[str], k: int, lam: float) -> list[int]:
    """Positions chosen one by one by lam * relevance - (1 - lam) * likeness to what is chosen; the first of equals.

    Likeness to more of the chosen only lowers a value, so a text is compared with the others of them only while it would
    be the next.
    """
    from ..functions.fuzzy import words_ratio

    lam = min(1.0, lam)
    if len(relevance) <= k or lam <= 0:
        return list(range(len(relevance)))
    words = [set(t.split()) for t in texts]
    chosen: list[int] = []
    # negative value so far, position, likeness so far, with how many of the chosen
    left = [(-(lam * r - (1 - lam) * 0.0), i, 0.0, 0) for i, r in enumerate(relevance)]
    heapq.heapify(left)
    while left and len(chosen) < k:
        _, i, like, met = heapq.heappop(left)
        if met == len(chosen):
            chosen.append(i)
        else:
            like = max(like, words_ratio(words[i], words[chosen[met]]) / 100)
            heapq.heappush(left, (-(lam * relevance[i] - (1 - lam) * like), i, like, met + 1))
    return chosen


def diversify(ranked: DataFrame, k: int, lam: float = 0.3, lam_short: float = 0.25) -> DataFrame:
    """The best ``k`` of each question by maximal marginal relevance, with ``mmr_rank``.

    Input: query_id, question, doc_id, text, vector_score, lexical_score, place; a question has as many rows as its
    lists were cut to, so a group is bounded. Relevance is log1p of the vector score, or of the lexical score where
    there is none; questions of six words or fewer use the smaller weight.
    """
    from ..functions import text as T

    ship(ranked.sparkSession)
    rows = ranked.select(
        "query_id", "doc_id", "place", T.fold(F.coalesce("text", F.lit(""))).alias("t"),
        F.when(F.coalesce("vector_score", F.lit(0.0)) > 0, F.col("vector_score")).otherwise(F.coalesce("lexical_score", F.lit(0.0))).alias("s"),
        T.diversity_weight(F.col("question"), lam, lam_short).alias("lam"),
    )

    def choose(part: pa.Table) -> pa.Table:
        part = part.sort_by("place")
        relevance = [math.log1p(max(0.0, s)) for s in part.column("s").to_pylist()]
        at = mmr_order(relevance, part.column("t").to_pylist(), k, part.column("lam")[0].as_py())
        return part.select(["query_id", "doc_id"]).take(at).append_column("mmr_rank", pa.array(range(1, len(at) + 1), pa.int32()))

    kinds = dict(ranked.dtypes)
    return spread(rows, "query_id").groupBy("query_id").applyInArrow(choose, f"query_id {kinds['query_id']}, doc_id {kinds['doc_id']}, mmr_rank int")
