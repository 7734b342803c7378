"""Quality of retrieval: hits against gold passages, nDCG, MRR and recall."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def judge(predictions: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, pos, hit): whether a prediction (query_id, pos from 1, text) holds any gold text of the question."""
    golds = gold.select("query_id", F.transform("ground_truth", T.fold_ascii).alias("g"))
    text = T.fold_ascii(F.coalesce("text", F.lit("")))
    return predictions.join(golds, "query_id").select("query_id", "pos", F.exists("g", lambda g: text.contains(g)).alias("hit"))


def metrics(judged: DataFrame, ndcg_k: int = 5, mrr_k: int = 10, recall_k: int = 5) -> DataFrame:
    """(query_id, ndcg, mrr, recall) of each question. The ideal order has all hits of the list in front."""
    gain = F.when(F.col("hit") & (F.col("pos") <= ndcg_k), 1 / F.log2(F.col("pos") + 1.0)).otherwise(0.0)
    out = judged.groupBy("query_id").agg(
        F.sum(gain).alias("dcg"), F.count_if("hit").alias("hits"), F.min(F.when(F.col("hit") & (F.col("pos") <= mrr_k), F.col("pos"))).alias("first"),
        F.max(F.when(F.col("hit") & (F.col("pos") <= recall_k), 1.0).otherwise(0.0)).alias("recall"),
    )
    most = F.least(F.col("hits"), F.lit(ndcg_k)).cast("int")
    ideal = F.aggregate(F.when(most > 0, F.sequence(F.lit(1), most)).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    return out.select("query_id", F.when(ideal > 0, F.col("dcg") / ideal).otherwise(0.0).alias("ndcg"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("mrr"), "recall")


def summarise(per_question: DataFrame) -> DataFrame:
    """Means over the questions, rounded to four places, 0 without any."""
    return per_question.agg(*[F.round(F.coalesce(F.avg(c), F.lit(0.0)), 4).alias(c) for c in per_question.columns if c != "query_id"])


def reference_text(gold: DataFrame) -> DataFrame:
    """(query_id, reference): the gold texts that aren't blank, one a line."""
    return gold.select("query_id", F.array_join(F.filter("ground_truth", lambda g: F.trim(g) != ""), "\n").alias("reference"))
