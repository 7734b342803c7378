"""Candidates in their final order: reranking, the contact bonus and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.models import score_pairs
from ..functions.ontology import Ontology

# fixed values: bonuses, words that ask for a contact, and words that name nobody
NAMED, PHONED, BOTH, STAFF_PAGE = 10.0, 6.0, 12.0, 4.0
CONTACT_WORDS = ("telefone", "tel", "ramal", "contato", "numero", "número", "celular", "whatsapp")
NOT_NAMES = (
    "computacao", "computação", "comp", "bcc", "bsi", "departamento", "departamentos", "curso", "cursos", "faculdade", "secao", "seção", "stgp",
    "stf", "dco", "telefone", "telefones", "contato", "contatos", "ramal", "qual", "onde", "email", "e-mail", "numero", "número",
)


def rerank(candidates: DataFrame, scorer=None, limit: int = 40, top_k: int = 8, rank: str = "place") -> DataFrame:
    """The first ``limit`` candidates of each question scored as pairs, the best ``top_k`` with ``final_rank``.

    The limit stands below the scorer, so no more than that many pairs are ever scored.
    """
    w = Window.partitionBy("query_id").orderBy(rank, "doc_id")
    few = candidates.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= limit)
    return order(score_pairs(few, scorer).withColumn("score", T.clean_score(F.col("rerank_score"))), top_k, "_n").drop("_n", "rerank_score")


def by_vector(candidates: DataFrame, top_k: int = 8, rank: str = "place") -> DataFrame:
    """Without a reranker: by vector score, missing ones last."""
    return order(candidates.withColumn("score", F.coalesce("vector_score", F.lit(0.0))), max(1, top_k), rank)


def order(scored: DataFrame, top_k: int, tie: str) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), tie, "doc_id")
    return scored.withColumn("final_rank", F.row_number().over(w)).filter(F.col("final_rank") <= top_k)


def contact_bonus(ranked: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """For questions that ask for a contact: 10 for a text that names the person (else -10), 6 for a phone (else -6),
    12 more for both, 4 for a staff page of a department. Input: query_id, question, text, source, score."""
    aliases = {T.fold_text(a): T.fold_text(b) for b, v in (ontology.aliases if ontology else {}).items() for a in [b, *v]}
    groups: dict[str, list[str]] = {}
    for a, b in aliases.items():
        groups.setdefault(b, []).append(a)
    asking = ranked.select("query_id", "question").distinct().filter(T.contains_any(F.col("question"), CONTACT_WORDS))
    names = F.filter(F.transform(T.candidate_terms(F.col("question")), T.fold), lambda t: (F.length(t) >= 4) & t.rlike(r"^\p{L}+$") & ~t.isin(*map(T.fold_text, NOT_NAMES)))
    # one row a question, joined: the terms are not worked out again for each text
    ranked = ranked.join(asking.select("query_id", names.alias("_terms")), "query_id", "left")
    terms, text = F.coalesce("_terms", F.array().cast("array<string>")), T.fold(F.coalesce("text", F.lit("")))
    named = F.exists(terms, lambda t: text.contains(t))
    for group in groups.values():
        same = F.array(*map(F.lit, group))
        named = named | (F.arrays_overlap(terms, same) & F.exists(same, lambda a: text.contains(a)))
    phone = F.coalesce("text", F.lit("")).rlike(T.PHONE_IN_QUESTION)
    source = F.coalesce("source", F.lit(""))
    bonus = (
        F.when(named, NAMED).otherwise(-NAMED) + F.when(phone, PHONED).otherwise(-PHONED) + F.when(named & phone, BOTH).otherwise(0.0)
        + F.when(source.contains("docentes") & source.contains("dep_"), STAFF_PAGE).otherwise(0.0)
    )
    out = ranked.withColumn("bonus", F.when(F.col("_terms").isNotNull(), bonus).otherwise(0.0)).drop("_terms").withColumn("score", F.col("score") + F.col("bonus"))
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "final_rank")
    return out.withColumn("final_rank", F.row_number().over(w))


def confidence(ranked: DataFrame, questions: DataFrame, threshold: float = 0.32) -> DataFrame:
    """(query_id, confidence, enough) of every question: the best score, logistic outside [0, 1], 0 without one."""
    best = ranked.groupBy("query_id").agg(F.max("score").alias("best"))
    out = questions.select("query_id").join(best, "query_id", "left")
    return out.select("query_id", T.sigmoid_confidence(F.col("best")).alias("confidence")).withColumn("enough", F.col("confidence") >= threshold)
