"""Questions to answers in one plan: retrieve, fuse, cap, diversify, rank, gate, cite."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.models import embed_texts
from ..functions.ontology import Ontology
from ..operators import answer as A
from ..operators import fuse, people, rank, retrieve
from ..operators.fuzzy_search import LIMIT, SentenceIndex, fuzzy_top
from ..operators.index import LexicalIndex
from ..shared import settle


@dataclasses.dataclass
class Corpus:
    """chunks (doc_id, source, chunk, text, sector_slug, emails, phones), their vectors (doc_id, embedding) and index."""

    chunks: DataFrame
    vectors: DataFrame
    index: LexicalIndex
    ontology: Ontology = dataclasses.field(default_factory=Ontology)
    sentences: SentenceIndex | None = None  # where it is given, questions without a word hit are searched fuzzily


def retrieve_round(questions: DataFrame, corpus: Corpus, settings: Settings, embedder=None, model=None, scorer=None, lexical: DataFrame | None = None) -> DataFrame:
    """query_id, question, doc_id, source, chunk, text, vector_score, lexical_score, score, final_rank, ..."""
    if lexical is None:
        lexical = settle(lexical_hits(questions, corpus, settings), "lexical")
    variants = retrieve.question_variants(questions, corpus.ontology, settings.mq_variants, model)
    rows = variants.select("query_id", F.posexplode("variants").alias("variant", "vtext"))
    asked = embed_texts(rows, embedder, "vtext", "qvec").select("query_id", "variant", "qvec")
    near = retrieve.vector_top(asked, corpus.vectors, retrieve.per_variant(settings, settings.mq_variants))
    near = settle(retrieve.merge_variants(near, settings.fetch_k), "near")
    near = retrieve.boost(near.join(corpus.chunks.select("doc_id", "sector_slug"), "doc_id"), questions, corpus.ontology).drop("sector_slug", "vector_rank")
    near = retrieve.top(near, settings.fetch_k, "vector_score", name="vector_rank")
    fused = (
        fuse.reciprocal_rank(near, lexical, settings.rrf_k)
        if settings.fuse_rrf
        else fuse.concatenate(near, lexical)
    )
    fused = fused.select("query_id", "doc_id", "fused_rank")
    full = fused.join(corpus.chunks, "doc_id").join(near.select("query_id", "doc_id", "vector_score"), ["query_id", "doc_id"], "left")
    full = full.join(lexical.select("query_id", "doc_id", F.col("score").alias("lexical_score")), ["query_id", "doc_id"], "left")
    capped = fuse.cap_by(full, settings.max_per_source).join(questions.select("query_id", "question"), "query_id")
    capped = settle(capped, "candidates")
    chosen = fuse.diversify(capped, max(settings.top_k, settings.fetch_k), settings.mmr_lambda, settings.mmr_lambda_short)
    kept = capped.drop("place").join(chosen.withColumnRenamed("mmr_rank", "place"), ["query_id", "doc_id"])
    ranked = rank.rerank(kept, scorer, settings.rerank_candidates, settings.rerank_top_k) if scorer else rank.by_vector(kept, settings.top_k)
    return rank.contact_bonus(ranked, corpus.ontology)


def lexical_hits(questions: DataFrame, corpus: Corpus, settings: Settings) -> DataFrame:
    best = retrieve.top(retrieve.bm25_best(questions, corpus.index, settings.fetch_k), settings.fetch_k, name="lexical_rank").drop("lexical_rank")
    best = retrieve.department_bonus(best, questions, corpus.chunks, corpus.ontology, settings.dept_bonus)
    best = retrieve.top(best, settings.fetch_k, name="lexical_rank")
    if corpus.sentences is None:
        return best
    best = settle(best, "lexical")
    rest = questions.join(best.select("query_id").distinct(), "query_id", "left_anti")
    fuzzy = fuzzy_top(rest, corpus.chunks, corpus.sentences, corpus.ontology, settings.lexical_threshold, min(LIMIT, settings.fetch_k), settings.dept_bonus)
    return best.unionByName(fuzzy.withColumnRenamed("rank", "lexical_rank").select(*best.columns))


def answer(questions: DataFrame, corpus: Corpus, settings: Settings | None = None, embedder=None, model=None, scorer=None) -> DataFrame:
    """One row a question: answer, citations, context_found, confidence, needs_clarification, route.

    A question for a known person's contact is answered from the contact index. The others are retrieved; those with
    little confidence are retrieved once more with an expanded question, which is taken where it does better.
    """
    settings = settings or Settings()
    contacts, aliases = people.contact_index(corpus.chunks, corpus.ontology)
    known = people.contact_answer(people.lookup(questions, contacts, aliases))
    direct = known.select("query_id", "answer", "citations", F.lit(True).alias("context_found"), "confidence", F.lit(False).alias("needs_clarification"), "route")
    rest = questions.join(known.select("query_id"), "query_id", "left_anti")
    rest = settle(rest, "questions")

    # what several branches below read is written; it is a few rows a question
    lexical = settle(lexical_hits(rest, corpus, settings), "lexical")
    ranked = settle(retrieve_round(rest, corpus, settings, embedder, model, scorer, lexical), "ranked")
    conf = settle(rank.confidence(ranked, rest, settings.confidence_min), "confidence")
    found = settle(lexical.join(corpus.chunks, "doc_id").join(rest, "query_id"), "hits")
    matched = settle(retrieve.matching_sentences(found, rest, corpus.ontology, settings.lexical_threshold), "matched")
    found = settle(found.join(matched, ["query_id", "doc_id"], "left"), "hits")
    sents = found
    has = set(corpus.chunks.columns)
    for name, kind in (("sector", "string"), ("siglas", "array<string>")):
        if name not in has:
            sents = sents.withColumn(name, F.lit(None).cast(kind))
    again = settle(A.retry_query(rest.join(conf.filter(F.col("confidence") < settings.min_score), "query_id", "left_semi"), sents, corpus.ontology).filter("retry is not null"), "retries")
    # most batches have no question to ask again
    second = ranked.limit(0) if again.isEmpty() else settle(retrieve_round(again.select("query_id", F.col("retry").alias("question")), corpus, settings, embedder, model, scorer), "second")
    conf2 = rank.confidence(second, again, settings.confidence_min).withColumnRenamed("confidence", "c2")
    both = conf.join(conf2.select("query_id", "c2"), "query_id", "left").withColumn("adopt", F.coalesce(F.col("c2") > F.col("confidence"), F.lit(False)))
    both = settle(both, "adopted")
    first, better = ranked.join(both.filter("adopt"), "query_id", "left_anti"), second.join(both.filter("adopt"), "query_id", "left_semi")
    ranked = settle(first.unionByName(better), "ranked")
    conf = both.select("query_id", F.when(F.col("adopt"), F.col("c2")).otherwise(F.col("confidence")).alias("confidence"))
    enough = (F.col("confidence") >= settings.confidence_min) if settings.require_context else F.lit(True)

    cited = A.citations(ranked, settings.max_sources).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "source", "chunk", "preview"))).alias("c"))
    cited = cited.select("query_id", F.transform("c", lambda x: F.struct(x["source"], x["chunk"], x["preview"])).alias("citations"))
    meta = metadata_of(rest, ranked)
    best = A.top_sentences(ranked)
    body = best.groupBy("query_id").agg(F.max("score").alias("s"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda x: x["sentence"]), " ").alias("b"))
    opening = ranked.filter("final_rank = 1").select("query_id", F.substring("text", 1, 500).alias("o"))
    people_found = people.people_candidates(found, corpus.ontology)
    low = A.low_confidence(rest, conf, people_found, found, settings.min_score).select("query_id", F.col("answer").alias("low"), F.col("context_found").alias("low_found"), "needs_clarification")
    rows = rest.join(conf, "query_id").join(cited, "query_id", "left").join(meta, "query_id", "left").join(body, "query_id", "left").join(opening, "query_id", "left").join(low, "query_id", "left")
    no_cites = F.array().cast(dict(cited.dtypes)["citations"])
    text = F.coalesce("meta", A.markdown(F.when(F.col("s") >= 0.45, F.col("b")).otherwise(F.coalesce("o", F.lit(""))), F.coalesce("citations", no_cites)))
    told = rows.select(
        "query_id", F.when(enough, text).otherwise(F.col("low")).alias("answer"), F.when(enough, F.coalesce("citations", no_cites)).otherwise(no_cites).alias("citations"),
        F.when(enough, F.col("citations").isNotNull()).otherwise(F.coalesce("low_found", F.lit(False))).alias("context_found"), "confidence",
        F.when(enough, F.lit(False)).otherwise(F.coalesce("needs_clarification", F.lit(True))).alias("needs_clarification"),
        F.when(~enough, "low_confidence").when(F.col("meta").isNotNull(), "metadata").otherwise("hybrid").alias("route"),
    )
    return told.unionByName(direct.select("query_id", "answer", F.transform("citations", lambda x: F.struct(x["source"], x["chunk"], x["preview"])).alias("citations"), "context_found", "confidence", "needs_clarification", "route"))


def metadata_of(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, meta) from the ranked chunks' metadata, if they have any."""
    empty = F.array().cast("array<string>")
    rows = ranked
    for name in ("emails", "phones"):
        if name not in rows.columns:
            rows = rows.withColumn(name, empty)
    return people.metadata_answer(questions, rows).withColumnRenamed("answer", "meta")
