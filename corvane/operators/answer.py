"""Answers: snippets, citations, Markdown, and what is said when confidence is low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ontology import Ontology
from ..shipping import ship

# fixed values: what the answers say
SEVERAL = "Encontrei mais de uma pessoa compatível. Informe o departamento, curso ou nome completo, ou escolha uma das opções:\n"
LOW_SEVERAL = "Não localizei trechos com confiança suficiente. "
LOW_NONE = "Não localizei contexto suficiente na base para responder. "
WHICH_UNIT = "Poderia indicar o departamento, curso ou unidade relacionado?"
NOTHING = "Não encontrei."


def citations(ranked: DataFrame, limit: int = 5, rank: str = "final_rank") -> DataFrame:
    """(query_id, place, source, chunk, preview): the best of each (source, chunk), ``limit`` a question."""
    source = F.coalesce("source", F.lit("desconhecido"))
    rows = ranked.select("query_id", F.col(rank).alias("_r"), source.alias("source"), "chunk", T.preview(F.col("text")).alias("preview"))
    one = Window.partitionBy("query_id", "source", "chunk").orderBy("_r")
    rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("_r")))
    return rows.filter(F.col("place") <= limit).select("query_id", "place", "source", "chunk", "preview")


def top_sentences(ranked: DataFrame, n: int = 3) -> DataFrame:
    """(query_id, place, sentence, score): sentences of the ranked texts most like the question."""
    from ..functions.fuzzy import column, token_set_ratio

    ship(ranked.sparkSession)
    rows = ranked.select("query_id", "question", "final_rank", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))
    one = Window.partitionBy("query_id", F.lower("sentence")).orderBy("final_rank", "pos")
    rows = rows.withColumn("_n", F.row_number().over(one)).filter("_n = 1")
    rows = rows.withColumn("score", column(token_set_ratio, T.squeeze(F.col("question")), F.col("sentence")) / 100)
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "final_rank", "pos")
    return rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n).select("query_id", "place", "sentence", "score")


def markdown(body: Column, sources: Column) -> Column:
    """``body`` under a heading and the sources (array<struct<source, chunk, preview>>) as a list."""
    items = F.transform(sources, lambda s: F.concat(F.lit("- "), s["source"], F.when(s["chunk"].isNull(), "").otherwise(F.concat(F.lit(" (chunk "), s["chunk"].cast("string"), F.lit(")")))))
    return F.concat_ws("\n", F.lit("### Resumo"), F.trim(body), F.when(F.size(sources) > 0, F.concat(F.lit("\n### Fontes\n"), F.array_join(items, "\n"))))


def direct(name: Column, dept: Column, phones: Column, emails: Column, snippets: Column) -> Column:
    """Name, department, phones and e-mails in one line; without any, the first snippet's 400 characters."""
    icon = lambda mark, xs: F.when(F.size(xs) > 0, F.concat(F.lit(mark + " "), F.array_join(xs, ", ")))
    line = F.concat_ws(" — ", F.nullif(name, F.lit("")), F.nullif(dept, F.lit("")), icon("📞", phones), icon("✉️", emails))
    return F.when(line != "", line).otherwise(F.substring(F.coalesce(F.get(snippets, F.lit(0)), F.lit(NOTHING)), 1, 400))


def low_confidence(questions: DataFrame, conf: DataFrame, candidates: DataFrame, hits: DataFrame, min_score: float = 0.25) -> DataFrame:
    """(query_id, answer, context_found, needs_clarification) where confidence is too low: the one person that fits,
    a choice of three, or a question for the unit with the best hits' files as options."""
    single = direct(F.col("name"), F.col("dept"), F.col("phones"), F.col("emails"), F.col("snippets"))
    parts = F.concat_ws(
        " — ", F.nullif("name", F.lit("")), F.nullif("dept", F.lit("")), F.when(F.size("phones") > 0, F.concat(F.lit("📞 "), F.array_join("phones", ", "))),
        F.when(F.size("emails") > 0, F.concat(F.lit("✉️ "), F.array_join("emails", ", "))),
    )
    option = F.concat(F.col("candidate").cast("string"), F.lit(". "), F.coalesce(F.nullif(parts, F.lit("")), "source", F.lit("sem detalhes")))
    people = candidates.withColumn("one", single).withColumn("option", option).groupBy("query_id").agg(
        F.count("*").alias("n"), F.min_by("one", "candidate").alias("one"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("candidate") <= 3, F.struct("candidate", "option")))), lambda s: s["option"]), "\n").alias("options"),
    )
    labels = hits.filter("lexical_rank <= 3").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("lexical_rank", T.label_of_file(F.col("source")).alias("l")))).alias("ls"))
    labels = labels.select("query_id", F.array_distinct(F.filter(F.transform("ls", lambda s: s["l"]), lambda x: F.coalesce(x, F.lit("")) != "")).alias("labels"))
    rows = questions.join(conf.select("query_id", "confidence"), "query_id").join(people, "query_id", "left").join(labels, "query_id", "left")
    low = F.col("confidence").isNull() | (F.col("confidence") < min_score)
    ask = F.when(
        F.size("labels") > 0,
        F.concat(F.lit("Encontrei múltiplas possibilidades: "), F.array_join(F.slice("labels", 1, 3), ", "), F.lit(". Pode dizer qual delas?")),
    ).otherwise(F.lit(WHICH_UNIT))
    several = F.concat(F.when(low, LOW_SEVERAL).otherwise(""), F.lit(SEVERAL), F.col("options"))
    none = F.concat(F.when(low, LOW_NONE).otherwise(""), ask)
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "query_id", F.when(n == 1, F.col("one")).when(n > 1, several).otherwise(none).alias("answer"), (n == 1).alias("context_found"), (n != 1).alias("needs_clarification"),
    )


def retry_query(questions: DataFrame, hits: DataFrame, ontology: Ontology) -> DataFrame:
    """(query_id, retry): the question and up to three expansions that it doesn't hold yet: synonyms of its terms,
    then of the best three hits (lexical_rank, sector, siglas, sentences) sectors, acronyms and department words."""
    q = T.fold(F.col("question"))
    empty = F.array().cast("array<string>")
    terms = F.transform(T.candidate_terms(F.col("question")), T.fold)
    syn = [F.when(F.array_contains(terms, k), F.array(*map(F.lit, v))).otherwise(empty) for k, v in ontology.synonyms.items() if v]
    tokens = [t for t, _, _ in ontology.tokens()]
    words = F.filter(T.letters(F.coalesce("sentence", F.lit(""))), lambda w: T.fold(w).isin(*tokens)) if tokens else empty
    seen = hits.filter("lexical_rank <= 3").select("query_id", "lexical_rank", F.concat(F.array_compact(F.array("sector")), F.coalesce("siglas", empty), words).alias("xs"))
    seen = seen.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("lexical_rank", "xs"))).alias("l"))
    rows = questions.join(seen, "query_id", "left").withColumn("all", F.concat(F.flatten(F.array(*syn)) if syn else empty, F.coalesce(F.flatten(F.transform("l", lambda s: s["xs"])), empty)))
    fresh = F.filter(F.transform("all", lambda x: F.trim(x)), lambda x: (x != "") & ~q.contains(T.fold(x)))
    # one row a question; the aggregation keeps the array from being worked out again for each of its elements
    rows = rows.withColumn("fresh", fresh).groupBy("query_id").agg(F.first("question").alias("question"), F.first("fresh").alias("fresh"))
    more = F.array_join(F.slice(T.first_spellings(F.col("fresh")), 1, 3), " ")
    return rows.select("query_id", F.when(more != "", F.trim(F.concat_ws(" ", "question", more))).alias("retry"))
