"""People and how to reach them: the contact index, its lookup, and candidates to choose between."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.ontology import Ontology
from ..shared import settle


def listed(rows: DataFrame, key: str, name: str, most: int | None = None) -> DataFrame:
    """(key, name): the different values ``x`` of each key as a sorted array, only the first ``most`` if given. Values
    combine before they are shuffled: an array has as many elements as there are different values."""
    first = rows.filter("x is not null").distinct()
    if most is not None:
        first = first.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("x"))).filter(F.col("_n") <= most)
    return first.groupBy(key).agg(F.array_sort(F.collect_list("x")).alias(name))


def contact_index(docs: DataFrame, ontology: Ontology | None = None, most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(contacts, aliases) of documents (source, chunk, text).

    A block whose first line is a person's name and which holds a phone or e-mail is an entry; entries of one folded
    name are united, with all their phones, e-mails, departments and citations (``most`` of each if given). ``aliases``
    (alias, canonical) holds the name, its words of four letters or more, and the dictionary's aliases of any of its
    words; an alias of several people belongs to the alphabetically first.
    """
    ontology = ontology or Ontology()
    body = F.explode(T.blocks(F.col("text")))
    rows = docs.select("source", "chunk", F.col("text").alias("_all"), body.alias("block"))
    first = F.try_element_at(F.filter(F.transform(F.split("block", "\n"), lambda x: F.trim(x)), lambda x: x != ""), F.lit(1))
    rows = rows.withColumn("name", T.clean_name(first)).filter("name is not null").filter(~T.generic_name(F.col("name")))
    rows = rows.withColumn("phones", T.phones(F.col("block"), T.PHONE_IN_QUESTION)).withColumn("emails", T.emails(F.col("block")))
    rows = rows.filter((F.size("phones") > 0) | (F.size("emails") > 0))
    dept = ontology.first_match(T.fold(F.coalesce("source", F.lit(""))))
    cite = F.struct("source", "chunk", F.substring(T.squeeze(F.col("_all")), 1, 180).alias("preview"))
    rows = rows.select(T.fold(F.col("name")).alias("canonical"), "name", "phones", "emails", dept.alias("d"), cite.alias("c"))
    rows = settle(rows, "contact-blocks")
    contacts = rows.groupBy("canonical").agg(F.min("name").alias("name"))
    for name, value in (
        ("phones", F.explode("phones")), ("emails", F.explode("emails")), ("departments", F.col("d.label")), ("dept_slugs", F.col("d.slug")), ("citations", F.col("c")),
    ):
        contacts = contacts.join(listed(rows.select("canonical", value.alias("x")), "canonical", name, most), "canonical", "left")
    kinds = dict(contacts.dtypes)
    lists = ("phones", "emails", "departments", "dept_slugs", "citations")
    contacts = contacts.select("canonical", "name", *[F.coalesce(c, F.array().cast(kinds[c])).alias(c) for c in lists])
    words = F.transform(T.letters(F.col("name")), T.fold)
    own = F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*T.GENERIC_NAME_TOKENS))
    told = []
    for base, variants in ontology.aliases.items():
        group = [T.fold_text(x) for x in [base, *variants]]
        told.append(F.when(F.arrays_overlap(words, F.array(*map(F.lit, group))), F.array(*[F.lit(g) for i, g in enumerate(group) if not i or len(g) >= 3])))
    more = F.flatten(F.array_compact(F.array(*told))) if told else F.array().cast("array<string>")
    names = contacts.select("canonical", F.explode(F.array_distinct(F.concat(F.array("canonical"), own, more))).alias("alias"))
    return contacts, names.groupBy("alias").agg(F.min("canonical").alias("canonical"))


def lookup(questions: DataFrame, contacts: DataFrame, aliases: DataFrame) -> DataFrame:
    """The contact that each question asks for: one row a question that has a contact word and a known name.

    Of several terms the longest wins, then the alphabetically first; a department in the question must be one of the
    person's, if the person has any.
    """
    words = T.PHONE_WORDS + T.EMAIL_WORDS + ("contato",)
    asked = questions.filter(T.contains_any(F.col("question"), words)).withColumn("hint", T.department_hint(F.col("question")))
    asked = asked.withColumn("tokens", T.question_tokens(F.col("question")))
    terms = asked.select("query_id", "question", "hint", "tokens", F.explode(F.transform(T.candidate_terms(F.col("question")), T.fold)).alias("alias"))
    found = terms.join(aliases, "alias", "left").withColumn("canonical", F.coalesce("canonical", "alias")).join(contacts, "canonical")
    found = found.filter(F.col("hint").isNull() | (F.size("dept_slugs") == 0) | F.array_contains("dept_slugs", F.col("hint")))
    w = Window.partitionBy("query_id").orderBy(F.length("alias").desc(), "alias")
    return found.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").withColumnRenamed("alias", "matched_token")


def best_contacts(items: Column, tokens: Column, n: int) -> Column:
    """The ``n`` items that hold most of the tokens; of equals the shorter, then the alphabetically last. If none holds
    any, the same order over all."""
    scored = F.transform(items, lambda x: F.struct(F.size(F.filter(tokens, lambda t: T.fold(x).contains(t))).alias("m"), (-F.length(x)).alias("l"), x.alias("x")))
    ranked = F.sort_array(scored, asc=False)
    hits = F.filter(ranked, lambda s: s["m"] > 0)
    return F.transform(F.slice(F.when(F.size(hits) > 0, hits).otherwise(ranked), 1, n), lambda s: s["x"])


def contact_answer(found: DataFrame) -> DataFrame:
    """:func:`lookup` rows with ``answer``: name, departments, two phones and three e-mails at most."""
    tokens = F.col("tokens")
    line = lambda label, items: F.when(F.size(items) > 0, F.concat(F.lit(f"**{label}:** "), F.array_join(items, ", ")))
    answer = F.concat_ws(
        "\n", F.lit("### Contato"), F.concat(F.lit("**Nome:** "), F.coalesce("name", F.lit("Contato"))), line("Departamento(s)", F.col("departments")),
        line("Telefone(s)", best_contacts(F.col("phones"), tokens, 2)), line("E-mail(s)", best_contacts(F.col("emails"), tokens, 3)),
    )
    return found.withColumn("answer", answer).withColumn("confidence", F.lit(0.99)).withColumn("route", F.lit("contact_fallback"))


def metadata_answer(questions: DataFrame, ranked: DataFrame) -> DataFrame:
    """(query_id, answer) of questions for e-mails or phones that the ranked chunks' own metadata can answer."""
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    have = ranked.groupBy("query_id").agg(union("emails").alias("emails"), union("phones").alias("phones"))
    q = questions.withColumn("tokens", T.question_tokens(F.col("question"))).join(have, "query_id").withColumn("we", T.wants_email(F.col("question"))).withColumn("wp", T.wants_phone(F.col("question")))
    q = q.filter((F.col("we") | F.col("wp")) & (~F.col("we") | (F.size("emails") > 0)) & (~F.col("wp") | (F.size("phones") > 0)))
    tokens = F.col("tokens")
    line = lambda wanted, label, c: F.when(F.col(wanted), F.concat(F.lit(f"**{label}:** "), F.array_join(best_contacts(F.col(c), tokens, 3), ", ")))
    return q.select("query_id", F.concat_ws("\n", F.lit("### Contato"), line("we", "E-mail(s)", "emails"), line("wp", "Telefone(s)", "phones")).alias("answer"))


def extract_name(text: Column, term: Column) -> Column:
    """The name in ``text`` with a word closest to ``term``, at .8 or more; without a term the first name."""
    names = F.regexp_extract_all(text, F.lit(T.NAME_SEQUENCE), 0)
    near = lambda n: F.array_max(F.transform(T.letters(n), lambda w: T.similarity(T.fold(w), T.fold(term))))
    scored = F.transform(names, lambda n, i: F.struct(near(n).alias("s"), (-i).alias("o"), n.alias("n")))
    best = F.array_max(F.filter(scored, lambda s: s["s"] >= 0.8))["n"]
    return F.when(term.isNull() | (term == ""), F.get(names, F.lit(0))).otherwise(best)


def person_block(text: Column, term: Column) -> Column:
    """The first block that holds the term."""
    return F.get(F.filter(T.blocks(text), lambda b: T.fold(b).contains(T.fold(term))), F.lit(0))


def people_candidates(hits: DataFrame, ontology: Ontology | None = None) -> DataFrame:
    """People behind lexical hits (query_id, question, doc_id, source, chunk, text, score, and if known the ``sentence``s that
    match), one row a name and department: best score, united contacts, documents, snippets; ``candidate`` ranks them by score.

    A question with a name keeps hits whose name has a word at .9 or more of it; without one, hits with a contact.
    """
    ontology = ontology or Ontology()
    names = F.filter(T.candidate_terms(F.col("question")), lambda t: t.rlike(r"^\p{L}+$"))
    # terms by question, joined: so they are not worked out again inside the expressions below
    terms = hits.select("query_id", "question").distinct().select("query_id", F.coalesce(F.get(names, F.lit(0)), F.lit("")).alias("term"))
    rows = hits.join(terms, "query_id")
    named = rows.select("query_id", "doc_id", extract_name(F.col("text"), F.col("term")).alias("name"))
    rows = rows.join(named, ["query_id", "doc_id"])
    target = F.coalesce("name", "term")
    block = F.when(target != "", person_block(F.col("text"), target))
    window = T.context_window(F.col("text"), F.col("name"), 100, 200)
    # sentences that match the question, where a hit has them; else how the text opens
    matched = F.nullif(T.squeeze(F.col("sentence")), F.lit("")) if "sentence" in hits.columns else F.lit(None).cast("string")
    rows = rows.withColumn("snippet", F.coalesce(block, window, matched, T.squeeze(F.substring("text", 1, 320))))
    rows = rows.withColumn("phones", T.phones(F.col("snippet"), T.PHONE_IN_QUESTION)).withColumn("emails", T.emails(F.col("snippet")))
    near = F.exists(T.letters(F.col("name")), lambda w: T.similarity(T.fold(w), T.fold(F.col("term"))) >= 0.9)
    has = (F.size("phones") > 0) | (F.size("emails") > 0)
    rows = rows.filter(F.when(F.col("name").isNull(), (F.col("term") == "") & has).otherwise((F.col("term") == "") | near))
    dept = ontology.first_match(T.fold(F.coalesce("source", F.lit(""))))["label"]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    out = rows.withColumn("dept", dept).groupBy("query_id", T.fold(F.coalesce("name", "source", F.lit(""))).alias("key"), F.coalesce("dept", F.lit("")).alias("dept"))
    out = out.agg(
        F.max_by("name", "score").alias("name"), F.max("score").alias("score"), union("phones").alias("phones"), union("emails").alias("emails"),
        F.array_sort(F.collect_set("doc_id")).alias("docs"), F.array_sort(F.collect_set("snippet")).alias("snippets"), F.max_by("source", "score").alias("source"),
    )
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "key", "dept")
    return out.withColumn("candidate", F.row_number().over(w))
