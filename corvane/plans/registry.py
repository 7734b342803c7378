"""Named queries over the driver's tables, each with its DuckDB counterpart where SQL can express it.

``documents`` stand for chunks (``source`` is the file), ``benchmark`` items for questions. The vectors of the driver
are not embeddings of its documents: where both lists are needed, vec_id is taken for doc_id, and a question's vector
is the one with its item_id. Vector searches take as queries the vectors whose id is divisible by 100.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import text as T
from ..functions.ontology import Ontology, tag_entities
from ..operators import agent, cache, chunking, evaluate, fuse, fuzzy_search, index, people, rank, retrieve, telemetry
from ..operators import answer as A
from ..shared import ON_CLEAR, settle, shared_path, state_of
from ..shipping import ship
from ..sources import tables
from . import questions as Q

#: A small dictionary in the words of the driver's texts.
ONTOLOGY = Ontology(
    departments={"src1": "The Department", "nicht": "Nicht Abteilung", "moron": "Insult Desk", "ciudad": "Que Departamento"},
    aliases={"the": ["thea", "ther"], "and": ["ande"]},
    synonyms={"the": ["tionthe", "erthe"], "nicht": ["keine"]},
    expansions={"that": ["that thing"], "que": ["que es", "porque"]},
    boosts={"src1": 1.5, "nicht": 1.25},
)
S = Settings()
QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def put(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark items as questions."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def digest(c):
    return F.md5(F.array_join(c, "\x01"))


def _list(x: str) -> str:
    return f"md5(array_to_string({x}, chr(1)))"


def _fold(x: str) -> str:
    return f"lower(strip_accents({x}))"


_ESC = {"'": "''"}
_LETTERS = f"'{T.LETTERS}'"
_WORDS = lambda c: f"list_transform(list_filter(regexp_extract_all({c}, {_LETTERS}), lambda x: length(x) >= 2), lambda x: {_fold('x')})"
_SQUEEZE = lambda c: f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
_STOP = ", ".join(f"'{s}'" for s in T.STOP_TERMS)


# ---- text ----
@query(f"select doc_id, md5({_fold('text')}) as folded from documents")
def text_fold(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.fold(F.col("text"))).alias("folded"))


@query(f"select doc_id, md5({_SQUEEZE('text')}) as squeezed from documents")
def ws_normalize(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.squeeze(F.col("text"))).alias("squeezed"))


@query("select doc_id, md5(regexp_replace(lower(replace(replace(strip_accents(text), 'ª', 'a'), 'º', 'o')), '[^\\x00-\\x7F]', '', 'g')) as folded from documents")
def ascii_fold(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.fold_ascii(F.col("text"))).alias("folded"))


@query(f"select doc_id, md5(translate(text, '{T.MOJIBAKE_FROM}{T.SOFT_HYPHEN}', '{T.MOJIBAKE_TO}')) as mapped from documents")
def mojibake_map(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.map_mojibake(F.col("text"))).alias("mapped"))


@query(f"select doc_id, len({_WORDS('text')})::bigint as n_tokens, {_list(_WORDS('text'))} as tokens from documents")
def bm25_tokens(spark, d):
    w = T.bm25_tokens(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(w).cast("long").alias("n_tokens"), digest(w).alias("tokens"))


@query(f"""
with t as (select conv_id, turn, list_concat(regexp_extract_all(trim(text), '{T.EMAIL}'), regexp_extract_all(trim(text), '{T.TERM}')) as ws from conversations),
u as (select conv_id, turn, unnest(range(1, len(ws) + 1)) as i, ws from t),
v as (select conv_id, turn, i, ws[i] as w, {_fold('ws[i]')} as k from u),
f as (select * from (select *, row_number() over (partition by conv_id, turn, k order by i) as n from v where k not in ({_STOP})) where n = 1)
select t.conv_id, t.turn, count(w)::bigint as n_terms, md5(coalesce(string_agg(w, chr(1) order by i), '')) as terms
from t left join f on t.conv_id = f.conv_id and t.turn = f.turn group by t.conv_id, t.turn
""")
def candidate_terms(spark, d):
    w = T.candidate_terms(F.col("text"))
    rows = table(spark, d, "conversations").withColumn("w", w)
    return rows.select("conv_id", "turn", F.size("w").cast("long").alias("n_terms"), digest("w").alias("terms"))


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{T.EMAIL}'), lambda x: lower(x)))), ',') as emails from documents")
def email_extract(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.emails(F.col("text")), ",").alias("emails"))


_DIGITS = "regexp_replace(x, '\\D', '', 'g')"
_PHONE = (
    f"case when length({_DIGITS}) = 11 then '(' || substr({_DIGITS}, 1, 2) || ') ' || substr({_DIGITS}, 3, 5) || '-' || substr({_DIGITS}, 8, 4)"
    f" when length({_DIGITS}) = 10 then '(' || substr({_DIGITS}, 1, 2) || ') ' || substr({_DIGITS}, 3, 4) || '-' || substr({_DIGITS}, 7, 4) else trim(x) end"
)


@query(f"select doc_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(text, '{T.PHONE}'), lambda x: {_PHONE}))), ',') as phones from documents")
def phone_normalize(spark, d):
    return docs(spark, d).select("doc_id", F.array_join(T.phones(F.col("text")), ",").alias("phones"))


@query(f"select doc_id, {_list(f'''list_sort(list_distinct(regexp_extract_all(replace(strip_accents(text), 'ß', 'ss'), '{T.FOLDED_ACRONYM}')))''')} as acronyms from documents")
def acronyms_folded(spark, d):
    return docs(spark, d).select("doc_id", digest(T.acronyms_folded(F.col("text"))).alias("acronyms"))


@query("select page_id, case when regexp_matches(url, '(?i)^https?://') then trim(url) end as url, (regexp_matches(trim(regexp_extract(html, '^\\s*([^\\n]*)', 1)), '(?i)^https?://')) as in_html from pages")
def leading_url(spark, d):
    page = F.concat(F.lit("\n "), F.col("url"), F.lit("\n"), F.col("html"))
    return table(spark, d, "pages").select("page_id", T.leading_url(page).alias("url"), T.leading_url(F.col("html")).isNotNull().alias("in_html"))


@query("""
with l as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '')[1] as s from documents)
select doc_id, md5(case when length(s) > 120 then rtrim(substr(s, 1, 117)) || '...' else s end) as section from l
""")
def section_guess(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.section_title(F.col("text"))).alias("section"))


@query("select doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> ''))::bigint as tokens from documents")
def token_counts(spark, d):
    return docs(spark, d).select("doc_id", T.token_count(F.col("text")).cast("long").alias("tokens"))


@query("""
select doc_id, len(s)::bigint as n_sentences, md5(array_to_string(s, chr(2))) as sentences from (
  select doc_id, list_filter(list_transform(string_split(regexp_replace(regexp_replace(text, '([.!?;:])\\s+', '\\1' || chr(1), 'g'), '\\n+', chr(1), 'g'), chr(1)),
    lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> '') as s from documents)
""")
def sentence_split(spark, d):
    s = T.sentences(F.col("text"))
    return docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n_sentences"), F.md5(F.array_join(s, "\x02")).alias("sentences"))


@query("""
with f as (select doc_id, trim(replace(text, chr(10), ' ')) as t from documents)
select doc_id, md5(case when length(t) > 200 then rtrim(substr(t, 1, 200)) || '...' else t end) as preview from f
""")
def previews(spark, d):
    return docs(spark, d).select("doc_id", F.md5(T.preview(F.col("text"))).alias("preview"))


@query("select sha256(text) as content_hash, count(*)::bigint as copies, min(doc_id) as first_doc from documents group by 1")
def doc_hash_dups(spark, d):
    return docs(spark, d).groupBy(F.sha2("text", 256).alias("content_hash")).agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc"))


_GREET = ", ".join(f"'{g}'" for g in T.GREETINGS)


@query(f"""
select conv_id, turn, case when length(q) < 2 or q in ({_GREET}) then 'ask_clarification' else 'answer' end as action,
  case when length(q) < 2 then '{T.ASK_QUESTION}' when q in ({_GREET}) then '{T.ASK_DETAIL}' end as message
from (select conv_id, turn, lower(trim(coalesce(text, ''))) as q from conversations)
""")
def triage(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", T.triage(F.col("text")).alias("t")).select("conv_id", "turn", "t.action", "t.message")


# ---- lexical index and search ----
_POST = f"""
w as materialized (select * from (select doc_id, {_WORDS('text')} as ws from documents) where len(ws) > 0),
doc_len as materialized (select doc_id, len(ws) as dl from w),
postings as materialized (select term, doc_id, count(*) as tf from (select doc_id, unnest(ws) as term from w) group by all),
corpus as materialized (select count(*) as n, avg(dl) as avgdl from doc_len),
dfs as materialized (select term, count(*) as df from postings group by term),
raw as materialized (select term, df, ln((select n from corpus) - df + 0.5) - ln(df + 0.5) as raw from dfs),
stats as materialized (select term, df, case when raw < 0 then {index.EPSILON} * (select avg(raw) from raw) else raw end as idf from raw)"""
_BM25 = f"""{_POST},
qt as (select query_id, term, count(*) as qtf from (select item_id as query_id, unnest({_WORDS('text')}) as term from benchmark) group by all),
bm as (
  select query_id, p.doc_id, sum(qtf * idf * tf * {index.K1 + 1} / (tf + {index.K1} * ({1 - index.B} + {index.B} * dl / avgdl))) as score
  from postings p join qt on p.term = qt.term join stats s on s.term = p.term join doc_len l on l.doc_id = p.doc_id, corpus
  group by all having score > 0),
lex as (select * from (select *, row_number() over (partition by query_id order by round(score, 9) desc, doc_id)::int as lexical_rank from bm) where lexical_rank <= {S.fetch_k})"""


_INDEXES: dict[tuple, str] = {}
ON_CLEAR.append(_INDEXES.clear)


def lexical(spark: SparkSession, d: str) -> index.LexicalIndex:
    """The index of a folder's documents: built by the first query that needs it, then read, as long as the documents' files
    are the same."""
    at = (spark.sparkContext.applicationId, d, state_of(spark, f"{d}/documents.parquet"))
    if at not in _INDEXES:
        path = shared_path(spark, "lexical-index")
        index.build(docs(spark, d), path)
        _INDEXES[at] = path
    return index.LexicalIndex.load(spark, _INDEXES[at])


def _bm25(spark, d) -> DataFrame:
    scored = retrieve.bm25_best(asked(spark, d), lexical(spark, d), S.fetch_k).withColumn("score", F.round("score", 9))
    # written: a few rows a question, so that documents need no shuffle to meet them
    return settle(retrieve.top(scored, S.fetch_k, name="lexical_rank"), "lexical")


@query(f"with {_POST} select term, df::bigint as df, round(idf, 6) as idf from stats")
def term_stats(spark, d):
    return lexical(spark, d).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


@query(f"with {_BM25} select query_id, doc_id, lexical_rank, round(score, 4) as score from lex")
def bm25_topk(spark, d):
    return _bm25(spark, d).select("query_id", "doc_id", "lexical_rank", F.round("score", 4).alias("score"))


_SENTENCES: dict[tuple, str] = {}
ON_CLEAR.append(_SENTENCES.clear)


def sentence_index(spark: SparkSession, d: str) -> fuzzy_search.SentenceIndex:
    """The sentence index of a folder's documents, kept like :func:`lexical`."""
    at = (spark.sparkContext.applicationId, d, state_of(spark, f"{d}/documents.parquet"))
    if at not in _SENTENCES:
        path = shared_path(spark, "sentence-index")
        fuzzy_search.build(docs(spark, d), path)
        _SENTENCES[at] = path
    return fuzzy_search.SentenceIndex.load(spark, _SENTENCES[at])


@query()
def fuzzy_topk(spark, d):
    """Misspelt questions over all documents: the longest word of each item with its third character left out."""
    word = F.try_element_at(F.array_sort(T.letters(F.col("question")), lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0)), F.lit(1))
    q = asked(spark, d).withColumn("w", word).select("query_id", F.concat(F.substring("w", 1, 2), F.expr("substring(w, 4)")).alias("question"))
    out = fuzzy_search.fuzzy_top(q, docs(spark, d), sentence_index(spark, d), ONTOLOGY, S.lexical_threshold, bonus=S.dept_bonus)
    return out.select("query_id", "doc_id", F.round("score", 6).alias("score"), F.col("rank").cast("int").alias("rank"))


_TOKENS = ONTOLOGY.tokens()
_SLUGS = lambda c: "list_distinct(list_filter([" + ", ".join(f"case when contains({_fold(c)}, '{t}') then '{s}' end" for t, s, _ in _TOKENS) + "], lambda x: x is not null))"
_LABELS = "map {" + ", ".join(f"'{s}': '{T.fold_text(n)}'" for s, n in ONTOLOGY.departments.items()) + "}"


@query(f"""
with {_BM25}, hints as (select item_id as query_id, {_SLUGS('text')} as slugs from benchmark)
select l.query_id, l.doc_id, round(score + case when len(list_filter(slugs, lambda s: contains({_fold('source')}, s) or contains({_fold('source')}, ({_LABELS})[s]))) > 0 then {S.dept_bonus} else 0 end, 4) as score
from lex l join documents x on l.doc_id = x.doc_id join hints h on h.query_id = l.query_id
""")
def bm25_dept_bonus(spark, d):
    out = retrieve.department_bonus(_bm25(spark, d), asked(spark, d), docs(spark, d), ONTOLOGY, S.dept_bonus)
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"))


# ---- vectors ----
_DIST = "list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (embedding[i]::double - qvec[i]::double) * (embedding[i]::double - qvec[i]::double)))"
_NEAR = f"""
q as (select vec_id as query_id, embedding as qvec from embeddings where vec_id % 100 = 0),
near as (
  select *, row_number() over (partition by query_id order by round(distance, 9), doc_id)::int as rank
  from (select query_id, vec_id as doc_id, {_DIST} as distance from embeddings, q) where true
)"""


@query(f"with {_NEAR} select query_id, doc_id, rank, round(1 / (1 + distance), 6) as similarity from near where rank <= {S.fetch_k}")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    asks = e.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.lit(0).alias("variant"), F.col("embedding").alias("qvec"))
    near = retrieve.vector_top(asks, e.select(F.col("vec_id").alias("doc_id"), "embedding"), S.fetch_k)
    return near.select("query_id", "doc_id", "rank", F.round("similarity", 6).alias("similarity"))


_PER = retrieve.per_variant(S, 2)


@query(f"""
with q as (
  select vec_id as query_id, 0 as variant, embedding as qvec from embeddings where vec_id % 100 = 0
  union all select vec_id, 1, list_transform(embedding, lambda x: (x::double * 0.5)::float) from embeddings where vec_id % 100 = 0
), near as (
  select *, row_number() over (partition by query_id, variant order by distance, doc_id) as r
  from (select query_id, variant, vec_id as doc_id, {_DIST} as distance from embeddings, q)
), best as (select query_id, doc_id, max(1 / (1 + distance)) as s, count(*) as n from near where r <= {_PER} group by all)
select query_id, doc_id, round(s, 6) as vector_score, n::bigint as n_variants from best
""")
def multi_variant_vector(spark, d):
    e = table(spark, d, "embeddings")
    own = e.filter("vec_id % 100 = 0")
    half = F.transform("embedding", lambda x: (x.cast("double") * 0.5).cast("float"))
    asks = own.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("variant"), F.col("embedding").alias("qvec")).unionByName(
        own.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("variant"), half.alias("qvec"))
    )
    near = retrieve.vector_top(asks, e.select(F.col("vec_id").alias("doc_id"), "embedding"), _PER)
    best = near.groupBy("query_id", "doc_id").agg(F.round(F.max("similarity"), 6).alias("vector_score"), F.count("*").alias("n_variants"))
    return best


# ---- fusion ----
_HYBRID = f"""{_BM25},
vq as (select b.item_id as query_id, e.embedding as qvec from benchmark b join embeddings e on e.vec_id = b.item_id),
vec as (
  select * from (
    select *, row_number() over (partition by query_id order by distance, doc_id)::int as vector_rank
    from (select query_id, vec_id as doc_id, round({_DIST}, 9) as distance from embeddings, vq where vec_id in (select doc_id from documents))
  ) where vector_rank <= {S.fetch_k}),
fused as (
  select *, row_number() over (partition by query_id order by rrf desc, vector_rank asc nulls last, lexical_rank asc nulls last, doc_id)::int as fused_rank from (
    select query_id, doc_id, round(sum(1.0::double / ({S.rrf_k} + r)), 12) as rrf, min(case when l = 0 then r end)::int as vector_rank, min(case when l = 1 then r end)::int as lexical_rank
    from (select query_id, doc_id, 0 as l, vector_rank as r from vec union all select query_id, doc_id, 1, lexical_rank from lex) group by query_id, doc_id)),
capped as (
  select f.query_id, f.doc_id, source, text, rrf, fused_rank, row_number() over (partition by f.query_id order by fused_rank)::int as place
  from (select f.*, x.source, x.text, row_number() over (partition by query_id, source order by fused_rank) as n from fused f join documents x on x.doc_id = f.doc_id) f
  where n <= {S.max_per_source})"""


def _vectors(spark, d) -> DataFrame:
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding").join(docs(spark, d).select("doc_id"), "doc_id", "left_semi")
    asks = asked(spark, d).join(table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("qvec")), "query_id").select("query_id", F.lit(0).alias("variant"), "qvec")
    near = retrieve.vector_top(asks, e, S.fetch_k)
    near = near.select("query_id", "doc_id", F.round("distance", 9).alias("distance"), F.col("rank").alias("vector_rank"), (1 / (1 + F.round("distance", 9))).alias("vector_score"))
    return settle(near, "near")


def _fused(near: DataFrame, lex: DataFrame) -> DataFrame:
    return fuse.reciprocal_rank(near, lex, S.rrf_k)


def _capped(spark, d, near: DataFrame | None = None, lex: DataFrame | None = None) -> DataFrame:
    fused = settle(_fused(_vectors(spark, d) if near is None else near, _bm25(spark, d) if lex is None else lex), "fused")
    return fuse.cap_by(docs(spark, d).select("doc_id", "source", "text").join(fused, "doc_id"), S.max_per_source)


@query(f"with {_HYBRID} select query_id, doc_id, round(rrf, 9) as rrf, vector_rank, lexical_rank, fused_rank from fused")
def rrf_fusion(spark, d):
    return _fused(_vectors(spark, d), _bm25(spark, d)).withColumn("rrf", F.round("rrf", 9))


@query(f"""
with {_HYBRID}, one as (select query_id, doc_id, min(l * 1000 + r) as place from (select query_id, doc_id, 0 as l, vector_rank as r from vec union all select query_id, doc_id, 1, lexical_rank from lex) group by query_id, doc_id)
select query_id, doc_id, (case when place >= 1000 then 1 else 0 end)::int as list, row_number() over (partition by query_id order by place, doc_id)::int as fused_rank from one
""")
def concat_fusion(spark, d):
    return fuse.concatenate(_vectors(spark, d), _bm25(spark, d))


@query(f"with {_HYBRID} select query_id, doc_id, source, fused_rank, place from capped")
def per_source_cap(spark, d):
    return _capped(spark, d).select("query_id", "doc_id", "source", "fused_rank", "place")


@query(f"with {_HYBRID} select query_id, place, doc_id, source, round(rrf, 9) as rrf from capped where place <= {S.top_k}")
def hybrid_topk(spark, d):
    return _capped(spark, d).filter(F.col("place") <= S.top_k).select("query_id", "place", "doc_id", "source", F.round("rrf", 9).alias("rrf"))


@query(f"""
with {_HYBRID}, k as (
  select query_id, source, doc_id as chunk, trim(replace(text, chr(10), ' ')) as t, place from capped where place <= {S.top_k})
select query_id, place, source, chunk, md5(case when length(t) > 200 then rtrim(substr(t, 1, 200)) || '...' else t end) as preview from k where place <= {S.max_sources}
""")
def citations(spark, d):
    ranked = _capped(spark, d).filter(F.col("place") <= S.top_k).withColumnRenamed("doc_id", "chunk")
    return A.citations(ranked, S.max_sources, "place").withColumn("preview", F.md5("preview"))


@query(f"""
with {_HYBRID}, best as (select query_id, max(score) as s from lex group by query_id)
select b.item_id as query_id, round(case when s is null then 0 when s between 0 and 1 then s else 1 / (1 + exp(-s)) end, 6) as confidence,
  (case when s is null then 0 when s between 0 and 1 then s else 1 / (1 + exp(-s)) end) >= {S.confidence_min} as enough
from benchmark b left join best on b.item_id = best.query_id
""")
def confidence_gate(spark, d):
    return rank.confidence(_bm25(spark, d), asked(spark, d), S.confidence_min).withColumn("confidence", F.round("confidence", 6))


@query()
def mmr_select(spark, d):
    near, lex = _vectors(spark, d), _bm25(spark, d)
    rows = _capped(spark, d, near, lex).join(asked(spark, d), "query_id").join(near.select("query_id", "doc_id", "vector_score"), ["query_id", "doc_id"], "left")
    rows = rows.join(lex.select("query_id", "doc_id", F.col("score").alias("lexical_score")), ["query_id", "doc_id"], "left")
    return fuse.diversify(rows, S.top_k, S.mmr_lambda, S.mmr_lambda_short)


@query()
def sentence_rank(spark, d):
    rows = _capped(spark, d).filter(F.col("place") <= S.top_k).join(asked(spark, d), "query_id").withColumnRenamed("place", "final_rank")
    return A.top_sentences(rows)


_SET = lambda c: f"list_distinct(list_filter(regexp_split_to_array({_fold(c)}, '\\s+'), lambda x: x <> ''))"


@query(f"""
with {_HYBRID}, rw as (
  select c.query_id, doc_id, place, {_SET('b.text')} as qw, {_SET('c.text')} as tw from capped c join benchmark b on b.item_id = c.query_id where place <= {S.rerank_candidates}),
s as (select query_id, doc_id, place, len(list_intersect(qw, tw))::double / len(qw) as score from rw)
select query_id, doc_id, round(score, 6) as score, final_rank from (select *, row_number() over (partition by query_id order by score desc, place, doc_id)::int as final_rank from s)
where final_rank <= {S.rerank_top_k}
""")
def rerank_top(spark, d):
    rows = _capped(spark, d).join(asked(spark, d), "query_id")
    from ..functions.models import overlap_scorer

    return rank.rerank(rows, overlap_scorer, S.rerank_candidates, S.rerank_top_k).select("query_id", "doc_id", F.round("score", 6).alias("score"), "final_rank")


@query()
def answers(spark, d):
    """The whole plan, with the hashing embedder for texts and questions."""
    from ..functions.models import embed_texts

    chunks = docs(spark, d).select("doc_id", "source", F.lit(0).alias("chunk"), "text", ONTOLOGY.first_match(F.lower("text"))["slug"].alias("sector_slug"), T.emails(F.col("text")).alias("emails"), T.phones(F.col("text")).alias("phones"))
    vectors = embed_texts(docs(spark, d).select("doc_id", "text")).select("doc_id", "embedding")
    corpus = Q.Corpus(settle(chunks, "chunks"), settle(vectors, "vectors"), lexical(spark, d), ONTOLOGY)
    return Q.answer(asked(spark, d), corpus, S)


# ---- dictionary ----
_CASES = " ".join(f"when contains(lower(text), '{t}') then '{n}'" for t, _, n in _TOKENS)


@query(f"select doc_id, case {_CASES} end as sector, case {_CASES.replace(chr(10), '')} end is not null as tagged from documents")
def sector_tag(spark, d):
    s = ONTOLOGY.first_match(F.lower("text"))
    return docs(spark, d).select("doc_id", s["label"].alias("sector"), s.isNotNull().alias("tagged"))


_BOOST = "case " + " ".join(f"when sector_slug = '{s}' and list_contains(slugs, '{s}') then {f}" for s, f in ONTOLOGY.boosts.items()) + " end"
_SLUG_CASES = " ".join(f"when contains(lower(text), '{t}') then '{s}'" for t, s, _ in _TOKENS)


@query(f"""
with {_BM25}, hints as (select item_id as query_id, {_SLUGS('text')} as slugs from benchmark),
sectors as (select doc_id, case {_SLUG_CASES} end as sector_slug from documents)
select l.query_id, l.doc_id, round(score * coalesce({_BOOST}, 1), 4) as score, ({_BOOST})::double as boost_factor
from lex l join sectors s on s.doc_id = l.doc_id join hints h on h.query_id = l.query_id
""")
def question_boost(spark, d):
    sectors = docs(spark, d).select("doc_id", ONTOLOGY.first_match(F.lower("text"))["slug"].alias("sector_slug"))
    out = retrieve.boost(_bm25(spark, d).join(sectors, "doc_id"), asked(spark, d), ONTOLOGY, ("score",))
    return out.select("query_id", "doc_id", F.round("score", 4).alias("score"), "boost_factor")


def _told(table: dict[str, list[str]], c: str) -> str:
    parts = [f"case when contains({_fold(c)}, '{k}') then [{', '.join(f'{chr(39)}{x}{chr(39)}' for x in v)}] else [] end" for k, v in table.items()]
    return f"flatten([{', '.join(parts)}])"


@query(f"""
with v as (
  select item_id as query_id, {_told(ONTOLOGY.expansions, 'text')} as custom, trim(text) as q, text,
    list_concat([trim(text), lower(trim(text)), trim(replace(trim(text), '?', '')), replace(replace(trim(text), 'quais', 'quais são'), 'qual', 'qual é')], {_told(ONTOLOGY.synonyms, 'text')}) as rest
  from benchmark
), a as (select query_id, custom, list_concat([text], list_concat(custom, rest)) as xs from v),
i as (select query_id, custom, xs, unnest(range(1, len(xs) + 1)) as n from a),
f as (select query_id, len(custom) as c, xs[n] as x, min(n) as n from i group by query_id, custom, xs[n]),
r as (select *, row_number() over (partition by query_id order by n) as pos from f)
select query_id, pos::int as pos, md5(x) as variant from r where pos <= greatest({S.mq_variants}, 1 + c)
""")
def query_variants(spark, d):
    v = retrieve.question_variants(asked(spark, d), ONTOLOGY, S.mq_variants)
    return v.select("query_id", F.posexplode("variants").alias("p", "v")).select("query_id", (F.col("p") + 1).alias("pos"), F.md5("v").alias("variant"))


_PAD = f"' ' || trim(regexp_replace({_fold('text')}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')) || ' '"
_ENT = [("DEPARTAMENTO", t) for t, _, _ in _TOKENS] + [("SINONIMO", T.fold_text(x)) for k, v in ONTOLOGY.synonyms.items() for x in [k, *v]]


@query(f"with p as (select doc_id, {_PAD} as p from documents) select doc_id, array_to_string(list_filter([{', '.join(f'case when contains(p, {chr(39)} {w} {chr(39)}) then {chr(39)}{k}:{w}{chr(39)} end' for k, w in dict.fromkeys(_ENT))}], lambda x: x is not null), ',') as entities from p")
def entity_ruler(spark, d):
    out = tag_entities(docs(spark, d).select("doc_id", "text"), ONTOLOGY)
    return out.select("doc_id", F.array_join(F.transform("entities", lambda e: F.concat(e["label"], F.lit(":"), e["phrase"])), ",").alias("entities"))


# ---- tables behind ingest; orders stand for the manifest ----
_DISK = "select o_orderkey::varchar as source_file, md5(o_orderstatus || case when o_orderkey % 7 = 0 then 'x' else '' end) as file_hash from orders where o_orderkey % 5 <> 0"
_HELD = "select o_orderkey::varchar as source_file, md5(o_orderstatus) as file_hash from orders where o_orderkey % 11 <> 0"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    o = table(spark, d, "orders")
    name = F.col("o_orderkey").cast("string").alias("source_file")
    changed = F.md5(F.concat("o_orderstatus", F.when(F.col("o_orderkey") % 7 == 0, "x").otherwise("")))
    return o.filter("o_orderkey % 5 <> 0").select(name, changed.alias("file_hash")), o.filter("o_orderkey % 11 <> 0").select(name, F.md5("o_orderstatus").alias("file_hash"))


@query(f"""
with d as ({_DISK}), m as ({_HELD})
select coalesce(d.source_file, m.source_file) as source_file,
  case when m.file_hash is null then 'new' when d.file_hash is null then 'deleted' when d.file_hash <> m.file_hash then 'modified' else 'unchanged' end as status
from d full outer join m on d.source_file = m.source_file
""")
def manifest_diff(spark, d):
    return tables.diff(*_sides(spark, d))


@query(f"with d as ({_DISK}), m as ({_HELD}) select source_file, file_hash from d union all select source_file, file_hash from m where source_file not in (select source_file from d)")
def manifest_upsert(spark, d):
    disk, held = _sides(spark, d)
    old = held.withColumn("processed_at", F.lit("2024-01-01").cast("timestamp"))
    return tables.upsert(old, disk.withColumn("processed_at", F.lit("2024-06-01").cast("timestamp"))).select("source_file", "file_hash")


@query(f"with d as ({_DISK}), m as ({_HELD}) select source_file from m where source_file in (select source_file from d)")
def obsolete_antijoin(spark, d):
    disk, held = _sides(spark, d)
    status = tables.diff(disk, held)
    return tables.without(held, status.filter("status = 'deleted'")).select("source_file")


@query("select doc_id, (row_number() over (order by source, doc_id) - 1)::bigint as faiss_index from documents")
def surrogate_ids(spark, d):
    return tables.number_rows(docs(spark, d).select("source", "doc_id"), ["source", "doc_id"]).select("doc_id", "faiss_index")


@query()
def chunk_pack(spark, d):
    out = chunking.chunk(docs(spark, d).select("doc_id", "source", "text"), S, ONTOLOGY)
    return out.select("doc_id", "chunk", "chunk_total", "chunk_tokens", F.md5("text").alias("text_md5"), "section", "sector")


# ---- names and contacts ----
@query("""
with t as (select distinct w from (select unnest(string_split(p_name, ' ')) as w from part) where regexp_matches(w, '^[a-z]+$'))
select a.w as a, b.w as b, round(1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)), 6) as similarity
from t a join t b on a.w < b.w and abs(length(a.w) - length(b.w)) <= 1 and 1 - levenshtein(a.w, b.w) / greatest(length(a.w), length(b.w)) >= 0.5
""")
def name_similarity(spark, d):
    """Different words of part names (a small vocabulary) that are alike; the threshold suits its short words."""
    t = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).filter(F.col("w").rlike("^[a-z]+$")).distinct()
    a, b = t.select(F.col("w").alias("a"), F.explode(F.array(*[F.length("w") + i for i in (-1, 0, 1)])).alias("l")), t.select(F.col("w").alias("b"), F.length("w").alias("l"))
    s = T.similarity(F.col("a"), F.col("b"))
    return a.join(b, "l").filter((F.col("a") < F.col("b")) & (s >= 0.5)).select("a", "b", F.round(s, 6).alias("similarity"))


@query(f"""
with e as (select source, lower(unnest(regexp_extract_all(text, '{T.EMAIL}'))) as x from documents),
p as (select source, {_PHONE} as x from (select source, unnest(regexp_extract_all(text, '{T.PHONE}')) as x from documents))
select s.source, coalesce((select string_agg(distinct x, ',' order by x) from e where e.source = s.source), '') as emails,
  coalesce((select md5(string_agg(distinct x, ',' order by x)) from p where p.source = s.source), md5('')) as phones
from (select distinct source from documents) s
""")
def contact_union(spark, d):
    rows = docs(spark, d).select("source", T.emails(F.col("text")).alias("e"), T.phones(F.col("text")).alias("p"))
    none = F.array(F.lit(None).cast("string"))
    one = lambda c: rows.select("source", F.explode(F.when(F.size(c) > 0, F.col(c)).otherwise(none)).alias("x")).distinct().groupBy("source").agg(F.array_sort(F.collect_list("x")).alias(c))
    out = one("e").join(one("p"), "source")
    return out.select("source", F.array_join("e", ",").alias("emails"), F.md5(F.array_join("p", ",")).alias("phones"))


def _pages_as_staff(spark, d) -> DataFrame:
    """Customers as a staff directory: a block with name, phone and e-mail each, in pages of 50."""
    c = table(spark, d, "customer")
    spell = lambda n: F.translate(F.lpad(n.cast("string"), 6, "0"), "0123456789", "qwzxkvjpfh")
    key = F.col("c_custkey")
    block = F.concat(F.lit("Prof. Ana"), spell(key), F.lit(" Silva"), spell(key % 97), F.lit("\nTel (14) 3103-"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("\nuser"), key.cast("string"), F.lit("@example.org"))
    page = F.floor(key / 50).cast("int")
    texts = c.groupBy(page.alias("chunk")).agg(F.array_join(F.array_sort(F.collect_list(block)), "\n\n").alias("text"))
    return texts.select(F.concat(F.lit("docentes_src1_"), F.col("chunk").cast("string")).alias("source"), "chunk", "text")


_SPELL = lambda n: f"translate(lpad(({n})::varchar, 6, '0'), '0123456789', 'qwzxkvjpfh')"


@query(f"""
select 'ana' || {_SPELL('c_custkey')} || ' silva' || {_SPELL('c_custkey % 97')} as canonical, '(14) 3103-' || lpad((c_custkey % 10000)::varchar, 4, '0') as phones,
  'user' || c_custkey || '@example.org' as emails, 'The Department' as departments
from customer
""")
def contact_index(spark, d):
    contacts, _ = people.contact_index(_pages_as_staff(spark, d), ONTOLOGY)
    return contacts.select("canonical", F.array_join("phones", ",").alias("phones"), F.array_join("emails", ",").alias("emails"), F.array_join("departments", ",").alias("departments"))


@query(f"""
select c_custkey as query_id, '### Contato' || chr(10) || '**Nome:** Ana' || {_SPELL('c_custkey')} || ' Silva' || {_SPELL('c_custkey % 97')} || chr(10) || '**Departamento(s):** The Department' || chr(10)
  || '**Telefone(s):** (14) 3103-' || lpad((c_custkey % 10000)::varchar, 4, '0') || chr(10) || '**E-mail(s):** user' || c_custkey || '@example.org' as answer
from customer
""")
def contact_lookup(spark, d):
    c = table(spark, d, "customer")
    spell = F.translate(F.lpad(F.col("c_custkey").cast("string"), 6, "0"), "0123456789", "qwzxkvjpfh")
    q = c.select(F.col("c_custkey").alias("query_id"), F.concat(F.lit("Qual o telefone de Ana"), spell, F.lit("?")).alias("question"))
    contacts, aliases = people.contact_index(_pages_as_staff(spark, d), ONTOLOGY)
    return people.contact_answer(people.lookup(q, contacts, aliases)).select("query_id", "answer")


# ---- conversations, cache, telemetry, evaluation ----
@query("""
select conv_id, turn, (count(*) over w)::bigint as n_before,
  md5(coalesce(string_agg(role || ':' || text, chr(1)) over w, '')) as history
from conversations window w as (partition by conv_id order by turn rows between unbounded preceding and 1 preceding)
""")
def history_window(spark, d):
    h = agent.history(table(spark, d, "conversations"))
    return h.select("conv_id", "turn", F.size("history").cast("long").alias("n_before"), digest(F.transform("history", lambda m: F.concat(m["role"], F.lit(":"), m["text"]))).alias("history"))


@query("select conv_id, turn, sha256(to_json({'conv': conv_id, 'role': role, 'turn': turn})::varchar) as key from conversations")
def cache_key(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", cache.key(conv=F.col("conv_id"), role=F.col("role"), turn=F.col("turn")).alias("key"))


@query("""
with c as (select 'k' || (user_id % 500) as key, max_by(event_id, event_id) as event_id from events where event_type = 'view' group by 1)
select e.event_id, c.event_id is not null as hit, 'v' || c.event_id as value_json from events e left join c on c.key = 'k' || (e.user_id % 700)
""")
def cache_lookup(spark, d):
    e = table(spark, d, "events")
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    last = e.filter("event_type = 'view'").groupBy(F.concat(F.lit("k"), F.col("user_id") % 500).alias("key")).agg(F.max("event_id").alias("v"))
    held = last.select(F.lit("query").alias("namespace"), "key", F.concat(F.lit("v"), "v").alias("value_json"))
    held = cache.store(spark.createDataFrame([], cache.SCHEMA), held, 43200, at)
    asks = e.select("event_id", F.concat(F.lit("k"), F.col("user_id") % 700).alias("key"))
    return cache.fetch(asks, held, "query", F.lit("2024-01-01 06:00:00").cast("timestamp")).select("event_id", "hit", "value_json")


@query("select event_type, count(*)::bigint as n from events group by 1")
def counters(spark, d):
    return telemetry.counters(table(spark, d, "events"))


@query("""
select time_bucket(interval '5 minutes', ts) as window_start, event_type, count(*)::bigint as n, round(avg(value), 6) as mean, round(max(value), 6) as top
from events group by 1, 2
""")
def latency_rollup(spark, d):
    e = table(spark, d, "events")
    out = e.groupBy(F.window("ts", "5 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("top"))
    return out.select(F.col("w.start").alias("window_start"), "event_type", "n", "mean", "top")


@query("select time_bucket(interval '1 day', ts) as window_start, event_type, count(*)::bigint as n from events group by 1, 2 having count(*) > 3")
def rate_alerts(spark, d):
    return telemetry.rate_alerts(table(spark, d, "events"), 24 * 60, 3).drop("window_end")


@query(f"""
with {_BM25}, gold as (select item_id as query_id, regexp_replace(lower(replace(replace(strip_accents(text), 'ª', 'a'), 'º', 'o')), '[^\\x00-\\x7F]', '', 'g') as g from benchmark),
j as (
  select l.query_id, lexical_rank as pos, contains(regexp_replace(lower(replace(replace(strip_accents(text), 'ª', 'a'), 'º', 'o')), '[^\\x00-\\x7F]', '', 'g'), g) as hit
  from lex l join documents x on x.doc_id = l.doc_id join gold on gold.query_id = l.query_id),
s as (
  select query_id, sum(case when hit and pos <= 5 then 1 / log2(pos + 1) else 0 end) as dcg, count(*) filter (where hit) as hits,
    min(pos) filter (where hit and pos <= 10) as first, max(case when hit and pos <= 5 then 1.0 else 0.0 end)::double as recall from j group by query_id)
select query_id, round(case when hits > 0 then dcg / list_sum(list_transform(range(1, least(hits, 5) + 1), lambda i: 1 / log2(i + 1))) else 0 end, 6) as ndcg,
  round(coalesce(1 / first, 0), 6) as mrr, recall from s
""")
def recall_mrr_ndcg(spark, d):
    """Gold: the item's whole text, a passage that planted documents hold."""
    gold = asked(spark, d).select("query_id", F.array("question").alias("ground_truth"))
    preds = _bm25(spark, d).join(docs(spark, d).select("doc_id", "text"), "doc_id").select("query_id", F.col("lexical_rank").alias("pos"), "text")
    m = evaluate.metrics(evaluate.judge(preds, gold))
    return m.select("query_id", F.round("ndcg", 6).alias("ndcg"), F.round("mrr", 6).alias("mrr"), "recall")


from . import more_queries  # noqa: E402, F401  registers more of them


def _shipped(fn):
    def run(spark: SparkSession, d: str) -> DataFrame:
        ship(spark)
        return fn(spark, d)

    run.__name__, run.__doc__ = fn.__name__, fn.__doc__
    return run


QUERIES = {k: _shipped(f) for k, f in QUERIES.items()}
