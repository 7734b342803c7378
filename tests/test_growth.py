"""Odd values in tables, and steps whose memory must not follow their input."""

import random
import re

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions import text as T
from corvane.functions.fuzzy import partial_ratio, ratio, token_set_ratio
from corvane.functions.ontology import tag_entities
from corvane.operators import chunking, fuse, fuzzy_search, index, retrieve
from corvane.plans import registry


def test_scores_without_a_value_are_as_in_sql(spark, tmp_path):
    values = [1.5, None, float("nan"), -0.25, float("inf"), None, 0.0, 1e-300, float("nan"), 12345678.9]
    spark.createDataFrame(list(enumerate(values * 2)), "event_id long, value double").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.QUERIES["score_cleanup"](spark, str(tmp_path)), con.sql(registry.ORACLE_SQL["score_cleanup"])
    told = lambda r: (r[0], *[None if x is None else repr(x) for x in r[1:]])
    assert sorted(told(tuple(r)) for r in got.select("event_id", "safe", "clean").collect()) == sorted(told(r) for r in want.fetchall())


def test_scores_that_are_floats_are_as_in_sql(spark, tmp_path):
    rows = [(i, i / 10) for i in range(60)] + [(60, None), (63, float("nan"))]
    spark.createDataFrame(rows, "event_id long, value double").withColumn("value", F.col("value").cast("float")).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    got, want = registry.QUERIES["score_cleanup"](spark, str(tmp_path)), con.sql(registry.ORACLE_SQL["score_cleanup"])
    told = lambda r: (r[0], *[None if x is None else repr(x) for x in r[1:]])
    assert sorted(told(tuple(r)) for r in got.select("event_id", "safe", "clean").collect()) == sorted(told(r) for r in want.fetchall())


def _peak(spark):
    """Largest memory, MB, that a Python worker of the session has had."""

    def used(batches):
        import resource

        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_pydict({"mb": [resource.getrusage(resource.RUSAGE_SELF).ru_maxrss >> 10]})

    return max(r.mb for r in spark.range(0, 64, 1, 16).mapInArrow(used, "mb long").collect())


def test_vector_search_holds_few_products_at_once(spark):
    rnd = np.random.default_rng(1)
    x, q = rnd.integers(-9, 9, (10_000, 8)).astype(float), rnd.integers(-9, 9, (3000, 8)).astype(float)
    vectors = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "doc_id long, embedding array<double>").coalesce(1)
    asks = spark.createDataFrame([(i, 0, v) for i, v in enumerate(q.tolist())], "query_id long, variant int, qvec array<double>")
    got = {(r.query_id, r.rank): (r.doc_id, r.distance) for r in retrieve.vector_top(asks, vectors, 3).collect()}
    for i in range(0, 3000, 100):
        d = ((x - q[i]) ** 2).sum(axis=1)
        assert [got[i, n + 1] for n in range(3)] == [(int(j), float(d[j])) for j in np.lexsort((np.arange(10_000), d))[:3]]
    # ten thousand rows by three thousand questions are 240 MB a copy
    assert _peak(spark) < 500


def test_one_pass_finds_the_best_of_every_question_with_ties(spark, monkeypatch):
    """Groups of equal texts, cut into small pieces and blocks of questions, against all scores."""
    rnd = random.Random(7)
    words = [f"{a}{b}" for a in "bcdfgklm" for b in ("alo", "ero", "ino", "uta")]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30))) for _ in range(150)]
    rows = [(i, texts[int(rnd.random() ** 3 * 150)]) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(index, "COUNTED", 200)
    built = index.build(docs)
    q = spark.createDataFrame([(i, " ".join(rnd.choice(words) for _ in range(4))) for i in range(25)] + [(99, "absent")], "query_id int, question string")
    want = {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in retrieve.top(retrieve.bm25(q, built).withColumn("score", F.round("score", 9)), 7).collect()}
    for block in (3, 4096):
        found = retrieve._scanned(retrieve._weights(q, built), built, 7, block).withColumn("score", F.round("score", 9))
        assert {(r.query_id, r.rank): (r.doc_id, round(r.score, 9)) for r in retrieve.top(found, 7).collect()} == want and len(want) > 150
    # no score of a single question is shuffled before a task has cut it to its best
    assert found.count() < 1500 * 25 / 4


def test_blocks_hold_all_postings_in_order(spark, monkeypatch):
    monkeypatch.setattr(index, "COUNTED", 50)
    rows = [(f"d{i}", text) for i, text in enumerate(["Ação ação, ÀB ab!", "", None, "x y", "São KK Ÿz ßa", *[f"alfa beta{'x' * (i % 7)} alfa" for i in range(200)]])]
    built = index.build(spark.createDataFrame(rows, "doc_id string, text string"))
    want = {}
    for i, text in rows:
        for w in re.findall(T.LETTERS, text or ""):
            if len(w) > 1:
                want[T.fold_text(w), i] = want.get((T.fold_text(w), i), 0) + 1
    assert {(r.term, r.doc_id): r.tf for r in built.postings.collect()} == want
    for r in built.blocks.collect():
        assert [x.doc_id for x in r.docs] == sorted(x.doc_id for x in r.docs) and r.top_tf == max(x.tf for x in r.docs) and r.least_dl == min(x.dl for x in r.docs)


def test_tasks_of_the_index_follow_its_tokens(spark, monkeypatch):
    """More tokens, more tasks: what a task holds doesn't grow with the corpus."""
    monkeypatch.setattr(index, "TASK_TOKENS", 100)
    docs = spark.createDataFrame([(i, "alfa beta gama delta " * 5) for i in range(640)], "doc_id long, text string")
    assert index.build(docs).blocks.select(F.input_file_name()).distinct().count() > 8


def test_chunks_come_in_small_batches(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PACKED", 500)
    texts = [None, "", " ", *[f"Uma frase {i} de teste. Outra frase com mais palavras. " * (i % 9) for i in range(60)]]
    docs = spark.createDataFrame([(i, f"s{i}", t) for i, t in enumerate(texts)], "doc_id int, source string, text string").coalesce(1)
    s = Settings(chunk_size=12, chunk_overlap=3)
    got = {}
    for r in chunking.chunk(docs, s).select("doc_id", "source", "chunk", "chunk_total", "text", "chunk_tokens").collect():
        got[r.doc_id, r.chunk] = (r.source, r.chunk_total, r.text, r.chunk_tokens)
    want = {}
    for i, t in enumerate(texts):
        cut = chunking.pack(t or "", 12, 3)
        want |= {(i, n): (f"s{i}", len(cut), c, k) for n, (c, k) in enumerate(cut)}
    assert got == want and len(want) > 100


def _copies(expression, marker):
    """How often a plan works out a piece of an expression."""
    return expression._jdf.queryExecution().optimizedPlan().toString().count(marker)


def test_texts_are_folded_once_for_all_phrases(spark):
    docs = spark.createDataFrame([(1, "a The Department of keine Sache"), (2, None)], "doc_id int, text string")
    tagged = tag_entities(docs, registry.ONTOLOGY)
    assert _copies(tagged, "[^\\p{L}\\p{N}]+") == 1
    assert [None if r.entities is None else [e.phrase for e in r.entities] for r in tagged.orderBy("doc_id").collect()] == [["the department", "the", "keine"], []]


def test_repair_works_each_step_out_once(spark):
    docs = spark.createDataFrame([("SÃ£o\nAnt´nio",), ("e\u0301",), (None,)], "t string")
    fixed = docs.select(T.repair(F.col("t")).alias("t"))
    assert _copies(fixed, "is_valid_utf8") <= 1
    assert [r.t for r in fixed.collect()] == ["São\nAntônio", "\u00e9", None]


def test_fuzzy_index_stores_no_grams(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"a sentence about biblioteca number {i}. another one") for i in range(50)], "doc_id long, text string")
    fuzzy_search.build(docs, f"file://{tmp_path}/s")
    assert sorted(x.name for x in tmp_path.joinpath("s").iterdir()) == ["places", "sentences", "words"]


def test_fuzzy_windows_in_accented_and_long_words(spark, monkeypatch):
    """Terms with letters of two bytes, parts of more than eight bytes, pieces of a few bytes."""
    monkeypatch.setattr(fuzzy_search, "LOOKED_AT", 40)
    rnd = random.Random(3)
    letters = "abcßæø "
    sentences = sorted({"".join(rnd.choice(letters) for _ in range(rnd.randint(1, 90))).strip() or "a" for _ in range(120)})
    terms = sorted({s[k : k + n] for s in sentences for k, n in [(rnd.randrange(len(s)), rnd.choice((3, 9, 40)))] if s[k : k + n].strip()})[:60]
    terms += [t[:2] + "b" + t[3:] for t in terms]
    terms = sorted(set(terms))
    held = fuzzy_search.SentenceIndex(spark.createDataFrame(list(enumerate(sentences)), "sid int, folded string"), None, None)
    got = fuzzy_search.window_matches(spark.createDataFrame([(t,) for t in terms], "term string"), held, 80)
    want = {(t, i): w for t in terms for i, s in enumerate(sentences) if (w := partial_ratio(t, s)) >= 80}
    assert {(r.term, r.sid): r.score for r in got.collect()} == want and len(want) > 200


def test_texts_are_cut_in_whole_batches_as_the_expression_cuts_them(spark, monkeypatch):
    """Letters, signs and scripts of all kinds, in pieces of a few hundred characters; no task cuts texts in a JVM pattern."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    monkeypatch.setattr(index, "CUT", 300)
    rnd = random.Random(3)
    signs = [*map(chr, range(1, 0x180)), *"ªº×÷…“日\U0001f600ıİſ", *"abcdeáéíóúñüABC    \n" * 20]
    texts = [None, "", "a", "é", "  ", "a b c", "ab", "ÀB", *("".join(rnd.choice(signs) for _ in range(rnd.choice((1, 2, 3, 40, 400)))) for _ in range(600))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    schema = "doc_id long, ws string, dl int"
    got = docs.mapInArrow(index._words_of(to_arrow_schema(StructType.fromDDL(schema))), schema)
    ws = T.bm25_tokens(F.coalesce("text", F.lit("")))
    want = docs.select("doc_id", F.array_join(ws, " ").alias("ws"), F.size(ws).alias("dl"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    assert "regexp_extract_all" not in got._jdf.queryExecution().toString()


def _mmr(relevance, texts, k, lam):
    """The definition: each step compares all that is left with all that is chosen."""
    chosen, left = [], list(range(len(texts)))
    while left and len(chosen) < k:
        value = {i: lam * relevance[i] - (1 - lam) * max((_set_ratio(texts[i], texts[j]) / 100 for j in chosen), default=0.0) for i in left}
        chosen.append(max(left, key=lambda i: (value[i], -i)))
        left.remove(chosen[-1])
    return chosen


def _set_ratio(a, b):
    """All three ratios of the joined words, in full."""
    left, right = set(a.split()), set(b.split())
    common, only_a, only_b = sorted(left & right), sorted(left - right), sorted(right - left)
    if not left or not right or (common and not (only_a and only_b)):
        return 100.0 if left and right else 0.0
    base, x, y = " ".join(common), " ".join(common + only_a), " ".join(common + only_b)
    return max([ratio(x, y), *([ratio(base, x), ratio(base, y)] if common else [])])


def test_diversity_compares_as_few_texts_as_it_needs_with_the_same_choice():
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcé") for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    for n in range(150):
        texts = [" ".join(rnd.choice(words) for _ in range(rnd.choice((0, 1, 5, 30)))) for _ in range(rnd.randint(1, 12))]
        texts += texts[: n % 3]
        relevance = [rnd.choice((0.0, 0.5, rnd.random())) for _ in texts]
        k, lam = rnd.randint(1, 9), rnd.choice((0.25, 0.3, 1.0))
        assert fuse.mmr_order(relevance, texts, k, lam) == (_mmr(relevance, texts, k, lam) if len(texts) > k else list(range(len(texts))))
        assert all(token_set_ratio(a, b) == _set_ratio(a, b) for a, b in zip(texts, texts[1:]))


def test_diversity_reads_whole_texts(spark):
    """Two texts that begin alike for 600 characters and go on differently, and one that is a copy of the first."""
    begin = " ".join(f"word{i}" for i in range(80))
    other = " ".join(f"{chr(97 + i % 26) * 3}{i}" for i in range(2000))
    rows = [(1, "q", 1, f"{begin} tail", 1.0, 1), (1, "q", 2, f"{begin} tail", 1.0, 2), (1, "q", 3, f"{begin} {other}", 0.99, 3)]
    ranked = spark.createDataFrame(rows, "query_id int, question string, doc_id int, text string, vector_score double, place int").withColumn("lexical_score", F.lit(None).cast("double"))
    assert [r.doc_id for r in fuse.diversify(ranked, 2).orderBy("mmr_rank").collect()] == [1, 3]


def test_windows_are_measured_where_sentences_are_looked_at():
    """In whole batches, with the scores of the definition; only sentences of the term's length and very long terms are left."""
    rnd = random.Random(11)
    make = lambda n: "".join(rnd.choice("abcdeé ") for _ in range(n))
    sentences = [make(rnd.choice((1, 6, 10, 30, 90))) for _ in range(90)]
    terms = {make(n) for n in (3, 6, 10, 10, 19, 40)}
    for s in sentences[:25]:
        t = s[(k := rnd.randrange(len(s))) : k + rnd.choice((5, 9, 12, 20, 64, 70))]
        terms |= {t, t[:2] + t[3:], t[:3] + "b" + t[3:]} - {""}
    for threshold in (80, 90):
        rows = []
        for t in sorted(terms):
            edits = int(len(t) * 2 * (1 - threshold / 100) + 1e-9)
            n = min(edits + 1, len(t))
            cut = [i * len(t) // n for i in range(n + 1)]
            rows.append((t, edits, [t[a:b] for a, b in zip(cut, cut[1:])]))
        at, which, scores = fuzzy_search._Terms(rows, threshold).look(pa.array(sentences))
        got = {(sentences[r], rows[n][0]): s for r, n, s in zip(at, which, scores)}
        want = {(s, t): w for s in sentences for t in terms if len(s) >= len(t) and (w := partial_ratio(t, s)) >= threshold}
        assert {k: s for k, s in got.items() if s == s} == {k: w for k, w in want.items() if len(k[0]) > len(k[1]) <= 64} and len(want) > 50
        assert {k for k in want if len(k[0]) == len(k[1])} | {k for k in want if len(k[1]) > 64} <= {k for k, s in got.items() if s != s}
