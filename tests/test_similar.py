"""Similarity joins and fuzzy search against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import fuzzy
from corvane.functions import text as T
from corvane.functions.ontology import Ontology
from corvane.operators import fuzzy_search, retrieve, similar

rnd = random.Random(5)


def edits(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def alike(a, b):
    return 1 - edits(a, b) / max(len(a), len(b))


def changed(word, letters):
    word = list(word)
    for _ in range(rnd.randint(0, 5)):
        i, what = rnd.randrange(len(word)), rnd.random()
        if what < 0.4:
            word[i] = rnd.choice(letters)
        elif what < 0.7 and len(word) > 4:
            del word[i]
        else:
            word.insert(i, rnd.choice(letters))
    return "".join(word)


def window(a, b):
    """The best ratio of the shorter string with all windows, by definition."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    both = [(short, long), (long, short)][: 1 + (len(a) == len(b))]
    return max(fuzzy.ratio(x, y[max(0, end - n) : end]) for x, y in both for end in range(1, len(y) + n))


def test_partial_ratio_by_definition():
    for _ in range(300):
        a, b = ("".join(rnd.choice("abc ") for _ in range(rnd.randint(0, 14))) for _ in range(2))
        assert fuzzy.partial_ratio(a, b) == window(a, b)


def test_close_words(spark):
    base = ["".join(rnd.choice("abcde") for _ in range(n)) for n in range(4, 34)]
    words = sorted({changed(w, "abcde") for w in base for _ in range(12)})
    want = {(w, t, int(100 * alike(w, t))) for w in words for t in base if abs(len(w) - len(t)) <= 1 and alike(w, t) >= 0.86}
    got = similar.close_words(spark.createDataFrame([(w,) for w in words], "word string"), spark.createDataFrame([(t,) for t in base], "term string"))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100


@pytest.fixture(scope="module")
def texts():
    sentences = ["".join(rnd.choice("abcd ") for _ in range(rnd.randint(1, 50))).strip() or "a" for _ in range(150)]
    terms = sorted({changed(s[i : i + rnd.randint(3, 22)].strip() or "abc", "abcd ") for s in sentences for i in (0, max(0, len(s) - 8), rnd.randrange(len(s)))})[:80]
    return sentences, terms


@pytest.mark.parametrize("threshold", [90, 75])
def test_windows(spark, texts, threshold):
    sentences, terms = texts
    best = {s: max(window(t, s) for t in terms) for s in sentences}
    got = similar.window_scores(spark.createDataFrame([(1, s) for s in sentences], "query_id int, folded string"), spark.createDataFrame([(1, t) for t in terms], "query_id int, term string"), threshold)
    assert {r.folded: r.score for r in got.collect()} == {s: b for s, b in best.items() if b >= threshold}
    # filters leave a share of the pairs to measure, and lose none that matches
    rows = spark.createDataFrame([(s, t) for s in sentences for t in terms], "folded string, term string").filter(similar.may_match(F.col("term"), F.col("folded"), threshold))
    kept = {tuple(r) for r in rows.collect()}
    assert {(s, t) for s in sentences for t in terms if window(s, t) >= threshold} <= kept
    assert threshold < 90 or len(kept) < len(sentences) * len(terms) / 2


@pytest.mark.parametrize("threshold", [90, 75])
def test_stored_grams(spark, texts, threshold):
    """Every pair that reaches the threshold comes through the grams."""
    sentences, terms = texts
    rows = [(i, s) for i, s in enumerate(sorted(set(sentences)))]
    table = spark.createDataFrame(rows, "sid int, folded string")
    held = table.select(F.explode(fuzzy_search.grams(F.col("folded"))).alias("gram"), "sid")
    index = fuzzy_search.SentenceIndex(table, None, None, held, held.groupBy("gram").agg(F.count("*").alias("n")))
    got = fuzzy_search.window_matches(spark.createDataFrame([(t,) for t in terms], "term string"), index, threshold)
    assert {(r.term, r.sid): r.score for r in got.collect()} == {(t, i): w for t in terms for i, s in rows if (w := window(t, s)) >= threshold}


def hits_of(text, terms, threshold):
    """Sentence hits of a text as they are defined, best first."""
    out = []
    for s in (x for part in text.split("\n") for x in __import__("re").split(r"(?<=[.!?;:])\s+", part)):
        s = " ".join(s.split())
        if not s:
            continue
        words = [w for w in __import__("re").findall(T.LETTERS, s)]
        words = [T.fold_text(w) for w in words if len(w) >= 5]
        exact = [int(100 * alike(w, t)) for t in terms for w in words if abs(len(w) - len(t)) <= 1 and alike(w, t) >= 0.86]
        best = max(exact) if exact else max((window(t, T.fold_text(s)) for t in terms), default=0)
        if best >= threshold:
            out.append((s, best))
    seen, kept = set(), []
    for s, b in sorted(out, key=lambda x: -x[1]):
        if s.lower() not in seen:
            seen.add(s.lower())
            kept.append((s, b))
    return kept


DOCS = [
    (1, "dep_comp/a.txt", "Secretária Joana Pereira. Telefone na portaria; biblioteca fechada!\nOutra linha de texto"),
    (2, "b.txt", "A bibliotecca abre cedo. A BIBLIOTECCA ABRE CEDO. Nada mais."),
    (3, "c.txt", "Matrículas: ver edital. Joanna Perreira atende"), (4, "d.txt", ""), (5, "e.txt", None), (6, "f.txt", "ab. biblio"), (7, "g.txt", "Telefonne da secretarria de computação"),
]
QUESTIONS = [(1, "Onde fica a biblioteca?"), (2, "telefone da secretaria Joana Pereira"), (3, "matricula computacao"), (4, "??"), (5, "zzzzzzz")]


def test_sentence_hits(spark):
    docs = spark.createDataFrame([(q, i, t) for q, _ in QUESTIONS for i, _, t in DOCS], "query_id int, doc_id int, text string")
    q = spark.createDataFrame(QUESTIONS, "query_id int, question string")
    terms: dict = {}
    for r in retrieve.question_terms(q).collect():
        terms.setdefault(r.query_id, []).append(r.term)
    for threshold in (90, 80):
        got: dict = {}
        for r in retrieve.sentence_hits(docs, q, threshold=threshold, limit=None).orderBy("hit").collect():
            got.setdefault((r.query_id, r.doc_id), []).append((r.sentence, r.score))
        want = {(n, i): [(s, round(b)) for s, b in hits] for n, _ in QUESTIONS for i, _, t in DOCS if (hits := hits_of(t or "", terms.get(n, []), threshold))}
        assert got == want and len(want) > 5


def test_fuzzy_top(spark):
    docs = spark.createDataFrame(DOCS, "doc_id int, source string, text string")
    q = spark.createDataFrame(QUESTIONS, "query_id int, question string")
    ontology = Ontology({"comp": "Departamento de Computação"})
    terms: dict = {}
    for r in retrieve.question_terms(q, ontology).collect():
        terms.setdefault(r.query_id, []).append(r.term)
    got = fuzzy_search.fuzzy_top(q, docs, fuzzy_search.build(docs), ontology, 85, 6).collect()
    want = []
    for n, question in QUESTIONS:
        best = [(max(b for _, b in hits) + (8 if "comp" in T.fold_text(question) and "comp" in s else 0), i) for i, s, t in DOCS if (hits := hits_of(t or "", terms.get(n, []), 85))]
        want += [(n, i, round(b, 6), k) for k, (b, i) in enumerate(sorted(best, key=lambda x: (-x[0], x[1]))[:6], 1)]
    assert sorted((r.query_id, r.doc_id, round(r.score, 6), r.rank) for r in got) == sorted(want) and len(want) > 5
