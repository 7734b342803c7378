import pytest
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions import fuzzy
from corvane.functions import text as T
from corvane.functions.ontology import Ontology


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("Computa§£o", "Computação"), ("Andr©a Carla", "Andréa Carla"), ("Hist³rico do curso", "Histórico do curso"), ("Inªs e gªnero", "Inês e gênero"),
        ("Profª. Dra. Nome", "Profª. Dra. Nome"), ("nº 123", "nº 123"), ("ºltimos encontros", "últimos encontros"), ("Jo£o e Ant´nio", "João e Antônio"),
    ],
)
def test_repair(spark, raw, want):
    assert one(spark, raw, T.repair) == want


@pytest.mark.parametrize(("raw", "want"), [("14999991234", "(14) 99999-1234"), ("1431036000", "(14) 3103-6000"), ("6308", "6308")])
def test_phone(spark, raw, want):
    assert one(spark, raw, T.normalize_phone) == want


def test_leading_url(spark):
    assert one(spark, "\n https://a.b/c \nx", T.leading_url) == "https://a.b/c"
    assert one(spark, "x\nhttps://a.b", T.leading_url) is None


def test_section(spark):
    assert one(spark, "\n" + "a" * 121 + "\nb", T.section_title) == "a" * 117 + "..."
    assert one(spark, "", T.section_title) is None


@pytest.mark.parametrize(("q", "action"), [("", "ask_clarification"), ("Oi", "ask_clarification"), ("onde?", "answer"), (None, "ask_clarification")])
def test_triage(spark, q, action):
    assert one(spark, q, T.triage).action == action


@pytest.mark.parametrize(("best", "want"), [(0.8, 0.8), (2.0, 0.880797), (None, 0.0)])
def test_confidence(spark, best, want):
    got = spark.createDataFrame([(best,)], "c double").select(T.sigmoid_confidence(F.col("c"))).first()[0]
    assert round(got, 6) == want


def test_terms(spark):
    assert one(spark, "Qual o e-mail da secretária ana@x.org e da Secretaria?", T.candidate_terms) == ["ana@x.org", "mail", "secretária", "ana", "org"]


def test_fold_matches_unicode(spark):
    s = "Ação É ñ ü Ç ž ő ß"
    assert one(spark, s, T.fold) == T.fold_text(s)


def test_json(spark):
    get = lambda c: T.first_json(c, "struct<a: int>")["a"]
    assert one(spark, '{"a": 1}', get) == 1
    assert one(spark, 'text {"a": 2} more', get) == 2
    assert one(spark, "none", get) is None


def test_fuzzy():
    assert fuzzy.ratio("abcd", "abed") == pytest.approx(75.0)
    assert fuzzy.partial_ratio("silva", "joao da silva neto") == 100
    assert fuzzy.token_set_ratio("a b c", "c b a d") == 100
    assert fuzzy.token_set_ratio("fuzzy was a bear", "wuzzy was a bear") == pytest.approx(100 * 2 * 15 / 32, abs=2)
    assert fuzzy.lcs_length("agcat", "gac") == 2


def test_settings():
    assert Settings.from_env({"FETCH_K": "80", "TOP_K": "x", "CHUNK_SIZE": "10", "CHUNK_OVERLAP": "60"}) == Settings(fetch_k=80, chunk_size=10, chunk_overlap=9)


def test_first_match_wins(spark):
    o = Ontology({"b": "Beta", "a": "Alpha"})
    assert one(spark, "a and b", lambda c: o.first_match(c)["label"]) == "Beta"
    assert one(spark, "xabx", lambda c: o.first_match(c, whole_word=True)) is None


def test_variants(spark):
    assert one(spark, " Quais cursos? qual ", T.local_variants) == ["Quais cursos? qual", "quais cursos? qual", "Quais cursos qual", "Quais cursos? qual é"]
