"""The lexical index: blocks, bounds and segments."""

import os
import random

import pytest

from corvane import shared
from corvane.operators import index, retrieve, segments
from corvane.plans import ingest, registry

WORDS = [f"{a}{b}" for a in "bcdfgklm" for b in ("alo", "ero", "ino", "uta")]


def corpus(n, seed=1):
    rnd = random.Random(seed)
    return [(i, " ".join(rnd.choice(WORDS[: rnd.choice((4, 12, 32))]) for _ in range(rnd.randint(0, 40)))) for i in range(n)]


def scores(spark, ix, questions):
    q = spark.createDataFrame(questions, "query_id int, question string")
    return {(r.query_id, r.doc_id): round(r.score, 9) for r in retrieve.bm25(q, ix).collect()}


def test_best_first_reads_less_and_finds_the_same(spark):
    docs = spark.createDataFrame([*corpus(2000), (5000, ""), (5001, None)], "doc_id long, text string")
    ix = index.build(docs)
    q = spark.createDataFrame([(1, "balo cero"), (2, "kuta"), (3, "balo balo mino guta"), (4, "nothing here")], "query_id int, question string")
    for k in (1, 30):
        read: list = []
        best = retrieve.top(retrieve.bm25_best(q, ix, k, read, one_pass=0), k).collect()
        want = retrieve.top(retrieve.bm25(q, ix), k).collect()
        assert {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in best} == {(r.query_id, r.rank, r.doc_id, round(r.score, 9)) for r in want}
        df = {r.term: r.df for r in ix.term_stats.collect()}
        assert 0 < sum(read) <= sum(df[w] for w in ("balo", "cero", "kuta", "balo", "mino", "guta"))


def test_documents_without_tokens_are_no_part_of_the_corpus(spark):
    docs = spark.createDataFrame([(1, "alfa beta"), (2, ""), (3, None), (4, "7 !"), (5, "alfa alfa gama delta")], "doc_id long, text string")
    row = index.build(docs).corpus.first()
    assert (row.n, row.avgdl) == (2, 3.0)


def test_segments_equal_a_rebuild(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    state, gone_schema = {}, "doc_id long, text string"
    rnd, questions = random.Random(3), [(1, "balo cero"), (2, "kuta kuta duta"), (3, "mino")]
    for step in range(4):
        out = [(i, state.pop(i)) for i in rnd.sample(sorted(state), min(len(state), 7))]
        new = {i + 100 * step: t for i, t in corpus(25, step)} | {i: f"balo {t}" for i, t in out[:3]}
        state |= new
        files = spark.createDataFrame([(f"f{step}", f"h{step}")], "source_file string, file_hash string").selectExpr("*", "current_timestamp() as processed_at")
        segments.append(spark, path, spark.createDataFrame(list(new.items()), gone_schema), spark.createDataFrame(out, gone_schema), files, fan=2)
    assert {r.doc_id: r.text for r in segments.chunks(spark, path).collect()} == state
    assert [s.level for s in segments.segments(spark, path)] == [2]
    files = spark.createDataFrame([("f0", None)], "source_file string, file_hash string").selectExpr("*", "current_timestamp() as processed_at")
    out = [(i, state.pop(i)) for i in sorted(state)[:5]]
    segments.append(spark, path, spark.createDataFrame([], gone_schema), spark.createDataFrame(out, gone_schema), files, fan=2)
    assert len(segments.segments(spark, path)) == 2 and segments.version(spark, path) == 5
    assert sorted(r.source_file for r in segments.manifest(spark, path).collect()) == [f"f{i}" for i in range(1, 4)]
    got, want = segments.lexical(spark, path), index.build(spark.createDataFrame(list(state.items()), gone_schema))
    assert tuple(got.corpus.first()) == pytest.approx(tuple(want.corpus.first()))
    assert {r.term: (r.df, round(r.idf, 9)) for r in got.term_stats.collect()} == {r.term: (r.df, round(r.idf, 9)) for r in want.term_stats.collect()}
    assert scores(spark, got, questions) == scores(spark, want, questions)
    q = spark.createDataFrame(questions, "query_id int, question string")
    assert {(r.query_id, r.rank, r.doc_id) for r in retrieve.top(retrieve.bm25_best(q, got, 4, one_pass=0), 4).collect()} == {(r.query_id, r.rank, r.doc_id) for r in retrieve.top(retrieve.bm25(q, want), 4).collect()}


def size(folder):
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)


def test_an_update_writes_what_changed(spark, tmp_path):
    src, out = tmp_path / "src", tmp_path / "out"
    src.mkdir()
    rnd = random.Random(5)
    for i in range(60):
        (src / f"{i}.txt").write_text(" ".join(f"w{rnd.randrange(4000)}x" for _ in range(2500)))
    assert ingest.update(spark, str(src), f"file://{out}") == {"new": 60}
    before = size(out)
    (src / "7.txt").write_text("Um texto novo e curto.")
    assert ingest.update(spark, str(src), f"file://{out}") == {"unchanged": 59, "modified": 1}
    assert size(out) - before < before / 10
    assert ingest.chunks(spark, f"file://{out}").filter("source like '%/7.txt'").count() == 1


def test_half_a_version_does_not_count(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    rows = spark.createDataFrame([("f", "h")], "source_file string, file_hash string").selectExpr("*", "current_timestamp() as processed_at")
    segments.replace(spark, path, spark.createDataFrame([(1, "alfa")], "doc_id long, text string"), rows)
    os.makedirs(tmp_path / "store" / "versions" / "2")
    assert segments.version(spark, path) == 1 and segments.chunks(spark, path).count() == 1


def test_index_of_a_folder_follows_its_files(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, "alfa beta")], "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    assert registry.lexical(spark, d).corpus.first().n == 1
    spark.createDataFrame([(1, "alfa beta"), (2, "gama")], "doc_id long, text string").write.mode("overwrite").parquet(f"{d}/documents.parquet")
    assert registry.lexical(spark, d).corpus.first().n == 2
    shared.clear(spark)
    assert registry.lexical(spark, d).corpus.first().n == 2
