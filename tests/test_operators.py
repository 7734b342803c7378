import json
import zipfile

import pytest
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions.ontology import Ontology
from corvane.operators import agent, cache, chunking, evaluate, fuse, index, people, rank, retrieve, telemetry
from corvane.operators import answer as A
from corvane.plans import ingest
from corvane.plans import questions as Q
from corvane.sources import files, tables
from corvane.streaming import streams


def test_sentences():
    assert chunking.split_sentences("Fale com o Dr. Silva. Ele atende.") == ["Fale com o Dr. Silva.", "Ele atende."]


def test_pack_overlap():
    text = "Um dois tres. Quatro cinco. Seis sete."
    assert chunking.pack(text, 5, 2) == [("Um dois tres.\nQuatro cinco.", 5), ("Quatro cinco.\nSeis sete.", 4)]
    assert chunking.pack("", 5, 2) == []
    assert [c for c, _ in chunking.pack("palavra " * 40, 20, 0)][0] != ""


def test_chunk_columns(spark):
    docs = spark.createDataFrame([("f.txt", "Ligue (14) 3103-6000 para a DTI. Escreva a x@y.org."), ("g.txt", None)], "source string, text string")
    rows = chunking.chunk(docs, Settings(chunk_size=50), Ontology({"dti": "Diretoria"})).collect()
    assert [(r.chunk, r.chunk_total, r.sector, r.emails, r.phones) for r in rows] == [(0, 1, "Diretoria", ["x@y.org"], ["(14) 3103-6000"])]


def test_rrf(spark):
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id int, doc_id string, vector_rank int")
    x = spark.createDataFrame([(1, "b", 1), (1, "c", 2)], "query_id int, doc_id string, lexical_rank int")
    got = {r.doc_id: (r.rrf, r.fused_rank) for r in fuse.reciprocal_rank(v, x, 60).collect()}
    assert got["b"] == (pytest.approx(1 / 62 + 1 / 61), 1) and got["a"] == (pytest.approx(1 / 61), 2) and got["c"] == (pytest.approx(1 / 62), 3)
    assert [r.doc_id for r in fuse.concatenate(v, x).orderBy("fused_rank").collect()] == ["a", "b", "c"]


def test_cap(spark):
    rows = spark.createDataFrame([(1, i, s, i) for i, s in enumerate("ssst", 1)], "query_id int, doc_id int, source string, fused_rank int")
    assert [r.source for r in fuse.cap_by(rows, 2).orderBy("place").collect()] == ["s", "s", "t"]


def test_mmr():
    assert fuse.mmr_order([1, 2], ["a", "b"], 5, 0.3) == [0, 1]
    assert fuse.mmr_order([1.0, 0.9, 0.5], ["a b c", "a b c", "x y z"], 2, 0.3) == [0, 2]
    assert fuse.mmr_order([1.0, 0.9, 0.5], ["a b c", "a b c", "x y z"], 2, 0) == [0, 1, 2]


def test_metrics(spark):
    j = spark.createDataFrame([(1, 1, False), (1, 2, True), (1, 3, True), (2, 1, False)], "query_id int, pos int, hit boolean")
    got = {r.query_id: r for r in evaluate.metrics(j).collect()}
    assert round(got[1].ndcg, 6) == 0.693426 and got[1].mrr == 0.5 and got[1].recall == 1.0
    assert (got[2].ndcg, got[2].mrr, got[2].recall) == (0.0, 0.0, 0.0)
    assert evaluate.summarise(evaluate.metrics(j.limit(0))).first().mrr == 0.0


def test_manifest(spark):
    rows = lambda d: spark.createDataFrame(list(d.items()), "source_file string, file_hash string")
    got = {r.source_file: r.status for r in tables.diff(rows({"a": "1", "b": "2", "c": "3"}), rows({"b": "2", "c": "9", "d": "4"})).collect()}
    assert got == {"a": "new", "b": "unchanged", "c": "modified", "d": "deleted"}


def test_number_rows(spark):
    got = tables.number_rows(spark.range(100).repartition(7), ["id"], start=5).collect()
    assert sorted((r.id, r.faiss_index) for r in got) == [(i, i + 5) for i in range(100)]


def test_bm25_hand_computed(spark):
    docs = spark.createDataFrame([(0, "ab ab cd"), (1, "cd ef"), (2, None), (3, "gh")], "doc_id int, text string")
    q = spark.createDataFrame([(1, "Áb ab x")], "query_id int, question string")
    got = retrieve.bm25(q, index.build(docs)).collect()
    assert [r.doc_id for r in got] == [0]
    import math

    # the document without a token is no part of the corpus: three documents of 3, 2 and 1 tokens
    idf = math.log(3 - 1 + 0.5) - math.log(1.5)
    assert got[0].score == pytest.approx(2 * idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / 2)))


def test_loaders(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("Olá\n\nmundo".encode())
    (tmp_path / "b.ini").write_bytes("é".encode("latin-1"))
    (tmp_path / "c.csv").write_text("n,v\na,1\nb,\n")
    (tmp_path / "d.json").write_text('{"a":{"b":[1,null]}}')
    (tmp_path / "e.json").write_text("{broken")
    (tmp_path / "f.exe").write_text("no")
    with zipfile.ZipFile(tmp_path / "g.docx", "w") as z:
        w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>um</w:t></w:r></w:p><w:p><w:r><w:t>dois</w:t></w:r></w:p></w:body></w:document>')
    got = {r.source.rsplit("/", 1)[1]: r for r in files.load(files.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"a.txt", "b.ini", "c.csv", "d.json", "e.json", "g.docx"}
    assert got["b.ini"].text == "é" and got["g.docx"].text == "um\ndois"
    assert got["c.csv"].text == "| n | v |\n| --- | --- |\n| a | 1 |\n| b |  |"
    assert got["d.json"].text == "a.b.0: 1\na.b.1: None"
    assert got["e.json"].text is None and got["e.json"].error
    assert {r.file_ext: r.files for r in files.count_by_extension(spark, str(tmp_path)).collect()}[".json"] == 2
    read = files.load(files.scan(spark, str(tmp_path)), {".txt": [lambda b: b.decode().upper()]}).filter("file_ext = '.txt'").first()
    assert read.text == "OLÁ\n\nMUNDO"


def test_sentinel(spark):
    empty = spark.createDataFrame([], "source string, text string")
    assert files.or_sentinel(empty).count() == 1
    assert files.or_sentinel(spark.createDataFrame([("a", "x")], "source string, text string")).collect()[0].text == "x"


def test_eval_set(spark, tmp_path):
    (tmp_path / "s.csv").write_text("query,expected\nq1,a||b\n ,x\n")
    (tmp_path / "s.jsonl").write_text('{"question": "q", "ground_truth": ["a", ""]}\n')
    assert [tuple(r) for r in files.read_eval_set(spark, str(tmp_path / "s.csv")).collect()] == [("q1", ["a", "b"])]
    assert [tuple(r) for r in files.read_eval_set(spark, str(tmp_path / "s.jsonl")).collect()] == [("q", ["a"])]


def test_ingest_rebuild_and_update(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "a.txt").write_text("Primeiro texto aqui.")
    (src / "b.txt").write_text("Segundo texto aqui.")
    assert ingest.update(spark, str(src), out) == {"new": 2}
    assert ingest.update(spark, str(src), out) == {"unchanged": 2}
    (src / "a.txt").write_text("Primeiro mudado.")
    (src / "b.txt").unlink()
    (src / "c.txt").write_text("Terceiro.")
    assert ingest.update(spark, str(src), out) == {"modified": 1, "deleted": 1, "new": 1}
    assert sorted(r.text for r in ingest.chunks(spark, out).collect()) == ["Primeiro mudado.", "Terceiro."]
    assert ingest.lexical(spark, out).corpus.first().n == 2


def test_contacts(spark):
    docs = spark.createDataFrame(
        [("dep_comp/docentes.txt", 0, "Prof. Ana Maria Souza\nTel (14) 3103-6000\nana@x.org\n\nCurso de Letras\nb@x.org\n\nBruno Lima\nsem nada"), ("x", 1, None)],
        "source string, chunk int, text string",
    )
    o = Ontology({"comp": "Departamento de Computação"}, {"ana": ["aninha"]})
    contacts, aliases = people.contact_index(docs, o)
    assert [r.canonical for r in contacts.collect()] == ["ana maria souza"]
    q = spark.createDataFrame([(1, "Qual o telefone da Aninha?"), (2, "Quem é Ana?"), (3, "email da souza")], "query_id int, question string")
    got = {r.query_id: r.answer for r in people.contact_answer(people.lookup(q, contacts, aliases)).collect()}
    assert set(got) == {1, 3} and "(14) 3103-6000" in got[1] and "Departamento de Computação" in got[1]


def test_best_contacts(spark):
    df = spark.createDataFrame([(["suporte.fc@u.br", "dti.fc@u.br", "x@u.br"], ["dti"])], "i array<string>, t array<string>")
    assert df.select(people.best_contacts(F.col("i"), F.col("t"), 3)).first()[0] == ["dti.fc@u.br"]
    assert df.select(people.best_contacts(F.col("i"), F.array(F.lit("zz")), 2)).first()[0] == ["x@u.br", "dti.fc@u.br"]


def test_cache(spark):
    at = lambda s: F.lit(s).cast("timestamp")
    empty = spark.createDataFrame([], cache.SCHEMA)
    rows = spark.createDataFrame([("query", "k", "1"), ("agent", "k", "2")], "namespace string, key string, value_json string")
    held = cache.store(empty, rows, 60, at("2024-01-01 00:00:00"))
    ask = spark.createDataFrame([("k",), ("z",)], "key string")
    assert {r.key: r.hit for r in cache.fetch(ask, held, "query", at("2024-01-01 00:00:30")).collect()} == {"k": True, "z": False}
    assert not any(r.hit for r in cache.fetch(ask, held, "query", at("2024-01-01 00:02:00")).collect())
    left, removed = cache.invalidate(held, "query")
    assert [r.namespace for r in left.collect()] == ["agent"] and [tuple(r) for r in removed.collect()] == [("query", 1)]


def test_agent(spark):
    q = spark.createDataFrame([(1, "onde fica?"), (2, "oi"), (3, "nada disto")], "query_id int, question string")
    conf = F.when(F.col("question").endswith("bloco A"), 0.82).otherwise(0.2)
    reply = lambda df: df.select("query_id", F.lit("r").alias("answer"), F.lit(True).alias("context_found"), conf.alias("confidence"))
    better = lambda df: df.select("query_id", F.when(F.col("query_id") == 1, F.concat("asked", F.lit(" bloco A"))).otherwise(F.col("asked")).alias("refined"))
    got = {r.query_id: (r.action, r.refine_attempts, r.refine_success) for r in agent.run(q, reply, better, 2).collect()}
    assert got == {1: ("AUTO_RESOLVER", 1, True), 2: ("PEDIR_INFO", 0, False), 3: ("PEDIR_INFO", 1, False)}
    none = {r.query_id: (r.action, r.refine_attempts) for r in agent.run(q, reply, better, 0).collect()}
    assert none[1] == ("PEDIR_INFO", 0)


def test_outcomes(spark):
    rows = spark.createDataFrame([(True, 0.9, False, True, 0, False), (False, 0.1, True, False, 2, False)], "context_found boolean, confidence double, needs_clarification boolean, cache_hit boolean, refine_attempts int, refine_success boolean")
    r = telemetry.outcomes(rows.withColumn("answer", F.lit(""))).first()
    assert (r.total, r.answered, r.ambiguous, r.low_confidence, r.cache_hits, r.refine_exhausted) == (2, 1, 1, 1, 1, 1)


def test_answer_plan(spark):
    texts = ["O laboratório de computação abre às oito horas.", "A biblioteca central fecha às dez.", "Prof. Ana Maria Souza\nTel (14) 3103-6000"]
    chunks = spark.createDataFrame([(i, f"f{i}.txt", 0, t, None, [], []) for i, t in enumerate(texts)], "doc_id long, source string, chunk int, text string, sector_slug string, emails array<string>, phones array<string>")
    from corvane.functions.models import embed_texts

    corpus = Q.Corpus(chunks, embed_texts(chunks).select("doc_id", "embedding"), index.build(chunks))
    q = spark.createDataFrame([(1, "Quando abre o laboratório de computação?"), (2, "telefone de Ana Souza")], "query_id int, question string")
    got = {r.query_id: r for r in Q.answer(q, corpus).collect()}
    assert got[2].route == "contact_fallback" and "(14) 3103-6000" in got[2].answer
    assert "laboratório" in got[1].answer and got[1].citations[0].source == "f0.txt"


def test_low_confidence_text(spark):
    q = spark.createDataFrame([(1, "x")], "query_id int, question string")
    conf = spark.createDataFrame([(1, 0.1)], "query_id int, confidence double")
    people_rows = people.people_candidates(spark.createDataFrame([], "query_id int, question string, doc_id int, source string, chunk int, text string, score double"))
    hits = spark.createDataFrame([(1, 1, "a/guia_do_aluno.pdf")], "query_id int, lexical_rank int, source string")
    r = A.low_confidence(q, conf, people_rows, hits).first()
    assert "guia do aluno" in r.answer and r.needs_clarification and not r.context_found


def test_contact_bonus(spark):
    rows = spark.createDataFrame([(1, "telefone da Carla", 1, "Carla (14) 3103-6000", "dep_x/docentes", 0.5, 2), (1, "telefone da Carla", 2, "nada", "y", 0.9, 1)], "query_id int, question string, doc_id int, text string, source string, score double, final_rank int")
    got = {r.doc_id: (round(r.score, 2), r.final_rank) for r in rank.contact_bonus(rows).collect()}
    assert got == {1: (32.5, 1), 2: (-15.1, 2)}


def test_stream_matches_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    rows = [{"ts": f"2024-01-01T00:00:{i:02d}", "event_type": "error"} for i in range(5)] + [{"ts": "2024-01-01T01:00:00", "event_type": "view"}]
    (src / "a.json").write_text("\n".join(map(json.dumps, rows)))
    schema = "ts timestamp, event_type string"
    stream = streams.rate_alerts(streams.event_stream(spark, str(src), schema))
    run = stream.writeStream.format("memory").queryName("alerts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(60)
    want = telemetry.rate_alerts(spark.read.schema(schema).json(str(src))).collect()
    assert sorted(map(tuple, spark.table("alerts").collect())) == sorted(map(tuple, want)) and len(want) == 1


def test_ingest_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.txt").write_text("x")
    held = {"m": spark.createDataFrame([], "source_file string, file_hash string, processed_at timestamp")}

    def save(df):
        held["m"] = spark.createDataFrame(df.collect(), "source_file string, file_hash string, processed_at timestamp")

    run = streams.ingest_stream(spark, str(src), str(tmp_path / "cp"), lambda: held["m"], save).trigger(availableNow=True).start()
    run.awaitTermination(60)
    assert held["m"].count() == 1
