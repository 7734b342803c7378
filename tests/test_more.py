"""Functions, files, cache and agent steps on small hand-made cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.config import Settings
from corvane.functions import models
from corvane.functions import text as T
from corvane.operators import agent, cache, chunking, fuse, people, retrieve, segments
from corvane.plans import ingest
from corvane.shared import shared_path
from corvane.sources import files
from corvane.streaming import streams


def one(spark, value, fn):
    return spark.createDataFrame([(value,)], "c string").select(fn(F.col("c"))).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("InformaÃ§Ãµes do cÃ¢mpus", "Informações do câmpus"), ("plain\nMÃ©dia\nJá certo", "plain\nMédia\nJá certo"), ("â€œaspasâ€\x9d", "“aspas”"),
        ("Acao é boa", "Acao é boa"), ("Ação e ß já certas", "Ação e ß já certas"), (None, None), ("", ""),
    ],
)
def test_repair_round_trips(spark, raw, want):
    assert one(spark, raw, T.repair) == want


def test_lines_are_trimmed(spark):
    text = "  \n 1 título 0 \n 2 texto \n\n  outro 1  "
    assert one(spark, text, T.section_title) == "1 título 0"
    assert one(spark, text, T.paragraphs) == ["1 título 0 2 texto", "outro 1"]


def test_sentences_follow_the_boundary_rule():
    cut = chunking.split_sentences
    assert cut("Fale com a Profa! Ana veio? Sim. ok. Fim") == ["Fale com a Profa! Ana veio?", "Sim. ok.", "Fim"]
    assert cut("... Nada. \n") == ["...", "Nada."] or cut("... Nada.") == ["... Nada."]
    assert cut("") == [] and cut("Sem fim") == ["Sem fim"]


def test_splitting_is_linear():
    began = time.time()
    assert len(chunking.split_sentences("Ab cd. " * 8000)) == 8000
    assert time.time() - began < 1


def test_pack_matches_a_plain_fold():
    rng = random.Random(1)
    for _ in range(30):
        text = " ".join("W" + "w " * rng.randint(0, 6) + "x." for _ in range(rng.randint(0, 40)))
        size, overlap = rng.randint(4, 12), rng.randint(0, 6)
        want, held = [], []
        for s in [s for p in chunking.split_paragraphs(text) for s in chunking.split_sentences(p)]:
            n = len(s.split())
            if sum(k for _, k in held) + n <= size:
                held.append((s, n))
                continue
            want.append(held)
            tail = []
            for x in reversed(held):
                if sum(k for _, k in tail) >= overlap:
                    break
                tail.insert(0, x)
            held = [*tail, (s, n)]
        want += [held] if held else []
        if all(len(s.split()) <= size for p in chunking.split_paragraphs(text) for s in chunking.split_sentences(p)):
            assert chunking.pack(text, size, overlap) == [("\n".join(s for s, _ in c), sum(k for _, k in c)) for c in want]


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 16)).astype(np.float32)
    x[50:60] = x[0]  # ties
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "doc_id long, embedding array<float>").repartition(5)
    asks = spark.createDataFrame([(q, 0, x[q].tolist()) for q in (0, 7, 55)], "query_id long, variant int, qvec array<float>")
    got = {}
    for r in retrieve.vector_top(asks, vectors, 12).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.doc_id))
    for q in (0, 7, 55):
        d = ((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1)
        assert [i for _, i in sorted(got[q])] == sorted(range(300), key=lambda i: (round(d[i], 12), i))[:12]
    assert retrieve.vector_top(asks.limit(0), vectors, 3).collect() == []


def test_question_variants_of_a_model(spark):
    from corvane.functions.ontology import Ontology

    q = spark.createDataFrame([(1, "Onde fica?"), (2, "Quando?")], "query_id int, question string")
    got = {r.query_id: r.variants for r in retrieve.question_variants(q, Ontology(), 1, lambda text, n: ["- 1) Em que lugar fica", " "] if "Onde" in text else []).collect()}
    assert got == {1: ["Onde fica?", "onde fica?"], 2: ["Quando?"]}


def test_matching_sentences(spark):
    hits = spark.createDataFrame([(1, 1, "Nada aqui. A secretaria abre cedo. Outra coisa."), (1, 2, "Um gato. Dois gatos. Tres.")], "query_id int, doc_id int, text string")
    q = spark.createDataFrame([(1, "horario da secretaria")], "query_id int, question string")
    got = {r.doc_id: r.sentence for r in retrieve.matching_sentences(hits, q).collect()}
    assert got[1] == "A secretaria abre cedo." and len(got[2].split("\n")) == 2


def test_contact_lists_are_bounded(spark):
    rows = spark.createDataFrame([("a", f"v{i % 40:02d}") for i in range(400)] + [("b", None), ("c", "x")], "k string, x string")
    got = {r.k: r.xs for r in people.listed(rows, "k", "xs", 30).collect()}
    assert got == {"a": [f"v{i:02d}" for i in range(30)], "c": ["x"]}


def test_history_is_bounded(spark):
    rows = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(9)], "conv_id int, turn int, role string, text string")
    got = {r.turn: [m.text for m in r.history] for r in agent.history(rows, 3).collect()}
    assert got[0] == [] and got[8] == ["m5", "m6", "m7"]


def test_agent_steps_with_a_model(spark):
    calls = spark.sparkContext.accumulator(0)

    def model(system, prompt):
        calls.add(1)
        return ("Qual unidade?" if "Opções" in prompt else "consulta nova"), None

    turns = agent.history(spark.createDataFrame([(1, 0, "user", "oi"), (1, 1, "user", "e o horario?")], "conv_id int, turn int, role string, text string")).withColumn("question", F.col("text"))
    assert {r.turn: r.standalone for r in agent.condense(turns, model).collect()} == {0: "oi", 1: "consulta nova"}
    short = spark.createDataFrame([(1, "q", "q", None, False, 0.1)], "query_id int, question string, asked string, answer string, context_found boolean, confidence double")
    assert [r.refined for r in agent.refine_with(model)(short).collect()] == ["consulta nova"]
    rows = spark.createDataFrame([("q", ["a"], ["p"])], "question string, options array<string>, previews array<string>")
    assert agent.ask_for_more(rows, model).first().answer == "Qual unidade?" and agent.ask_for_more(rows).first().answer == agent.ASK_MORE


def test_weights_are_clamped():
    assert fuse.mmr_order([1.0, 0.9, 0.5], ["a", "a", "b"], 2, 7.0) == [0, 1]


def test_logits():
    assert models.from_logits(0.25) == 0.25 and models.from_logits([0.0]) == 0.5
    assert models.from_logits(np.array([0.0, 1.0])) == pytest.approx(1 / (1 + np.exp(-1)))


def test_files_around_ingest(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.py").write_text("def read_txt(raw):\n    return 'own ' + raw.decode()\n\ndef load(raw):\n    return 'any'\n")
    (tmp_path / "p" / "_skip.py").write_text("raise ValueError\n")
    (tmp_path / "x.txt").write_text("olá")
    (tmp_path / "y.md").write_text("# Um\n\n- **dois** [três](http://x) `q`\n")
    readers = files.plugins(str(tmp_path / "p"))
    found = files.scan(spark, str(tmp_path)).filter("file_ext in ('.txt', '.md')")
    got = {r.file_ext: r.text for r in files.load(found, {".txt": readers[".txt"]}).collect()}
    assert got == {".txt": "own olá", ".md": "Um\n\ndois três q\n"}
    assert files.plugins(str(tmp_path / "none")) == {} and files.read_prompt(str(tmp_path / "none")) == "" and files.read_prompt(str(tmp_path / "x.txt")) == "olá"


def test_events_rotate(spark, tmp_path):
    path = f"file://{tmp_path}/events"
    row = spark.createDataFrame([("a" * 50,)], "m string")
    for _ in range(4):
        files.write_events(row, path, max_bytes=60, keep=2)
    assert sorted(p.name for p in tmp_path.iterdir() if p.name.startswith("events")) == ["events", "events.1", "events.2"]
    files.write_events(row, path, max_bytes=1 << 20, keep=2)
    assert spark.read.json(path).count() == 2


def test_empty_eval_set(spark, tmp_path):
    (tmp_path / "e.csv").write_text("question,ground_truth\n ,x\n")
    with pytest.raises(ValueError, match="no questions"):
        files.read_eval_set(spark, str(tmp_path / "e.csv"))


def test_ingest_drops_cached_answers(spark, tmp_path):
    src, out, held = tmp_path / "src", f"file://{tmp_path}/out", f"file://{tmp_path}/cache"
    src.mkdir()
    (src / "a.txt").write_text("Primeiro texto aqui.")
    rows = spark.createDataFrame([("query", "k", "1"), ("agent", "k", "2"), ("other", "k", "3")], "namespace string, key string, value_json string")
    cache.store(spark.createDataFrame([], cache.SCHEMA), rows).write.parquet(held)
    assert ingest.update(spark, str(src), out, cache_path=held) == {"new": 1}
    assert [r.namespace for r in spark.read.parquet(held).collect()] == ["other"]


def test_ingest_stream_builds_the_index(spark, tmp_path):
    src, out = tmp_path / "src", f"file://{tmp_path}/out"
    src.mkdir()
    (src / "a.txt").write_text("Primeiro texto aqui.")
    run = streams.ingest_folder_stream(spark, str(src), out, f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert run.exception() is None and ingest.chunks(spark, out).count() == 1
    # a second start takes only the new file; the first one's chunks stay where they were written
    (src / "b.txt").write_text("Segundo texto.")
    run = streams.ingest_folder_stream(spark, str(src), out, f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    held = segments.segments(spark, out)
    assert run.exception() is None and [spark.read.parquet(f"{out}/segments/{s.name}/chunks").count() for s in held] == [1, 1]
    # the same batch once more, as after a lost commit
    assert ingest.add(spark, files.scan(spark, str(src)), out) == {"unchanged": 2} and ingest.version(spark, out) == 2


def test_event_stream_appends(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b")], "event_id long, event_type string").write.json(f"{tmp_path}/in")
    events = spark.readStream.schema("event_id long, event_type string").json(f"{tmp_path}/in")
    run = streams.append_events(events, f"{tmp_path}/out", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(tuple(r) for r in spark.read.json(f"{tmp_path}/out").select("event_id", "event_type").collect()) == [(1, "a"), (2, "b")]


def test_debug_dump(spark, tmp_path):
    files.dump_debug(spark.createDataFrame([(7, "Qual é?", "{}")], "query_id int, question string, payload string"), f"{tmp_path}/dump")
    assert [p.name for p in (tmp_path / "dump").iterdir() if p.is_dir()] == ["file=007_Qual_.json"]


def test_whole_lists(spark):
    """Neither histories nor contact lists are cut."""
    turns = spark.createDataFrame([(1, t, "user", f"m{t}") for t in range(80)], "conv_id int, turn int, role string, text string")
    assert {r.turn: len(r.history) for r in agent.history(turns).collect()} == {t: t for t in range(80)}
    assert max(len(r.history) for r in agent.history(turns, 5).collect()) == 5
    block = "Ana Maria Souza\n" + "\n".join(f"(14) 3103-{i:04d}" for i in range(1200))
    docs = spark.createDataFrame([("a.txt", 0, block)], "source string, chunk int, text string")
    assert len(people.contact_index(docs)[0].first().phones) == 1200 and len(people.contact_index(docs, most=10)[0].first().phones) == 10


def test_cache_keys_tell_apart(spark):
    row = spark.createDataFrame([(" Olá  MUNDO ", "olá mundo")], "a string, b string")
    made = lambda c, s=Settings(), v=1: cache.key(**cache.query_payload(F.col(c), s, F.lit(v)))  # noqa: B008, E731
    a, b, c, d = row.select(made("a"), made("b"), made("b", Settings(top_k=9)), made("b", v=2)).first()
    assert a == b and len({b, c, d}) == 3


def test_shared_folder_is_needed_on_a_cluster():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, name, default=None):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError, match="checkpoint"):
        shared_path(Session(), "x")
