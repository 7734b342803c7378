"""The whole pipeline against plain Python, stage by stage, on a small made-up corpus."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import decontaminate, language_id, pieces

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(3)
    vocabulary = {"en": [f"{a}{b}" for a in ("th", "wh", "and", "ing") for b in ("er", "on", "at", "ed", "is")], "de": [f"{a}{b}" for a in ("sch", "ung", "ein", "keit") for b in ("ü", "ich", "au", "tz", "en")]}
    text = lambda lang, n: " ".join(rng.choice(vocabulary[lang]) for _ in range(n))
    rows, shared = [], "a footer line that very many of the documents carry at their end"
    for i in range(90):
        lang = "en" if i % 3 else "de"
        rows.append((i, text(lang, rng.randint(40, 120)) + (f"\n{shared.title() if i % 4 else shared}  " if i % 5 == 0 else ""), lang))
    words = [r[1].split(" ") for r in rows]
    near = lambda k, n: " ".join(words[k][:n] + ["changed"] + words[k][n:])
    rows += [(100 + k, rows[k][1], "en") for k in range(0, 12, 3)]  # exact copies
    rows += [(120 + k, near(k, 20), "en") for k in range(1, 20, 4)]  # a word put in
    rows += [(140 + k, " ".join(words[k][: len(words[k]) * 9 // 10]), "en") for k in range(2, 20, 4)]  # cut
    items = [(k, text("en", 15)) for k in range(6)] + [(9, "short item")]
    rows += [(160 + k, f"{text('en', 30)} {t.upper()} {text('en', 10)}", "en") for k, t in items[:4]]
    rows += [(180, None, None), (181, "", "en"), (182, "12 34 ½", "en"), (183, "漢字 " * 30, None), (184, rows[50][1], "en"), (184, rows[50][1], "en")]
    return [(i, t, lang, "s", None if t is None else len(t)) for i, t, lang in rows], items


def drop_lines(docs):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").lower()
    holders: dict = {}
    for i, t in docs:
        for line in t.split("\n"):
            if len(key(line)) >= 40:
                holders.setdefault(key(line), set()).add(i)
    gone = {k: max(ids) for k, ids in holders.items() if len(ids) >= 5}
    return [(i, "\n".join(x for x in t.split("\n") if key(x) not in gone or gone[key(x)] == i)) for i, t in docs]


def keep_one(docs):
    sets = []
    for _, t in docs:
        w = t.lower().split()
        sets.append({" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            both = len(sets[a] | sets[b])
            if not both or len(sets[a] & sets[b]) / both >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    first: dict = {}
    for k, (i, t) in enumerate(docs):
        first[find(k)] = min(first.get(find(k), (i, t)), (i, t))
    return sorted(first.values())


def clean(docs, items):
    windows = {w for _, t in items for w in decontaminate.windows_of(decontaminate.words_of(t))}

    def hit(t):
        w = decontaminate.words_of(t)
        return any(tuple(w[k : k + n]) in windows for n in {len(x) for x in windows} for k in range(len(w) - n + 1))

    return [(i, t) for i, t in docs if not hit(t)]


def test_pipeline_matches_plain_python(spark, tmp_path):
    rows, items = corpus()
    root = f"file://{tmp_path}"
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("exact", F.lit("clash"))
    docs.write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    out = corpus_pipeline.run(spark, root)
    assert {"piece_ids", "n_pieces", "exact", "exact_"} <= set(out.columns)
    got = sorted((r.doc_id, r.text, list(r.piece_ids), r.exact_) for r in out.collect())

    model = language_id.train(docs, F.lit(True))
    told = model.predict([t for _, t, *_ in rows])
    kept = [(i, t) for (i, t, *_), (_, _, rejected) in zip(rows, told) if not rejected]
    assert not {180, 181, 182, 183} & {i for i, _ in kept} and len(kept) > 100
    after_lines = drop_lines(kept)
    assert after_lines != kept
    after_copies = keep_one(after_lines)
    assert len(after_copies) < len(after_lines) - 8
    want = clean(after_copies, items)
    assert len(want) < len(after_copies)
    encoder = pieces.PieceModel(pieces.read_pieces())
    import numpy as np

    assert got == [(i, t, np.frombuffer(encoder.encode(t), "<i4").tolist(), True) for i, t in want]


def test_stages_name_five_operators():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "lines", "near_copies", "benchmark", "pieces"]
