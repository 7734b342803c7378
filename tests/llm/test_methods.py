"""Methods against brute force and against other implementations, on small made-up inputs."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import common, language_id, pieces


def words(rng, n, letters="abcdeimnorstu", lo=1, hi=8):
    return ["".join(rng.choice(letters) for _ in range(rng.randint(lo, hi))) for _ in range(n)]


# ---- the training draw ----
def test_draw_repeated_rows(spark):
    rows = spark.range(40).select(F.col("id"), F.lit("x").alias("c")).crossJoin(spark.range(300).select(F.lit(1).alias("o"))).drop("o")
    got = common.draw(rows.select("c", "id"), "c", "id", 10).collect()
    assert len(got) == len({r.id for r in got}) == 10


def test_draw_ties_and_few(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2), ("b", 3), (None, 4)], "c string, id long")
    assert sorted(map(tuple, common.draw(rows, "c", "id", 5).collect())) == [("a", 1), ("b", 2), ("b", 3)]
    assert common.draw(rows.limit(0), "c", "id", 5).collect() == []


def test_language_letters():
    assert not language_id.has_letter("²³ ½ 12 _ !") and not language_id.has_letter(None) and language_id.has_letter("1é")


# ---- pieces ----
def _unigram(table):
    """The library's unigram model with a table of pieces."""
    import sentencepiece

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    tag = lambda k, wire: varint(k << 3 | wire)
    block = lambda k, b: tag(k, 2) + varint(len(b)) + b
    kinds = {0: 1, 1: 6}
    rows = [block(1, p.encode()) + tag(2, 5) + struct.pack("<f", s) + tag(3, 0) + varint(kinds.get(k) or (2 if p == "<unk>" else 3)) for p, s, k in table]
    proto = b"".join(block(1, r) for r in rows) + block(2, tag(3, 0) + varint(1) + tag(35, 0) + varint(1))
    proto += block(3, block(1, b"identity") + tag(3, 0) + varint(1) + tag(4, 0) + varint(0) + tag(5, 0) + varint(1))
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(proto)
    return out


def test_pieces_match_the_library():
    table = pieces.read_pieces()
    own, library = pieces.PieceModel(table), _unigram(table)
    score = {i: s for i, (_, s, _) in enumerate(table)}
    rng = random.Random(3)
    texts = ["the house of the people", "", " ", "a    b", "über straße\n\tçé ☃ \U0001f600", "x" * 5000] + [" ".join(words(rng, 60)).capitalize() + ".\n" for _ in range(300)]
    for t in texts:
        a, b = np.frombuffer(own.encode(t), "<i4").tolist(), library.encode(t)
        # equal sums are told apart by the library's 32-bit rounding
        assert a == b or len(a) == len(b) and sum(map(score.get, a)) == pytest.approx(sum(map(score.get, b)), rel=1e-9), t
        assert own.decode(own.encode(t)) == t
    assert [table[i][0] for i in own.viterbi("▁the▁house")] == ["▁the", "▁house"]


def test_zipf_scores_are_log_probabilities():
    table = pieces.zipf_scores([("<unk>", 0.0, 2), ("a", -5.0, 0), ("<0x41>", 0.0, 1), ("b", -1e9, 0), ("c", -7.0, 0)])
    assert sum(np.exp(s) for _, s, k in table if k == 0) == pytest.approx(1) and [s for _, s, k in table if k] == [0.0, 0.0]
    assert [s for _, s, k in table if not k] == sorted((s for _, s, k in table if not k), reverse=True)


# ---- the subsequence kernel ----
def _kernel_by_hand(a, b):
    """All occurrences of four characters within seven, written out."""
    from itertools import combinations

    from corvane.llm import toxicity as X

    def weights(s):
        out = {}
        for at in combinations(range(len(s)), X.LENGTH):
            if at[-1] - at[0] < X.SPAN:
                u = "".join(s[i] for i in at)
                out[u] = out.get(u, 0) + X.DECAY ** (at[-1] - at[0] + 1)
        return out

    x, y = weights(a), weights(b)
    return sum(w * y.get(u, 0) for u, w in x.items()) / np.prod(X.norms(np.array([len(a), len(b)])))


def test_kernel_matches_enumeration():
    from corvane.llm import toxicity as X

    rng = random.Random(5)
    left = [" moron ", " mo ron ", " m o r o n ", " mxoxrxoxn ", "ab", " ", *(f" {' '.join(words(rng, 5))} " for _ in range(6))]
    right = [" moron ", " loser ", *(f" {' '.join(words(rng, 4))} " for _ in range(5))]
    got = X.kernel(X.Occurrences(left), X.Occurrences(right))
    want = np.array([[_kernel_by_hand(a, b) for b in right] for a in left])
    near = np.isclose(got, want, atol=1e-6)
    assert near.mean() > 0.9 and (got >= want - 1e-6).all()  # a hashed place may be shared
    assert got[0, 0] > got[1, 0] > got[5, 0] == 0 and got[3, 0] > 0 == got[4, 0]


def test_folded_weights_are_the_sum_of_kernels():
    from corvane.llm import toxicity as X

    rng = random.Random(6)
    marks, texts = [f" {w} " for w in words(rng, 9, lo=4)], [f" {' '.join(words(rng, 7))} " for _ in range(20)]
    alpha = np.array([rng.uniform(-1, 1) for _ in marks])
    own = X.Strings(texts)
    got = X.values(own, (own.begin, own.end - 1), X.Occurrences(marks).fold(alpha))
    assert np.allclose(got, X.kernel(X.Occurrences(texts), X.Occurrences(marks)) @ alpha, atol=1e-5)


def test_runs_of_words():
    from corvane.llm import toxicity as X

    s = X.Strings([" a b c d ", " e "])
    first, last, of = s.windows(3)
    assert [(s.text[a : b + 1], o) for a, b, o in zip(first, last, of)] == [(" a b c ", 0), (" b c d ", 0), (" e ", 1)]
    assert X.sentences_of("You i d i o t! Go\nGo go go away. 1.5") == [" you idiot ", " go ", " go away ", " 15 "] and X.sentences_of(None) == []


def test_insults_with_gaps_and_insertions():
    from corvane.llm import toxicity as X

    rng = random.Random(7)
    vocabulary = words(rng, 300, lo=2)
    clean = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(5, 60))) + "." for _ in range(200)]
    toxic = [f"{t[:-1]} {rng.choice(['you moron', 'what a fool', 'such a loser', 'moron loser'])} {u}" for t, u in zip(clean[:100], clean[1:])]
    model = X.ToxicityModel([(t, 0) for t in clean[100:]] + [(t, 1) for t in toxic])
    unseen = [" ".join(rng.choice(vocabulary) for _ in range(20)) for _ in range(60)]
    plain = model.predict(unseen)
    assert (plain >= 0.5).mean() <= 0.1
    around = list(zip(unseen, unseen[1:]))
    without = model.predict([f"{t} {u}" for t, u in around])
    for w in ("moron", "m o r o n", "m.o.r.o.n", "mo-ron", "loser", "mor on", "mo ron", "moxron"):
        told = model.predict([f"{t} {w} {u}" for t, u in around])
        # what is inserted weakens an insult but doesn't hide it
        assert (told > without).mean() > 0.8 and np.median(told) > np.median(without), w
    assert model.predict([None, "", " .. "]).max() <= model.predict(unseen).min() + 1e-12


def test_one_label_only():
    from corvane.llm import toxicity as X

    assert X.ToxicityModel([]).predict(["x", None]).tolist() == pytest.approx([0, 0], abs=1e-6)
    assert X.ToxicityModel([("x", 1)]).predict(["x", None]).tolist() == pytest.approx([1, 1], abs=1e-6)


# ---- fingerprint groups ----
def test_groups_of_equal_forms(spark, tmp_path):
    from corvane import llm
    from corvane.llm import fingerprints

    rows = [(i, f"Copy  {i % 3} STRASSE") for i in range(60)] + [(100 + i, f"own {i}") for i in range(7)] + [(200, None), (201, ""), (None, "own 3"), (300, "copy 0 straße"), (300, "copy 0 straße")]
    spark.createDataFrame(rows, "doc_id long, text string").withColumn("form", F.lit("clash")).write.parquet(f"{tmp_path}/documents.parquet")
    got = llm.queries()["op4_fingerprints"](spark, str(tmp_path)).collect()
    forms: dict = {}
    for i, t in rows:
        forms.setdefault(fingerprints.canonical(t), []).append(i)
    want = sorted((i is None, i, len(ids), min((x for x in ids if x is not None), default=None)) for ids in forms.values() for i in ids)
    assert sorted((r.doc_id is None, r.doc_id, r.copies, r.group_id) for r in got) == want


def test_forms_with_one_fingerprint_stay_apart(spark):
    from corvane.llm import fingerprints

    rows = spark.createDataFrame([(1, "f", b"a"), (2, "f", b"b"), (3, "f", b"a"), (4, "g", b"c"), (5, "g", b"c"), (6, "h", None)], "doc_id long, fingerprint string, form binary")
    got = {r.doc_id: (r.group_id, r.copies) for r in fingerprints.with_groups(rows).collect()}
    assert got == {1: (1, 2), 2: (2, 1), 3: (1, 2), 4: (4, 2), 5: (4, 2), 6: (6, 1)}


# ---- benchmark windows ----
def test_items_in_blocks(spark):
    from corvane.llm import decontaminate

    rng = random.Random(9)
    vocabulary = words(rng, 60)
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 3, 9, 10, 30])))) for k in range(40)] + [(None, "a b c"), (40, None)]
    docs = [(k, " ".join([*rng.choices(vocabulary, k=rng.randint(0, 50)), *items[k % 40][1].split()[: rng.randint(5, 30)], *rng.choices(vocabulary, k=9)])) for k in range(120)] + [(None, None), (7, ""), (7, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = []
    for i, t in docs:
        w = decontaminate.words_of(t)
        hit, names = set(), set()
        for item, x in items:
            for win in decontaminate.windows_of(decontaminate.words_of(x)) if item is not None else ():
                for at in range(len(w) - len(win) + 1):
                    if tuple(w[at : at + len(win)]) == win:
                        hit.update(range(at, at + len(win)))
                        names.add(item)
        want.append((str(i), len(w), len(hit), sorted(names)))
    for size in (1 << 20, 300):  # one block, many blocks
        got = decontaminate.find_items(a, b, block_bytes=size).collect()
        assert sorted((str(r.doc_id), r._n_words, r._n_hit, list(r._items)) for r in got) == sorted(want)
    assert any(n for _, _, n, _ in want) and any(not n for _, _, n, _ in want)


# ---- shards that no split makes smaller ----
def test_family_of_one_half_in_several_tasks(spark):
    from corvane.llm import simhash

    rng = np.random.default_rng(4)
    base = [rng.integers(0, 1 << 62, 4).astype("<u8") for _ in range(30)]
    rows = [(k, int(rng.integers(0, 1 << 30)) << 32 | 77, bytearray((base[k % 30] ^ np.array([k // 30, 0, 0, 0], "<u8")).tobytes())) for k in range(240)]
    points = spark.createDataFrame(rows, "fp long, word long, sketch binary")
    got = simhash.similar_links(points, 8, shard_points=4).collect()
    roots = {r.node: r.root for r in simhash.components(spark.createDataFrame(got, "a long, b long")).collect()}
    assert {k: roots.get(k, k) for k in range(240)} == {k: k % 30 for k in range(240)}
    dealt = spark.range(100).select(F.lit(1).cast("long").alias("shard"), F.col("id").alias("fp"), (F.col("id") < 60).alias("home"))
    cut = simhash.cut_shards(dealt, 16).cache()
    assert cut.select("part").distinct().count() == 7 and cut.filter("asks").count() == 100 and cut.filter("home").count() == 420


# ---- nearest centroid ----
def test_language_is_the_nearest_centroid():
    rng = random.Random(11)
    tongues = {"x": "abcde", "y": "cdefg", "z": "mnopq"}
    train = [(k, " ".join(words(rng, 30, letters))) for k, letters in tongues.items() for _ in range(25)]
    model = language_id.Centroids([k for k, _ in train], np.stack([language_id.counts(t) for _, t in train]).astype(np.float32))
    texts = [" ".join(words(rng, 12, rng.choice([*tongues.values(), "rstuv", "abmno"]))) for _ in range(60)] + [None, "12 ½", ""]
    for text, (lang, score, rejected) in zip(texts, model.predict(texts)):
        if not language_id.has_letter(text):
            assert (lang, score, rejected) == ("und", 0.0, True)
            continue
        grams: dict = {}
        b = (" " + " ".join(text.split()) + " ").encode()
        for n in (1, 2, 3):
            for i in range(len(b) - n + 1):
                key = int.from_bytes(b[i : i + n], "big") + (n << 26)
                place = (key * 2654435761 % 2**32) >> 20
                grams[place] = grams.get(place, 0) + 1
        v = {p: np.log1p(c) * model.idf[p] for p, c in grams.items()}
        size = np.sqrt(sum(x * x for x in v.values()))
        best = {}
        for c, k in zip(model.centroids, model.owner):
            cos = sum(x * c[p] for p, x in v.items()) / size
            best[k] = max(best.get(k, -1), cos)
        top = max(best, key=best.get)
        assert lang == model.langs[top] and rejected == (best[top] < model.bounds[top]) and 0 < score <= 1
        assert len(set(model.owner)) == 3 and (model.owner == top).sum() == language_id.CENTROIDS
