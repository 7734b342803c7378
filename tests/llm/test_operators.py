"""Each operator against brute force, an exact round trip, held-out accuracy or SQL."""

import collections
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane import llm
from corvane.llm import decontaminate, fingerprints, line_dedup, lm_score, pieces, sharding, simhash, toxicity, warc
from tests.test_queries import SF, TABLES, TYPES, rows

DUCK = duckdb.connect()
for t in TABLES:
    DUCK.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
DOCS = dict(DUCK.sql("select doc_id, text from documents").fetchall())


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_matches_sql(spark, name):
    got, want = llm.queries()[name](spark, SF), DUCK.sql(llm.oracle_sql()[name])
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in got.dtypes} == kinds
    assert rows(got.toPandas()) == rows(want.df())


def test_language_id_accuracy(spark):
    got = {r.doc_id: r for r in llm.queries()["op1_language_id"](spark, SF).collect()}
    told = dict(DUCK.sql("select doc_id, lang from documents where lang is not null").fetchall())
    held = [i for i in told if got[i].held_out]
    assert np.mean([got[i].lang_pred == told[i] for i in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())


def test_pieces_are_the_best_path():
    table = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 1) for i in range(256)] + [(p, s, 0) for p, s in (("▁", -3.0), ("▁a", -1.0), ("a", -2.0), ("b", -2.0), ("ab", -2.5), ("▁ab", -4.0), ("ba", -1.5), ("▁▁", -9.0))]
    model = pieces.PieceModel(table)
    score = {p: s for p, s, k in table if k == 0}

    def best(s):
        value = [0.0] + [-math.inf] * len(s)
        for end in range(1, len(s) + 1):
            value[end] = max([value[k] + score[s[k:end]] for k in range(end) if s[k:end] in score] + ([value[end - 1] + model.unknown] if s[end - 1] not in score else []))
        return value[-1]

    for text in ("ab", "abab ba", "a  b", "ž ab\nab", "baab  ", " ", "ba▁b"):
        s = pieces.MARK + text.replace(" ", pieces.MARK)
        ids = np.frombuffer(model.encode(text), "<i4").tolist()
        total, at = 0.0, 0
        while at < len(ids):
            piece, _, kind = table[ids[at]]
            if kind == 1:
                lead = int(piece[3:5], 16)
                at += 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                total += model.unknown
            else:
                total, at = total + score[piece], at + 1
        assert total == pytest.approx(best(s)), text


def test_pieces_round_trip(spark):
    got = llm.queries()["op2_sentencepiece"](spark, SF).collect()
    assert all(r.exact and r.decoded_sha256 == hashlib.sha256(DOCS[r.doc_id].encode()).hexdigest() for r in got)
    model = pieces.PieceModel(pieces.read_pieces())
    for text in ("", "a  b", "  lead", "trail  ", "\n\n x", "Ω漢字 \té", "x" * 3000):
        ids = model.encode(text)
        assert model.decode(ids) == text
        whole = model.viterbi(pieces.MARK + text.replace(" ", pieces.MARK)) if text else []
        assert np.frombuffer(ids, "<i4").tolist() == whole


def test_lm_counts_and_scores(spark):
    got = {r.doc_id: r for r in llm.queries()["op3_lm_score"](spark, SF).collect()}
    learn = lambda i: zlib.crc32(str(i).encode()) % 5 != 1
    c, pairs, starts = collections.Counter(), collections.Counter(), 0
    kept, kept_pairs, kept_starts = collections.Counter(), collections.Counter(), 0
    seq = {i: [*lm_score.tokens(t), None] for i, t in DOCS.items()}
    for i, s in seq.items():
        if learn(i):
            two = list(zip(["start", *s[:-1]], s, strict=True))
            c.update(s)
            pairs.update(two)
            starts += 1
            if zlib.crc32(str(i).encode()) % 5 != 2:
                kept.update(s)
                kept_pairs.update(two)
                kept_starts += 1
    n, v = sum(c.values()), len(c)
    for i, s in seq.items():
        r = got[i]
        base = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in s)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (not learn(i), len(s), sum(c[x] > 0 for x in s), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    # the weights, by EM over single events
    kn, kv = sum(kept.values()), len(kept)
    bins = collections.Counter()
    for i, s in seq.items():
        if learn(i) and zlib.crc32(str(i).encode()) % 5 == 2:
            for u, w in zip(["start", *s[:-1]], s, strict=True):
                cu = kept_starts if u == "start" else kept[u]
                p = np.array([kept_pairs[u, w] / max(1, cu) * (kv + 1), kept[w] / kn * (kv + 1)])
                b = lm_score._ratio(p)
                bins[int(lm_score._bucket(np.array([cu]))[0]), int(b[0]), int(b[1])] += 1
    weights = lm_score.fit_weights([(*k, x) for k, x in bins.items()])
    for i, s in list(seq.items())[:40]:
        total = 0.0
        for u, w in zip(["start", *s[:-1]], s, strict=True):
            cu = starts if u == "start" else c[u]
            a = weights[int(lm_score._bucket(np.array([cu]))[0])]
            total += math.log10(a[0] * pairs[u, w] / max(1, cu) + a[1] * c[w] / n + a[2] / (v + 1))
        assert got[i].score == pytest.approx(total, rel=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    # the trigrams' shares, in the same way
    got = {r.doc_id: r for r in lm_score.score_corpus(spark.read.parquet(f"{SF}/documents.parquet"), order=3).collect()}
    three, kept_three = collections.Counter(), collections.Counter()
    for i, s in seq.items():
        if learn(i):
            t = list(zip(["start", *s[:-2]], s[:-1], s[1:]))
            three.update(t)
            if zlib.crc32(str(i).encode()) % 5 != 2:
                kept_three.update(t)

    def short(u, w, cu, two, one, size, distinct):
        a = weights[int(lm_score._bucket(np.array([cu]))[0])]
        return a[0] * two[u, w] / max(1, cu) + a[1] * one[w] / size + a[2] / (distinct + 1)

    bins = collections.Counter()
    for i, s in seq.items():
        if learn(i) and zlib.crc32(str(i).encode()) % 5 == 2:
            for u, x, w in zip(["start", *s[:-2]], s[:-1], s[1:]):
                cu, p = kept_pairs[u, x], short(x, w, kept[x], kept_pairs, kept, kn, kv)
                bins[int(lm_score._bucket(np.array([cu]))[0]), int(lm_score._ratio(np.array([kept_three[u, x, w] / max(1, cu) / p]))[0])] += 1
    shares = lm_score.fit_shares([(*k, x) for k, x in bins.items()])
    assert shares[0] == 0 and any(three[t] > 1 for t in three)
    for i, s in list(seq.items())[:60]:
        total, before = 0.0, None
        for u, w in zip(["start", *s[:-1]], s, strict=True):
            p = short(u, w, starts if u == "start" else c[u], pairs, c, n, v)
            if before is not None:
                cu = pairs[before, u]
                a = shares[int(lm_score._bucket(np.array([cu]))[0])]
                p = a * three[before, u, w] / max(1, cu) + (1 - a) * p
            total += math.log10(p)
            before = u
        assert got[i].score == pytest.approx(total, rel=1e-6)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_fingerprints(spark):
    got = {r.doc_id: r for r in llm.queries()["op4_fingerprints"](spark, SF).collect()}
    order = sorted(DOCS, reverse=True)
    for k, i in enumerate(order):
        text, after = DOCS[i], DOCS[order[(k + 1) % len(order)]]
        other = fingerprints.edited(text, after)
        f = lambda s: fingerprints.fingerprint(fingerprints.canonical(s))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(other.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (f(text), f(other), float(f(text) == f(other)), float(f(text) == f(after)))
    assert fingerprints.canonical("Ａ  B\n") == fingerprints.canonical("a b") and fingerprints.canonical("STRASSE") == fingerprints.canonical("Straße")


def test_exact_groups(spark):
    docs = spark.createDataFrame([(1, "A b"), (2, "a  B "), (3, None), (4, ""), (5, "c")], "doc_id long, text string")
    assert sorted((r.group_id, r.copies) for r in fingerprints.exact_groups(docs).collect()) == [(1, 2), (3, 2), (5, 1)]


def brute_components(fps, radius):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(fps)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(fps))]


def test_simhash_bits():
    text = "the quick brown fox the quick brown"
    words = text.split()
    import xxhash

    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]), 42) for i in range(len(words) - 2)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.simhash(text) == want and simhash.simhash(None) == simhash.simhash(" \t") == 0
    assert simhash.simhash("One two") == xxhash.xxh64_intdigest("one two", 42)


def test_vp_tree_finds_every_link(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 150, dtype=np.int64).tolist()
    fps = sorted({f ^ (1 << int(rng.integers(0, 63))) if k % 2 else f for k in range(8) for f in base} | {base[0] ^ 3 ^ (i << 10) for i in range(300)})
    df = spark.createDataFrame([(f, f) for f in fps], "doc_id long, fp long")
    from corvane.llm.common import materialise

    got = {r.fp: r.first for r in simhash.group_fingerprints(materialise(df, "t"), "doc_id", 2, shard_points=64).select("fp", "first").collect()}
    root = brute_components([f & (1 << 64) - 1 for f in fps], 2)
    least = {}
    for f, r in zip(fps, root, strict=True):
        least[r] = min(least.get(r, f), f)
    assert got == {f: least[r] for f, r in zip(fps, root, strict=True)}


def test_simhash_query(spark):
    got = {r.doc_id: r for r in llm.queries()["op5_simhash"](spark, SF).collect()}
    ids = sorted(DOCS)
    fps = [simhash.simhash(DOCS[i]) for i in ids]
    root = brute_components(fps, 2)
    assert all(got[i].fingerprint == f"{f:016x}" and got[i].component_id == ids[r] for i, f, r in zip(ids, fps, root, strict=True))


def test_keep_one(spark):
    docs = spark.createDataFrame([(3, "a b c d e f g"), (1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (9, "z y x w v u t")], "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 9]


def test_keep_one_of_similar(spark):
    rng = np.random.default_rng(11)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    base = [[word() for _ in range(300)] for _ in range(40)]
    docs, clean = [], []
    for k, words in enumerate(base):
        docs.append((k, " ".join(words)))
        edited = list(words)
        for at in rng.integers(0, 300, 2):
            edited[at] = word()
        docs.append((100 + k, " ".join(edited)))
        clean.append((200 + k, " ".join([word() for _ in range(150)] + words[:150])))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(docs + clean, "doc_id long, text string")).collect()}
    assert {i for i, _ in clean} <= got and set(range(40)) <= got
    assert len(got & set(range(100, 140))) <= 3


def test_keep_one_matches_brute_force_on_added_cut_and_replaced(spark):
    rng = np.random.default_rng(23)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    docs = {}
    for k in range(150):
        n = int(rng.integers(60, 600))
        words, change = [word() for _ in range(n)], rng.uniform(0.01, 0.3)
        few = [*words]
        for at in rng.integers(0, n, max(1, int(change * n / 6))):
            few[at] = word()
        other = ([*words, *[word() for _ in range(int(change * n))]], words[: int(n * (1 - change))], few)[k % 3]
        docs |= {2 * k: words, 2 * k + 1: other}
    cut = {i: {tuple(w[a : a + 5]) for a in range(len(w) - 4)} for i, w in docs.items()}
    similar = {k: len(cut[2 * k] & cut[2 * k + 1]) / len(cut[2 * k] | cut[2 * k + 1]) for k in range(150)}
    want = {2 * k for k in similar} | {2 * k + 1 for k, s in similar.items() if s < 0.8}
    assert all(15 < sum(s >= 0.8 for k, s in similar.items() if k % 3 == m) < 50 for m in range(3))
    got = {r.doc_id for r in simhash.keep_one(spark.createDataFrame([(i, " ".join(w)) for i, w in docs.items()], "doc_id long, text string")).collect()}
    assert want <= got and len(got - want) <= 1


def test_verified_links_in_blocks(spark):
    texts = {k: " ".join(f"w{i}" for i in range(k, k + 60)) for k in range(0, 60, 3)} | {k: " ".join(f"x{i}" for i in range(k, k + 60)) for k in (100, 130)}
    made = spark.createDataFrame([(k, (False, k, str(k))) for k in texts], "fp long, least struct<none boolean, id long, row string>")
    source = spark.createDataFrame([(str(k), t) for k, t in texts.items()], "row string, _body string")
    edges = spark.createDataFrame([(k, 0) for k in texts if k], "a long, b long")
    sets = {k: simhash.shingle_set(t, 5) for k, t in texts.items()}
    alike = lambda a, b: len(np.intersect1d(sets[a], sets[b])) / len(np.union1d(sets[a], sets[b])) >= 0.8
    want = {k: 0 if k < 100 else k for k in texts}
    assert all(alike(k, k + 3) for k in range(0, 57, 3)) and not alike(100, 130)
    for block in (2048, 4):
        links = simhash.verified_links(source, made, edges, 5, 0.8, block).collect()
        assert all(want[r.a] == want[r.b] for r in links)
        got = {r.node: r.root for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
        assert {k: got.get(k, k) for k in texts} == want


def test_half_links_match_brute_force(spark):
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 62, 120).tolist()
    words += [w ^ (1 << int(rng.integers(0, 62))) ^ (1 << int(rng.integers(0, 62))) for w in words]
    sketch = [rng.integers(0, 1 << 62, 4).astype("<u8") for _ in range(120)]
    sketch += [x ^ np.array([7, 0, 1, 0], "<u8") for x in sketch[:60]] + [rng.integers(0, 1 << 62, 4).astype("<u8") for _ in range(60)]
    df = spark.createDataFrame([(i, w, bytearray(x.tobytes())) for i, (w, x) in enumerate(zip(words, sketch, strict=True))], "fp long, word long, sketch binary")
    got = {tuple(sorted((r.a, r.b))) for r in simhash.similar_links(df, 40, shard_points=32).collect()}
    want = {(i, i + 120) for i in range(60)}
    assert got == want


def _toxic_texts(n, sizes, seed=5):
    rng = np.random.default_rng(seed)
    syllables = ["re", "ta", "no", "li", "su", "ba", "ke", "mo"]
    bad = ["grumpo", "zonkert", "flimbat"]
    out = []
    for i in range(n):
        body = ["".join(rng.choice(syllables, sizes[k % len(sizes)])) for k in range(40)]
        if i % 2:
            body.insert(int(rng.integers(0, 40)), bad[i // 2 % 3])
        out.append((" ".join(body), i % 2))
    return out


def test_toxicity_fixture():
    texts = _toxic_texts(400, [3])
    model = toxicity.ToxicityModel(texts[:300])
    told = model.predict([t for t, _ in texts[300:]]) >= 0.7
    assert np.mean([a == bool(y) for a, (_, y) in zip(told, texts[300:], strict=True)]) > 0.97
    gapped = model.predict(["you g.r.u.m.p.o", "z o n k e r t", "zonkkert", "flim-bat"])
    assert gapped.min() >= 0.7 and model.predict(["", None]).max() < 0.7


def test_toxicity_across_spaces():
    texts = _toxic_texts(300, [1, 1, 2, 3])
    model = toxicity.ToxicityModel(texts)
    split = ["re gr um po no", "talino gru mpo", "g rum po", "zon ke rt ta", "z on ker t", "fl im bat", "flimbat"]
    assert min(model.predict(split)) >= toxicity.THRESHOLD
    assert max(model.predict([t for t, y in texts if not y])) < toxicity.THRESHOLD


def test_toxicity_held_out(spark):
    sf = SF.replace("0.001", "0.1")
    got = {r.doc_id: r for r in llm.queries()["op6_toxicity"](spark, sf).collect()}
    told = duckdb.sql(f"select doc_id, toxic from '{sf}/labels.parquet'").fetchall()
    held = [(got[i], y) for i, y in told if got[i].held_out]
    hit = sum(r.predicted for r, y in held if y)
    assert hit / sum(y for _, y in held) > 0.8 and hit / sum(r.predicted for r, _ in held) > 0.7


def test_line_runs_add_in_batches(spark):
    runs = line_dedup.LineRuns(spark, buckets=2)
    key = lambda s: hashlib.md5(s.encode()).hexdigest()
    batches = [[(5, ["b", None])], [(9, ["a", "b"]), (8, ["a"])], [(7, ["a", "c"]), (7, ["a"])], [(2, ["a", "a"]), (None, ["a"]), (None, ["a"])]]
    new = []
    for b in batches:
        rows = [(bytes([n]), i, [k and key(k) for k in ks]) for n, (i, ks) in enumerate(b)]
        new.append(runs.add(spark.createDataFrame(rows, "row binary, doc_id long, keys array<string>")))
    assert new == [1, 1, 1, 0]
    assert [len(x) for x in runs.levels] == [0, 0, 1]
    got = {bytes(r.key).hex(): (r.docs, r.keeper) for r in runs.merged().collect()}
    assert got == {key("a"): (6, 9), key("b"): (2, 9), key("c"): (1, 7)}
    again = line_dedup.LineRuns(spark, buckets=2, levels=runs.levels)
    assert again.merged().count() == 3
    runs.drop()


def test_runs_hold_a_key_once(spark):
    made = spark.range(4000).select(F.xxhash64("id").cast("string").cast("binary").alias("row"), F.col("id").alias("doc_id"), F.array(F.md5((F.col("id") % 700).cast("string"))).alias("keys"), (F.col("id") % 5).alias("b"))
    runs = line_dedup.LineRuns(spark)
    new = [runs.add(made.filter(F.col("b") == b)) for b in range(5)]
    assert sum(new) == 700
    assert all(spark.table(n).count() == spark.table(n).select("key").distinct().count() for n in runs.names)
    assert runs.merged().agg(F.count("*"), F.sum("docs")).first()[:] == (700, 4000)
    runs.drop()


def test_line_runs_over_calls(spark):
    line = "a line of more than forty characters that many documents hold"
    rows = lambda ids: spark.createDataFrame([(i, f"{line}\nown {i}") for i in ids], "doc_id long, text string")
    runs = line_dedup.LineRuns(spark, buckets=2)
    first = {r.doc_id: r._kept for r in line_dedup.dedup_lines(rows([10, 11, 12]), runs=runs).collect()}
    assert all(line in t for t in first.values())
    later = {r.doc_id: r._kept for r in line_dedup.dedup_lines(rows([1, 2, 20, 20]), runs=runs).collect()}
    assert later == {1: "own 1", 2: "own 2", 20: f"{line}\nown 20"}
    runs.drop()
    # rows of one id are one document: four documents are too few
    four = line_dedup.dedup_lines(rows([1, 1, 1, 2, 3, 4])).collect()
    assert all(r._n_dropped == 0 for r in four)
    # rows without an id are one each, and smaller than any id
    plain = spark.createDataFrame([(None, f"{line}\nown {i}") for i in range(4)] + [(7, line)], "doc_id long, text string")
    none = line_dedup.dedup_lines(plain).collect()
    assert sorted((r.doc_id is None, r._n_dropped) for r in none) == [(False, 0)] + [(True, 1)] * 4


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.org/p{i % 5}?q#x", None if i == 4 else f"<p>{i % 4} é</p>") for i in range(40)], "page_id long, url string, html string")
    root = f"file://{tmp_path}/w"
    captures = warc.write_archives(warc.mark_revisits(pages), root)
    index = warc.CaptureIndex.build(captures, root)
    got = index.get("https://H1.example.org/p1?q")
    assert sorted(r["page_id"] for r in got) == [i for i in range(40) if i % 3 == 1 and i % 5 == 1]
    assert all(r["payload"] is None or r["payload"].decode() == f"<p>{r['page_id'] % 4} é</p>" for r in got)
    assert index.get("http://nobody/") == []
    assert warc.url_key("HTTP://Www.Example.COM/a?b=1#c") == "com,example,www)/a?b=1"


def test_warc_index_of_many_blocks(spark, tmp_path, monkeypatch):
    rows = [(f"k{i // 700:03d}", i, "f", i, 1) for i in range(4000)]
    captures = spark.createDataFrame(rows, "key string, page_id long, file string, offset long, length long")
    index = warc.CaptureIndex.build(captures, f"file://{tmp_path}/w")
    keys = spark.createDataFrame([("k000",), ("k003",), ("k003",), ("none",)], "key string")
    got = sorted(r.page_id for r in index.lookup(keys).collect())
    assert got == [*range(700), *range(2100, 2800)]


def test_decontaminate_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    docs = DUCK.sql("select doc_id, text from documents").fetchall()
    items = DUCK.sql("select item_id, text from benchmark").fetchall()
    got = decontaminate.find_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items[:6], "item_id long, text string"), keep=["doc_id"])
    for r in got.collect():
        words, hit, found = decontaminate.words_of(DOCS[r.doc_id]), set(), set()
        for item, text in items[:6]:
            for w in decontaminate.windows_of(decontaminate.words_of(text)):
                for at in range(len(words) - len(w) + 1):
                    if tuple(words[at : at + len(w)]) == w:
                        hit |= set(range(at, at + len(w)))
                        found.add(item)
        assert (r._n_words, r._n_hit, r._items) == (len(words), len(hit), sorted(found))


def test_weighted_shards(spark):
    df = spark.createDataFrame([(i, "x") for i in range(6000)], "doc_id long, text string")
    got = sharding.assign_shards(df, [1.0, 2.0, 3.0]).collect()
    n = collections.Counter(r.shard for r in got)
    assert abs(n[2] / n[0] - 3) < 0.5 and abs(n[1] / n[0] - 2) < 0.4
    assert all(r.grown_shard in (r.shard, 3) for r in got)
    for s in n:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(n[s]))
