"""Secret scans, hard negatives and the prefix trie against brute force, with odd rows."""

import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from corvane.llm import hard_negatives, prefix_trie, secret_scan

rnd = random.Random(11)


# ---- secret scans ----
def battery(token, pairs):
    """The three tests worked out from their definitions."""
    alphabet = next(a for a in secret_scan.ALPHABETS if set(token) <= set(a))
    m, n, k = secret_scan.plain_model(pairs, alphabet), len(token), len(alphabet)
    v = [alphabet.index(c) for c in token]
    equal = sum(v[i] == v[j] for i in range(n) for j in range(n) if i != j)
    apart = sum((a < k // 2) != (b < k // 2) for a, b in zip(v, v[1:]))
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    product = sum((a - middle) * (b - middle) for a, b in zip(v, v[1:])) / spread / (n - 1)

    def chi(p2, p3):
        return (equal - n * (n - 1) * p2) / math.sqrt(max(1e-9, 2 * n * (n - 1) * (p2 - p2 * p2) + 4 * n * (n - 1) * (n - 2) * (p3 - p2 * p2)))

    def tail(z):
        return math.erfc(z / math.sqrt(2)) / 2

    def fisher(ps):
        h = -sum(math.log(max(p, 1e-300)) for p in ps)
        return min(1.0, math.exp(-h) * (1 + h + h * h / 2))

    s = m["apart"]
    more = (apart - (n - 1) * s) / math.sqrt((n - 1) * s * (1 - s)) * (1 if s <= 0.5 else -1)
    less = (product - m["mean"]) * math.sqrt((n - 1) / m["var"]) * (-1 if m["mean"] >= 0 else 1)
    plain = fisher([tail(-chi(m["p2"], m["p3"])), tail(more), tail(less)])
    z = (chi(1 / k, 1 / k**2), (apart - (n - 1) / 2) / math.sqrt((n - 1) / 4), product * math.sqrt(n - 1))
    return plain, fisher([min(1.0, 2 * tail(abs(x))) for x in z])


def prose(n):
    words = "the of and to in is that for it with as was on be at by this have from or one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
    return " ".join(rnd.choice(words) for _ in range(n))


def secret(n, alphabet=secret_scan.ALPHABETS[10]):
    return "".join(rnd.choice(alphabet) for _ in range(n))


PLAIN = ["getUserAccountByEmailAddressAndName", "https/www/example/org/some/longer/path/of/words", "this_is_a_very_long_identifier_in_snake_case", "a" * 60, "abcdefghijklmnopqrstuvwxyz0123456789", "donaudampfschifffahrtsgesellschaft"]


def spans_of(text):
    found = []
    for kind, (name, pattern, group, least) in enumerate(
        (("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
    ):
        found += [(m.start(), kind, m.end(), name) for m in re.finditer(pattern, text, re.ASCII) if len(m[group]) >= least]
    return sorted(found)


def test_secret_scan(spark):
    secrets = [secret(n) for n in (32, 40, 44, 64, 88)]
    rows = [(i, prose(80)) for i in range(60)]
    rows += [(100 + i, f"é𝄞 {prose(5)} {s} {prose(3)}") for i, s in enumerate(secrets)] + [(200 + i, f"{prose(4)} {s} {prose(4)}") for i, s in enumerate(PLAIN)]
    rows += [(300, f"𝄞𝄞 Password : 'abc' token=token:abcdefgh api_key=\"{secret(30)}\" x"), (301, f"AKIA{'Z9' * 9} AKIAXX AKIA{'Q' * 10} {'0a' * 12} {'0b' * 11}é{'12' * 20}")]
    rows += [(302, None), (303, ""), (None, f"secret={secrets[0]}"), (304, rows[60][1]), (304, rows[60][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("_row", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("start", F.lit(2))
    got = secret_scan.find_secrets(docs).collect()
    assert len(got) == len(rows)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        base = [(s["start"], s["kind"], s["end"], s["name"]) for s in r._spans if s["name"] != "random"]
        assert base == spans_of(texts[r.doc_id])
    odd = {r.doc_id: [texts[r.doc_id][s["start"] : s["end"]] for s in r._spans if s["name"] == "random"] for r in got}
    assert all(odd[100 + i] == [s] for i, s in enumerate(secrets)) and odd[304] == [secrets[0]]
    assert not any(odd[200 + i] for i in range(len(PLAIN))) and not any(odd[i] for i in range(60)) and odd[None] == odd[302] == odd[303] == []


def test_battery_by_hand(spark):
    docs = spark.createDataFrame([(i, prose(50)) for i in range(20)], "doc_id long, text string")
    pairs = secret_scan.ordinary_pairs(docs)
    want = {}
    for _, t in ((r.doc_id, r.text) for r in docs.collect()):
        for w in t.split():
            for a, b in zip(w, [*w[1:], ""]):
                want[a, b] = want.get((a, b), 0) + 1
    assert {(a, b): n for a, b, n in pairs} == want
    tokens = [secret(n, a) for n in (20, 33, 64, 200) for a in secret_scan.ALPHABETS] + PLAIN + ["".join(prose(30).split())]
    got = {r.token: r for r in secret_scan.battery(spark.createDataFrame([(t,) for t in tokens], "token string"), pairs).collect()}
    for t in tokens:
        assert (got[t].p_plain, got[t].p_random) == pytest.approx(battery(t, pairs), rel=1e-4, abs=1e-300)


def test_step_up(spark):
    """The histogram's step-up against the plain one over values on the histogram's steps."""
    values = [(24.0, 10 ** (-rnd.choice((0, 10, 50, 200, 250, 300, 400)) / 100)) for _ in range(300)] + [(100.0, 10 ** (-x / 100)) for x in (5, 100, 350, 420)]
    values = [(n, p * (1 - 1e-9)) for n, p in values]
    want = 0
    for n in (24.0, 100.0):
        ps = sorted(p for m, p in values if m == n)
        want += max([i for i, p in enumerate(ps, 1) if p <= 0.01 * i / len(ps)], default=0)
    assert secret_scan.discoveries(spark.createDataFrame(values, "n double, p_plain double"), 0.01).count() == want > 3


# ---- hard negatives ----
def mined(rows, is_anchor, positives=5, negatives=10):
    rows = sorted({(i, lab, tuple(v)) for i, lab, v in rows})
    out = []
    for a in rows:
        if not is_anchor(a[0]):
            continue
        scores = sorted(((sum(x * y for x, y in zip(a[2], b[2])), b) for b in rows if b != a), key=lambda s: (-s[0], s[1]))
        for p, b in [s for s in scores if s[1][1] == a[1]][:positives]:
            fits = [(s, c) for s, c in scores if c[1] != a[1] and 30 * p <= 100 * s <= 90 * p][:negatives]
            out += [(a[0], b[0], i, c[0], p, s) for i, (s, c) in enumerate(fits, 1)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["clusters", "ties", "long"])
def test_hard_negatives(spark, shape, monkeypatch):
    draw = random.Random(shape)
    if shape == "clusters":
        centres = [[draw.randint(-300, 300) for _ in range(6)] for _ in range(8)]
        rows = [(i, draw.randint(0, 2), [c + draw.randint(-20, 20) for c in draw.choice(centres)]) for i in range(700)]
    elif shape == "ties":
        rows = [(i, i % 3, [draw.randint(-1, 1) for _ in range(3)]) for i in range(200)] + [(1000 + i, i % 2, [1, 1, 0]) for i in range(300)]
    else:
        rows = [(i, i % 2, [draw.randint(-(2**27), 2**27) for _ in range(4)]) for i in range(120)] + [(500, 0, [5, 5]), (501, 1, []), (502, 0, [0, 0, 0, 0])]
    rows += rows[:40]
    monkeypatch.setattr(hard_negatives, "LISTED", 2)
    df = spark.createDataFrame(rows, "id long, label int, vec array<long>")
    space = hard_negatives.NearestRows
    monkeypatch.setattr(hard_negatives, "NearestRows", lambda r, a: space(r, a, partition_rows=50, group_anchors=8, pivots=9))
    got = hard_negatives.mine(df, F.col("id") % 10 == 0).collect()
    assert sorted(map(tuple, got)) == mined(rows, lambda i: i % 10 == 0)


def test_bounds_skip_partitions(spark):
    """Far clusters are never compared."""
    draw = random.Random(4)
    rows = [(i, i % 3, [1000 * (i % 5 == j) + draw.randint(-9, 9) for j in range(5)]) for i in range(2000)]
    space = hard_negatives.NearestRows(spark.createDataFrame(rows, "id long, label int, vec array<long>"), F.col("id") % 100 == 0, partition_rows=100, pivots=40)
    assert space.first(None, 5, True).count() == 100
    assert 0 < space.compared < 20 * 2000 / 2


def test_hard_negatives_odd_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5], 1), (7, [0.9, 0.5], 0), (1, [1.0, 0.4], 1), (2, [0.3, 0.3], 2), (3, [nan, 1.0], 2), (4, [inf, 1.0], 2), (5, None, 2), (6, [1.0, None], 2), (None, [1.0, 1.0], 2), (8, [0.3, 0.2], None), (9, [], 4), (2, [0.3, 0.3], 2)]
    for name, held in (("odd", rows), ("empty", [])):
        df = spark.createDataFrame(held, "vec_id long, embedding array<float>, label int")
        for c in ("id", "vec", "cell", "name", "part"):
            df = df.withColumn(c, F.lit("clash"))
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
    # 0 and 7 move to the next label: 0 has label 2, 7 has label 1
    got = sorted(map(tuple, hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/odd").collect()))
    vec = {i: tuple(math.floor(256 * x) for x in v) for i, v in ((0, [1.0, 0.5]), (7, [0.899999976158142, 0.5]), (1, [1.0, 0.4000000059604645]), (2, [0.30000001192092896] * 2), (9, []))}
    assert got == mined([(0, 2, vec[0]), (7, 1, vec[7]), (1, 1, vec[1]), (2, 2, vec[2]), (9, 4, vec[9])], lambda i: i % 100 == 0)
    assert hard_negatives.op12_hard_negatives(spark, f"{tmp_path}/empty").collect() == []


# ---- prefix trie ----
def trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in convs.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + ts[h:])
    nodes = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            nodes.setdefault(ts[:d], []).append(c)
    out = []
    for seq, members in nodes.items():
        below = [s for s in nodes if s[: len(seq)] == seq]
        out.append((
            min(members), len(seq), min(nodes[seq[:-1]]) if seq else None, len(members), sum(len(s) == len(seq) + 1 for s in below),
            sum(not any(len(t) == len(s) + 1 and t[: len(s)] == s for t in below) for s in below),
            sum((len(nodes[s]) - 1) * len(s[-1][1]) for s in below if s), hashlib.sha256(",".join(map(str, sorted(c for c in members if len(built[c]) == len(seq)))).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shape", ["shared", "odd", "deep"])
def test_prefix_trie(spark, tmp_path, shape):
    draw = random.Random(shape)
    if shape == "shared":
        rows = [(c, t, draw.choice("ua"), draw.choice(("hi", "é𝄞", "who is it?"))) for c in range(90, 230) for t in range(draw.randint(1, 6))]
    elif shape == "odd":
        rows = [(c, draw.choice((None, 1, 1, 2, 3)), draw.choice((None, "u", "")), draw.choice((None, "", "x", "yy"))) for c in (*range(-205, -190), *range(0, 25), 100, 1000) for _ in range(draw.randint(1, 7))]
        rows += [(None, 1, "u", "x"), rows[0], rows[0]]
    else:
        rows = [(1, t, "u", f"t{t}") for t in range(120)] + [(2, t, "u", f"t{t}") for t in range(60)] + [(201, t, "u", f"t{t}") for t in range(119)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for c in ("pos", "depth", "key", "digest", "chars", "_task"):
        df = df.withColumn(c, F.lit("clash"))
    df.write.parquet(f"{tmp_path}/conversations.parquet")
    got = prefix_trie.op13_prefix_trie(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == trie(rows)


def test_prefix_trie_of_nothing(spark, tmp_path):
    for name, rows in (("none", []), ("nameless", [(None, 1, "u", "x")])):
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/{name}/conversations.parquet")
        assert prefix_trie.op13_prefix_trie(spark, f"{tmp_path}/{name}").collect() == []


def test_running_sums(spark, monkeypatch):
    """A group that spans tasks counts on; sums wrap at 2^62."""
    monkeypatch.setattr(prefix_trie, "ROWS_PER_TASK", 50)
    rows = [(1 if i % 4 else 2 + i, i, draw) for i, draw in ((i, rnd.randrange(1 << 62)) for i in range(400))]
    got = prefix_trie.running(spark.createDataFrame(rows, "g long, o long, x long"), "g", [F.col("o")], {"s": "x"}, "t").collect()
    held: dict = {}
    for g, o, x in sorted(rows):
        n, s = held.get(g, (0, 0))
        held[g] = (n + 1, (s + x) % (1 << 62))
        assert [(r.pos, r.s) for r in got if (r.g, r.o) == (g, o)] == [held[g]]
