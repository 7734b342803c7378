r"""Operator 11, secret scans: fixed patterns, and a battery of randomness tests for what no pattern knows.

Patterns find assignments of secrets, access keys and hexadecimal strings. The battery looks at every other run of
``MIN_LENGTH`` or more characters of ``[A-Za-z0-9+/_-]``. The narrowest alphabet that holds a run is its inferred
encoding; three statistics are taken over that alphabet: chi-squared of the symbols against uniformity, the number of
runs of symbols below and above the alphabet's middle, and the serial correlation of neighbours. Each is held

* against ordinary writing, whose symbol and neighbour frequencies are counted over the words of all documents: the
  three p-values (as uniform, as many runs, as little correlation by chance?) combine by Fisher's method to ``p_plain``;
* against random symbols, two-sided, combined to ``p_random``.

A run is a secret if ordinary writing is rejected with the false-discovery rate held at ``FDR`` by Benjamini's and
Hochberg's step-up over the different runs of its length band, and randomness isn't (``p_random >= RANDOM_LEVEL``).
Means and variances hold for a run's own length, so a short run needs a stronger departure than a long one, and bands
of half an octave keep a crowd of short runs from setting the bar of the long. The step-up reads a histogram of
p-values, each rounded up by a hundredth of a decade at most, so no task sorts a band. Built-in functions only; what
comes to the driver is a table of neighbouring symbols, 66 x 66 at most.

Defined cases: a null text is empty and has no spans; rows without or with the same id have a row each; repeated rows
and repeated runs get equal results, and a run counts once in the step-up; without any words ordinary writing is taken
as uniform, so the battery finds nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, skew_join, table

MIN_LENGTH, FDR, RANDOM_LEVEL = 20, 0.01, 0.001
#: Kind, pattern, group whose length counts, least length.
PATTERNS = (
    ("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", 0, 24),
)
RANDOM = "random"
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Narrowest first; a run has the first alphabet that holds all its characters. Small letters come first where there are
#: others, so that ordinary words stay on one side of the middle.
ALPHABETS = (
    _DIGITS, _DIGITS + "abcdef", _DIGITS + "ABCDEF", _LOWER, _UPPER, _UPPER + "234567", _LOWER + _DIGITS, _UPPER + _DIGITS, _LOWER + _UPPER,
    _LOWER + _DIGITS + _UPPER, _LOWER + _DIGITS + _UPPER + "+/", _LOWER + _DIGITS + _UPPER + "-_", _LOWER + _DIGITS + _UPPER + "+/-_",
)
_CHARS = "[A-Za-z0-9+/_-]"
_RUN = f"(?<!{_CHARS}){_CHARS}{{{MIN_LENGTH},}}"
#: erfc(x) = t exp(-x^2 + P(t)), t = 1 / (1 + x / 2): coefficients of P, a published approximation to 1.2e-7 relative error.
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
#: Steps of a decade of p in the histogram, and its last step.
_STEPS, _LAST = 100, 30_000


def upper_tail(z: Column, t: Column) -> Column:
    """The normal distribution's share above ``z``; ``t`` is 1 / (1 + |z| / sqrt(8))."""
    p = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        p = p * t + c
    half = t * F.exp(p - z * z / 2) / 2
    return F.when(z >= 0, half).otherwise(1 - half)


def fisher(h: Column) -> Column:
    """One p-value of three, from -sum ln p: half of Fisher's statistic has a gamma distribution of shape 3."""
    return F.least(F.lit(1.0), F.exp(-h) * (1 + h + h * h / 2))


def ordinary_pairs(docs: DataFrame, text: str = "text") -> list[tuple[str, str, int]]:
    """(symbol, next symbol or empty, count) over the words of all documents that are too short for the battery; words
    are counted first, so that each is taken apart once."""
    words = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(f"{_CHARS}+"), F.lit(0))).alias("w"))
    words = words.filter(F.length("w") < MIN_LENGTH).groupBy("w").agg(F.count("*").alias("n"))
    places = words.select("n", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("w")), lambda i: F.substring(F.col("w"), i, F.lit(2)))).alias("at", "pair"))
    pairs = places.groupBy(F.substring("pair", 1, 1).alias("a"), F.substring("pair", 2, 1).alias("b")).agg(F.sum("n").alias("n"))
    return [(r.a, r.b, r.n) for r in pairs.collect()]


def plain_model(pairs: list[tuple[str, str, int]], alphabet: str) -> dict[str, float]:
    """What ordinary writing does within an alphabet: the chance that two symbols (P2) and three (P3) are equal, that a
    neighbour lies on the other side of the middle, and mean and variance of the standardised product of neighbours. One
    count is added for each symbol, and as many for pairs, dealt as if random."""
    k = len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    seen = [1.0] * k
    middle, spread = (k - 1) / 2, (k * k - 1) / 12
    near, apart, product, square = float(k), k / 2, 0.0, float(k)
    for a, b, n in pairs:
        if a in place:
            seen[place[a]] += n
            if b in place:
                u, v = place[a], place[b]
                w = (u - middle) * (v - middle) / spread
                near, apart, product, square = near + n, apart + n * ((u < k // 2) != (v < k // 2)), product + n * w, square + n * w * w
    total = sum(seen)
    mean = product / near
    return {
        "k": k, "p2": sum((s / total) ** 2 for s in seen), "p3": sum((s / total) ** 3 for s in seen),
        "apart": apart / near, "mean": mean, "var": max(square / near - mean * mean, 1e-9),
    }


def battery(runs: DataFrame, pairs: list[tuple[str, str, int]]) -> DataFrame:
    """``runs`` (with ``token``) and encoding (place in ALPHABETS), n, p_plain, p_random."""
    models = [plain_model(pairs, a) for a in ALPHABETS]
    encoding = F.coalesce(*[F.when(F.col("token").rlike(f"^[{a.replace('-', '')}{'-' if '-' in a else ''}]+$"), F.lit(i)) for i, a in enumerate(ALPHABETS)])

    def of(name: str) -> Column:
        return F.element_at(F.array(*[F.lit(float(m[name])) for m in models]), F.col("encoding") + 1)

    alphabet = F.element_at(F.array(*map(F.lit, ALPHABETS)), F.col("encoding") + 1)
    sides = F.element_at(F.array(*[F.lit("L" * (len(a) // 2) + "H" * (len(a) - len(a) // 2)) for a in ALPHABETS]), F.col("encoding") + 1)
    out = runs.withColumn("encoding", encoding).withColumn("alphabet", alphabet).withColumn("n", F.length("token").cast("double"))
    counts = F.transform(F.sequence(F.lit(1), F.length("alphabet")), lambda i: F.col("n") - F.length(F.replace(F.col("token"), F.substring(F.col("alphabet"), i, F.lit(1)), F.lit(""))))
    out = out.withColumn("equal", F.aggregate(counts, F.lit(0.0), lambda s, c: s + c * (c - 1)))
    out = out.withColumn("sides", sides).withColumn("side", F.expr("translate(token, alphabet, sides)"))
    switches = sum(((F.length("side") - F.length(F.replace(F.col("side"), F.lit(x), F.lit("")))) / 2 for x in ("LH", "HL")), F.lit(0.0))
    out = out.withColumn("switches", switches)
    # product of neighbours, standardised by the alphabet's own middle and variance
    places = F.expr("transform(filter(split(token, ''), c -> c <> ''), c -> cast(instr(alphabet, c) as double) - 1 - (length(alphabet) - 1) / 2d)")
    start = F.struct(F.lit(0.0).alias("last"), F.lit(0.0).alias("sum"))
    walk = F.aggregate(places, start, lambda s, v: F.struct(v.alias("last"), (s["sum"] + s["last"] * v).alias("sum")))
    k, n = of("k"), F.col("n")
    out = out.withColumn("product", walk["sum"] * 12 / (k * k - 1) / (n - 1))

    def chi(p2: Column, p3: Column) -> Column:
        """The chi-squared statistic is a multiple of the number of equal pairs; that number's mean and variance are exact."""
        var = 2 * n * (n - 1) * (p2 - p2 * p2) + 4 * n * (n - 1) * (n - 2) * (p3 - p2 * p2)
        return (F.col("equal") - n * (n - 1) * p2) / F.sqrt(F.greatest(var, F.lit(1e-9)))

    s = of("apart")
    more = (F.col("switches") - (n - 1) * s) / F.sqrt((n - 1) * s * (1 - s))
    less = (F.col("product") - of("mean")) * F.sqrt((n - 1) / of("var"))
    # one column a score and a p-value: nested, each would be written out wherever the tail's polynomial names it
    scores = {
        "z1": -chi(of("p2"), of("p3")), "z2": F.when(s <= 0.5, more).otherwise(-more), "z3": F.when(of("mean") >= 0, -less).otherwise(less),
        "z4": F.abs(chi(1 / k, 1 / (k * k))), "z5": F.abs((F.col("switches") - (n - 1) / 2) / F.sqrt((n - 1) / 4)), "z6": F.abs(F.col("product") * F.sqrt(n - 1)),
    }
    out = out.withColumns(scores)
    out = out.withColumns({f"t{i}": 1 / (1 + F.abs(f"z{i}") / (2 * math.sqrt(2))) for i in range(1, 7)})
    out = out.withColumns({f"p{i}": F.least(F.lit(1.0), (1 if i < 4 else 2) * upper_tail(F.col(f"z{i}"), F.col(f"t{i}"))) for i in range(1, 7)})
    out = out.withColumns({name: sum((-F.ln(F.greatest(F.col(f"p{i}"), F.lit(1e-300))) for i in of_these), F.lit(0.0)) for name, of_these in (("h1", (1, 2, 3)), ("h2", (4, 5, 6)))})
    return out.select(*runs.columns, "encoding", "n", fisher(F.col("h1")).alias("p_plain"), fisher(F.col("h2")).alias("p_random"))


def discoveries(tested: DataFrame, fdr: float = FDR) -> DataFrame:
    """Rows of ``tested`` (n, p_plain) that the step-up rejects at ``fdr`` within their length band."""
    band = F.floor(2 * F.log2("n")).cast("int")
    step = F.least(F.floor(-F.log10(F.greatest(F.col("p_plain"), F.lit(1e-300))) * _STEPS), F.lit(_LAST)).cast("int")
    rows = tested.withColumn("_band", band).withColumn("_step", step)
    bars = rows.groupBy("_band", "_step").agg(F.count("*").alias("c"))
    # one row a step and band, however many runs there are
    sofar = F.sum("c").over(Window.partitionBy("_band").orderBy(F.col("_step").desc()))
    bars = bars.withColumn("rank", sofar).withColumn("m", F.sum("c").over(Window.partitionBy("_band")))
    bars = bars.filter(F.pow(F.lit(10.0), -F.col("_step") / _STEPS) <= fdr * F.col("rank") / F.col("m")).groupBy("_band").agg(F.min("_step").alias("_bar"))
    return rows.join(F.broadcast(bars), "_band").filter(F.col("_step") >= F.col("_bar")).drop("_band", "_step", "_bar")


def _matches(body: Column, kind: int, pattern: str, group: int, least: int) -> Column:
    """Matches of a pattern in order, each with the code points before it since the last one."""
    found = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(pattern), F.lit(0)).alias("all"), F.split(body, pattern, -1).alias("gap"), F.regexp_extract_all(body, F.lit(pattern), F.lit(group)).alias("part")
    )
    hits = F.transform(
        F.filter(found, lambda f: f["all"].isNotNull()),
        lambda f, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("at"), F.length(f["gap"]).alias("gap"), F.length(f["all"]).alias("len"),
            (F.length(f["part"]) >= least).alias("ok"), F.when(F.lit(kind == len(PATTERNS)), f["all"]).alias("token"),
        ),
    )
    return F.when(body.rlike(pattern), hits).otherwise(F.array().cast("array<struct<kind:int,at:int,gap:int,len:int,ok:boolean,token:string>>"))


def find_secrets(docs: DataFrame, text: str = "text", fdr: float = FDR) -> DataFrame:
    """``docs`` with ``_spans``: array of (start, kind, end, name), sorted; kind is a place in PATTERNS, or behind it for the battery.

    The texts are scanned once for spans and once for the words of ordinary writing; only matches are shuffled.
    """
    body, kinds, row = F.coalesce(F.col(text), F.lit("")), len(PATTERNS), free_name(docs, "_row")
    held = F.concat(*[_matches(body, i, p, g, n) for i, (_, p, g, n) in enumerate(PATTERNS)], _matches(body, kinds, _RUN, 0, MIN_LENGTH))
    scanned = materialise(docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != text], F.monotonically_increasing_id().alias(row), held.alias("_held")), "secret-matches")
    before = Window.partitionBy("row", "kind").orderBy("at")
    spans = scanned.select(F.col(row).alias("row"), F.inline("_held")).withColumn("end", F.sum(F.col("gap") + F.col("len")).over(before))
    spans = spans.filter("ok").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end", "token", F.unhex(F.md5("token")).alias("key"))
    spans = materialise(spans, "secret-spans")

    runs = spans.filter(F.col("kind") == kinds)
    tokens = runs.groupBy("key").agg(F.min("token").alias("token"), F.count("*").alias("held"))
    tested = materialise(battery(tokens, ordinary_pairs(docs, text)).select("key", "held", "n", "p_plain", "p_random"), "secret-tests")
    odd = discoveries(tested, fdr).filter(F.col("p_random") >= RANDOM_LEVEL).select("key", "held", F.lit(True).alias("found"))
    total = runs.count()
    found = skew_join(runs.select("row", "kind", "start", "end", "key"), odd, "key", "held", total, F.xxhash64("row", "start")).filter("found")
    both = spans.filter(F.col("kind") < kinds).select("row", "kind", "start", "end").unionByName(found.select("row", "kind", "start", "end"))
    # a run inside a span of the patterns adds nothing
    reach = F.max(F.when(F.col("kind") < kinds, F.col("end"))).over(Window.partitionBy("row").orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("reach", reach).filter((F.col("kind") < kinds) | F.col("reach").isNull() | (F.col("reach") < F.col("end")))
    name = F.element_at(F.array(*[F.lit(p[0]) for p in PATTERNS], F.lit(RANDOM)), F.col("kind") + 1)
    per_row = both.groupBy(F.col("row").alias("_at")).agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", name.alias("name")))).alias("_spans"))
    out = scanned.drop("_held").join(per_row, F.col(row) == F.col("_at"), "left").drop(row, "_at")
    return out.withColumn("_spans", F.coalesce("_spans", F.array().cast(dict(per_row.dtypes)["_spans"])))


def told(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["name"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in all documents, counted and digested by kind."""
    out = find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.size(F.filter(F.transform("_spans", lambda s: s["name"]), lambda x: x == name)).cast("long").alias(f"n_{name}") for name, *_ in PATTERNS]
    base = F.filter("_spans", lambda s: s["kind"] < len(PATTERNS))
    return out.select("doc_id", *counts, F.sha2(told(base), 256).alias("base_sha256"), told(F.col("_spans")).alias("spans"))


QUERIES = {"op11_secret_scan": op11_secret_scan}
ORACLE_SQL: dict[str, str] = {}
