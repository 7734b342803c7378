"""Operator 5, SimHash near-dedup: fingerprints linked by a vantage-point tree.

A fingerprint bit is set if it is set in over half of the hashes of a text's word shingles. Distinct fingerprints
are dealt to shards by a vantage-point tree: a node splits at the median Hamming distance from a vantage point, and
the tree's points come from a bounded sample, which decides the balance only. A fingerprint lives in one shard and
is asked in every shard that its ball of ``radius`` bits reaches (``d <= mu + radius`` and ``d > mu - radius``, the
triangle bounds), so every pair within the radius meets in one of the two home shards. Inside a shard the same
splits go on until few points are left, which are compared in full. A shard that no split makes smaller (a family of
points with one value) is cut: its home points go to several tasks, each of which takes a part of the points that ask.

A shard returns a spanning forest of its links, never all pairs, and the forests are joined into components by
alternating large-star and small-star steps over tables in shared storage.

:func:`keep_one`, for documents of a stated similarity, uses the same tree. A 64-bit fingerprint of the different words
moves little when a few words change; pairs within two bits in either half of it (so all within five bits), found by
a tree over each half, are candidates if 256-bit SimHashes of their different five-word shingles are as close as texts
of that similarity are. Texts that gain or lose a passage move that fingerprint further, so pairs that share one of
``BANDS`` keys, each of ``BAND_ROWS`` least hashes of the shingles, are candidates as well: a pair of similarity s is
missed with a chance of ``(1 - s**BAND_ROWS)**BANDS``. What candidates connect meets in one place (in pairs of blocks,
where it is much), and every pair there links only if the exact Jaccard similarity of its shingles is high enough.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle are one
shingle; null ids never become a component's id unless it has no other; repeated rows get a row each; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower_bytes, free_name, free_shuffles, map_arrow, materialise, remove, skew_join, table, with_columns

SHINGLE, RADIUS, SEED = 3, 2, 42
#: Fingerprints at home in a shard, and those sampled for vantage points.
SHARD_POINTS, TREE_SAMPLE = 4096, 20_000
#: Below so many points a node is compared in full.
BUCKET = 192


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint of the lower-cased words ``[^\\x20\\x09-\\x0D]+``."""
    words = ascii_lower_bytes(text).split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    hashes = [digest(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
    return int.from_bytes(np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).tobytes(), "big")


def fingerprint_docs(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """The columns ``keep`` and ``fp`` (the fingerprint as a signed long)."""
    source = docs.select(*keep, F.col(text).alias("_text"))

    def scan(batches):
        for batch in batches:
            fps = np.array([simhash(t, shingle) for t in batch.column(len(keep)).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(fps)], names=[*keep, "fp"])

    schema = source.drop("_text").schema
    return map_arrow(source, scan, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields) + ", fp long")


#: Bits of a wide sketch, in numbers of 64.
WIDE = 4
_MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93], np.uint64)


def _majority(hashes: np.ndarray) -> np.ndarray:
    """Bits set in over half of the rows of (n, k) numbers, as k numbers."""
    bits = np.unpackbits(np.ascontiguousarray(hashes, ">u8").view(np.uint8).reshape(len(hashes), -1), axis=1)
    return np.packbits(bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)).view(">u8").astype(np.uint64)


def wide_simhash(text: str | None, shingle: int) -> tuple[int, bytes]:
    """Fingerprint of the different words, and the sketch of the different shingles."""
    words, digest = (ascii_lower_bytes(text).split() if text else []), xxhash.xxh64_intdigest
    if not words:
        return 0, bytes(8 * WIDE)
    own = np.array([digest(w, SEED) for w in set(words)], np.uint64)
    cut = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}
    h = np.array([digest(x, SEED) for x in cut], np.uint64)[:, None] * _MIX[None, :]
    return int(_majority(own[:, None])[0]), _majority(h ^ (h >> np.uint64(31)) * _MIX[::-1]).astype("<u8").tobytes()


#: Keys of a text's least shingle hashes, and hashes a key.
BANDS, BAND_ROWS = 30, 6
#: Points that are compared with each other at once.
BLOCK = 2048
_TURN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS), np.uint64) | np.array([[1], [0]], np.uint64)


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles; texts shorter than a shingle are one, texts without a word have none."""
    words, digest = (ascii_lower_bytes(text).split() if text else []), xxhash.xxh64_intdigest
    cut = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else ()
    return np.sort(np.array([digest(x, SEED) for x in cut], np.uint64))


def band_keys(shingles: np.ndarray) -> np.ndarray:
    """A key for each band of the least hashes; no keys without a shingle."""
    if not len(shingles):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(shingles), 1024):
        h = (shingles[at : at + 1024, None] ^ _TURN[1]) * _TURN[0]
        least = np.minimum(least, (h ^ (h >> np.uint64(29))).min(axis=0))
    bands = least.reshape(BANDS, BAND_ROWS)
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)], np.uint64).view(np.int64)


def jaccard_links(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the index of its root among those that pairs of at least this Jaccard similarity connect."""
    order = np.argsort([len(x) for x in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    begin = np.concatenate(([0], np.cumsum(size)))
    names, ids = np.unique(np.concatenate([sets[i] for i in order]), return_inverse=True)
    mark, parent = np.zeros(len(names), bool), np.arange(len(sets))
    for i in range(len(sets)):
        if not size[i]:
            continue
        # no set larger than this can be similar enough to a set of this size
        after = np.arange(i + 1, np.searchsorted(size, size[i] / similarity + 1e-9, "right"))
        after = after[parent[after] != parent[i]]
        if not len(after):
            continue
        mark[ids[begin[i] : begin[i + 1]]] = True
        if 4 * len(after) > after[-1] - i:
            common = np.add.reduceat(mark[ids[begin[i + 1] : begin[after[-1] + 1]]], begin[i + 1 : after[-1] + 1] - begin[i + 1], dtype=np.int64)[after - i - 1]
        else:
            common = np.array([np.count_nonzero(mark[ids[begin[j] : begin[j + 1]]]) for j in after], np.int64)
        mark[ids[begin[i] : begin[i + 1]]] = False
        linked = after[common >= similarity * (size[i] + size[after] - common) - 1e-9]
        if len(linked):
            tied = np.unique(parent[np.append(linked, i)])
            parent[np.isin(parent, tied)] = tied[0]
    root = np.empty(len(sets), np.int64)
    root[order] = order[parent]
    return root


def sketch_bits(similarity: float) -> int:
    """The distance of sketches that texts of this similarity (Jaccard) have, and a little over a deviation more."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(64 * WIDE * share + 1.25 * np.sqrt(64 * WIDE * share * (1 - share)))


def _distance(points: np.ndarray, vantage: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ vantage).astype(np.int16)


def build_tree(sample: np.ndarray, depth: int):
    """Nested (vantage, mu, near, far), or None for a shard. The vantage point is the sampled one whose distances spread most."""
    if depth == 0 or len(sample) < 4:
        return None
    tries = sample[:: max(1, len(sample) // 16)][:16]
    vantage = max(tries, key=lambda v: (float(np.var(_distance(sample, v))), int(v)))
    d = _distance(sample, vantage)
    mu = int(np.median(d))
    if not 0 < int((d <= mu).sum()) < len(d):
        mu -= 1
    near = d <= mu
    if not near.any() or near.all():
        return None
    return vantage, mu, build_tree(sample[near], depth - 1), build_tree(sample[~near], depth - 1)


def route(tree, points: np.ndarray, radius: int):
    """(shard, index of point, at home) for every shard that a point's ball reaches."""
    out = []

    def walk(node, name: int, index: np.ndarray, home: np.ndarray) -> None:
        if not len(index):
            return
        if node is None:
            out.append((np.full(len(index), name, np.int64), index, home))
            return
        vantage, mu, near, far = node
        d = _distance(points[index], vantage)
        left, right = d <= mu + radius, d > mu - radius
        walk(near, 2 * name, index[left], (home & (d <= mu))[left])
        walk(far, 2 * name + 1, index[right], (home & (d > mu))[right])

    walk(tree, 1, np.arange(len(points)), np.ones(len(points), bool))
    return [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        for x in (a, b):
            while True:
                up = parent[x]
                if np.array_equal(up, x):
                    break
                x[:] = up
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        apart = lo != hi
        a, b = lo[apart], hi[apart]
        np.minimum.at(parent, b, a)


def link_shard(points: np.ndarray, home: np.ndarray, radius: int, sketches: np.ndarray | None = None, bits: int = 0, asks: np.ndarray | None = None) -> np.ndarray:
    """For each point the index of its root among the points that links of home points with those that ask (all, or where
    ``asks``) connect. With ``sketches`` (rows of numbers) a link needs them to be within ``bits`` as well."""
    parent = np.arange(len(points))

    def compare(own: np.ndarray, ask: np.ndarray) -> None:
        step = max(1, (1 << 20) // max(1, len(own)))
        for at in range(0, len(ask), step):
            part = ask[at : at + step]
            i, j = np.nonzero(np.bitwise_count(points[part][:, None] ^ points[own][None, :]) <= radius)
            a, b = part[i], own[j]
            if sketches is not None:
                a, b = a[a != b], b[a != b]
                near = np.concatenate([np.bitwise_count(sketches[a[k : k + 65536]] ^ sketches[b[k : k + 65536]]).sum(axis=1) <= bits for k in range(0, len(a), 65536)] or [np.empty(0, bool)])
                a, b = a[near], b[near]
            _union(parent, a, b)

    stack = [(np.flatnonzero(home), np.arange(len(points)) if asks is None else np.flatnonzero(asks))]
    while stack:
        own, ask = stack.pop()
        if not len(own) or not len(ask):
            continue
        if len(own) <= BUCKET:
            compare(own, ask)
            continue
        tries = points[own[:: max(1, len(own) // 4)][:4]]
        vantage = max(tries, key=lambda v: (float(np.var(_distance(points[own], v))), int(v)))
        d, e = _distance(points[own], vantage), _distance(points[ask], vantage)
        mu = int(np.median(d))
        if (d <= mu).all():
            mu -= 1
        near = d <= mu
        if not near.any():
            compare(own, ask)
            continue
        stack += [(own[near], ask[e <= mu + radius]), (own[~near], ask[e > mu - radius])]
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def _tree_of(points: DataFrame, value, shard_points: int):
    """A tree over a bounded sample of a long column's values."""
    n = points.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n) / shard_points))))
    share = min(1.0, TREE_SAMPLE / max(1, n))
    drawn = points.filter(F.pmod(F.xxhash64("fp"), F.lit(1_000_000)) < int(np.ceil(share * 1_000_000))) if depth else points.limit(0)
    sample = np.array(sorted(r.v for r in drawn.select(value.alias("v")).toLocalIterator()), np.int64).view(np.uint64)
    return build_tree(sample, depth)


def cut_shards(dealt: DataFrame, most: int) -> DataFrame:
    """Rows (shard, fp, home, ...) of a shard with ``part`` and ``asks``. A shard of more than ``most`` rows has several
    parts: a row asks in one of them, and home rows are in all."""
    sizes = dealt.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > most)
    # rows are at least ``most`` times as many as these
    sizes = materialise(sizes.select(F.col("shard").alias("_shard"), F.ceil(F.col("n") / most).cast("int").alias("_parts")), "large-shards")
    rows = dealt.join(F.broadcast(sizes), F.col("shard") == F.col("_shard"), "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("_parts")).cast("int")
    rows = rows.withColumn("_own", own).withColumn("part", F.explode(F.when(F.col("home"), F.sequence(F.lit(0), F.col("_parts") - 1)).otherwise(F.array("_own"))))
    return rows.withColumn("asks", F.col("part") == F.col("_own")).drop("_shard", "_parts", "_own")


def similar_links(points: DataFrame, bits: int, shard_points: int = 4 * SHARD_POINTS) -> DataFrame:
    """Edges (a, b) among distinct points ``fp`` (a name), ``word`` (fingerprint of words) and ``sketch``."""
    out = None
    for shift in (0, 32):
        half = F.shiftrightunsigned("word", shift).bitwiseAND(F.lit((1 << 32) - 1))
        tree = _tree_of(points, half, shard_points)

        def deal(batches, tree=tree):
            for batch in batches:
                halves = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
                shard, index, home = route(tree, halves.view(np.uint64), RADIUS)
                at = pa.array(index)
                yield pa.RecordBatch.from_arrays([pa.array(shard), batch.column(0).take(at), batch.column(1).take(at), batch.column(2).take(at), pa.array(home)], names=["shard", "fp", "half", "sketch", "home"])

        def link(part: pa.Table) -> pa.Table:
            order = part.sort_by([("fp", "ascending"), ("home", "descending")])
            fps = order.column("fp").to_numpy().astype(np.int64)
            sketches = np.frombuffer(b"".join(order.column("sketch").to_pylist()), "<u8").reshape(-1, WIDE)
            root = link_shard(order.column("half").to_numpy().astype(np.uint64), order.column("home").to_numpy(), RADIUS, sketches, bits, order.column("asks").to_numpy())
            tied = np.flatnonzero(root != np.arange(len(root)))
            return pa.table({"a": pa.array(fps[tied]), "b": pa.array(fps[root[tied]])})

        dealt = map_arrow(points.select("fp", half.alias("half"), "sketch"), deal, "shard long, fp long, half long, sketch binary, home boolean")
        edges = cut_shards(dealt, 8 * shard_points).groupBy("shard", "part").applyInArrow(link, "a long, b long")
        out = edges if out is None else out.unionByName(edges)
    return out


def vp_links(points: DataFrame, radius: int = RADIUS, shard_points: int = SHARD_POINTS) -> DataFrame:
    """Edges (a, b) that connect what links within ``radius`` among distinct ``fp``; at most one a shard and point."""
    tree = _tree_of(points, F.col("fp"), shard_points)

    def deal(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            shard, index, home = route(tree, fps.view(np.uint64), radius)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(fps[index]), pa.array(home)], names=["shard", "fp", "home"])

    def link(part: pa.Table) -> pa.Table:
        order = part.sort_by([("fp", "ascending"), ("home", "descending")])
        fps = order.column("fp").to_numpy().astype(np.int64)
        root = link_shard(fps.view(np.uint64), order.column("home").to_numpy(), radius, asks=order.column("asks").to_numpy())
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(fps[tied]), "b": pa.array(fps[root[tied]])})

    dealt = map_arrow(points.select("fp"), deal, "shard long, fp long, home boolean")
    return cut_shards(dealt, 8 * shard_points).groupBy("shard", "part").applyInArrow(link, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node in ``edges`` (a, b), root the smallest node reachable."""

    def settle(df: DataFrame) -> tuple[DataFrame, tuple]:
        df = materialise(df, "stars")
        return df, tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())

    def least(df: DataFrame) -> DataFrame:
        return df.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("w")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"), "w")

    edges, was = settle(edges.filter("a <> b").distinct())
    if not was[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        total = 2 * was[0]
        mins = least(both)
        large = skew_join(both.filter("b > a").withColumnRenamed("a", "u"), mins, "u", "w", total, F.col("b"))
        large = large.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # every edge now points from the larger to the smaller node
        mins = least(large)
        small = skew_join(large.withColumnRenamed("a", "u"), mins, "u", "w", total, F.col("b"))
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(mins.select(F.col("u").alias("a"), F.col("m").alias("b")))
        after, now = settle(small.filter("a <> b").distinct())
        remove(edges)
        edges = after
        if now == was:
            break
        was = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def group_fingerprints(rows: DataFrame, rank: str, radius: int = RADIUS, shard_points: int = SHARD_POINTS, links=None, carry: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` (with ``fp``; a written table) with ``first``, the least ``rank`` of its component. ``links`` makes edges
    of the distinct points, which have the columns ``carry`` as well; by default :func:`vp_links`."""
    own = [F.first(c).alias(c) for c in carry]
    points = materialise(rows.groupBy("fp").agg(F.count("*").alias("n"), F.min(rank).alias("least"), *own), "fingerprints")
    edges = materialise(links(points) if links else vp_links(points, radius, shard_points), "links")
    roots = components(edges)
    rooted = points.join(roots, points["fp"] == roots["node"], "left").select("fp", "n", "least", F.coalesce("root", "fp").alias("root"))
    rooted = materialise(rooted, "roots")
    total, docs = rooted.agg(F.count("*"), F.sum("n")).first()
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"), F.count("*").alias("w"))
    named = skew_join(rooted, firsts, "root", "w", total, F.col("fp")).select(F.col("fp"), "n", "first")
    named = materialise(named, "components")
    for x in (points, edges, rooted):
        remove(x)
    free_shuffles(rows.sparkSession)
    rows = rows.drop(*carry)
    return skew_join(rows, named, "fp", "n", docs or 0, F.xxhash64(*[c for c in rows.columns if c != "fp"]))


def band_links(points: DataFrame) -> DataFrame:
    """Edges (a, b) that connect the distinct points ``fp`` with a key in common of ``keys``."""
    bands = points.select("fp", F.explode("keys").alias("key"))
    firsts = bands.groupBy("key").agg(F.min("fp").alias("b"), F.count("*").alias("w")).filter("w > 1")
    total = points.agg(F.sum(F.size("keys"))).first()[0] or 0
    return skew_join(bands, firsts, "key", "w", total, F.col("fp")).filter("b <> fp").select(F.col("fp").alias("a"), "b").distinct()


def verified_links(texts: DataFrame, points: DataFrame, candidates: DataFrame, shingle: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of points whose shingles' Jaccard similarity is at least ``similarity``, as a forest a block.

    ``points``: ``fp`` and ``least.row``, the key of one of its rows among ``texts`` (row, _body). What ``candidates``
    connect is compared in full, in pairs of blocks where it is more than ``block`` points.
    """
    roots = materialise(components(candidates), "candidate-roots")
    parts = roots.groupBy("root").agg(F.count("*").alias("w")).withColumn("parts", F.ceil(F.col("w") / block).cast("int"))
    named = skew_join(roots, parts, "root", "w", roots.count(), F.col("node"))
    members = named.join(points.select("fp", F.col("least.row").alias("row")), F.col("node") == F.col("fp")).select("fp", "row", "root", "parts")
    members = texts.join(materialise(members, "candidate-rows"), "row").dropDuplicates(["fp"]).select("fp", "root", "parts", "_body")

    def cut(batches):
        for batch in batches:
            sets = [shingle_set(t, shingle).astype("<u8").tobytes() for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], names=["fp", "root", "parts", "shingles"])

    def link(part: pa.Table) -> pa.Table:
        fps = part.column("fp").to_numpy().astype(np.int64)
        root = jaccard_links([np.frombuffer(x, "<u8") for x in part.column("shingles").to_pylist()], similarity)
        tied = np.flatnonzero(root != np.arange(len(root)))
        return pa.table({"a": pa.array(fps[tied]), "b": pa.array(fps[root[tied]])})

    sets = map_arrow(members, cut, "fp long, root long, parts int, shingles binary")
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    met = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.select("fp", "shingles", "root", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return met.groupBy("root", "i", "j").applyInArrow(link, "a long, b long")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one document of each group of texts whose word shingles are similar: the smallest id, and of rows
    that repeat it, one."""
    row = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.coalesce(F.col(text), F.lit("")))))
    rank = F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.hex(row).alias("row"))
    source = docs.select(rank.alias("rank"), F.col(text).alias("_body"))

    def scan(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            told, sets = [wide_simhash(t, shingle) for t in texts], [shingle_set(t, shingle) for t in texts]
            word = np.array([w for w, _ in told], np.uint64).view(np.int64)
            same = np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in sets], np.uint64).view(np.int64)
            keys = pa.array([band_keys(x) for x in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same), pa.array(word), pa.array([x for _, x in told], pa.binary()), keys], names=["rank", "fp", "word", "sketch", "keys"])

    schema = with_columns(source.drop("_body"), "fp long, word long, sketch binary, keys array<long>")
    rows = materialise(map_arrow(source, scan, schema), "document-sketches")
    bits = sketch_bits(similarity)

    def links(points: DataFrame) -> DataFrame:
        candidates = materialise(similar_links(points, bits).unionByName(band_links(points)), "candidates")
        return verified_links(source.select(F.col("rank.row").alias("row"), "_body"), points, candidates, shingle, similarity)

    grouped = group_fingerprints(rows, "rank", links=links, carry=("word", "sketch", "keys"))
    name = free_name(docs, "_row")
    kept = grouped.filter(F.col("rank") == F.col("first")).select(F.unhex(F.col("rank.row")).alias(name)).distinct()
    return docs.withColumn(name, row).join(materialise(kept, "kept"), name, "left_semi").dropDuplicates([name]).drop(name)


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = materialise(fingerprint_docs(docs, ["doc_id"]), "document-fingerprints")
    out = group_fingerprints(rows, "doc_id")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


QUERIES = {"op5_simhash": op5_simhash}
ORACLE_SQL: dict = {}
