"""Operator 3, LM scoring: a bigram or trigram model by deleted interpolation.

P(v | u) mixes three estimates: count(u, v) / count(u), count(v) / N, and 1 / (N's vocabulary + 1). With ``order`` 3,
P(w | u, v) mixes count(u, v, w) / count(u, v) with P(w | v). The weights belong to buckets of the context's frequency, count(u) or
count(u, v), by powers of two, and are learned by expectation-maximisation on held-out counts: part of the training
documents is left out of the counts while the weights are fitted. A text's first token has no trigram.

Texts are not shuffled. A task turns its documents into blocks. It writes a block's tokens (numbers of the block's
different words) to shared storage and asks for the counts of the block's different words and word pairs: sorted
hashes, cut by range into parts and packed. Each part adds up what all blocks of the corpus brought, and
answers each block in the order in which it asked. The block keeps its counts in shared storage and, for a trigram model,
asks for its trigrams in the same way, but only for those whose two pairs both occur more than once in the corpus: any other trigram
occurs once, and in that very place, so its count is known. With the answers a block scores its documents. So every
word, pair and trigram of the corpus is counted, once a block and part of the data travels, and no task holds more than
a part or a block. There are as many parts as the corpus' tokens need at about PART_TOKENS each, so a part's size
doesn't grow with the corpus. Words, pairs and trigrams are told apart by 64-bit hashes.

Defined cases: a null text is an empty one, with the end token only; without training documents all counts are zero
and only the uniform estimate is left, 1 / (0 + 1) times its whole weight, so every score is 0; ids are whole numbers;
repeated rows count and are scored as documents of their own; a null id counts as the empty string; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import ascii_lower_bytes, free_shuffles, map_arrow, materialise, shared_path, table

#: Tokens in a block, and those whose words and pairs one part adds up (by the texts' bytes, at BYTES_A_TOKEN each).
BLOCK_TOKENS, PART_TOKENS, BYTES_A_TOKEN = 1_000_000, 4_000_000, 6
BUCKETS, EM_ROUNDS = 24, 40
#: Bins of the log ratios between estimates, four to a factor of two, from -40 to 40 powers of two.
RATIO_BINS = 320
_START, _END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def tokens(text: str | None) -> list[bytes]:
    """Lower-cased words ``[^\\x20\\x09-\\x0D]+``; the end token is not among them."""
    return ascii_lower_bytes(text).split() if text else []


def pair_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair of word hashes."""
    h = (u * np.uint64(0x9FB21C651E98DF25)) ^ (v + np.uint64(0x165667B19E3779F9))
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)


def pack(keys: np.ndarray, *counts: np.ndarray) -> bytes:
    """Sorted keys as the low bytes of their gaps, and counts, most of them one byte long."""
    gaps = np.diff(keys, prepend=np.uint64(0))
    head = np.array([len(keys)], "<u4").tobytes()
    return _join(head, zlib.compress(_planes(gaps), 1), *map(small, counts))


def _planes(x: np.ndarray) -> bytes:
    """Numbers with their first bytes first, then the second ones, and so on: easier to compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _unplanes(b: bytes, size: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T)


def _join(*parts: bytes) -> bytes:
    return b"".join(np.array([len(p)], "<u4").tobytes() + p for p in parts)


def _parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int(np.frombuffer(blob, "<u4", 1, at)[0])
        out.append(blob[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def small(x: np.ndarray) -> bytes:
    """Numbers as bytes, with those of 255 and more behind, compressed."""
    large = x >= 255
    return zlib.compress(np.where(large, 255, x).astype(np.uint8).tobytes() + x[large].astype("<i8").tobytes() + np.array([len(x)], "<i8").tobytes(), 1)


def unsmall(b: bytes) -> np.ndarray:
    raw = zlib.decompress(b)
    n = int(np.frombuffer(raw[-8:], "<i8")[0])
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw[n:-8], "<i8")
    return out


def unpack(blob: bytes) -> tuple[np.ndarray, ...]:
    """The keys and the counts of :func:`pack`."""
    _, body, *counts = _parts(blob)
    return np.cumsum(_unplanes(zlib.decompress(body), 8).view("<u8").ravel(), dtype=np.uint64), *map(unsmall, counts)


class Block:
    """Documents on their way to a block."""

    def __init__(self):
        self.ids: list = []
        self.kinds: list[int] = []  # 0 to be scored only, 1 counted, 2 counted and held out for the weights
        self.numbers: dict[bytes, int] = {}
        self.words: list[np.ndarray] = []
        self.size = 0

    def add(self, doc_id, kind: int, text: str | None) -> None:
        numbers = self.numbers
        words = tokens(text)
        self.ids.append(doc_id)
        self.kinds.append(kind)
        self.words.append(np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int32, len(words)))
        self.size += len(words) + 1

    def arrays(self):
        """Of the block's words their hashes; of its tokens (ends included) word numbers, context numbers, documents."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.numbers), np.uint64, len(self.numbers))
        return np.concatenate((hashes, [_START, _END])), np.array([len(w) + 1 for w in self.words], np.int64), np.concatenate(self.words) if self.words else np.empty(0, np.int32)


def _tokens_of(words: np.ndarray, lengths: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each token, its context (n_words: start; n_words + 1: end) and its document."""
    ends = np.cumsum(lengths) - 1
    token = np.empty(int(lengths.sum()), np.int32)
    inner = np.ones(len(token), bool)
    inner[ends] = False
    token[inner], token[ends] = words, n_words + 1
    context = np.empty_like(token)
    context[1:] = token[:-1]
    context[ends - lengths + 1] = n_words
    return token, context, np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)


def _sums(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sorted different keys and the sums of the values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[first], *[np.add.reduceat(v[order], first) if len(keys) else v for v in values]


def _by_kind(at: np.ndarray, kind: np.ndarray, n: int) -> list[np.ndarray]:
    """Of each place how often it is counted, how often of that held out, and how often only scored."""
    return [np.bincount(at, w, minlength=n).astype(np.int64) for w in (kind > 0, kind == 2, kind == 0)]


def _cut(name: str, keys: np.ndarray, *counts: np.ndarray, parts: int, kind: int) -> dict[str, list]:
    """The asks of a block's sorted keys, one a part."""
    out: dict[str, list] = {"block": [], "part": [], "blob": []}
    cuts = np.searchsorted(keys, _bounds(parts))
    for p, (a, b) in enumerate(zip(cuts, cuts[1:])):
        if b > a:
            out["block"].append(name)
            out["part"].append(2 * p + kind)
            out["blob"].append(pack(keys[a:b], *[c[a:b] for c in counts]))
    return out


_ASK, _ANSWER = "block string, part long, blob binary", "block string, part long, answer binary"


def _table(rows: dict[str, list]) -> pa.Table:
    kinds = {"block": pa.string(), "part": pa.int64(), "blob": pa.binary(), "answer": pa.binary()}
    return pa.table({k: pa.array(v, kinds[k]) for k, v in rows.items()})


def _answers(part: pa.Table, totals: bool) -> pa.Table:
    """Each block's keys with what all blocks bring; with ``totals`` a row of sums under the block ''."""
    blobs = [unpack(b) for b in part.column("blob").to_pylist()]
    keys, *sums = _sums(*[np.concatenate([b[k] for b in blobs]) for k in range(4)])
    blobs = [b[0] for b in blobs]
    rows: dict[str, list] = {"block": part.column("block").to_pylist(), "part": part.column("part").to_pylist(), "answer": []}
    for own in blobs:
        at = np.searchsorted(keys, own)
        rows["answer"].append(_join(*[small(x[at]) for x in sums]))
    if totals:
        n, h = sums[:2]
        real, kept = (keys != _START) & (n > 0), (keys != _START) & (n > h)
        rows["block"].append("")
        rows["part"].append(-1)
        rows["answer"].append(np.array([n[real].sum(), real.sum(), (n - h)[kept].sum(), kept.sum()], "<i8").tobytes())
    return _table(rows)


def count_corpus(docs: DataFrame, root: str, parts: int, order: int = 2) -> DataFrame:
    """(block, part, answer): of each block the answers about trigrams and a row with part -1; under the block '' totals.

    ``docs``: ``doc_id`` long, ``kind`` int (see :class:`Block`) and ``text``. Blocks and their counts lie under ``root``.
    """

    def ask(batches):
        from pyspark import TaskContext

        task, at, block = TaskContext.get().partitionId(), 0, Block()

        def flush():
            name = f"{task}-{at}"
            hashes, lengths, words = block.arrays()
            kinds = np.array(block.kinds, np.int64)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, pa.schema([("id", pa.int64())])) as w:
                w.write_batch(pa.RecordBatch.from_arrays([pa.array(block.ids, pa.int64())], names=["id"]))
            stored = [sink.getvalue().to_pybytes(), kinds.astype(np.int8).tobytes(), lengths.astype("<i8").tobytes(), _planes(words.astype("<i4")), hashes.astype("<u8").tobytes()]
            # a repeated task writes the same bytes to the same place
            storage.replace(f"{root}/block-{name}", _join(*[zlib.compress(x, 1) for x in stored]), f".{uuid.uuid4().hex}")
            told = Tokens(kinds, lengths, words, hashes)
            n, h, o = _by_kind(told.token, told.kind, len(hashes))
            for x, k in ((n, kinds > 0), (h, kinds == 2), (o, kinds == 0)):
                x[-2] = k.sum()  # the start, as a context
            yield from _table(_cut(name, *_sums(hashes, n, h, o), parts=parts, kind=0)).to_batches()
            counts = _by_kind(told.pair_of, told.kind, len(told.pairs))
            yield from _table(_cut(name, *_sums(told.pair_hashes, *counts), parts=parts, kind=1)).to_batches()

        for batch in batches:
            for i, kind, text in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                block.add(i, kind, text)
                if block.size >= BLOCK_TOKENS:
                    yield from flush()
                    at, block = at + 1, Block()
        if block.ids:
            yield from flush()

    def ask_again(key: tuple, rows: pa.Table) -> pa.Table:
        name = key[0].as_py()
        if not name:
            return _table({"block": [""] * len(rows), "part": [-1] * len(rows), "blob": rows.column("answer").to_pylist()})
        b = Counted.answered(root, name, rows.column("part").to_pylist(), rows.column("answer").to_pylist())
        b.keep(root, name)
        if order < 3:
            return _table({"block": [name], "part": [-1], "blob": [b""]})
        b.find_triples()
        at = np.flatnonzero(b.asked)
        counts = [x[at] for x in _by_kind(b.triple_of, b.kind[b.later], len(b.triples))]
        out = _cut(name, *_sums(b.triple_hashes()[at], *counts), parts=parts, kind=0)
        return _table({"block": [name, *out["block"]], "part": [-1, *out["part"]], "blob": [b"", *out["blob"]]})

    def answer_again(key: tuple, rows: pa.Table) -> pa.Table:
        if key[0].as_py() < 0:
            return rows.rename_columns(["block", "part", "answer"])
        return _answers(rows, False)

    asked = map_arrow(docs.select("doc_id", "kind", "text"), ask, _ASK)
    told = asked.groupBy("part").applyInArrow(lambda key, rows: _answers(rows, key[0].as_py() % 2 == 0), _ANSWER)
    again = told.groupBy("block").applyInArrow(ask_again, _ASK)
    return materialise(again.groupBy("part").applyInArrow(answer_again, _ANSWER), "lm-counts")


def _bounds(parts: int) -> np.ndarray:
    return np.array([(k << 64) // parts for k in range(parts)] + [(1 << 64) - 1], np.uint64)


class Tokens:
    """A block's tokens, different pairs and different trigrams."""

    def __init__(self, kinds: np.ndarray, lengths: np.ndarray, words: np.ndarray, hashes: np.ndarray):
        self.lengths, self.hashes = lengths, hashes
        self.token, self.context, self.doc = _tokens_of(words, lengths, len(hashes) - 2)
        self.kind = kinds[self.doc]
        self.pairs, self.pair_of = np.unique(self.context.astype(np.int64) * len(hashes) + self.token, return_inverse=True)
        self.left, self.right = self.pairs // len(hashes), self.pairs % len(hashes)
        self.pair_hashes = pair_hash(hashes[self.left], hashes[self.right])

    def find_triples(self) -> None:
        """Tokens that aren't a text's first, and their trigrams as two pairs that share a word."""
        self.later = np.flatnonzero(self.context != len(self.hashes) - 2)
        self.triples, self.triple_of = np.unique(self.pair_of[self.later - 1].astype(np.int64) * len(self.pairs) + self.pair_of[self.later], return_inverse=True)
        self.front, self.back = self.triples // len(self.pairs), self.triples % len(self.pairs)

    def triple_hashes(self) -> np.ndarray:
        return pair_hash(self.pair_hashes[self.front], self.hashes[self.right[self.back]])


def _told(answers: list[tuple[int, bytes]]) -> list[np.ndarray]:
    """The counts of a block's sorted keys from its answers, by part."""
    got = [[unsmall(x) for x in _parts(a)] for _, a in sorted(answers)]
    return [np.concatenate(x) for x in zip(*got, strict=True)] if got else [np.empty(0, np.int64)] * 3


class Counted(Tokens):
    """A block together with its counts: n of training documents, h of those held out; ``again`` tells pairs that the corpus
    has more than once, ``asked`` trigrams whose pairs both are such."""

    def find_triples(self) -> None:
        super().find_triples()
        self.asked = self.again[self.front] & self.again[self.back]

    def __init__(self, root: str, name: str):
        stored = [zlib.decompress(x) for x in _parts(storage.read(f"{root}/block-{name}"))]
        self.ids = pa.ipc.open_stream(stored[0]).read_all().column("id")
        self.kinds = np.frombuffer(stored[1], np.int8)
        words = _unplanes(stored[3], 4).view("<i4").ravel()
        super().__init__(self.kinds, np.frombuffer(stored[2], "<i8"), words, np.frombuffer(stored[4], "<u8"))

    @classmethod
    def answered(cls, root: str, name: str, parts: list[int], answers: list[bytes]) -> Counted:
        """With the answers about words (even parts) and pairs (odd ones)."""
        b = cls(root, name)
        rank = np.unique(b.hashes, return_inverse=True)[1]
        b.word_n, b.word_h, _ = (x[rank] for x in _told([x for x in zip(parts, answers, strict=True) if x[0] % 2 == 0]))
        rank = np.unique(b.pair_hashes, return_inverse=True)[1]
        b.pair_n, b.pair_h, other = (x[rank] for x in _told([x for x in zip(parts, answers, strict=True) if x[0] % 2]))
        b.again = b.pair_n + other > 1
        return b

    def keep(self, root: str, name: str) -> None:
        kept = _join(*map(small, (self.word_n, self.word_h, self.pair_n, self.pair_h, self.again.astype(np.int64))))
        storage.replace(f"{root}/counts-{name}", kept, f".{uuid.uuid4().hex}")

    @classmethod
    def kept(cls, root: str, name: str, rows: pa.Table | None = None) -> Counted:
        """As it was kept; with ``rows``, the answers about trigrams, with their counts as well."""
        b = cls(root, name)
        b.word_n, b.word_h, b.pair_n, b.pair_h, again = (unsmall(x) for x in _parts(storage.read(f"{root}/counts-{name}")))
        b.again = again > 0
        if rows is not None:
            b.find_triples()
            # a trigram that wasn't asked for occurs here only
            b.triple_n, b.triple_h, _ = _by_kind(b.triple_of, b.kind[b.later], len(b.triples))
            at = np.flatnonzero(b.asked)
            rank = np.unique(b.triple_hashes()[at], return_inverse=True)[1]
            n, h, _ = _told([(p, a) for p, a in zip(rows.column("part").to_pylist(), rows.column("answer").to_pylist(), strict=True) if p >= 0])
            b.triple_n[at], b.triple_h[at] = n[rank], h[rank]
        return b


def _bucket(context_count: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, then one bucket to a power of two."""
    return np.minimum(np.frexp(context_count.astype(float))[1], BUCKETS - 1)


def fit_weights(bins: list[tuple[int, int, int, int]]) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each bucket by EM over (bucket, bin of log2 pair/uniform, bin of log2
    word/uniform, held-out tokens). Buckets without tokens keep equal shares of what can be non-zero."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for k in range(BUCKETS):
        own = np.array([b[1:] for b in bins if b[0] == k], float).reshape(-1, 3)
        if not len(own):
            continue
        p, n = np.c_[_level(own[:, 0]), _level(own[:, 1]), np.ones(len(own))], own[:, 2:]
        w = weights[k]
        for _ in range(EM_ROUNDS):
            share = w * p
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n).sum(axis=0) + [0, 0, 1e-3]
            w /= w.sum()
        weights[k] = w
    return weights


def fit_shares(bins: list[tuple[int, int, int]]) -> np.ndarray:
    """The trigram estimate's share in each bucket by EM over (bucket, bin of log2 trigram/shorter estimate, held-out
    tokens); none for contexts never seen, a half for buckets without tokens."""
    shares = np.full(BUCKETS, 0.5)
    shares[0] = 0.0
    for k in range(1, BUCKETS):
        own = np.array([b[1:] for b in bins if b[0] == k], float).reshape(-1, 2)
        if not len(own):
            continue
        r, n = _level(own[:, 0]), own[:, 1]
        for _ in range(EM_ROUNDS):
            shares[k] = float((n * shares[k] * r / (shares[k] * r + 1 - shares[k])).sum() / (n.sum() + 1e-3))
    return shares


def _level(b: np.ndarray) -> np.ndarray:
    return np.where(b < 0, 0.0, 2.0 ** ((b - RATIO_BINS // 2) / 4.0))


def _ratio(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        b = np.rint(np.log2(x) * 4)
    return np.where(x > 0, np.clip(b, -RATIO_BINS // 2, RATIO_BINS // 2 - 1) + RATIO_BINS // 2, -1).astype(np.int64)


def score_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: int = 5, skip: int = 1, order: int = 2) -> DataFrame:
    """Scores of all texts under a model of those whose CRC-32 of the id modulo ``learn`` is not ``skip``; a quarter
    of the latter (the next remainder) is held out while weights are fitted."""
    spark = docs.sparkSession
    part = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % learn
    held = (skip + 1) % learn
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.when(part == skip, 0).when(part == held, 2).otherwise(1).alias("kind"), F.col(text).alias("text"))
    size = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    shuffled = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = max(2 * shuffled, -(-size // (BYTES_A_TOKEN * PART_TOKENS)))
    root = shared_path(spark, "lm-blocks")
    counts = count_corpus(source, root, parts, order)
    free_shuffles(spark)
    sums = np.zeros(4, np.int64)
    for r in counts.filter("block = ''").select("answer").toLocalIterator():  # one row a part
        sums += np.frombuffer(bytes(r.answer), "<i8")
    total, distinct, kept_total, kept_distinct = (int(x) for x in sums)
    blocks = counts.filter("block <> '' and part < 0").select("block")
    tasks = max(1, min(blocks.count(), 16 * shuffled))
    # as many tasks as stated: rows are few and small, what a task does with them is not
    names, answers = blocks.repartition(tasks, "block"), counts.filter("block <> ''").repartition(tasks, "block")

    def short(b: Counted, n1, n2, tokens: int, vocabulary: int, weights: np.ndarray) -> np.ndarray:
        """P(v | u) of each pair."""
        context = n1[b.left]
        w = weights[_bucket(context)] if tokens else np.array([[0.0, 0.0, 1.0]])
        return w[:, 0] * n2 / np.maximum(1, context) + w[:, 1] * n1[b.right] / max(1, tokens) + w[:, 2] / (vocabulary + 1)

    def pair_bins(key: tuple, rows: pa.Table) -> pa.Table:
        b = Counted.kept(root, key[0].as_py())
        seen = np.bincount(b.pair_of, b.kind == 2, minlength=len(b.pairs)).astype(np.int64)
        at = np.flatnonzero(seen)
        context, uniform = (b.word_n - b.word_h)[b.left[at]], 1.0 / (kept_distinct + 1)
        pair = (b.pair_n - b.pair_h)[at] / np.maximum(1, context) / uniform
        word = (b.word_n - b.word_h)[b.right[at]] / max(1, kept_total) / uniform
        cell = (_bucket(context) * (RATIO_BINS + 1) + _ratio(pair) + 1) * (RATIO_BINS + 1) + _ratio(word) + 1
        cell, n = _sums(cell, seen[at])
        return pa.table({"cell": pa.array(cell.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    # at most BUCKETS * (RATIO_BINS + 1) ** 2 cells, whatever the corpus
    cells, wide = names.groupBy("block").applyInArrow(pair_bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect(), RATIO_BINS + 1
    weights = fit_weights([(r.cell // wide // wide, r.cell // wide % wide - 1, r.cell % wide - 1, r.n) for r in cells])

    def triple_bins(key: tuple, rows: pa.Table) -> pa.Table:
        b = Counted.kept(root, key[0].as_py(), rows)
        seen = np.bincount(b.triple_of, b.kind[b.later] == 2, minlength=len(b.triples)).astype(np.int64)
        at = np.flatnonzero(seen)
        p = short(b, b.word_n - b.word_h, b.pair_n - b.pair_h, kept_total, kept_distinct, weights)[b.back[at]]
        context = (b.pair_n - b.pair_h)[b.front[at]]
        cell = _bucket(context) * (RATIO_BINS + 1) + _ratio((b.triple_n - b.triple_h)[at] / np.maximum(1, context) / p) + 1
        cell, n = _sums(cell, seen[at])
        return pa.table({"cell": pa.array(cell.astype(np.int64)), "n": pa.array(n.astype(np.int64))})

    # at most BUCKETS * (RATIO_BINS + 1) cells
    cells = answers.groupBy("block").applyInArrow(triple_bins, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect() if order > 2 else []
    shares = fit_shares([(r.cell // wide, r.cell % wide - 1, r.n) for r in cells])

    def scored(key: tuple, rows: pa.Table) -> pa.Table:
        b = Counted.kept(root, key[0].as_py(), rows if order > 2 else None)
        pair = short(b, b.word_n, b.pair_n, total, distinct, weights)
        p = pair[b.pair_of]
        if order > 2:
            context = b.pair_n[b.front]
            share = shares[_bucket(context)]
            p[b.later] = (share * b.triple_n / np.maximum(1, context) + (1 - share) * pair[b.back])[b.triple_of]
        size = len(b.lengths)
        word = b.word_n[b.token]
        base = np.log10((word + 0.5) / (total + 0.5 * (distinct + 1)))
        return pa.table({
            "doc_id": b.ids, "kind": pa.array(b.kinds.astype(np.int32)), "n_tokens": pa.array(b.lengths.astype(np.int64)),
            "n_known": pa.array(np.bincount(b.doc, word > 0, minlength=size).astype(np.int64)),
            "base_score": pa.array(np.bincount(b.doc, base, minlength=size)), "score": pa.array(np.bincount(b.doc, np.log10(p), minlength=size)),
        })

    out = answers.groupBy("block").applyInArrow(scored, "doc_id long, kind int, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", (F.col("kind") == 0).alias("held_out"), "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a bigram model; those whose checksum modulo 5 is 1 are not learned from."""
    return score_corpus(table(spark, sf_dir, "documents"))


QUERIES = {"op3_lm_score": op3_lm_score}
ORACLE_SQL: dict = {}
