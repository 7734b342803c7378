"""Operator 9, benchmark decontamination: a prefix-filtered join of item windows with document words.

Items are cut into windows of ``size`` consecutive words (a shorter item is one window). The words of a window are
ordered by rarity, counted over all documents; a document can only hold the window if it holds the rarest word, so
that word is the window's necessary prefix. Where a document has it, the window's place follows from the word's
offset; places that stick out of the document are pruned, the others are verified word for word.

Items lie in shared storage in blocks of a stated size, any number of them. One pass over the documents counts the
words of all blocks, one finds their windows. A task holds one block at a time: with several, it gathers documents of
``HELD_BYTES`` and takes them through the blocks in turn, reading each block anew. Documents are not shuffled.

Defined cases: a null text has no words; items with a null id or without words are ignored; rows that repeat an item
id count as one item; documents that repeat get a row each; no items or no documents give no hits or no rows; other
columns are ignored or pass through.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import free_name, map_arrow, materialise, shared_path, table, with_columns

WINDOW = 10
#: UTF-8 bytes of item text in one block; a task holds one block at a time.
BLOCK_BYTES = 16 << 20
#: UTF-8 bytes of documents that a task takes through the blocks together, where there are several.
HELD_BYTES = 64 << 20
#: Between words: ASCII other than digits and letters. A-Z become a-z.
_TO_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else 32 if c <= 0x2F or 0x3A <= c <= 0x60 or 0x7B <= c <= 0x7F else c for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


def windows_of(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


class WindowIndex:
    """Windows of some items behind their rarest words."""

    def __init__(self, items: list[tuple[int, str]], rarity: dict[bytes, int], size: int = WINDOW):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for w in windows_of(words_of(text), size):
                owners.setdefault(w, set()).add(item)
        self.by_prefix: dict[bytes, list[tuple[int, list[bytes], set]]] = {}
        for w, ids in owners.items():
            at = min(range(len(w)), key=lambda i: (rarity.get(w[i], 0), w[i], i))
            self.by_prefix.setdefault(w[at], []).append((at, list(w), ids))
        self.prefixes = frozenset(self.by_prefix)

    def find(self, words: list[bytes], covered: bytearray, found: set) -> None:
        """Mark hit words in ``covered`` and add the ids of items with a window to ``found``."""
        if self.prefixes.isdisjoint(words):
            return
        prefixes, n = self.by_prefix, len(words)
        for place, word in enumerate(words):
            for at, window, ids in prefixes.get(word, ()):
                start, end = place - at, place - at + len(window)
                if start >= 0 and end <= n and words[start:end] == window:
                    covered[start:end] = b"\1" * len(window)
                    found |= ids


def _item_blocks(items: DataFrame, item_id: str, text: str, root: str, block_bytes: int) -> int:
    """Write (id, text) lists of about ``block_bytes`` each (an item larger than that is a block) as ``items-k`` under
    ``root``; their number. The driver holds one block."""
    n, block, held = 0, [], 0
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).filter("i is not null and t is not null")
    for row in rows.toLocalIterator():
        block.append((row.i, row.t))
        held += len(row.t.encode("utf-8", "surrogatepass"))
        if held >= block_bytes:
            storage.write(f"{root}/items-{n}", pickle.dumps(block))
            n, block, held = n + 1, [], 0
    if block:
        storage.write(f"{root}/items-{n}", pickle.dumps(block))
    return n + bool(block)


class _Blocks:
    """The blocks under a folder, one at a time; ``make`` turns a block's number into what is held of it."""

    def __init__(self, n: int, make):
        self.n, self.make, self.at, self.held = n, make, -1, None

    def __iter__(self):
        for k in range(self.n):
            if self.at != k:
                self.held = None  # before the next is read
                self.at, self.held = k, self.make(k)
            yield k, self.held


def _gathered(batches, several: bool):
    """Batches as they come, or with several blocks about HELD_BYTES of them as one."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if not several or size >= HELD_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def _load(root: str, name: str):
    return pickle.loads(storage.read(f"{root}/{name}"))


def _rarity(docs: DataFrame, text: str, root: str, n: int) -> None:
    """Write each block's words with the documents that hold them, counted over all documents, as ``rarity-k``; as many
    rows as a block has words."""

    def count(batches):
        seen = [Counter() for _ in range(n)]
        blocks = _Blocks(n, lambda k: frozenset(w for _, t in _load(root, f"items-{k}") for w in words_of(t)))
        for held in _gathered(batches, n > 1):
            texts = [set(words_of(t)) for batch in held for t in batch.column(0).to_pylist()]
            for k, vocabulary in blocks:
                for words in texts:
                    seen[k].update(vocabulary & words)
        for k, words in enumerate(seen):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k] * len(words), pa.int64()), "w": pa.array(list(words), pa.binary()), "n": pa.array(list(words.values()), pa.int64())})

    counted = materialise(map_arrow(docs.select(F.col(text)), count, "k long, w binary, n long").groupBy("k", "w").agg(F.sum("n").alias("n")), "item-words")
    for k in range(n):
        rows = counted.filter(F.col("k") == k).select("w", "n").toLocalIterator()
        storage.write(f"{root}/rarity-{k}", pickle.dumps({bytes(r.w): r.n for r in rows}))


ADDED = "_n_words long, _n_hit long, _items array<long>"


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = WINDOW, keep: list[str] | None = None, clean_only: bool = False,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with the number of words, of hit words and the items found.

    ``clean_only`` returns the rows without a hit, without those three columns.
    """
    root = shared_path(docs.sparkSession, "benchmark-items")
    n = _item_blocks(items, item_id, item_text, root, block_bytes)
    if n:
        _rarity(docs, text, root, n)
    names = docs.columns if keep is None else keep
    body = free_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.coalesce(F.col(f"`{text}`"), F.lit("")).alias(body))

    def scan(batches):
        blocks = _Blocks(n, lambda k: WindowIndex(_load(root, f"items-{k}"), _load(root, f"rarity-{k}"), size))
        for held in _gathered(batches, n > 1):
            texts = [words_of(t) for batch in held for t in batch.column(batch.num_columns - 1).to_pylist()]
            covered, found = [bytearray(len(w)) for w in texts], [set() for _ in texts]
            for _, index in blocks:
                for w, c, f in zip(texts, covered, found, strict=True):
                    index.find(w, c, f)
            at = 0
            for batch in held:
                own, to = [batch.column(i) for i in range(len(names))], at + batch.num_rows
                if clean_only:
                    yield pa.RecordBatch.from_arrays(own, names=names).filter(pa.array([not f for f in found[at:to]], pa.bool_()))
                else:
                    added = [
                        pa.array([len(w) for w in texts[at:to]], pa.int64()), pa.array([sum(c) for c in covered[at:to]], pa.int64()),
                        pa.array([sorted(f) for f in found[at:to]], pa.list_(pa.int64())),
                    ]
                    yield pa.RecordBatch.from_arrays([*own, *added], names=[*names, "_n_words", "_n_hit", "_items"])
                at = to

    return map_arrow(source, scan, with_columns(source.drop(body), "" if clean_only else ADDED))


def items_digest(ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest()


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    docs, bench = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    out = find_items(docs.select("doc_id", "text"), bench, keep=["doc_id"])
    ids = F.array_join(F.array_sort(F.transform("_items", lambda i: i.cast("string"))), ",")
    return out.select(
        "doc_id", F.col("_n_words").alias("n_words"), F.col("_n_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"), (F.col("_n_hit") > 0).alias("contaminated"),
    )


_SQL = rf"""
with iw as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null and item_id is not null
), dw as (
  select doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), wins as (
  select distinct item_id, len(win) as k, array_to_string(win, ' ') as s from (
    select item_id, w[i:i + {WINDOW - 1}] as win from (select item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) as i from iw where len(w) > 0)
  )
), lens as (select distinct k from wins),
spots as (
  select doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') as s
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as i from dw, lens where len(w) >= k)
), hits as (select p.doc_id, p.i, p.k, x.item_id from spots p join wins x on p.k = x.k and p.s = x.s),
places as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + k)) as j from hits) group by doc_id),
named as (
  select doc_id, count(*) as n_items, string_agg(id, ',' order by id) as ids
  from (select distinct doc_id, item_id::varchar as id from hits) group by doc_id
)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(p.n_hit, 0)::bigint as n_hit, coalesce(n.n_items, 0)::bigint as n_items,
  sha256(coalesce(n.ids, '')) as items_sha256, coalesce(p.n_hit, 0) > 0 as contaminated
from dw d left join places p on d.doc_id = p.doc_id left join named n on d.doc_id = n.doc_id
"""

QUERIES = {"op9_decontaminate": op9_decontaminate}
ORACLE_SQL = {"op9_decontaminate": _SQL}
