"""Fuzzy search over a whole corpus: a stored index of its sentences, for questions that word search has no answer to.

The index holds each different folded sentence once, the documents that have it, and its words. A question's terms reach
sentences in two ways:

* by a close word, through the words that :func:`~.similar.close_words` finds in the vocabulary;
* by a window: of one part more than a term may have edits, one stands whole in the sentence, and the window lies about it.
  All sentences are read once for all terms; a pair whose window can't be alike is dropped where it is found, so no grams
  are stored or shuffled. Sentences shorter than the term come by one of their own parts, which stands in the term. What is
  left is measured, each pair once.
"""

from __future__ import annotations

import dataclasses
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import text as T
from ..functions.fuzzy import column, partial_ratio
from ..functions.ontology import Ontology
from ..shared import read_bytes, settle, shared_path, spread, write_bytes
from ..shipping import ship
from . import similar
from .retrieve import department_bonus, question_terms, top

TABLES = ("sentences", "places", "words")
#: Bytes of sentences that a task looks at once.
LOOKED_AT = 4_000_000
#: Characters of a part that are looked up, and places that are compared at once.
SEED, HITS = 4, 250_000
#: Terms whose keys are sent to all tasks.
FEW = 10_000
#: Documents that a question gets.
LIMIT = 6


def grams(c: Column) -> Column:
    """Different runs of one, two and three characters."""

    def runs(n: int) -> Column:
        return F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(runs(1), runs(2), runs(3)))


@dataclasses.dataclass
class SentenceIndex:
    """sentences (sid, folded), places (sid, doc_id, words), words (word). Different spellings of a sentence have a place each. Grams are no part of what is stored; who has them as
    (gram, sid) and (gram, n) may keep them here."""

    sentences: DataFrame
    places: DataFrame
    words: DataFrame
    grams: DataFrame | None = None
    counts: DataFrame | None = None

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> SentenceIndex:
        return cls(*[spark.read.parquet(f"{path}/{n}") for n in TABLES])


def build(docs: DataFrame, path: str | None = None) -> SentenceIndex:
    """The index of documents (doc_id, text) at ``path``, by default a new one in the shared folder. A sentence is known by 128 bits
    of its folded text, so the same sentence in many documents is taken apart once."""
    spark = docs.sparkSession
    path = path or shared_path(spark, "sentence-index")
    rows = docs.select("doc_id", F.explode(F.array_distinct(T.sentences(F.col("text")))).alias("s"))
    plain = F.octet_length("s") == F.length("s")
    rows = rows.withColumn("folded", F.when(plain, F.lower("s")).otherwise(T.fold(F.col("s"))))
    # words are cut before they are folded, so spellings of one folded sentence may differ in their words
    words = F.when(plain, F.regexp_extract_all("folded", F.lit("[a-z]{5,}"), 0)).otherwise(F.filter(T.bm25_tokens(F.col("s")), lambda w: F.length(w) >= 5))
    words = F.array_distinct(words)
    rows.select(F.unhex(F.md5("folded")).alias("sid"), "doc_id", "folded", words.alias("words")).write.parquet(f"{path}/places")
    rows = spark.read.parquet(f"{path}/places")
    rows.select(F.explode("words").alias("word")).distinct().write.parquet(f"{path}/words")
    rows.select("sid", "folded").distinct().write.parquet(f"{path}/sentences")
    return SentenceIndex.load(spark, path)


def _parts(c: Column, threshold: float) -> Column:
    """One part more than a string may have edits at ``threshold``, so one of them stands whole in what matches it."""
    n = F.length(c)
    parts = F.least(F.floor(n * (2 * (1 - threshold / 100)) + 1e-9).cast("int") + 1, n)
    begin = lambda i: (F.floor(i * n / parts) + 1).cast("int")
    return F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.substring(c, begin(i), begin(i + 1) - begin(i)))


def _pieces(batch: pa.RecordBatch):
    """Slices of a batch whose second column has about LOOKED_AT bytes."""
    column, begin = batch.column(1), 0
    ends = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    while begin < batch.num_rows:
        end = max(begin + 1, int(np.searchsorted(ends, ends[begin] + LOOKED_AT)) - 1)
        yield batch.slice(begin, end - begin)
        begin = end


def _characters(column: pa.Array, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings of a column as one array of codes a character, and where each begins; zeros follow the last."""
    held = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = memoryview(column.buffers()[2])[held[0] : held[-1]] if held[-1] > held[0] else b""
    signs = np.frombuffer(str(raw, "utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.zeros(len(column) + 1, np.int64)
    np.cumsum(np.asarray(pc.utf8_length(column)), out=begins[1:])
    return np.r_[codes[signs], np.zeros(SEED, np.uint8)], begins


class _Terms:
    """Terms ready to be looked for: a sentence that can reach the threshold holds one of a term's parts, and about it enough of
    the term's characters in their order.

    Characters are codes of a byte, equal ones for equal characters; what no term has is 1. With so many characters that codes
    repeat, and for what stands across the border of two sentences, more is kept, never less: what is kept is measured.
    """

    def __init__(self, terms: list[tuple[str, int, list[str]]], threshold: float):
        self.threshold, share = threshold, threshold / 100
        signs = sorted({ch for t, _, _ in terms for ch in t})
        self.crowded = len(signs) > 254
        self.codes = np.ones(0x110000, np.uint8)
        for i, ch in enumerate(signs):
            self.codes[ord(ch)] = 2 + i % 254
        self.names = [t for t, _, _ in terms]
        self.size = np.array([len(t) for t in self.names])
        self.edits = np.array([e for _, e, _ in terms])
        # characters that a window of the term's length, and one at an end of the sentence, must have
        self.within = np.ceil(share * self.size - 1e-9).astype(np.int64)
        self.at_end = np.ceil(share * self.size / (2 - share) - 1e-9).astype(np.int64)
        self.bits = np.zeros((len(terms), 256), np.uint64)
        seeds: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for n, (term, _, parts) in enumerate(terms):
            for i, ch in enumerate(term[:64]):
                self.bits[n, self.codes[ord(ch)]] |= np.uint64(1 << i)
            begin = 0
            for part in parts:
                size = min(SEED, len(part))
                seeds.setdefault(size, {}).setdefault(int.from_bytes(self.codes[[ord(ch) for ch in part[:size]]].tobytes(), "little"), []).append((n, begin))
                begin += len(part)
        self.begins = np.zeros(1 << 16, bool)
        #: by size of a seed: its codes in order, where the terms of each begin, terms and offsets
        self.seeds = {}
        for size, held in seeds.items():
            found = sorted(held)
            for code in found:
                if size > 1:
                    self.begins[code & 0xFFFF] = True
                else:
                    self.begins[code::256] = True
            listed = [x for code in found for x in held[code]]
            bounds = np.cumsum([0, *[len(held[code]) for code in found]])
            self.seeds[size] = np.array(found, np.uint32), bounds, np.array([n for n, _ in listed]), np.array([o for _, o in listed])

    def look(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of a column, terms that may match and the score of the best window; NaN where it is yet to be measured."""
        text, begins = _characters(column, self.codes)
        last = len(text) - SEED
        place = np.flatnonzero(self.begins[text[:last].astype(np.uint16) | text[1 : last + 1].astype(np.uint16) << 8])
        pairs, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        code = np.zeros(len(place), np.uint32)
        for size in range(1, SEED + 1):
            code |= text[place + (size - 1)].astype(np.uint32) << np.uint32(8 * (size - 1))
            if size not in self.seeds:
                continue
            codes, bounds, terms, offsets = self.seeds[size]
            i = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
            hit = np.flatnonzero(codes[i] == code)
            for part in range(0, len(hit), HITS):
                at = hit[part : part + HITS]
                count = bounds[i[at] + 1] - bounds[i[at]]
                which = np.repeat(bounds[i[at]] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum())
                found, score = self._near(text, begins, np.repeat(place[at], count), terms[which], offsets[which])
                pairs.append(found)
                scores.append(score)
        pairs, scores = np.concatenate(pairs), np.concatenate(scores)
        order = np.lexsort((-scores, pairs))
        pairs, scores = pairs[order], scores[order]
        first = np.r_[True, pairs[1:] != pairs[:-1]] if len(pairs) else np.zeros(0, bool)
        return pairs[first] // len(self.names), pairs[first] % len(self.names), scores[first]

    def _common(self, text: np.ndarray, term: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Lengths of the longest common subsequences of terms (64 characters at most) and stretches of the text."""
        # Hyyro's algorithm, all stretches at once: a zero is a character of the term that the subsequence has
        v = np.full(len(term), np.iinfo(np.uint64).max)
        for k in range(int((end - begin).max(initial=0))):
            sign = text[np.minimum(begin + k, len(text) - 1)]
            u = v & np.where(begin + k < end, self.bits[term, sign], np.uint64(0))
            v = (v + u) | (v - u)
        return np.bitwise_count(~v).astype(np.int64)

    def _near(self, text: np.ndarray, begins: np.ndarray, place: np.ndarray, term: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places with a part of a term, rows and terms (as one number) that have enough in common, and scores."""
        row = np.searchsorted(begins, place, side="right") - 1
        first, after = begins[row], begins[row + 1]
        start, stop = place - offset - self.edits[term], place - offset + self.size[term] + self.edits[term]
        at_end = (start <= first) | (stop >= after)
        need = np.where(at_end, self.at_end[term], self.within[term]) - np.maximum(0, self.size[term] - 64)
        low, high = np.maximum(start, first), np.minimum(stop, after)
        # sentences shorter than the term come another way
        fit = (after - first >= self.size[term]) & (high - low >= need)
        pairs, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        for size in np.unique(self.size[term]):
            mine = np.flatnonzero(fit & (self.size[term] == size))
            mine = mine[self._common(text, term[mine], low[mine], high[mine]) >= need[mine]]
            best = np.zeros(len(mine))
            measured = np.zeros(len(mine), bool) if size > 64 or self.crowded else after[mine] - first[mine] > size
            own = mine[measured]
            if len(own):
                top = np.zeros(len(own))
                # every window of the term's length about the part, cut off at the ends of the sentence
                for move in range(-int(size), int(2 * self.edits[term[own]].max() + size) + 1):
                    begin = start[own] + move
                    end = np.minimum(begin + size, after[own])
                    begin = np.maximum(begin, first[own])
                    some = np.flatnonzero((end > begin) & (end <= high[own]) & (begin >= low[own]))
                    common = self._common(text, term[own[some]], begin[some], end[some])
                    top[some] = np.maximum(top[some], 200.0 * common / (size + end[some] - begin[some]))
                best[measured] = top
            best[~measured] = np.nan
            kept = np.isnan(best) | (best >= self.threshold)
            pairs.append((row * len(self.names) + term)[mine[kept]])
            scores.append(best[kept])
        return np.concatenate(pairs), np.concatenate(scores)


def _near(terms: DataFrame, sentences: DataFrame, threshold: float) -> DataFrame:
    """(term, sid, folded, score): sentences, no shorter than the term, that hold a part of it, and about it enough of its characters
    in their order. A sentence of the term's length, and one with a term too long for it, has no score yet and may not match.

    The terms lie in shared storage; a task looks for all parts in many sentences at once.
    """
    spark = terms.sparkSession
    at = f"{shared_path(spark, 'fuzzy-terms')}/0"
    edits = F.floor(F.length("term") * (2 * (1 - threshold / 100)) + 1e-9).cast("int")
    rows = [tuple(r) for r in terms.filter("term <> ''").select("term", edits, _parts(F.col("term"), threshold)).collect()]
    write_bytes(at, pickle.dumps((rows, threshold)))
    schema = f"term string, sid {dict(sentences.dtypes)['sid']}, folded string, score double"
    fields = to_arrow_schema(StructType.fromDDL(schema))

    def look(batches):
        held = _Terms(*pickle.loads(read_bytes(at)))
        names = pa.array(held.names, pa.string())
        for batch in batches:
            for piece in _pieces(batch):
                row, term, score = held.look(piece.column(1))
                own, score = piece.take(pa.array(row)), pa.array(score, from_pandas=True)
                folded = pc.if_else(score.is_null(), own.column(1).cast(pa.string()), None)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(term)), own.column(0).cast(fields[1].type), folded, score], schema=fields)

    # a few MB of sentences take long to look at
    return spread(sentences.select("sid", "folded"), "sid").mapInArrow(look, schema) if rows else spark.createDataFrame([], schema)


def window_matches(terms: DataFrame, index: SentenceIndex, threshold: float) -> DataFrame:
    """(term, sid, score): sentences whose best window with a term (term) reaches ``threshold``."""
    ship(terms.sparkSession)
    near = settle(_near(terms, index.sentences.filter("folded <> ''"), threshold), "near-sentences")
    longer = near.filter("score is null").select("term", "sid", "folded")
    # sentences that are shorter than some term are few, and so are their parts
    longest = terms.agg(F.max(F.length("term"))).first()[0] or 0
    small = index.sentences.filter(F.length("folded") <= longest)
    places = F.sequence(F.lit(1), F.length("term"))
    runs = F.flatten(F.transform(places, lambda k: F.transform(places, lambda i: F.substring(F.col("term"), i, k))))
    inside = terms.select("term", F.explode(F.array_distinct(runs)).alias("part"))
    shorter = small.select("sid", "folded", F.explode(F.array_distinct(_parts(F.col("folded"), threshold))).alias("part")).join(inside, "part").filter(F.length("folded") <= F.length("term"))
    pairs = longer.unionByName(shorter.select("term", "sid", "folded")).filter(similar.may_match(F.col("term"), F.col("folded"), threshold)).distinct()
    pairs = settle(pairs.withColumn("whole", F.contains("folded", F.col("term")) | F.contains("term", F.col("folded"))), "fuzzy-pairs")
    rest = spread(pairs.filter("not whole"), "term", "sid").withColumn("score", column(partial_ratio, F.col("term"), F.col("folded"))).filter(F.col("score") >= threshold)
    done = near.filter("score is not null").select("term", "sid", "score").unionByName(pairs.filter("whole").select("term", "sid", F.lit(100.0).alias("score")))
    return done.unionByName(rest.select("term", "sid", "score"))


def fuzzy_top(questions: DataFrame, docs: DataFrame, index: SentenceIndex, ontology: Ontology | None = None, threshold: float = 90, limit: int = LIMIT, bonus: float = 8.0) -> DataFrame:
    """(query_id, doc_id, score, rank): the documents whose best sentence is closest to a term of the question.

    A sentence with a close word has the closest word's score, any other the score of its best window; sentences below
    ``threshold`` don't count; a document whose source names a department of the question has ``bonus`` more. ``docs``:
    doc_id and source.
    """
    asked = settle(question_terms(questions, ontology), "terms")
    terms = asked.select("term").distinct()
    # the keys of few terms, and the words close to them, go to where the words lie
    sent = F.broadcast if terms.count() <= FEW else lambda x: x
    close = settle(similar.close_words(index.words, terms, sent=sent), "close-words")
    close = index.places.select("sid", F.explode("words").alias("word")).join(sent(close), "word")
    exact = settle(close.join(asked, "term").groupBy("query_id", "sid").agg(F.max("score").cast("double").alias("score")), "close-sentences")
    window = window_matches(terms, index, threshold).join(asked, "term").groupBy("query_id", "sid").agg(F.max("score").alias("score"))
    window = window.join(exact.select("query_id", "sid"), ["query_id", "sid"], "left_anti")
    best = exact.filter(F.col("score") >= threshold).unionByName(window).join(index.places.select("sid", "doc_id"), "sid")
    best = best.groupBy("query_id", "doc_id").agg(F.max("score").alias("score"))
    if ontology:
        best = department_bonus(best, questions, docs, ontology, bonus)
    return top(best, limit)
