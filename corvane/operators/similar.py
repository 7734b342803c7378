"""Similarity joins that look at few pairs: words by edit distance, sentences by their best window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.fuzzy import column, partial_ratio
from ..shared import settle, spread
from ..shipping import ship

#: Least similarity of two words, and the longest word that is taken by deletions (two of them at most).
WORD_SIMILARITY, DELETED_TO = 0.86, 21


def _edits(length: Column, similarity: float) -> Column:
    """Most edits that words of this length may differ by."""
    return F.floor(length * (1 - similarity) + 1e-9).cast("int")


def _shorter(word: Column) -> Column:
    """All strings with one character less."""
    return F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def _deletions(word: Column, similarity: float) -> Column:
    """``word`` with as many characters deleted as the longest partner allows, two at most: words within that distance share one."""
    edits = _edits(F.length(word) + 1, similarity)
    one = F.when(edits >= 1, _shorter(word)).otherwise(F.array().cast("array<string>"))
    two = F.when(edits >= 2, F.flatten(F.transform(_shorter(word), _shorter))).otherwise(F.array().cast("array<string>"))
    return F.when(F.length(word) <= DELETED_TO, F.array_distinct(F.concat(F.array(word), one, two))).otherwise(F.array().cast("array<string>"))


def _cut(length: Column, parts: Column, i: Column) -> Column:
    """Where part ``i`` (from 0) of as many equal parts begins, from 1."""
    return (F.floor(i * length / parts) + 1).cast("int")


def _segments(word: Column, similarity: float) -> Column:
    """A long word's keys: one part more than it may have edits, so one of them stands unchanged in any close word."""
    parts = _edits(F.length(word) + 1, similarity) + 1
    n = F.length(word)
    keys = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.concat_ws("\x01", n, i, F.substring(word, _cut(n, parts, i), _cut(n, parts, i + 1) - _cut(n, parts, i))))
    return F.when(n >= DELETED_TO, keys).otherwise(F.array().cast("array<string>"))


def _segment_places(word: Column, similarity: float) -> Column:
    """Keys that close words of any length may have as :func:`_segments`: their parts, moved by as many places as edits."""

    def of(n: Column) -> Column:
        parts = _edits(n + 1, similarity) + 1

        def part(i: Column) -> Column:
            begin, size = _cut(n, parts, i), _cut(n, parts, i + 1) - _cut(n, parts, i)
            places = F.filter(F.sequence(begin - parts + 1, begin + parts - 1), lambda p: (p >= 1) & (p + size - 1 <= F.length(word)))
            return F.transform(places, lambda p: F.concat_ws("\x01", n, i, F.substring(word, p, size)))

        return F.when(n >= DELETED_TO, F.flatten(F.transform(F.sequence(F.lit(0), parts - 1), part))).otherwise(F.array().cast("array<string>"))

    n = F.length(word)
    return F.when(n >= DELETED_TO, F.array_distinct(F.concat(of(n - 1), of(n), of(n + 1)))).otherwise(F.array().cast("array<string>"))


def close_words(words: DataFrame, terms: DataFrame, similarity: float = WORD_SIMILARITY, sent=lambda keys: keys) -> DataFrame:
    """(word, term, score): pairs of different words and terms with a normalised edit distance that leaves ``similarity``, and
    lengths one apart at most; score is 0 to 100.

    Words meet terms by equal keys: what is left after deletions, for long words unchanged parts. Words of a length that
    no term is near are left out first. ``sent``: what is done to the terms' keys before they are joined.
    """
    near = terms.select(F.explode(F.array(*[F.length("term") + d for d in (-1, 0, 1)])).alias("n")).distinct()
    few = spread(words.join(sent(near), F.length("word") == F.col("n"), "left_semi"), "word")
    # edits are bounded by deletions up to their length, by parts beyond
    own = few.select("word", F.explode(F.concat(_deletions(F.col("word"), similarity), _segment_places(F.col("word"), similarity))).alias("key"))
    other = terms.select("term", F.explode(F.concat(_deletions(F.col("term"), similarity), _segments(F.col("term"), similarity))).alias("key"))
    pairs = own.join(sent(other), "key").select("word", "term").filter(F.abs(F.length("word") - F.length("term")) <= 1).distinct()
    alike = T.similarity(F.col("word"), F.col("term"))
    return pairs.withColumn("alike", alike).filter(F.col("alike") >= similarity).select("word", "term", F.floor(100 * F.col("alike")).cast("int").alias("score"))


def _grams(c: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(2))))


def may_match(term: Column, sentence: Column, threshold: float) -> Column:
    """Whether the best-window ratio of two strings can reach ``threshold``; false only where it can't.

    With n characters in the shorter one, a window of n at most and a ratio of t, at most ``2 n (1 - t)`` characters are
    deleted or inserted. So of that many parts and one more of the shorter string one stands whole in the longer, and of
    its different pairs of characters all but two for each edit.
    """
    in_sentence, in_term = _may_lie(term, sentence, threshold), _may_lie(sentence, term, threshold)
    return ((F.length(term) <= F.length(sentence)) & in_sentence) | ((F.length(term) >= F.length(sentence)) & in_term)


def _may_lie(short: Column, long: Column, threshold: float) -> Column:
    n = F.length(short)
    edits = F.floor(n * (2 * (1 - threshold / 100)) + 1e-9).cast("int")
    parts = edits + 1
    whole = F.exists(F.sequence(F.lit(0), parts - 1), lambda i: F.contains(long, F.substring(short, _cut(n, parts, i), _cut(n, parts, i + 1) - _cut(n, parts, i))))
    shared = F.size(F.array_intersect(_grams(short), _grams(long))) >= F.size(_grams(short)) - 2 * edits
    return F.contains(long, short) | ((edits > 0) & whole & ((n < 2) | shared))


def window_scores(sentences: DataFrame, terms: DataFrame, threshold: float) -> DataFrame:
    """(query_id, folded, score): the best window ratio of a question's sentences with its terms, where it reaches ``threshold``.

    ``sentences``: query_id, folded; ``terms``: query_id, term. A question's terms lie in its sentences' rows as an array.
    A sentence that holds a term whole, or lies in one, has the best score there is; of the others only the pairs that
    pass the filters become rows, and each is measured once however many questions have it.
    """
    ship(sentences.sparkSession)
    asked = terms.groupBy("query_id").agg(F.collect_set("term").alias("asked"))
    holds = F.exists("asked", lambda t: F.contains(F.col("folded"), t) | F.contains(t, F.col("folded")))
    rows = settle(sentences.select("query_id", "folded").distinct().join(asked, "query_id").withColumn("whole", holds), "asked-sentences")
    whole = rows.filter("whole").select("query_id", "folded", F.lit(100.0).alias("score"))
    kept = F.filter("asked", lambda t: may_match(t, F.col("folded"), threshold))
    pairs = settle(rows.filter("not whole").select("query_id", "folded", F.explode(kept).alias("term")), "window-pairs")
    tried = spread(pairs.select("term", "folded").distinct(), "term", "folded").withColumn("score", column(partial_ratio, F.col("term"), F.col("folded"))).filter(F.col("score") >= threshold)
    part = pairs.join(tried, ["term", "folded"]).groupBy("query_id", "folded").agg(F.max("score").alias("score"))
    return whole.unionByName(part)
