"""String similarity that SQL lacks: Indel ratio, token-set ratio and best-window ratio, 0 to 100."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import functions as F


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit of a Python integer a character of ``a``."""
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for ch in b:
        hit = row & where.get(ch, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if not total else 200.0 * lcs_length(a, b) / total


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of the longer, windows at the ends shorter as well; of strings
    of one length each is tried as the shorter."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    best = _best_window(short, long)
    return max(best, _best_window(long, short)) if len(a) == len(b) and best < 100 else best


def _best_window(short: str, long: str) -> float:
    if not short:
        return 100.0 if not long else 0.0
    if short in long:
        return 100.0
    n, best = len(short), 0.0
    # characters that a window shares with the shorter string bound its subsequence; kept up to date as the window moves
    spare = Counter(short)
    shared = 0
    for end in range(1, len(long) + n):
        if end <= len(long):
            spare[long[end - 1]] -= 1
            shared += spare[long[end - 1]] >= 0
        if end > n:
            spare[long[end - n - 1]] += 1
            shared -= spare[long[end - n - 1]] > 0
        begin, stop = max(0, end - n), min(end, len(long))
        if 200.0 * shared / (n + stop - begin) > best:
            best = max(best, ratio(short, long[begin:stop]))
    return best


def token_set_ratio(a: str, b: str) -> float:
    return words_ratio(set(a.split()), set(b.split()))


def words_ratio(left: set[str], right: set[str]) -> float:
    """:func:`token_set_ratio` of two sets of words. What both have stands first in what is compared, so only the rest needs a
    subsequence."""
    if not left or not right:
        return 0.0
    common, only_a, only_b = left & right, " ".join(sorted(left - right)), " ".join(sorted(right - left))
    if common and (not only_a or not only_b):
        return 100.0
    base = sum(map(len, common)) + len(common) - 1 if common else 0
    gap = 1 if common else 0
    with_a, with_b = base + gap + len(only_a), base + gap + len(only_b)
    best = 200.0 * (base + gap + lcs_length(only_a, only_b)) / (with_a + with_b)
    if common:
        best = max(best, 200.0 * base / (base + with_a), 200.0 * base / (base + with_b))
    return best


def column(fn, a, b):
    """``fn`` of two string columns, in Arrow batches; null for a null."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([None if u is None or v is None else fn(u, v) for u, v in zip(x, y, strict=True)], dtype="float64")

    return run(a, b)
