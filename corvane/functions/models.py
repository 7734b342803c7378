"""Stand-ins for models: pure functions that a real embedder, scorer or language model can replace."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .text import fold_text


def hashing_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """Words hashed to signed places, at length one; empty texts are zero."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), dim), np.float32)
        for row, text in enumerate(texts):
            for word in fold_text(text).split():
                h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
                out[row, h % dim] += 1 if h >> 16 & 1 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norm == 0, 1, norm)).tolist()

    return embed


def embed_texts(df: DataFrame, embedder: Callable[[list[str]], list[list[float]]] | None = None, text: str = "text", out: str = "embedding") -> DataFrame:
    """``df`` with an array<float> column; the embedder is used once a batch."""
    ship(df.sparkSession)
    run = embedder or hashing_embedder()

    @F.pandas_udf("array<float>")
    def embed(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(run([t or "" for t in part]))

    return df.withColumn(out, embed(F.col(text)))


def overlap_scorer(question: str, text: str) -> float:
    """Share of the question's words that the text holds."""
    q = set(fold_text(question).split())
    return len(q & set(fold_text(text).split())) / len(q) if q else 0.0


def from_logits(given) -> float:
    """A model's output as a score: a number as it is; one logit by its logistic value, several by the second's softmax."""
    if not hasattr(given, "__len__"):
        return float(given)
    x = np.asarray(given, float).ravel()
    if len(x) == 1:
        return float(1 / (1 + np.exp(-x[0])))
    e = np.exp(x - x.max())
    return float(e[1] / e.sum())


def score_pairs(df: DataFrame, scorer: Callable[[str, str], float | list[float]] | None = None, question: str = "question", text: str = "text", out: str = "rerank_score") -> DataFrame:
    """``df`` with the scorer's value of each pair; a scorer that fails or gives no number counts as 0, and
    one that gives logits is read by :func:`from_logits`."""
    ship(df.sparkSession)
    run = scorer or overlap_scorer

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        values = []
        for a, b in zip(q, t, strict=True):
            try:
                v = from_logits(run(a or "", b or ""))
            except Exception:  # noqa: BLE001  a model's failure is a score of 0
                v = 0.0
            values.append(0.0 if v != v else v)
        return pd.Series(values, dtype="float64")

    return df.withColumn(out, score(F.col(question), F.col(text)))


def with_retries(call: Callable[..., tuple], attempts: int = 3, wait: Callable[[float], None] | None = None) -> Callable[..., tuple]:
    """``call`` tried up to ``attempts`` times, waiting 2, 4, .. seconds, 10 at most; then no text, no data."""
    import time

    def run(*args, **kwargs):
        for k in range(attempts):
            try:
                return call(*args, **kwargs)
            except Exception:  # noqa: BLE001
                if k + 1 < attempts:
                    (wait or time.sleep)(min(10, 2 ** (k + 1)))
        return "", None

    return run
