"""Operator 1, language ID: nearest centroid over normalised TF-IDF n-gram vectors.

A text's vector holds its byte n-grams (one to three bytes of the lower-cased words, hashed to ``DIM`` places; ASCII
digits and marks only part words) as log counts times inverse document frequency, at length one. Every language has several centroids, found by
spherical k-means on its training texts; a text takes the language of the centroid with the largest cosine, and is
rejected if that cosine lies under the language's bound, which is learned from training texts left out of the
centroids. The score is the winner's share in a softmax over the languages' best cosines, at a temperature fitted
on the same left-out texts.

Training reads at most ``PER_LANGUAGE`` document ids a language, drawn by hash, one text an id however often it is
repeated (the largest by code units); what reaches the driver are their hashed counts (at most DIM places each).

Defined cases: a text that is null or has no letter is ``und`` with score 0 and is rejected; with no training rows
all texts are ``und``; ties go to the first language in order; repeated rows get a row each; an empty table gives an
empty result; other columns are ignored or pass through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, draw, free_name, map_arrow, table, with_columns

DIM, CENTROIDS, PER_LANGUAGE = 4096, 4, 400
#: A text is rejected if its cosine is under this share of the language's lowest left-out hundredth.
REJECT_SHARE = 0.4
_WORDS = bytes(c if c >= 0x80 or chr(c).isalpha() else 32 for c in range(256))


def has_letter(text: str | None) -> bool:
    """Whether any character is a letter (superscript digits and fractions are none)."""
    return bool(text) and any(map(str.isalpha, text))


def counts(text: str) -> np.ndarray:
    """Hashed n-gram counts of a whole text."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORDS).split()
    b = np.frombuffer(b" %b " % b" ".join(words), np.uint8).astype(np.uint32)
    out = np.zeros(DIM, np.int64)
    key = np.zeros(len(b), np.uint32)
    for n in range(1, 4):
        key = (key[: len(b) - n + 1] << np.uint32(8)) | b[n - 1 :]
        if len(key):
            out += np.bincount(((key + np.uint32(n << 26)) * np.uint32(2654435761)) >> np.uint32(20), minlength=DIM)
    return out


class Centroids:
    """The model: ``langs``, ``owner`` of each centroid, the centroids, idf, bounds and temperature."""

    def __init__(self, langs: list[str], vectors: np.ndarray):
        """``vectors``: counts, one row a training text; ``langs`` its language."""
        self.langs = sorted(set(langs))
        y = np.array([self.langs.index(x) for x in langs])
        self.idf = (np.log((1 + len(y)) / (1 + (vectors > 0).sum(axis=0))) + 1).astype(np.float32)
        x = self.weigh(vectors)
        left_out = np.arange(len(y)) % 4 == 3
        self._fit(x[~left_out] if (~left_out).any() else x, y[~left_out] if (~left_out).any() else y)
        held = left_out if left_out.any() else ~left_out
        best = self.similar(x[held])
        self.temperature = min(
            (0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3),
            key=lambda t: -float(np.log(np.clip(_softmax(best / t)[np.arange(len(best)), y[held]], 1e-6, 1)).mean()),
        )
        self.bounds = np.zeros(len(self.langs), np.float32)
        for k in range(len(self.langs)):
            own = best[y[held] == k, k]
            self.bounds[k] = REJECT_SHARE * np.quantile(own, 0.01) if len(own) else 0
        self._fit(x, y)

    def weigh(self, vectors: np.ndarray) -> np.ndarray:
        x = np.log1p(vectors.astype(np.float32)) * self.idf
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def _fit(self, x: np.ndarray, y: np.ndarray) -> None:
        centroids, owner = [], []
        for k in range(len(self.langs)):
            own = x[y == k]
            if not len(own):
                continue
            c = own[[0]]
            while len(c) < min(CENTROIDS, len(own)):  # the text that is farthest from the centroids so far
                c = np.vstack([c, own[np.argmin((own @ c.T).max(axis=1))]])
            for _ in range(12):
                near = np.argmax(own @ c.T, axis=1)
                c = np.stack([own[near == j].sum(axis=0) if (near == j).any() else c[j] for j in range(len(c))])
                c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
            centroids.append(c)
            owner += [k] * len(c)
        self.centroids, self.owner = np.vstack(centroids).astype(np.float32), np.array(owner)

    def similar(self, x: np.ndarray) -> np.ndarray:
        """The best cosine with each language."""
        cos = x @ self.centroids.T
        out = np.full((len(x), len(self.langs)), -1, np.float32)
        for k in range(len(self.langs)):
            if (self.owner == k).any():
                out[:, k] = cos[:, self.owner == k].max(axis=1)
        return out

    def predict(self, texts: list[str | None]) -> list[tuple[str, float, bool]]:
        """(language, score, rejected) of each text."""
        out: list[tuple[str, float, bool]] = [("und", 0.0, True)] * len(texts)
        told = [i for i, t in enumerate(texts) if has_letter(t)]
        for at in range(0, len(told), 256):
            part = told[at : at + 256]
            best = self.similar(self.weigh(np.stack([counts(texts[i]) for i in part])))
            p, k = _softmax(best / self.temperature), best.argmax(axis=1)
            for row, i in enumerate(part):
                j = int(k[row])
                out[i] = (self.langs[j], float(p[row, j]), bool(best[row, j] < self.bounds[j]))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Centroids | None:
    """Fit on at most ``per_language`` rows a language where ``learn`` holds."""
    rows = docs.filter(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), F.col(lang).alias("_lang"), F.col(text).alias("_text"))
    # at most per_language ids a language: a size that the parameter bounds
    ids = F.broadcast(draw(rows.select("_id", "_lang"), "_lang", "_id", per_language))

    def vectors(batches):
        for batch in batches:
            rows = [(k, counts(t).astype(np.uint32)) for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) if has_letter(t)]
            where = [np.flatnonzero(v) for _, v in rows]
            yield pa.RecordBatch.from_pydict({
                "lang": pa.array([k for k, _ in rows], pa.string()),
                "at": pa.array([w.astype(np.uint16).tobytes() for w in where], pa.binary()),
                "n": pa.array([v[w].tobytes() for (_, v), w in zip(rows, where, strict=True)], pa.binary()),
            })

    # of rows that repeat an id one text is taken
    drawn = rows.join(ids, ["_id", "_lang"]).groupBy("_id", "_lang").agg(F.max("_text").alias("_text"))
    rows = map_arrow(drawn.select("_lang", "_text"), vectors, "lang string, at binary, n binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, bytes(r.at), bytes(r.n)))
    x = np.zeros((len(rows), DIM), np.float32)
    for i, r in enumerate(rows):
        x[i, np.frombuffer(bytes(r.at), np.uint16)] = np.frombuffer(bytes(r.n), np.uint32)
    order = np.random.default_rng(7).permutation(len(rows))
    return Centroids([rows[i].lang for i in order], x[order])


ADDED = "_lang_pred string, _score double, _rejected boolean"


def identify(docs: DataFrame, model: Centroids | None, text: str = "text", keep: list[str] | None = None, accepted_only: bool = False) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with language, score and rejection; ``accepted_only`` returns the
    rows that are not rejected, without those columns."""
    names = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    body = free_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(body))

    def scan(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            told = held.value.predict(texts) if held.value else [("und", 0.0, True)] * len(texts)
            own = [batch.column(i) for i in range(len(names))]
            if accepted_only:
                yield pa.RecordBatch.from_arrays(own, names=names).filter(pa.array([not r for _, _, r in told], pa.bool_()))
                continue
            added = [pa.array([t[0] for t in told], pa.string()), pa.array([t[1] for t in told], pa.float64()), pa.array([t[2] for t in told], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*own, *added], names=[*names, "_lang_pred", "_score", "_rejected"])

    return map_arrow(source, scan, with_columns(source.drop(body), "" if accepted_only else ADDED))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents, learned from those whose checksum modulo 3 is not 1."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs, crc_mod(F.col("doc_id"), 3) != 1)
    out = identify(docs, model, keep=["doc_id"])
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_lang_pred").alias("lang_pred"),
        F.col("_score").alias("score"), F.col("_rejected").alias("rejected"),
    )


QUERIES = {"op1_language_id": op1_language_id}
ORACLE_SQL: dict = {}
