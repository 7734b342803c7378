"""Operator 6, toxicity: a support vector machine over a gap-weighted subsequence kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of four characters, the products of their weights in both. An
occurrence may have gaps: it weighs ``DECAY ** span`` and spans at most ``SPAN`` characters, so characters or a space
put between the letters of an insult lower its weight but don't hide it. Subsequences are hashed to 2**BITS places and
a string's weights are divided by a norm that its length gives.

The examples are sentences: what lies between line breaks or closing marks, lower-cased, without ASCII marks, runs of
three or more single characters joined, a word that follows itself once; of a sentence longer than ``WINDOW`` words every
run of that many words. Landmarks are single words of the examples, chosen step by step by the loss' slope along them;
examples are mapped onto their kernel values with the landmarks, whitened by the landmarks' own kernel (Nyström), and a
squared-hinge linear machine is fitted there. Its value is a weighted sum of kernels with landmarks, so it is folded into
one weight a place, which scores any sentence exactly and without landmarks at hand.

Labels are a text's, so the machine is fitted as for multiple instances. A first machine over whole texts (unbroken
subsequences only) ranks sentences. Then, round by round, the worst sentence of each toxic text is a positive example,
if it is worse than those of most clean texts, the worst sentences of clean texts are negative ones, and the machine
fitted on them ranks sentences for the next round. A text's score is the chance that at least one of its sentences is
toxic, each by a logistic curve fitted on training texts that the machine hasn't seen.

Training reads at most ``PER_LABEL`` labelled document ids a label, drawn by hash, one text an id, and all of their
sentences.

Defined cases: null and empty texts and texts without a word have the lowest score; texts are scored whole; with no
labelled rows, or one label only, the score is the share of toxic rows (0 without any); an id that is labelled both
ways counts for each; repeated rows get a row each; an empty table gives an empty result; other columns are ignored or
pass through.
"""

from __future__ import annotations

import math
import re
from itertools import combinations, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod, draw, free_name, map_arrow, table, with_columns

DECAY, SPAN, LENGTH, BITS = 0.6, 7, 4, 20
#: Words of a sentence that are looked at together.
WINDOW = 8
PER_LABEL, LANDMARKS, ROUNDS, STEPS, THRESHOLD = 1500, 256, 4, 4, 0.7
#: Steps of a character's value in one.
GRAIN = float(1 << 24)
#: Strings of fewer characters have the norm of so many.
SHORTEST = 30
#: What a squared miss costs, the labels balanced, where the squared weights cost a half.
COST = 2.0
#: Characters of strings that are held at once, and of those that are worked on at once.
CHUNK, BLOCK = 1 << 20, 1 << 15
#: Offsets of the further characters of a subsequence.
SHAPES = list(combinations(range(1, SPAN), LENGTH - 1))
_MARKS = {c: None for c in range(33, 127) if not chr(c).isalnum()}
_END = re.compile(r"[.!?]+\s|[\n\r]")
_SINGLE = re.compile(r"(?<= )(?:\S ){3,}")


def sentences_of(text: str | None) -> list[str]:
    """Each sentence with a word as `` word word word ``."""
    out = []
    for part in _END.split(text.lower()) if text else ():
        if words := part.translate(_MARKS).split():
            once = " ".join([w for w, _ in groupby(words)])
            out.append(_SINGLE.sub(lambda m: m.group().replace(" ", "") + " ", f" {once} "))
    return out


class Strings:
    """Strings as one array of character codes, and places of all occurrences that lie inside one string."""

    def __init__(self, strings: list[str]):
        self.text = "".join(strings)
        cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        letter, space = (cp >= 97) & (cp <= 122), cp == 32
        # a-z, space, and 37 codes for all else
        self.codes = np.where(letter, cp - np.uint32(96), np.where(space, np.uint32(0), np.uint32(27) + cp % np.uint32(37))).astype(np.uint32)
        size = np.array([len(s) for s in strings], np.int64)
        self.end = np.cumsum(size)
        self.begin = self.end - size
        self.spaces = np.flatnonzero(space)

    def places(self, gaps: bool = True):
        """(start, places, outside, weight) of each shape over blocks of characters: a place is taken at every character,
        ``outside`` are those whose occurrence would leave the string. Without ``gaps`` only the unbroken shape."""
        ends = {last: np.unique(np.concatenate([np.maximum(self.end - k, self.begin) for k in range(1, last + 1)])) for last in range(LENGTH - 1, SPAN)}
        for start in range(0, len(self.codes), BLOCK):
            n = min(BLOCK, len(self.codes) - start)
            block = np.zeros(n + SPAN, np.uint32)
            part = self.codes[start : start + n + SPAN]
            block[: len(part)] = part
            at = [block[k : k + n] for k in range(SPAN)]
            front = {a: (at[0] << np.uint32(6) | at[a]) * np.uint32(2654435761) for a in range(1, SPAN - 2)}
            out = {c: tail[np.searchsorted(tail, start) : np.searchsorted(tail, start + n)] - start for c, tail in ends.items()}
            for b, c in combinations(range(2, SPAN), 2):
                back = (at[b] << np.uint32(6) | at[c]) * np.uint32(2246822519)
                for a in range(1, b) if gaps or c == LENGTH - 1 else ():
                    yield start, ((front[a] + back) >> np.uint32(32 - BITS)).astype(np.intp), out[c], DECAY ** (c + 1)

    def local(self, weights: np.ndarray) -> np.ndarray:
        """For each character the weighted sum over the occurrences that begin there."""
        total, weights = np.zeros(len(self.codes), np.float32), weights.astype(np.float32)
        for start, place, outside, w in self.places():
            found = weights.take(place)
            found[outside] = 0
            found *= np.float32(w)
            total[start : start + len(found)] += found
        return total

    def mass(self, share: np.ndarray) -> np.ndarray:
        """The sum over places of all occurrences, each times the share of the character where it begins."""
        out = np.zeros(1 << BITS)
        for start, place, outside, w in self.places():
            own = share[start : start + len(place)] * w
            own[outside] = 0
            np.add.at(out, place, own)
        return out

    def windows(self, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First and last character (a space each) of every run of ``size`` words inside a string, or of all of a shorter
        one, and the string it is of."""
        owner = np.searchsorted(self.end, self.spaces, "right")
        last = np.searchsorted(self.spaces, self.end) - 1  # a string ends with a space
        k, first = np.arange(len(self.spaces)), np.searchsorted(self.spaces, self.begin)
        stop = np.minimum(k + size, last[owner])
        keep = (k < last[owner]) & ((k + size <= last[owner]) | (k == first[owner]))
        return self.spaces[k[keep]], self.spaces[stop[keep]], owner[keep]


_WEIGHTS = np.array([DECAY ** (s[-1] + 1) for s in SHAPES])
_LASTS = np.array([s[-1] for s in SHAPES])


def norms(sizes: np.ndarray) -> np.ndarray:
    """The norm of strings of these sizes: what their occurrences would weigh if all subsequences were different;
    that of ``SHORTEST`` characters for shorter ones."""
    sizes = np.maximum(np.asarray(sizes, float), SHORTEST)
    return np.sqrt(np.maximum((np.maximum(sizes[:, None] - _LASTS, 0) * _WEIGHTS**2).sum(axis=1), _WEIGHTS[0] ** 2))


def values(strings: Strings, spans: tuple[np.ndarray, np.ndarray], weights: np.ndarray) -> np.ndarray:
    """The kernel-weighted sum of each span of characters (ends included), over occurrences that begin in it."""
    # whole numbers, so that a text's value doesn't depend on what stands before it
    run = np.concatenate(([0], np.cumsum(np.rint(strings.local(weights) * GRAIN).astype(np.int64))))
    return (run[spans[1] + 1] - run[spans[0]]) / GRAIN / norms(spans[1] - spans[0] + 1)


class Occurrences:
    """(string, place, weight) of all occurrences in some strings (without ``gaps``, of unbroken ones), those of one string
    and place summed."""

    def __init__(self, strings: list[str], gaps: bool = True):
        keys, weights, size = [np.empty(0, np.int64)], [np.empty(0)], [len(x) for x in strings]
        run = np.cumsum(size)
        cuts = [0, *np.unique(np.searchsorted(run, np.arange(CHUNK // 4, run[-1] if len(run) else 0, CHUNK // 4))).tolist(), len(strings)]
        for a, b in zip(cuts, cuts[1:]):
            s = Strings(strings[a:b])
            owner, rows = np.repeat(np.arange(a, b), s.end - s.begin), [(np.empty(0, np.int64), np.empty(0))]
            for start, place, outside, w in s.places(gaps):
                inside = np.ones(len(place), bool)
                inside[outside] = False
                rows.append((owner[start : start + len(place)][inside] << BITS | place[inside], np.full(int(inside.sum()), w)))
            key, at = np.unique(np.concatenate([k for k, _ in rows]), return_inverse=True)
            keys.append(key)
            weights.append(np.bincount(at, np.concatenate([w for _, w in rows])))
        key, self.weight = np.concatenate(keys), np.concatenate(weights)
        self.owner, self.place, self.norm = key >> BITS, key & ((1 << BITS) - 1), norms(size)

    def own(self) -> np.ndarray:
        """The root of each string's kernel with itself, before norms."""
        return np.sqrt(np.bincount(self.owner, self.weight**2, minlength=len(self.norm)) + 1e-12)

    def fold(self, alpha: np.ndarray) -> np.ndarray:
        """The weights of places that give the sum of kernels with the strings, each times its ``alpha``."""
        return np.bincount(self.place, self.weight * (alpha / self.norm)[self.owner], minlength=1 << BITS)


def kernel(left: Occurrences, right: Occurrences) -> np.ndarray:
    """Kernel values of strings (rows) with strings (columns)."""
    wide = len(right.norm)
    out = np.zeros(len(left.norm) * wide)
    order = np.argsort(right.place, kind="stable")
    owner, place, weight = right.owner[order], right.place[order], right.weight[order]
    begin = np.searchsorted(place, np.arange((1 << BITS) + 1))
    n = np.diff(begin)[left.place]
    hit = np.flatnonzero(n)
    for at in range(0, len(hit), CHUNK // 8):
        rows = hit[at : at + CHUNK // 8]
        k = n[rows]
        pair = np.repeat(begin[left.place[rows]] - np.cumsum(k) + k, k) + np.arange(k.sum())
        out += np.bincount(np.repeat(left.owner[rows], k) * wide + owner[pair], np.repeat(left.weight[rows], k) * weight[pair], minlength=len(out))
    return out.reshape(len(left.norm), wide) / np.outer(left.norm, right.norm)


def _parts(texts: list[str | None]):
    """(strings, first, last, text) over all runs of words of all sentences, in parts of about CHUNK characters."""
    held: list[str] = []
    owner: list[int] = []
    size = 0
    for i, text in enumerate(texts):
        for s in sentences_of(text):
            held.append(s)
            owner.append(i)
            size += len(s)
        if held and (size >= CHUNK or i + 1 == len(texts)):
            strings = Strings(held)
            first, last, of = strings.windows()
            yield strings, first, last, np.array(owner)[of]
            held, owner, size = [], [], 0
    if held:
        strings = Strings(held)
        first, last, of = strings.windows()
        yield strings, first, last, np.array(owner)[of]


def worst(texts: list[str | None], weights: np.ndarray) -> tuple[np.ndarray, list[str | None]]:
    """Of each text the value of its worst run of words (-inf without one), and that run."""
    top, found = np.full(len(texts), -np.inf), [None] * len(texts)
    for strings, first, last, text in _parts(texts):
        v = values(strings, (first, last), weights)
        np.maximum.at(top, text, v)
        for j in np.flatnonzero(v == top[text])[::-1]:  # the first of equals
            found[text[j]] = strings.text[first[j] : last[j] + 1]
    return top, found


class ToxicityModel:
    """``weights`` of places, ``bias``, and ``slope`` and ``offset`` of the score; or the score that ``always`` holds."""

    def __init__(self, texts: list[tuple[str | None, int]], landmarks: int = LANDMARKS, rounds: int = ROUNDS):
        self.weights, self.bias, self.slope, self.offset, self.always = np.zeros(1 << BITS), 0.0, 0.0, -30.0, None
        self.landmarks: list[str] = []
        labels = np.array([y for _, y in texts], int)
        if not labels.any() or labels.all():
            self.always = float(len(labels) > 0 and labels.all())
            return
        told = np.arange(len(texts)) % 5 != 4
        if len(set(labels[told])) < 2 or len(set(labels[~told])) < 2:
            told = np.ones(len(texts), bool)
        own = [t for (t, _), k in zip(texts, told, strict=True) if k]
        self._fit(own, labels[told], landmarks, rounds)
        unseen = ~told if not told.all() else told
        self._calibrate([t for (t, _), k in zip(texts, unseen, strict=True) if k], labels[unseen])

    def _fit(self, texts: list[str | None], labels: np.ndarray, landmarks: int, rounds: int) -> None:
        whole = ["".join(sentences_of(t)).replace("  ", " ") for t in texts]
        self._machine(*[[t for t, own in zip(whole, labels, strict=True) if own == y and t] for y in (1, 0)], landmarks // 2, gaps=False)
        clean: dict[str, None] = {}
        for _ in range(rounds):
            top, runs = worst(texts, self.weights)
            known = len(clean)
            clean |= dict.fromkeys(r for r, y in zip(runs, labels, strict=True) if not y and r)
            # a toxic text without a sentence worse than those of most clean texts lends no example
            bar = np.quantile(top[(labels == 0) & np.isfinite(top)], 0.9) if clean else -np.inf
            toxic = [r for r, y, v in zip(runs, labels, top, strict=True) if y and r and v > bar]
            if not toxic or not clean or len(clean) == known:
                break
            self._machine(toxic, list(clean), landmarks // (2 * rounds))

    def _machine(self, toxic: list[str], clean: list[str], landmarks: int, gaps: bool = True) -> None:
        """Fit on examples, with so many more landmarks."""
        if not toxic or not clean:
            return
        y = np.r_[np.ones(len(toxic)), -np.ones(len(clean))]
        cost = COST * len(y) / np.r_[np.full(len(toxic), 2.0 * len(toxic)), np.full(len(clean), 2.0 * len(clean))]
        examples = Occurrences([*toxic, *clean], gaps)
        words = sorted({f" {w} " for s in (*toxic, *clean) for w in s.split()} - set(self.landmarks))
        choice, marks, found = Occurrences(words, gaps), Occurrences(self.landmarks, gaps), np.zeros(len(y))
        for step in range(STEPS + 1):
            if self.landmarks:
                eigen, vectors = np.linalg.eigh(kernel(marks, marks))
                large = eigen > 1e-6 * eigen.max()
                whiten, like = vectors[:, large] / np.sqrt(eigen[large]), kernel(examples, marks)
                w, self.bias = _squared_hinge(like @ whiten, y, cost)
                alpha = whiten @ w
                found = like @ alpha + self.bias
            if step < STEPS:
                self.landmarks += self._choose(words, choice, examples.fold(cost * y * np.maximum(0, 1 - y * found)), landmarks // STEPS)
                marks = Occurrences(self.landmarks, gaps)
        if self.landmarks:
            self.weights = marks.fold(alpha)

    def _choose(self, words: list[str], choice: Occurrences, slope: np.ndarray, n: int) -> list[str]:
        """Words along which the loss falls most, none much like another one."""
        if not words:
            return []
        gain = np.abs(np.bincount(choice.owner, choice.weight * slope[choice.place], minlength=len(words))) / choice.own()
        best = [words[i] for i in np.lexsort((np.arange(len(words)), -gain))[: 8 * n] if words[i] not in self.landmarks]
        own, chosen = Occurrences(best), []
        like = kernel(own, own)
        like /= np.sqrt(np.outer(like.diagonal(), like.diagonal())) + 1e-12
        for i in range(len(best)):
            if len(chosen) < n and all(like[i, j] < 0.5 for j in chosen):
                chosen.append(i)
        return [best[i] for i in chosen]

    def _calibrate(self, texts: list[str | None], labels: np.ndarray) -> None:
        y = labels.astype(float)
        share = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum()))  # either label counts for a half
        parts = [(values(strings, (first, last), self.weights) + self.bias, text) for strings, first, last, text in _parts(texts)]
        best = (math.inf, 1.0, 0.0)
        for slope in (1, 2, 3, 4, 6, 8, 12):
            for shift in np.linspace(-1, 3, 81):
                evidence = sum((np.bincount(text, _softplus(slope * (v - shift)), minlength=len(y)) for v, text in parts), np.zeros(len(y)))
                p = np.clip(1 - np.exp(-evidence), 1e-2, 1 - 1e-2)
                loss = -float((share * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum())
                best = min(best, (loss, float(slope), float(-slope * shift)))
        self.slope, self.offset = best[1:]

    def predict(self, texts: list[str | None]) -> np.ndarray:
        """The chance that at least one of a text's runs of words is toxic, each by its own logistic value."""
        if self.always is not None:
            return np.full(len(texts), self.always)
        evidence = np.zeros(len(texts))
        for strings, first, last, text in _parts(texts):
            v = values(strings, (first, last), self.weights) + self.bias
            evidence += np.bincount(text, _softplus(self.slope * v + self.offset), minlength=len(texts))
        return 1 - np.exp(-evidence)


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, np.clip(x, -60, 60))


def _squared_hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, float]:
    """Newton steps for |w|^2 / 2 + sum(cost * max(0, 1 - y f)^2), bias unregularised."""
    z = np.c_[x, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(30):
        active = y * (z @ w) < 1
        a = z[active] * cost[active, None]
        new = np.linalg.solve(z[active].T @ a + np.diag(ridge), a.T @ y[active])
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w[:-1], float(w[-1])


def train(docs: DataFrame, labels: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", per_label: int = PER_LABEL) -> ToxicityModel:
    """Fit on at most ``per_label`` labelled ids a label among the labels rows where ``learn`` holds."""
    rows = labels.filter(learn & F.col(toxic).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), (F.col(toxic) > 0).cast("int").alias("_y"))
    # at most per_label ids a label: a size that the parameter bounds; of rows that repeat an id one text is taken
    ids = F.broadcast(draw(rows, "_y", "_id", per_label))
    drawn = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(ids, "_id").groupBy("_id", "_y").agg(F.max("_text").alias("_text"))
    texts = [(r["_text"], r["_y"]) for r in drawn.orderBy(F.xxhash64("_id"), "_id", "_y").toLocalIterator()]
    return ToxicityModel(texts)


def score_texts(docs: DataFrame, model: ToxicityModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``, or all) and ``_score``."""
    names = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(model)
    body = free_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(body))

    def scan(batches):
        for batch in batches:
            found = held.value.predict(batch.column(batch.num_columns - 1).to_pylist())
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(names))], pa.array(found, pa.float64())], names=[*names, "_score"])

    return map_arrow(source, scan, with_columns(source.drop(body), "_score double"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learned from labels whose document's checksum modulo 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = train(docs, labels, crc_mod(F.col("doc_id"), 3) != 1)
    out = score_texts(docs, model, keep=["doc_id"])
    return out.select(
        "doc_id", (crc_mod(F.col("doc_id"), 3) == 1).alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= THRESHOLD).cast("int").alias("predicted"),
    )


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE_SQL: dict = {}
