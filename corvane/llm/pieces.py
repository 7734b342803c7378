"""Operator 2, SentencePiece encoding and decoding: an Aho-Corasick automaton drives a single-pass Viterbi.

The automaton holds the model's pieces. One pass over a text yields, at every position, all pieces that end there
(the state's own and, along the output links, its suffixes); each relaxes the best score of the position from the
position where it begins. A character without a piece of its own costs a fixed penalty and is encoded as bytes.

Pieces hold the space mark only at their front, so a best path always breaks where a mark follows another
character, and at characters that no piece holds. Texts are cut there and each different unit is encoded once a
task; a model for which that does not hold is run over whole texts. The vocabulary file is read on the driver and
broadcast, a size that the model fixes.

Viterbi maximises a sum of log probabilities. A unigram model's file holds them. A BPE model's file holds the order of
its merges instead, and sums of those numbers mean nothing, so its pieces take Zipf's law over that order
(:func:`zipf_scores`): no training, and a rule for any BPE vocabulary. Its paths are those of a unigram model with that
table, not the merges that the BPE model itself would make.

Defined cases: a null text encodes and decodes like an empty one, to nothing; a mark in the text itself decodes to a
space, so such a text does not come back exactly (``exact`` is false); repeated rows get a row each; an empty table
gives an empty result; other columns pass through.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, map_arrow, table, with_columns

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Below the lowest score, for a character that has no piece.
UNKNOWN_PENALTY = 10.0
#: Units that a task remembers.
CACHE = 400_000


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[tuple[str, float, int]]:
    """Pieces with the log probability ``1 / (r * H)``, r their place among the normal ones (from 1), H the harmonic sum."""
    n = sum(kind == 0 for _, _, kind in pieces)
    log_h, r, out = math.log(math.fsum(1 / k for k in range(1, n + 1))), 0, []
    for piece, score, kind in pieces:
        r += kind == 0
        out.append((piece, -math.log(r) - log_h if kind == 0 else score, kind))
    return out


def read_pieces(path: str = MODEL, scores: str = "auto") -> list[tuple[str, float, int]]:
    """(piece, score, kind): kind 0 normal, 1 a byte, 2 never matched.

    ``scores``: "file" takes them from the file, "zipf" from :func:`zipf_scores`, "auto" the latter if the file's are
    whole numbers that fall with the piece's place, as those of a BPE model do.
    """
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    kind = lambda i: 1 if m.is_byte(i) else 2 if m.is_control(i) or m.is_unknown(i) or m.is_unused(i) else 0
    pieces = [(m.id_to_piece(i), m.get_score(i), kind(i)) for i in range(m.get_piece_size())]
    given = [score for _, score, k in pieces if k == 0 and score > -1e8]
    ranks = all(a > b for a, b in zip(given, given[1:])) and all(x == int(x) for x in given)
    return zipf_scores(pieces) if scores == "zipf" or scores == "auto" and ranks else pieces


class PieceModel:
    def __init__(self, pieces: list[tuple[str, float, int]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.bytes_of, self.byte_id, lowest = [], {}, 0.0
        self.singles, letters = set(), set()
        for i, (piece, score, kind) in enumerate(pieces):
            if kind == 1:
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                continue
            self.bytes_of.append(piece.replace(MARK, " ").encode() if kind == 0 else b"")
            if kind == 0:
                self.automaton.add_word(piece, (i, len(piece), score))
                lowest = min(lowest, score) if score > -1e8 else lowest
                letters.update(piece)
                if len(piece) == 1:
                    self.singles.add(piece)
        self.automaton.make_automaton()
        self.unknown = lowest - UNKNOWN_PENALTY
        self.unknown_id = next((i for i, (p, _, k) in enumerate(pieces) if k == 2 and p == "<unk>"), 0)
        self.fronted = all(MARK not in p.lstrip(MARK) for p, _, k in pieces if k == 0)
        self.lines_apart = "\n" not in letters
        self.marked, self.bare = _Units(self, MARK), _Units(self, "")

    def viterbi(self, s: str) -> list[int]:
        """Piece ids of the best path over ``s`` (spaces already marks)."""
        n = len(s)
        best, start, piece = [0.0] + [-1e30] * n, [0] * (n + 1), [-1] * (n + 1)
        singles, unknown, at = self.singles, self.unknown, 0
        for last, (i, size, score) in self.automaton.iter(s):
            end = last + 1
            while at < end:
                at += 1
                if s[at - 1] not in singles:
                    best[at], start[at] = best[at - 1] + unknown, at - 1
            score += best[end - size]
            if score > best[end] or piece[end] >= 0 and score == best[end] and end - size < start[end]:
                best[end], start[end], piece[end] = score, end - size, i
        while at < n:
            at += 1
            if s[at - 1] not in singles:
                best[at], start[at] = best[at - 1] + unknown, at - 1
        out, at = [], n
        while at:
            if piece[at] >= 0:
                out.append(piece[at])
            else:
                out += [self.byte_id.get(b, self.unknown_id) for b in reversed(s[at - 1].encode("utf-8", "surrogatepass"))]
            at = start[at]
        return out[::-1]

    def encode(self, text: str | None) -> bytes:
        """Piece ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        if not (self.fronted and self.lines_apart) or MARK in text:
            return _packed(self.viterbi(MARK + text.replace(" ", MARK)))
        if len(self.marked) > CACHE:
            self.marked.clear()
        if len(self.bare) > CACHE:
            self.bare.clear()
        marked, bare, out = self.marked, self.bare, []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append(bare["\n"])
            words = line.split(" ")
            if "" in words:  # runs of spaces: a unit is a run and what follows it
                out += [bare[u] for u in re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", (MARK if not k else "") + MARK.join(words))]
                continue
            out.append(bare[words[0]] if k else marked[words[0]])
            out += [marked[w] for w in words[1:]]
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        known = self.bytes_of
        return b"".join([known[i] for i in np.frombuffer(ids, "<i4").tolist()])[1:].decode("utf-8", "replace")


class _Units(dict):
    def __init__(self, model: PieceModel, front: str):
        super().__init__()
        self.model, self.front = model, front

    def __missing__(self, unit: str) -> bytes:
        out = self[unit] = _packed(self.model.viterbi(self.front + unit))
        return out


def _packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


def encode_texts(docs: DataFrame, text: str = "text", path: str = MODEL, keep: list[str] | None = None, digests: bool = False, scores: str = "auto") -> DataFrame:
    """``docs`` (the columns ``keep``, or all) with ``_ids``, ``_decoded`` and ``_exact``; with ``digests``, with
    ``_n_pieces`` and SHA-256 digests of ids and decoded text in place of the first two."""
    names = docs.columns if keep is None else keep
    held = docs.sparkSession.sparkContext.broadcast(read_pieces(path, scores))
    body = free_name(docs, "_text")
    source = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias(body))
    added = "_n_pieces long, _ids_sha256 string, _decoded_sha256 string, _exact boolean" if digests else "_ids array<int>, _decoded string, _exact boolean"

    def scan(batches):
        model = PieceModel(held.value)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            for at in range(0, len(texts), 256):
                part = [t or "" for t in texts[at : at + 256]]
                ids = [model.encode(t) for t in part]
                back = [model.decode(i) for i in ids]
                own = [batch.column(i).slice(at, len(part)) for i in range(len(names))]
                if digests:
                    sha = lambda b: hashlib.sha256(b).hexdigest()
                    out = [pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([sha(i) for i in ids]), pa.array([sha(b.encode("utf-8", "surrogatepass")) for b in back])]
                    fields = ["_n_pieces", "_ids_sha256", "_decoded_sha256"]
                else:
                    ends = np.concatenate(([0], np.cumsum([len(i) // 4 for i in ids]))).astype(np.int32)
                    out = [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4"))), pa.array(back, pa.string())]
                    fields = ["_ids", "_decoded"]
                out.append(pa.array([a == b for a, b in zip(part, back, strict=True)], pa.bool_()))
                yield pa.RecordBatch.from_arrays([*own, *out], names=[*names, *fields, "_exact"])

    return map_arrow(source, scan, with_columns(source.drop(body), added))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoding of all documents, decoded again."""
    out = encode_texts(table(spark, sf_dir, "documents"), keep=["doc_id"], digests=True)
    return out.select(
        "doc_id", F.col("_n_pieces").alias("n_pieces"), F.col("_ids_sha256").alias("ids_sha256"),
        F.col("_decoded_sha256").alias("decoded_sha256"), F.col("_exact").alias("exact"),
    )


QUERIES = {"op2_sentencepiece": op2_sentencepiece}
ORACLE_SQL: dict = {}
