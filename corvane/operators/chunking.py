"""Documents into sentence-packed chunks: a fold over each document's sentences in one Arrow-batched function."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import Settings
from ..functions import text as T
from ..functions.ontology import Ontology
from ..shipping import ship

# fixed values: words whose full stop ends no sentence; pieces of over-long sentences
ABBREVIATIONS = ("sr", "sra", "srta", "prof", "profa", "profª", "prof.", "dra", "dr", "d.", "etc", "dti", "staepe", "stpg")
SEPARATORS = ("; ", ", ", " ", "")
#: Characters of chunks that a task's Python holds at once.
PACKED = 1_000_000
_LONGEST, _INK = max(map(len, ABBREVIATIONS)), re.compile(r"\S")
_PROTECTED = [re.compile(p) for p in (T.EMAIL, T.PHONE, T.URL, T.ACRONYM)]


def split_paragraphs(text: str) -> list[str]:
    parts = re.split(r"\n{2,}", text.replace("\r\n", "\n").replace("\r", "\n"))
    flat = (" ".join(line.strip() for line in p.split("\n") if line.strip()) for p in parts)
    return [p for p in flat if p]


def _ends_sentence(paragraph: str, at: int) -> bool:
    """Whether the mark at ``at`` follows a word that is no abbreviation and stands before a capital. Looks back over one
    word and ahead over one gap only."""
    end = at
    while end and paragraph[end - 1].isspace():
        end -= 1
    if not end:
        return False
    start = end
    while start and (paragraph[start - 1].isalnum() or paragraph[start - 1] in "-_"):
        start -= 1
    if end - start <= _LONGEST and paragraph[start:end].lower() in ABBREVIATIONS:
        return False
    after = _INK.search(paragraph, at + 1)
    return after is not None and after.group().isupper()


def split_sentences(paragraph: str) -> list[str]:
    """Cuts after ``.``, ``?`` and ``!`` where the word before is no abbreviation and a capital follows."""
    out, start = [], 0
    for m in re.finditer(r"[.?!]", paragraph):
        if _ends_sentence(paragraph, m.start()):
            if sentence := paragraph[start : m.end()].strip():
                out.append(sentence)
            start = m.end()
    if sentence := paragraph[start:].strip():
        out.append(sentence)
    return out


def cut_characters(text: str, size: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size`` characters: at the first separator that occurs, pieces filled up in order; what is
    still too long is cut by the separators after it."""
    if len(text) <= size:
        return [text.strip()] if text.strip() else []
    mark = next((s for s in separators if s == "" or s in text))
    if mark == "":
        return [p for i in range(0, len(text), size) if (p := text[i : i + size].strip())]
    after = separators[separators.index(mark) + 1 :]
    parts = text.split(mark)
    parts = [p + mark.rstrip() if i + 1 < len(parts) else p for i, p in enumerate(parts)]
    out, held = [], ""
    for part in parts:
        joined = f"{held} {part}".strip() if held else part
        if len(joined) <= size:
            held = joined
            continue
        if held.strip():
            out.append(held.strip())
        held = ""
        if len(part) <= size:
            held = part
        else:
            out += cut_characters(part, size, after)
    return [*out, held.strip()] if held.strip() else out


def pack(text: str, size: int, overlap: int) -> list[tuple[str, int]]:
    """(chunk, tokens) of a document. A chunk is filled to ``size`` tokens; the next begins with the smallest tail of
    whole sentences that has ``overlap`` tokens (which may take it past ``size``). A sentence longer than ``size``
    tokens stands alone, cut to ``size`` characters unless it holds a protected span."""
    held: list[tuple[str, int]] = []
    total = 0
    out: list[list[tuple[str, int]]] = []
    for s in (s for p in split_paragraphs(text) for s in split_sentences(p)):
        n = len(s.split())
        if not n:
            continue
        if n > size:
            if held:
                out.append(held)
            held, total = [], 0
            pieces = [s] if any(p.search(s) for p in _PROTECTED) else cut_characters(s, size)
            out += [[(p, len(p.split()))] for p in pieces]
        elif total + n <= size:
            held.append((s, n))
            total += n
        else:
            out.append(held)
            tail, kept = len(held), 0
            while tail and kept < overlap:
                tail -= 1
                kept += held[tail][1]
            held, total = [*held[tail:], (s, n)], kept + n
    if held:
        out.append(held)
    if not out:
        return [(p, len(p.split())) for p in cut_characters(text, size, ("\n\n", "\n", " ", ""))]
    return [("\n".join(s for s, _ in c), sum(k for _, k in c)) for c in out]


def chunk(docs: DataFrame, settings: Settings | None = None, ontology: Ontology | None = None, source: str = "source", text: str = "text") -> DataFrame:
    """Chunks of documents with position, total, section, tokens, sector, e-mails, phones, URLs and acronyms."""
    ship(docs.sparkSession)
    s = settings or Settings()
    size, overlap = s.chunk_size, s.chunk_overlap

    names = [c for c in docs.columns if c not in (text, source)]
    rows = docs.select(F.col(source).alias("source"), *names, F.col(text).alias("text"))
    added = StructType.fromDDL("chunk_total int, chunk int, text string, chunk_tokens int")
    schema = StructType([*rows.drop("text").schema.fields, *added.fields])
    fields = to_arrow_schema(schema)

    def packed(batches):
        """Chunks of PACKED characters of text at a time, so a task's Python holds a bounded number of them."""
        for batch in batches:
            texts, begin = batch.column(batch.num_columns - 1), 0
            held: list = []
            weight = 0
            for i in range(batch.num_rows):
                held.append(pack(texts[i].as_py() or "", size, overlap))
                weight += sum(len(c) for c, _ in held[-1])
                if weight < PACKED and i + 1 < batch.num_rows:
                    continue
                totals = [len(c) for c in held]
                row = [begin + j for j, n in enumerate(totals) for _ in range(n)]
                own = batch.select(list(range(batch.num_columns - 1))).take(pa.array(row, pa.int64()))
                more = [[totals[j - begin] for j in row], [p for n in totals for p in range(n)], [t for c in held for t, _ in c], [n for c in held for _, n in c]]
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(m, fields.field(n).type) for m, n in zip(more, added.names, strict=True)]], names=schema.names)
                begin, held, weight = i + 1, [], 0

    out = rows.mapInArrow(packed, schema)
    out = out.select("source", *names, "chunk_total", "chunk", "text", "chunk_tokens")
    sector = (ontology or Ontology()).first_match(F.lower("text"))
    return (
        out.withColumn("section", T.section_title(F.col("text")))
        .withColumn("_s", sector)
        .withColumn("sector", F.col("_s.label"))
        .withColumn("sector_slug", F.col("_s.slug"))
        .withColumn("emails", T.emails(F.col("text")))
        .withColumn("phones", T.phones(F.col("text")))
        .withColumn("urls", T.urls(F.col("text")))
        .withColumn("siglas", T.acronyms(F.col("text")))
        .drop("_s")
    )
