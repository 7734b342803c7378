"""Operator 4, document fingerprints: a canonical exact digest.

The canonical form of a text is its NFKC case folding with runs of white space made one space and none at the ends.
The fingerprint is the form's 128-bit XXH3 digest. Documents group by fingerprint, and inside equal fingerprints by
the bytes of the form itself, so two forms never share a group. The likeness of two fingerprints is 1 if they and
the bytes behind them are equal, else 0: an exact digest knows nothing in between.

Only documents whose fingerprint another one shares need their bytes compared. The query finds those fingerprints from
digests alone, and the pass that edits the texts writes the compressed forms of just these documents.

Defined cases: a null text is an empty one; ids are whole numbers; in the order of documents null ids come last and
equal ids are ordered by text; the only document follows itself; repeated rows get a row each and are copies of each
other; the group id is the least id, null if no copy has one; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
import zlib

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_shuffles, map_arrow, materialise, skew_join, table

#: Ids drawn for each range of documents; they decide only how even the ranges are.
DRAWN_PER_RANGE = 20


def canonical(text: str | None) -> bytes:
    if not text:
        return b""
    if text.isascii():
        folded = text.lower()
    else:
        folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode("utf-8", "surrogatepass")


def fingerprint(form: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(form)


def likeness(a: tuple[str, bytes], b: tuple[str, bytes]) -> float:
    return float(a[0] == b[0] and a[1] == b[1])


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as many code points of the front of ``following``, or all."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pack(form: bytes) -> bytes:
    """A form, compressed: equal bytes for equal forms, different ones for different forms."""
    return zlib.compress(form, 1)


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", forms: bool = False) -> DataFrame:
    """(doc_id, fingerprint), and with ``forms`` the compressed ``form``, of every row."""
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def scan(batches):
        for batch in batches:
            made = [canonical(t) for t in batch.column(1).to_pylist()]
            out = {"doc_id": batch.column(0), "fingerprint": pa.array([fingerprint(f) for f in made], pa.string())}
            yield pa.RecordBatch.from_pydict(out | ({"form": pa.array([_pack(f) for f in made], pa.binary())} if forms else {}))

    kind = source.schema["doc_id"].dataType.simpleString()
    return map_arrow(source, scan, f"doc_id {kind}, fingerprint string" + (", form binary" if forms else ""))


def form_groups(rows: DataFrame) -> DataFrame:
    """(fingerprint, form, group_id, copies): one row a form, ``group_id`` its least id. ``rows``: doc_id, fingerprint, form.

    Rows combine before the shuffle, so a group of any size costs a row a task; the grouping compares the bytes of forms
    whose fingerprints are equal.
    """
    return rows.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("copies"))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(fingerprint, form, group_id, copies): one row a canonical form of all documents, the form compressed."""
    return form_groups(digests(docs, doc_id, text, forms=True))


def shared_ids(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The different ids (null among them) of documents whose fingerprint another row shares."""
    rows = materialise(digests(docs, doc_id, text), "digests")
    shared = materialise(rows.groupBy("fingerprint").agg(F.count("*").alias("n")).filter("n > 1").withColumn("shared", F.lit(True)), "shared-digests")
    total = rows.count()
    told = skew_join(rows, shared, "fingerprint", "n", total, F.xxhash64("doc_id"))
    return told.filter("shared").select("doc_id").distinct()


def with_groups(rows: DataFrame) -> DataFrame:
    """``rows`` (fingerprint, form and others; a written table) with ``group_id`` and ``copies`` in place of the form; a
    row without a form is a group of its own."""
    sharing = rows.filter("form is not null")
    groups = materialise(form_groups(sharing.select("doc_id", "fingerprint", "form")), "form-groups")
    told = groups.groupBy("fingerprint").agg(F.count("*").alias("forms"), F.sum("copies").alias("weight"), F.min("group_id").alias("group_id"), F.sum("copies").alias("copies"))
    total = told.agg(F.sum("weight")).first()[0] or 0
    # one form a fingerprint, nearly always: the fingerprint names the group; rows that are alone don't travel
    told = materialise(told, "form-names")
    several = [r.fingerprint for r in told.filter("forms > 1").limit(1).collect()]
    named = skew_join(sharing if several else sharing.drop("form"), told, "fingerprint", "weight", total, F.xxhash64("doc_id"))
    out = named.filter("forms = 1").drop("forms", "form")
    if several:
        mixed = named.filter("forms > 1").drop("forms", "group_id", "copies")
        out = out.unionByName(mixed.join(groups, ["fingerprint", "form"]).drop("form"))
    alone = rows.filter("form is null").drop("form")
    return alone.withColumn("group_id", F.col("doc_id")).withColumn("copies", F.lit(1).cast("long")).unionByName(out)


def _ranges(docs: DataFrame, doc_id: str, parts: int) -> list[float]:
    """Cuts of the ids into about ``parts`` even ranges, from a sample of DRAWN_PER_RANGE ids a range."""
    n = docs.count()
    share = min(1.0, parts * DRAWN_PER_RANGE / max(1, n))
    drawn = docs.filter(F.pmod(F.xxhash64(doc_id), F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    ids = sorted(float(r[0]) for r in drawn.select(doc_id).filter(F.col(doc_id).isNotNull()).toLocalIterator())
    return sorted({ids[len(ids) * k // parts] for k in range(1, parts)}) if len(ids) > 1 else []


def with_next(docs: DataFrame, fn, schema: str, doc_id: str = "doc_id", text: str = "text", marked: DataFrame | None = None) -> DataFrame:
    """``fn`` over an iterator of (id, text, text of the next document, marked), next in descending order of id; marked
    are the documents whose ids (null as well) are among the different ids of ``marked``.

    Documents go to ranges of ids, one shuffle; the first document of each range goes to the range before as well,
    where it only serves as the next of that range's last. Marks travel as rows of their own before their documents.
    """
    from pyspark.ml.feature import Bucketizer

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    place = F.coalesce(F.col("doc_id").cast("double"), F.lit(-1.7e308)).alias("place")
    splits = [-float("inf"), *_ranges(docs, "doc_id", 4 * parts), float("inf")]
    cut = Bucketizer(splits=splits, inputCol="place", outputCol="range") if len(splits) > 2 else None
    ranged = lambda df: cut.transform(df) if cut else df.withColumn("range", F.lit(0.0))
    # one row a range: as many as four times the partitions
    heads = ranged(docs.select("doc_id", place)).groupBy("range").agg(F.max("doc_id").alias("doc_id")).collect()
    order = sorted(heads, key=lambda r: -r["range"])
    also = docs.sparkSession.createDataFrame([(r["doc_id"], order[i - 1]["range"]) for i, r in enumerate(order)], "head long, also double")
    placed = ranged(docs.withColumn("place", place)).join(F.broadcast(also), F.col("doc_id").eqNullSafe(F.col("head")), "left")
    targets = F.when(F.col("also").isNull(), F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("extra")))).otherwise(
        F.array(F.struct(F.col("range").alias("r"), F.lit(0).alias("extra")), F.struct(F.col("also").alias("r"), F.lit(1).alias("extra")))
    )
    dealt = placed.select("doc_id", "text", F.explode(targets).alias("t")).select("doc_id", "text", "t.r", "t.extra")
    if marked is not None:
        marks = ranged(marked.select(F.col("doc_id").cast("long").alias("doc_id"), place))
        dealt = dealt.unionByName(marks.select("doc_id", F.lit(None).cast("string").alias("text"), F.col("range").alias("r"), F.lit(0).alias("extra")))
    dealt = dealt.repartition(parts, "r").sortWithinPartitions("r", "extra", F.col("doc_id").desc_nulls_last(), F.col("text").isNotNull(), F.xxhash64("text"), "text")

    def rows(batches):
        held, mark = None, ()
        for batch in batches:
            for i, t, r, extra in zip(*[batch.column(c).to_pylist() for c in range(4)], strict=True):
                if t is None:
                    mark = (i,)
                    continue
                if held and held[2] == r and not held[3]:
                    yield held[0], held[1], t, held[4]
                held = (i, t, r, extra, mark == (i,))

    return map_arrow(dealt, lambda batches: fn(rows(batches)), schema)


_COLUMNS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, form binary"


def _compare(rows):
    names = [c.split()[0] for c in _COLUMNS.split(", ")]
    out, told = [[] for _ in names], (None, None)

    def flush():
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.binary()]
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=names)
        for c in out:
            c.clear()
        return batch

    held = 0
    for doc_id, text, following, marked in rows:
        if told[0] is text:
            own = told[1]
        else:
            form = canonical(text)
            own = (fingerprint(form), form)
        form = canonical(following)
        after = (fingerprint(form), form)
        other = edited(text, following)
        form = canonical(other)
        changed = (fingerprint(form), form)
        sha = hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest()
        packed = _pack(own[1]) if marked else None
        for c, v in zip(out, (doc_id, len(text), sha, own[0], changed[0], likeness(own, changed), likeness(own, after), packed), strict=True):
            c.append(v)
        held += len(packed or b"")
        told = (following, after)
        if len(out[0]) >= 2000 or held >= 16 << 20:
            yield flush()
            held = 0
    if out[0]:
        yield flush()


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts, and the group of documents with the same form."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = with_next(docs, _compare, _COLUMNS, marked=materialise(shared_ids(docs), "shared-ids"))
    rows = materialise(rows, "fingerprints")
    free_shuffles(spark)
    return with_groups(rows)


QUERIES = {"op4_fingerprints": op4_fingerprints}
ORACLE_SQL: dict = {}
