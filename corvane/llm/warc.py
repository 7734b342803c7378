"""Operator 8, WARC: archives with a two-level capture index.

Records are written as members of gzipped archives in shared storage. The index sorts one line a capture by its
reversed-host URL key, cuts the lines into compressed blocks, and keeps for each index shard a sparse directory of
its blocks' first keys; above the directories stand the shards' first keys, one a shard. A lookup binary-searches
the shards' heads, then a shard's directory, reads the range of one block, binary-searches the block's lines, and
reads the range of the record.

Of records with equal payloads of ``min_bytes`` or more, the one with the largest page id is a response; the others
are revisits that refer to it. Payloads are grouped by SHA-256.

Defined cases: a null payload is empty, a null URL is an empty key; a null page id is smaller than any, and stays a
response where no other page has its payload; rows that repeat the largest id are all responses; repeated rows get a
record and a row each; no pages give no archives and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import json
import uuid
import zlib
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .common import map_arrow, materialise, shared_path, skew_join, table

#: Lines of an index block, compressed bytes of an archive, captures of an index shard, bytes read as one stretch.
BLOCK_LINES, ARCHIVE_BYTES, SHARD_CAPTURES, STRETCH = 1000, 1 << 29, 1_000_000, 64 << 20
_DATE = "1970-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def url_key(url: str | None) -> str:
    """``com,example,www)/path?query`` of a URL: the host reversed and lower-cased, scheme and fragment left out."""
    if not url:
        return ""
    try:
        s = urlsplit(url.strip())
        host, port = (s.hostname or ""), s.port
    except ValueError:
        return url.strip()
    front = ",".join(reversed(host.split("."))) + (f":{port}" if port and port not in (80, 443) else "")
    return f"{front}){s.path or '/'}" + (f"?{s.query}" if s.query else "")


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    clean = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {_DATE}", f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Type, page id, payload (None for a revisit), payload size, digest and refers_to of an uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:] if ": " in line)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = next(int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:"))
    number = lambda name: int(v) if (v := fields.get(name, "")[10:-1]) not in ("", "None") else None
    revisit = fields["WARC-Type"] == "revisit"
    out = {"type": fields["WARC-Type"], "page_id": number("WARC-Record-ID"), "size": size, "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": number("WARC-Refers-To"), "payload": None if revisit else payload}
    if not revisit and (len(payload) != size or digest_of(payload) != out["digest"]):
        raise ValueError(f"record of page {out['page_id']} is damaged")
    return out


def mark_revisits(pages: DataFrame, page_id: str = "page_id", html: str = "html", min_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, revisit, refers_to)."""
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), "url", body.alias("html"), F.unhex(F.sha2(body, 256)).alias("sha"))
    again = rows.filter(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.count("*").alias("n"), F.max("page_id").alias("keeper")).filter("n > 1")
    again = materialise(again.withColumn("found", F.lit(True)), "payloads")
    total = again.agg(F.sum("n")).first()[0] or 0
    out = skew_join(rows, again, "sha", "n", total, F.xxhash64("page_id", "url"))
    revisit = F.coalesce(F.col("found") & F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper")), F.lit(False))
    return out.select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("keeper")).alias("refers_to"))


def write_archives(rows: DataFrame, root: str) -> DataFrame:
    """Write (page_id, url, html, revisit, refers_to) as archives under ``root``; captures (key, page_id, file, offset,
    length), written once. A repeated task writes files of its own; only those of the attempt that counted are named."""

    def write(batches):
        out, path, at = None, "", 0
        for batch in batches:
            lines: list[tuple] = []
            for page_id, url, html, revisit, refers_to in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                if out is None or at >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    path = f"{root}/archive-{uuid.uuid4().hex}.warc.gz"
                    out = storage.create(path)
                    info = b"software: corvane\r\n"
                    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: {_DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n"
                    first = _member(head.encode() + info + b"\r\n\r\n")
                    out.write(first)
                    at = len(first)
                data = _member(record(page_id, url, html.encode("utf-8", "surrogatepass"), refers_to, revisit))
                out.write(data)
                lines.append((url_key(url), page_id, path.rsplit("/", 1)[1], at, len(data)))
                at += len(data)
            key, ids, files, offsets, lengths = zip(*lines, strict=True) if lines else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(key, pa.string()), pa.array(ids, pa.int64()), pa.array(files, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())],
                names=["key", "page_id", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return materialise(map_arrow(rows, write, "key string, page_id long, file string, offset long, length long"), "captures")


class CaptureIndex:
    """``heads``: (first key, last key, shard) of each index shard under ``root``, in order."""

    def __init__(self, root: str, heads: list[tuple[str, str, str]]):
        self.root, self.heads = root, sorted(heads)

    @classmethod
    def build(cls, captures: DataFrame, root: str, shard_captures: int = SHARD_CAPTURES) -> CaptureIndex:
        shards = max(int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-captures.count() // shard_captures))
        order = ["key", "page_id", "file", "offset"]

        def write(batches):
            name = f"index-{uuid.uuid4().hex}"
            block: list[str] = []
            entries: list[list] = []
            at, last, out = 0, "", None

            def flush():
                nonlocal at, out
                if out is None:
                    out = storage.create(f"{root}/{name}.gz")
                data = _member("\n".join(block).encode("utf-8", "surrogatepass"))
                out.write(data)
                entries.append([json.loads(block[0].partition("\t")[0]), at, len(data)])
                at += len(data)
                block.clear()

            for batch in batches:
                for key, page_id, file, offset, length in zip(*[batch.column(c).to_pylist() for c in range(5)], strict=True):
                    block.append(f"{json.dumps(key)}\t{json.dumps([page_id, file, offset, length])}")
                    last = key
                    if len(block) >= BLOCK_LINES:
                        flush()
            if block:
                flush()
            if out is not None:
                out.close()
                storage.write(f"{root}/{name}.directory", json.dumps(entries).encode())
                yield pa.RecordBatch.from_pydict({"first": [entries[0][0]], "last": [last], "shard": [name]})

        ranged = captures.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("key", "page_id", "file", "offset", "length")
        heads = materialise(map_arrow(ranged, write, "first string, last string, shard string"), "index-heads")
        return cls(root, [(r.first, r["last"], r.shard) for r in heads.select(F.col("first"), "last", "shard").toLocalIterator()])  # one row a shard

    def shards_of(self, key: str) -> list[str]:
        """Shards whose range of keys holds ``key``."""
        at, found = max(0, bisect.bisect_left([h[0] for h in self.heads], key) - 1), []
        for first, last, shard in self.heads[at:]:
            if first > key:
                break
            if last >= key:
                found.append(shard)
        return found

    def get(self, url: str) -> list[dict]:
        """All records of a URL."""
        key = url_key(url)
        rows = [line for shard in self.shards_of(key) for line in _Shard(self.root, shard).find(key)]
        return [parse_record(zlib.decompress(storage.read(f"{self.root}/{f}", o, n), 31)) for _, f, o, n in rows]

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Captures (key, page_id, file, offset, length) of the different ``key``s."""
        root, held = self.root, keys.sparkSession.sparkContext.broadcast(self)

        def place(batches):
            index = held.value
            for batch in batches:
                rows = [(s, k) for k in batch.column(0).to_pylist() for s in index.shards_of(k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["shard", "key"])

        def find(key: tuple, part: pa.Table) -> pa.Table:
            shard = _Shard(root, key[0].as_py())
            rows = [(k, *line) for k in sorted(part.column("key").to_pylist()) for line in shard.find(k)]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            return pa.table([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["key", "page_id", "file", "offset", "length"])

        placed = map_arrow(keys.select("key").distinct(), place, "shard string, key string")
        return placed.groupBy("shard").applyInArrow(find, "key string, page_id long, file string, offset long, length long")


class _Shard:
    """One index shard: its directory, and the block that was read last."""

    def __init__(self, root: str, name: str):
        self.path = f"{root}/{name}.gz"
        self.entries = json.loads(storage.read(f"{root}/{name}.directory"))
        self.firsts = [e[0] for e in self.entries]
        self.at, self.keys, self.lines = -1, [], []

    def _load(self, at: int) -> None:
        if at != self.at:
            _, offset, length = self.entries[at]
            lines = zlib.decompress(storage.read(self.path, offset, length), 31).decode("utf-8", "surrogatepass").split("\n")
            cut = [line.partition("\t") for line in lines]
            self.at, self.keys, self.lines = at, [json.loads(c[0]) for c in cut], [c[2] for c in cut]

    def find(self, key: str):
        at = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while at < len(self.entries) and self.firsts[at] <= key:
            self._load(at)
            for i in range(bisect.bisect_left(self.keys, key), bisect.bisect_right(self.keys, key)):
                yield json.loads(self.lines[i])
            at += 1


def read_archives(captures: DataFrame, root: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of captures, read stretch by stretch."""

    def read(batches):
        name, file = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True):
                if path != name:
                    if file is not None:
                        file.close()
                    store, where = storage.locate(f"{root}/{path}")
                    name, file = path, store.open_input_file(where)
                rows.append(parse_record(zlib.decompress(file.read_at(length, offset), 31)))
            yield pa.RecordBatch.from_pydict({
                "page_id": pa.array([r["page_id"] for r in rows], pa.int64()), "payload_bytes": pa.array([r["size"] for r in rows], pa.int64()),
                "payload_digest": pa.array([r["digest"] for r in rows], pa.string()), "record_type": pa.array([r["type"] for r in rows], pa.string()),
                "refers_to": pa.array([r["refers_to"] for r in rows], pa.int64()),
            })
        if file is not None:
            file.close()

    parts = int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / STRETCH)
    ordered = captures.select("file", "offset", "length").repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    return map_arrow(ordered, read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives, found again by the index, and read back."""
    pages, root = table(spark, sf_dir, "pages"), shared_path(spark, "warc")
    captures = write_archives(mark_revisits(pages), root)
    index = CaptureIndex.build(captures, root)
    found = materialise(index.lookup(captures.select("key")), "found")
    return read_archives(found, root)


_SQL = """
with p as (select page_id, coalesce(html, '') as html from pages),
k as (select html, max(page_id) as keeper from p group by html),
b as (select page_id, strlen(p.html) as n, sha1(p.html) as hex, keeper from p join k on p.html = k.html),
bits as (select page_id, list_reduce(list_prepend('', list_transform(range(40), lambda i: lpad(bin(('0x' || substr(hex, i + 1, 1))::int), 4, '0'))), lambda a, x: a || x) as s from b)
select b.page_id, b.n::bigint as payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(5), lambda j: substr(s, 5 * i + j + 1, 1)::int << (4 - j)))::int, 1)), '') as payload_digest,
  case when b.page_id = keeper then 'response' else 'revisit' end as record_type,
  case when b.page_id <> keeper then keeper end as refers_to
from b join bits on b.page_id = bits.page_id
"""

QUERIES = {"op8_warc": op8_warc}
ORACLE_SQL = {"op8_warc": _SQL}
