"""Files in, documents out: one row a file, failures in a column of their own instead of a stopped job."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import types
import zipfile
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leading_url
from ..shipping import ship

# fixed values: extensions that ingest reads, and those of the plain index build
EXTENSIONS = (".pdf", ".docx", ".md", ".txt", ".php", ".sql", ".json", ".xml", ".ini", ".config", ".example", ".yml", ".yaml", ".csv")
INDEX_EXTENSIONS = (".txt", ".md", ".pdf", ".docx")
PLAIN = (".txt", ".php", ".sql", ".xml", ".ini", ".config", ".example", ".yml", ".yaml")
SENTINEL = "Nenhum documento foi carregado."


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] = EXTENSIONS, ordered: bool = False) -> DataFrame:
    """(source, file_ext, file_hash, content) of the files below ``folder`` with one of the extensions."""
    out = scanned(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder), extensions)
    return out.orderBy("source") if ordered else out


def scanned(files: DataFrame, extensions: tuple[str, ...] = EXTENSIONS) -> DataFrame:
    """:func:`scan` of files (path, content) that are read already, from a folder or a stream."""
    ext = F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1))
    out = files.withColumn("file_ext", ext).filter(F.col("file_ext").isin(*[e.lower() for e in extensions]))
    return out.select(F.col("path").alias("source"), "file_ext", F.sha2("content", 256).alias("file_hash"), "content")


def decode_text(content):
    """Bytes as UTF-8 where they are valid, else as Latin-1."""
    c = F.col(content) if isinstance(content, str) else content
    return F.when(F.is_valid_utf8(c.cast("string")), c.cast("string")).otherwise(F.decode(c, "ISO-8859-1"))


def csv_to_markdown(raw: str, outer: bool = True) -> str:
    """A Markdown table of all columns as text; blanks stay, line breaks in cells become spaces."""
    rows = [[re.sub(r"[\r\n]+", " ", cell).strip() for cell in row] for row in csv.reader(io.StringIO(raw)) if row]
    if not rows:
        return ""
    width = len(rows[0])
    rows = [(r + [""] * width)[:width] for r in rows]
    line = (lambda cells: f"| {' | '.join(cells)} |") if outer else " | ".join
    return "\n".join([line(rows[0]), line(["---"] * width), *map(line, rows[1:])]).strip()


def json_to_lines(raw: str) -> str:
    """``path: value`` lines, depth first, keys and positions joined by dots."""
    lines: list[str] = []
    stack = [("", json.loads(raw))]
    while stack:
        path, node = stack.pop()
        inner = list(node.items()) if isinstance(node, dict) else list(enumerate(node)) if isinstance(node, list) else None
        if inner is None:
            lines.append(f"{path}: {str(node).replace(chr(10), ' ').strip()}")
        else:
            stack += [(f"{path}.{k}" if path else str(k), v) for k, v in reversed(inner)]
    return "\n".join(lines)


def docx_to_text(content: bytes) -> str:
    """Paragraphs of a .docx, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_to_text(content: bytes) -> str:
    """Text of a PDF, with a reader library if one is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as e:
        raise ValueError("no PDF reader is installed") from e
    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def _plain(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


#: Extension -> function of bytes; others may be registered, and win over these.
READERS: dict[str, Callable[[bytes], str]] = {
    ".csv": lambda b: csv_to_markdown(_plain(b)), ".json": lambda b: json_to_lines(_plain(b)),
    ".docx": docx_to_text, ".pdf": pdf_to_text,
}


def load(files: DataFrame, readers: dict[str, list[Callable[[bytes], str]]] | None = None) -> DataFrame:
    """``files`` of :func:`scan` as documents: source, file_ext, file_hash, text, url, error.

    Plain texts and Markdown never leave the JVM. Others go through Python: the registered readers of the extension
    in turn until one gives text, then the built-in one. A file that can't be read has null text and an error.
    """
    ship(files.sparkSession)
    own = {k.lower(): list(v) for k, v in (readers or {}).items()}

    @F.pandas_udf("struct<text: string, error: string>")
    def parse(ext: pd.Series, content: pd.Series) -> pd.DataFrame:
        out = []
        for e, raw in zip(ext, content, strict=True):
            text, error = "", None
            for reader in [*own.get(e, []), READERS.get(e, _plain)]:
                try:
                    text = reader(bytes(raw)) or ""
                    error = None
                except Exception as x:  # noqa: BLE001  one bad file doesn't stop the others
                    text, error = "", f"{type(x).__name__}: {x}"
                if text:
                    break
            out.append((None if error else text, error))
        return pd.DataFrame(out, columns=["text", "error"])

    direct = [e for e in (*PLAIN, ".md") if e not in own]
    body = decode_text("content")
    body = F.when(F.col("file_ext") == ".md", strip_markdown(body)).otherwise(body)
    plain = files.filter(F.col("file_ext").isin(*direct)).select("source", "file_ext", "file_hash", body.alias("text"), F.lit(None).cast("string").alias("error"))
    parsed = files.filter(~F.col("file_ext").isin(*direct)).withColumn("p", parse("file_ext", "content")).select("source", "file_ext", "file_hash", "p.text", "p.error")
    return plain.unionByName(parsed).withColumn("url", leading_url(F.col("text")))


def plugins(folder: str) -> dict[str, list[Callable[[bytes], str]]]:
    """Readers for :func:`load` from the Python files of a folder, in the order of their names: a function ``read_<ext>``
    serves that extension, a function ``load`` every extension, after those."""
    own: dict[str, list] = {}
    general = []
    for name in sorted(os.listdir(folder)) if os.path.isdir(folder) else ():
        if not name.endswith(".py") or name.startswith("_"):
            continue
        # not entered among the modules, so its functions travel to the executors by value
        module = types.ModuleType(f"corvane_plugin_{name[:-3]}")
        with open(os.path.join(folder, name), encoding="utf-8") as f:
            exec(compile(f.read(), name, "exec"), module.__dict__)  # noqa: S102  the user's own folder
        for k, fn in vars(module).items():
            if k.startswith("read_") and callable(fn):
                own.setdefault(f".{k[5:].lower()}", []).append(fn)
            elif k == "load" and callable(fn):
                general.append(fn)
    return {ext: [*own.get(ext, []), *general] for ext in {*own, *(EXTENSIONS if general else ())}}


def read_prompt(path: str) -> str:
    """A prompt file's text; empty if it can't be read."""
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except (OSError, UnicodeDecodeError):
        return ""


def strip_markdown(c):
    """Markdown without its marks: fences, headings, quotes, list signs, emphasis; links and images as their text."""
    c = F.regexp_replace(c, r"(?m)^[ \t]*(```|~~~).*$\n?", "")
    c = F.regexp_replace(c, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    c = F.regexp_replace(c, r"(?m)^[ \t]*(#{1,6}[ \t]+|>[ \t]?|[-*+][ \t]+|\d+[.)][ \t]+)", "")
    c = F.regexp_replace(c, r"(\*\*|__)(?=\S)(.+?)(?<=\S)\1", "$2")
    return F.regexp_replace(F.regexp_replace(c, r"(?<![\w*])\*(?=\S)([^*\n]+?)(?<=\S)\*(?![\w*])", "$1"), r"`([^`\n]+)`", "$1")


def or_sentinel(docs: DataFrame) -> DataFrame:
    """``docs``, or one placeholder document if there is none with text."""
    one = docs.sparkSession.createDataFrame([("vazio", SENTINEL)], "source string, text string")
    have = docs.filter(F.trim(F.coalesce("text", F.lit(""))) != "")
    none = have.limit(1).agg(F.count("*").alias("_n"))  # one row
    return have.unionByName(one.crossJoin(F.broadcast(none)).filter("_n = 0").drop("_n"), allowMissingColumns=True)


def count_by_extension(spark: SparkSession, folder: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.groupBy(F.lower(F.regexp_extract("path", r"(\.[^./]+)$", 1)).alias("file_ext")).agg(F.count("*").alias("files"))


def read_eval_set(spark: SparkSession, path: str) -> DataFrame:
    """(question, ground_truth array) of a CSV, JSONL or JSON file; blank questions are left out."""
    if path.endswith(".csv"):
        raw = spark.read.option("header", True).option("multiLine", True).csv(path)
        names = {"query": "question", "expected": "ground_truth"}
        raw = raw.select(*[F.col(c).alias(names.get(c, c)) for c in raw.columns])
        out = raw.select("question", F.split(F.coalesce("ground_truth", F.lit("")), r"\|\|").alias("g"))
    else:
        raw = spark.read.option("multiLine", path.endswith(".json")).json(path)
        kind = dict(raw.dtypes).get("ground_truth", "string")
        out = raw.select("question", (F.col("ground_truth") if kind.startswith("array") else F.array(F.col("ground_truth").cast("string"))).alias("g"))
    out = out.select(F.trim("question").alias("question"), F.filter(F.transform("g", lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "").alias("ground_truth"))
    out = out.filter(F.coalesce("question", F.lit("")) != "")
    if out.isEmpty():
        raise ValueError(f"no questions in {path}")
    return out


def write_events(events: DataFrame, path: str, max_bytes: int = 10 << 20, keep: int = 5) -> None:
    """Append telemetry rows as JSON lines, each stamped in UTC. A folder that holds ``max_bytes`` or more is first renamed
    to ``path.1``, that to ``path.2`` and so on; the ``keep`` youngest stay."""
    spark = events.sparkSession
    at = lambda k: spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}.{k}" if k else path)
    store = at(0).getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(at(0)) and store.getContentSummary(at(0)).getLength() >= max_bytes:
        store.delete(at(keep), True)
        for k in range(keep - 1, -1, -1):
            if store.exists(at(k)):
                store.rename(at(k), at(k + 1))
    events.withColumn("ts_iso", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")).write.mode("append").json(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """One JSON file of metrics by target."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def debug_name(question, index):
    """File name of a question's dump: its number and its first 60 characters made safe."""
    return F.concat(F.lpad(index.cast("string"), 3, "0"), F.lit("_"), F.substring(F.regexp_replace(question, r"[^a-zA-Z0-9_-]+", "_"), 1, 60), F.lit(".json"))


def dump_debug(payloads: DataFrame, path: str) -> None:
    """(query_id, question, payload) as JSON, a folder for each question's file name."""
    payloads.withColumn("file", debug_name(F.col("question"), F.col("query_id"))).write.mode("overwrite").partitionBy("file").json(path)
