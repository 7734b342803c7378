"""Tables in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, label: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Where that is unset, a local master gets a temporary folder; a cluster is
    refused, as its executors don't share one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corvane/{label}-{uuid.uuid4().hex}"


def write_bytes(path: str, data: bytes) -> None:
    """A small file of the driver's in shared storage."""
    store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with store.open_output_stream(name, compression=None) as out:
        out.write(data)


def read_bytes(path: str) -> bytes:
    store, name = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
    with store.open_input_file(name) as f:
        return f.read()


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write a result and read it back: what comes after plans on a plain table, and a lost executor loses nothing."""
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *by: str) -> DataFrame:
    """``df`` over as many tasks as a shuffle has. Spark joins small partitions of its own shuffles by their bytes; rows that
    are few but take long to work on are better dealt by a stated number."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, none if it isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in store.listStatus(at)] if store.exists(at) else []


def state_of(spark: SparkSession, path: str) -> tuple[int, int, int]:
    """Bytes, files and time of last change of a file or folder: a table that was replaced has another state."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark._jsc.hadoopConfiguration())
    held = store.getContentSummary(at)
    return held.getLength(), held.getFileCount(), store.getFileStatus(at).getModificationTime()


#: Called when the shared folder is cleared, by those who remember paths in it.
ON_CLEAR: list[Callable[[], None]] = []


def clear(spark: SparkSession) -> None:
    """Delete all that this package has written to the shared folder; results not yet read are lost with it."""
    for forget in ON_CLEAR:
        forget()
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{base.rstrip('/')}/corvane")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
