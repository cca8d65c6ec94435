"""The folder that driver and executors share, tables staged in it, and byte access to files there."""

from __future__ import annotations

import atexit
import ctypes
import os
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_tables: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; where that is unset and all runs on one machine (tests), a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='kelpline-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder for one run; removed when the session's program ends, or earlier with remove()."""
    path = f"{shared_dir(spark)}/kelpline/{name}-{uuid.uuid4().hex[:12]}"
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _clean() -> None:
    for spark, table in _tables:
        try:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        except Exception:  # noqa: BLE001  the session may have ended before
            pass
    for spark, path in _made:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended before
            pass


#: Rows that go to Python at a time while a table is staged. Texts may be long; what needs larger runs puts batches together.
BATCH = 1024


@contextmanager
def _small_batches(spark: SparkSession):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(BATCH, int(before)) if int(before) > 0 else BATCH))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def tidy() -> None:
    """Gives memory that a worker has freed back to the system: idle workers would hold on to it while others need it."""
    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # no glibc
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: it cuts the lineage, and what made it isn't run again."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stage_bucketed(df: DataFrame, name: str, key: str) -> DataFrame:
    """As stage(), dealt by a hash of `key` into as many buckets as shuffles have partitions: a later join or group by `key` finds the
    rows in place, and only the other side moves. The table's files are in the shared folder; its name is dropped when the session's program
    ends."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    table = f"kelpline_{name}_{uuid.uuid4().hex[:12]}"
    _tables.append((spark, table))
    with _small_batches(spark):
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(partitions(spark), key).saveAsTable(table)
    return spark.table(table)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_path(uri: str) -> str | None:
    """The plain path of a file: URI or path; None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return None if "://" in uri else uri


def write_bytes(uri: str, parts) -> int:
    """Write the byte strings of an iterator as one file: under another name first, then renamed, so that a task that is run
    again or twice leaves one whole file. Returns the size."""
    own = f"{uri}.{uuid.uuid4().hex[:8]}.tmp"
    size = 0
    if path := local_path(uri):
        temp = local_path(own)
        Path(temp).parent.mkdir(parents=True, exist_ok=True)
        with open(temp, "wb") as out:
            for x in parts:
                size += out.write(x)
        os.replace(temp, path)
        return size
    from pyarrow import fs

    store, temp = fs.FileSystem.from_uri(own)
    store.create_dir(os.path.dirname(temp), recursive=True)
    with store.open_output_stream(temp) as out:
        for x in parts:
            out.write(x)
            size += len(x)
    to = temp.removesuffix(own.removeprefix(uri))
    if store.get_file_info(to).type != fs.FileType.NotFound:
        store.delete_file(to)
    store.move(temp, to)
    return size


def read_range(uri: str, start: int, size: int) -> bytes:
    if path := local_path(uri):
        with open(path, "rb") as f:
            f.seek(start)
            return f.read(size)
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        f.seek(start)
        return f.read(size)
