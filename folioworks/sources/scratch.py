"""Intermediate tables and files in the shared folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from urllib.parse import urlparse

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a local session gets one of its own; on a cluster
    that is an error, as executors don't share local folders."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "local")
        if master.partition("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioworks-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path where all executors can write."""
    return f"{shared_root(spark)}/folioworks/{name}-{uuid.uuid4().hex}"


#: Spark's own setting to delete the shuffle files of a query as it ends.
FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends here, and a lost executor costs
    nothing that was written before. What was shuffled for it is deleted once the table is written."""
    spark = df.sparkSession
    path, before = scratch_path(spark, name), spark.conf.get(FREE)
    spark.conf.set(FREE, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(FREE, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._scratch = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables made by cut that nothing will read again."""
    for table in tables:
        delete(table.sparkSession, table._scratch)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


_STORED: dict[tuple, str] = {}


def stored(spark: SparkSession, name: str, source: str, build: Callable[[str], object]) -> str:
    """The folder that build wrote something into that follows from the files of a table, source: built once in a session for
    the files as they are (names, sizes and times of change), and anew once they are others."""
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    files = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in fs.listStatus(at)))
    key = (spark.sparkContext.applicationId, shared_root(spark), name, files)
    if key not in _STORED:
        path = scratch_path(spark, name)
        build(path)
        _STORED[key] = path
    return _STORED[key]


#: Bytes of rows that Python workers are handed at a time.
BATCH_BYTES = 4_000_000


def small_batches(spark: SparkSession) -> None:
    """From here on Python workers of this session get at most some BATCH_BYTES of rows at a time (or a single row), so a
    worker's memory follows neither the rows' number nor the session's defaults. It only ever lowers the bound, and no
    result depends on it."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def _filesystem(uri: str):
    from pyarrow import fs

    parsed = urlparse(uri)
    if parsed.scheme in ("", "file"):
        return fs.LocalFileSystem(), parsed.path
    return fs.FileSystem.from_uri(uri)


def write_file(folder: str, name: str, chunks: Iterable[bytes]) -> tuple[str, int]:
    """Write chunks of bytes to folder/name by way of a name of this attempt's own; returns (uri, bytes).

    A second attempt of a task writes the same content under the same final name, so readers of the manifest
    never see a half-written file.
    """
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    final, attempt, size = f"{root}/{name}", f"{root}/.{name}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(attempt, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    fs.move(attempt, final)
    return f"{folder.rstrip('/')}/{name}", size


def open_file(uri: str, seekable: bool = False):
    """A sequential input stream of the raw bytes of a file in the shared folder, or one that reads at any place."""
    fs, path = _filesystem(uri)
    return fs.open_input_file(path) if seekable else fs.open_input_stream(path, compression=None)
