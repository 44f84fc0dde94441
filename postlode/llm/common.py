"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and tab to carriage return.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def crc_bucket(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null id: null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, named by spark.checkpoint.dir.

    Where the session names none, a local master (tests) gets a temporary folder; on a cluster
    that is an error, as executors do not share such a folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not named:
        own = sc.getCheckpointDir()
        if not own:
            if not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            own = "file://" + tempfile.mkdtemp(prefix="postlode-shared-")
            sc.setCheckpointDir(own)
        return own.rstrip("/")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, uri: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(uri)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session may be gone at interpreter exit; the folder is then the cluster's to sweep
        pass


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder under the shared one, deleted when the driver ends."""
    uri = f"{shared_folder(spark)}/postlode-{kind}-{uuid.uuid4().hex}"
    atexit.register(_delete, spark, uri)
    return uri


def materialise(df: DataFrame, kind: str, rows: int | None = None, files: dict | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts lineage so that lost executors cost only the tasks that they ran, and
    pins columns such as partition numbers that a recomputation could change.

    ``rows``: about how many narrow rows there are at most; they are written in as few files as a million a
    file makes, since each file costs a task, and where the store is a local file system without native code also
    several processes that the executor forks to set permissions.
    ``files``: options of the Parquet writer.
    """
    spark = df.sparkSession
    uri = new_folder(spark, kind)
    if rows is not None:
        df = df.coalesce(1 + rows // 1_000_000)
    df.write.options(**files or {}).parquet(uri)
    out = spark.read.schema(df.schema).parquet(uri)
    out.stored_at = uri
    return out


def discard(*written: DataFrame) -> None:
    """Delete tables of ``materialise`` that no later plan reads."""
    for df in written:
        _delete(df.sparkSession, df.stored_at)


def bounded_batches(df: DataFrame, rows: int = 2_000) -> DataFrame:
    """``df``, whose session passes at most ``rows`` rows at once to Python workers from now on.

    A batch lies in the executor's memory outside the heap and again in the worker's; with the default of
    10,000 rows, texts make it tens of megabytes and more.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, rows)
    return df


def partition_number() -> int:
    return TaskContext.get().partitionId()


def local_path(uri: str) -> str | None:
    """The path behind a file: address, None for any other store."""
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if uri.startswith("/") else None


def open_store(uri: str):
    """(pyarrow file system, path) of an address in any store that pyarrow knows."""
    from pyarrow import fs

    here = local_path(uri)
    return (fs.LocalFileSystem(), here) if here else fs.FileSystem.from_uri(uri)


def rows_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
