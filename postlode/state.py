"""State between runs: the stored table of postings, and pinned intermediate results."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.operators.joins import merge, with_new_ids
from postlode.schema import POSTING_SCHEMA, STORED, conform


def pinned(df: DataFrame) -> DataFrame:
    """``df`` computed and cut from its lineage by a checkpoint in the shared folder.

    The folder is spark.checkpoint.dir. Where the session names none, a local master (tests) gets a temporary one;
    on a cluster that is an error, as executors do not share such a folder.
    """
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="postlode-"))
    return df.checkpoint()


def scratch(spark: SparkSession, kind: str) -> str:
    """A fresh folder in the shared one."""
    pinned(spark.range(0))  # names the shared folder, if nothing has
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{kind}-{uuid.uuid4().hex}"


#: Scores of one band of files.
BAND = 10


class PostingTable:
    """Stored postings by key, as Parquet under one folder.

    Rows lie in buckets by a hash of their key, and in each by bands of score. A write makes
    new files for the buckets that it touches, in a folder of its own, then a manifest (each bucket's
    version, and the largest id), and then moves the pointer to it; files of other buckets stay as they are.
    Readers of the old manifest are not disturbed, and a failed write leaves the table as it was. The number of
    buckets is fixed by the first write; choose it so that a bucket fits a few tasks.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _pointers(self) -> list[str]:
        at = self._path(f"{self.folder}/current")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def manifest(self) -> tuple[dict[int, str], int, int]:
        """Each bucket's version, the largest id given, and the number of buckets."""
        found = self._pointers()
        if not found:
            return {}, 0, self.buckets
        rows = self.spark.read.parquet(f"{self.folder}/manifest-{found[-1].split('-', 1)[1]}").collect()
        return {r.bucket: r.version for r in rows if r.bucket >= 0}, max(r.last_id for r in rows), max(r.buckets for r in rows)

    def _stored(self, only: list[int] | None = None) -> DataFrame:
        """Rows of all or ``only`` some buckets, with ``_bucket`` and ``_band``."""
        held = self.manifest()[0]
        paths = [f"{self.folder}/rows/version={v}/_bucket={b}" for b, v in sorted(held.items()) if only is None or b in only]
        if not paths:
            return self.spark.createDataFrame([], POSTING_SCHEMA).select(*STORED, F.lit(0).alias("_bucket"), F.lit(0).alias("_band"))
        return self.spark.read.option("basePath", f"{self.folder}/rows").parquet(*paths).drop("version")

    def read(self) -> DataFrame:
        """All stored rows; columns that are not stored come back as defaults."""
        return conform(self._stored().drop("_bucket", "_band"))

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Put ``rows`` (all of the buckets ``touched``) in these buckets' place."""
        held, last, buckets = self.manifest()
        version, before = uuid.uuid4().hex, self._pointers()
        band = F.floor(F.coalesce("relevance_score", F.lit(0)) / BAND).cast("int")
        placed = rows.select(*STORED, bucket_of("deduplication_key", buckets).alias("_bucket"), band.alias("_band"))
        ordered = placed.repartition("_bucket").sortWithinPartitions("_bucket", "_band", F.desc("relevance_score"))
        ordered.write.partitionBy("_bucket", "_band").parquet(f"{self.folder}/rows/version={version}")
        root = self._path(f"{self.folder}/rows/version={version}")
        made = {int(n.split("=")[1]) for n in (s.getPath().getName() for s in self._fs.listStatus(root)) if n.startswith("_bucket=")}
        now = {b: v for b, v in held.items() if b not in touched} | dict.fromkeys(made, version)
        top = rows.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        lines = [(-1, "", max(last, top), buckets), *((b, v, 0, buckets) for b, v in now.items())]
        self.spark.createDataFrame(lines, "bucket int, version string, last_id long, buckets int").coalesce(1).write.parquet(f"{self.folder}/manifest-{version}")
        number = int(before[-1].split("-")[0]) + 1 if before else 0
        self._fs.mkdirs(self._path(f"{self.folder}/current/{number:012d}-{version}"))

    def known_keys(self) -> DataFrame:
        return self.read().filter("deduplication_key <> ''").select("deduplication_key").distinct()

    def at_least(self, score: int = 0) -> DataFrame:
        """Rows of at least this score, best and then latest first; lower bands' files are not read."""
        some = self._stored().filter((F.col("_band") >= score // BAND) & (F.col("relevance_score") >= score))
        return conform(some.drop("_bucket", "_band")).orderBy(F.desc("relevance_score"), F.desc("date_found"))

    def upsert(self, batch: DataFrame, order: str = "_seq") -> None:
        """Merge a batch (row columns and an order column) into the table; only the buckets of its keys are read and written."""
        batch = pinned(batch.select(*STORED, order))
        _, last, buckets = self.manifest()
        touched = [r[0] for r in batch.select(bucket_of("deduplication_key", buckets)).distinct().collect()]
        merged = merge(self._stored(touched).select(*STORED), batch, order=order)
        self._replace(pinned(with_new_ids(merged, last=last)), touched)

    def set_status(self, row: int, status: str) -> None:
        """Set a row's status; only the row's bucket is written."""
        touched = [r[0] for r in self._stored().filter(F.col("id") == row).select("_bucket").distinct().collect()]
        if touched:
            changed = F.when(F.col("id") == row, F.lit(status)).otherwise(F.col("application_status"))
            self._replace(pinned(self._stored(touched).withColumn("application_status", changed).select(*STORED)), touched)


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(F.col(key), F.lit(""))), F.lit(buckets)).cast("int")
