"""Joins: size override, unseen rows, keyed merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.classify import bucket, size_key
from postlode.functions.text import strip_white

#: A dimension given as a dict is broadcast up to this many rows; above it the planner decides.
BROADCAST_ROWS = 10_000
MERGE_KEEPS = ("id", "created_at", "job_url", "deduplication_key")


def size_dimension(spark, sizes: dict[str, str] | DataFrame) -> DataFrame:
    """``size_key, size_label``; of names with one key the last in the list holds, bare numbers become buckets."""
    if isinstance(sizes, dict):
        rows = [(i, str(k), str(v).strip()) for i, (k, v) in enumerate(sizes.items())]
        named = spark.createDataFrame(rows, "place int, name string, size string")
    else:
        named = sizes.select(F.monotonically_increasing_id().alias("place"), "name", strip_white(F.col("size")).alias("size"))
    keyed = named.withColumn("size_key", size_key(F.col("name"))).filter("size_key <> '' and size <> ''")
    last = keyed.groupBy("size_key").agg(F.max_by("size", "place").alias("size"))
    number = F.when(F.col("size").rlike("^[0-9]+$"), F.col("size").try_cast("bigint"))
    return last.select("size_key", F.when(number.isNotNull(), bucket(number)).otherwise(F.col("size")).alias("size_label"))


def with_size_override(df: DataFrame, sizes: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """``df`` with company size and source from the curated list where the company is in it."""
    sizes = lx.COMPANY_SIZES if sizes is None else sizes
    dimension = size_dimension(df.sparkSession, sizes)
    if isinstance(sizes, dict) and len(sizes) <= BROADCAST_ROWS:
        dimension = F.broadcast(dimension)
    keyed = df.withColumn("_company", size_key(F.col("company_name")))
    joined = keyed.join(dimension, keyed["_company"] == dimension["size_key"], "left")
    known = F.col("size_label").isNotNull()
    return joined.withColumns(
        {
            "company_size_source": F.when(known, "size override file").otherwise(F.col("company_size_source")),
            "company_size": F.coalesce("size_label", "company_size"),
        }
    ).drop("_company", "size_key", "size_label")


def unseen(df: DataFrame, seen: DataFrame, key: str = "deduplication_key") -> DataFrame:
    """Rows whose key is not among the seen ones; empty keys were never seen."""
    keys = seen.filter(F.col(key) != "").select(F.col(key).alias("_seen")).distinct()
    return df.join(keys, df[key] == keys["_seen"], "left_anti")


def latest_per_key(batch: DataFrame, key: str, order: str) -> DataFrame:
    """Each key's last row in the batch, but with the columns that a merge keeps from its first."""
    columns = [c for c in batch.columns if c != key]
    kept = [c for c in MERGE_KEEPS if c in columns]
    row = F.struct(*columns)
    first = F.struct(*[F.col(c) for c in kept]) if kept else F.lit(None)
    both = batch.groupBy(key).agg(F.max_by(row, order).alias("last"), F.min_by(first, order).alias("first"))
    return both.select(key, *[(F.col("first") if c in kept else F.col("last"))[c].alias(c) for c in columns])


def merge(stored: DataFrame, batch: DataFrame, key: str = "deduplication_key", order: str = "_seq") -> DataFrame:
    """Stored rows updated by the batch's last row of each key; new keys are added.

    Id, URL, key and creation time stay those of the first insert. New ids follow the largest
    stored one, by key order within the new rows.
    """
    news = latest_per_key(batch, key, order).drop(order)
    columns = [c for c in stored.columns if c != key]
    s, n = stored.alias("s"), news.alias("n")
    joined = s.join(n, F.col(f"s.{key}") == F.col(f"n.{key}"), "full_outer")
    old, new = F.col(f"s.{key}").isNotNull(), F.col(f"n.{key}").isNotNull()
    out = [F.coalesce(F.col(f"s.{key}"), F.col(f"n.{key}")).alias(key)]
    for c in columns:
        if c not in news.columns:
            out.append(F.col(f"s.{c}").alias(c))
        elif c in MERGE_KEEPS:
            out.append(F.when(old, F.col(f"s.{c}")).otherwise(F.col(f"n.{c}")).alias(c))
        else:
            out.append(F.when(new, F.col(f"n.{c}")).otherwise(F.col(f"s.{c}")).alias(c))
    return joined.select(*out).select(*stored.columns)


def with_new_ids(merged: DataFrame, key: str = "deduplication_key", last: int = 0) -> DataFrame:
    """Ids for rows that have none, after the largest one (``last`` at least), rising in key order."""
    from postlode.operators.order import numbered

    last = max(last, merged.agg(F.coalesce(F.max("id"), F.lit(0)).alias("n")).first().n)
    fresh = numbered(merged.filter("id is null"), [key], "_n").withColumn("id", (F.col("_n") + 1 + last).cast("bigint")).drop("_n")
    return merged.filter("id is not null").unionByName(fresh.select(*merged.columns))


def round_robin(left: DataFrame, right: DataFrame, left_place: str, right_place: str) -> DataFrame:
    """Each left row with the right row at its place modulo the number of right rows."""
    n = right.agg(F.count("*").alias("_n"))
    placed = left.crossJoin(F.broadcast(n)).withColumn("_p", F.pmod(F.col(left_place), F.greatest(F.col("_n"), F.lit(1))))
    return placed.join(right, placed["_p"] == right[right_place]).drop("_p", "_n")
