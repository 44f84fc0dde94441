"""Sorts, limits and row numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top(df: DataFrame, k: int, score: str = "relevance_score", tie: str = "_seq") -> DataFrame:
    """The k best rows, ties in row order: one heap a task, no full sort."""
    return df.orderBy(F.desc(score), F.asc(tie)).limit(k)


def ranked(df: DataFrame, k: int, score: str = "relevance_score", tie: str = "_seq") -> DataFrame:
    """``top`` with ``rank`` from 1."""
    best = top(df, k, score, tie)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), F.asc(tie))))


def limit_per_source(df: DataFrame, n: int, source: str = "source_platform", order: str = "_seq") -> DataFrame:
    """Each source's first n rows; tasks keep n a source before the shuffle."""
    w = Window.partitionBy(source).orderBy(order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def numbered(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Global row numbers from 0 in an order, without bringing all rows to one task.

    Rows are range-partitioned and numbered within partitions; a row a partition comes to the
    driver with its count.
    """
    spark = df.sparkSession
    low = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    # a checkpoint would pin the partitions too, but number and part come from one pass over one sort
    placed = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumns({"_part": F.spark_partition_id(), "_pos": low})
    from postlode.state import pinned

    held = pinned(placed)
    counts = sorted(held.groupBy("_part").count().collect())
    starts, seen = [], 0
    for part, n in counts:
        starts.append((part, seen))
        seen += n
    first = F.broadcast(spark.createDataFrame(starts, "_part int, _first bigint"))
    return held.join(first, "_part").withColumn(name, F.col("_first") + F.col("_pos")).drop("_part", "_pos", "_first")
