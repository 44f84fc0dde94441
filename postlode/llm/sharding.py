"""Contiguous shards of nearly equal bytes, cut from global prefix sums.

Only (content hash, doc_id, size, checksum) of each row move: they are range-partitioned
and sorted by content hash, so equal texts are neighbours and a hot text is split over
partitions by its ids, and by row numbers where those are equal too. Byte and row totals of
the partitions (one row each) give the partitions' offsets; the rows where the running byte
sum passes k/n of all bytes are the cuts, whatever text they fall into.

Null text counts as empty text (size 1, checksum 0). Repeated rows are rows of their own.
An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.llm.common import discard, materialise

#: Rows of one partition are numbered by the low bits of monotonically_increasing_id.
ROW_BITS = (1 << 33) - 1


def in_global_order(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """``rows`` sorted globally, with ``part`` (rising along the order) and ``pos`` (from 0) fixed in a table.

    ``rows`` are written first, with a number each that parts equal rows: range partitioning reads its input twice.
    """
    held = materialise(rows.withColumn("tie", F.monotonically_increasing_id()), f"{kind}-rows")
    ordered = held.repartitionByRange(*by, "tie").sortWithinPartitions(*by, "tie").drop("tie")
    numbered = ordered.select(
        "*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND(F.lit(ROW_BITS)).alias("pos")
    )
    out = materialise(numbered, f"{kind}-order")
    discard(held)
    return out


def _cuts(ordered: DataFrame, totals: list, shards: int) -> list[int]:
    """The global row numbers at which shards 1, 2, ... begin: a row is before a cut if its middle byte is."""
    first_byte, first_row = [0], [0]
    for t in totals:
        first_byte.append(first_byte[-1] + t.bytes)
        first_row.append(first_row[-1] + t.rows)
    targets = [first_byte[-1] * k / shards for k in range(1, shards)]
    at = [min(bisect_right(first_byte, t) - 1, len(totals) - 1) for t in targets]
    run = Window.partitionBy("part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    parts = sorted({totals[i].part for i in at})
    summed = ordered.filter(F.col("part").isin(parts)).withColumn("middle", F.sum("size").over(run) - F.col("size") / 2)
    before = [
        F.count_if((F.col("part") == totals[i].part) & (F.col("middle") <= t - first_byte[i])).alias(f"n{k}")
        for k, (t, i) in enumerate(zip(targets, at, strict=True))
    ]
    cut = summed.agg(*before).first() if before else []
    cuts = [first_row[i] + n for i, n in zip(at, cut, strict=True)]
    return [max(cuts[: k + 1]) for k in range(len(cuts))]


def shard_by_bytes(docs: DataFrame, shards: int = 8) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots are gapless from 0 in each shard."""
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("h"),
    )
    ordered = in_global_order(rows, ["h", "doc_id", "size"], "shards")
    totals = sorted(ordered.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect())
    cuts = _cuts(ordered, totals, shards) if totals else [0] * (shards - 1)
    offsets, seen = [], 0
    for t in totals:
        offsets.append((t.part, seen))
        seen += t.rows
    # one row for each partition of the sort: broadcast is bounded by the number of partitions
    starts = spark.createDataFrame(offsets, "part int, first long")
    row = F.col("first") + F.col("pos")
    shard = sum((F.when(row >= c, 1).otherwise(0) for c in cuts), F.lit(0))
    begins = F.element_at(F.array(*[F.lit(c).cast("long") for c in [0, *cuts]]), F.col("shard") + 1)
    return (
        ordered.join(F.broadcast(starts), "part")
        .withColumn("shard", shard.cast("int"))
        .select("doc_id", "size", "text_crc32", "shard", (row - begins).alias("slot"))
    )
