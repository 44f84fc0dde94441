"""What the two vector searches share: valid rows, tiles of queries and candidates, running top k."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def valid(vectors: DataFrame) -> DataFrame:
    """``vec_id, embedding`` of rows that have an id and a vector without null or non-finite components."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select("vec_id", F.col("embedding").cast("array<double>")).filter(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad
    )


def matrix(lists: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of numbers as a matrix; shorter rows are filled with zeros."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    width = int(sizes.max()) if len(sizes) else 0
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def widen(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


def in_tiles(candidates: DataFrame, queries: DataFrame, query_group: Column) -> DataFrame:
    """Rows of both sides dealt to tiles: ``cgroup, qgroup, query`` and the columns both sides have.

    ``candidates`` has ``cgroup``; ``queries`` has ``cgroups``, an array of the candidate groups
    it visits. A query goes to its candidate groups, a candidate to the query groups of which any query
    visits it: a tile holds at most one group of each, whatever the tables' sizes.
    """
    columns = [c for c in candidates.columns if c != "cgroup"]
    right = queries.select(*columns, query_group.cast("int").alias("qgroup"), F.explode("cgroups").alias("cgroup"))
    tiles = right.select("cgroup", "qgroup").distinct()
    left = candidates.join(tiles, "cgroup").select(*columns, "qgroup", "cgroup").withColumn("query", F.lit(False))
    return left.unionByName(right.withColumn("query", F.lit(True)))


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to smaller ids."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def ranked(found: DataFrame, query: list[str], k: int) -> DataFrame:
    """The k best of each query's rows, with ``rank`` from 1."""
    from pyspark.sql.window import Window

    order = Window.partitionBy(*query).orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
