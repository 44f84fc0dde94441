"""Exact top-k by inner product over norm-sorted candidates.

Components are floored to integers (floor(scale * x)). Candidates are sorted by descending
length and cut into groups of ``group`` rows. Queries first meet the longest group, which
gives each a lower bound of its k-th score; then they visit only the groups whose longest
vector could still reach it (Cauchy-Schwarz), a prefix of the groups. Queries are grouped by
length too, so that whole tiles of short queries and short candidates drop out. Within a tile of one
query group and one candidate group, candidates are taken in blocks of descending length:
vectors are rotated by the right singular vectors of a bounded sample, the inner product of
the first coordinates plus the product of the residual lengths bounds the score, and only
pairs whose bound reaches the query's k-th score so far are computed in full, in integers.
The rotation only sharpens bounds; results are exact whatever the sample.

Rows without id, vector, or with null or non-finite components take no part. Vectors of
unequal length are filled with zeros. Repeated rows are rows of their own: only the query's
own row is left out. Ties go to the smaller id. An empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import materialise
from postlode.llm.sharding import in_global_order
from postlode.llm.vectors import best, in_tiles, matrix, ranked, valid, widen

SCHEMA = "query_row long, query_id long, vec_id long, score long, theta double"
#: Integers of up to this size are exact in doubles.
EXACT = 2.0**53


def rotation(sample: np.ndarray) -> np.ndarray:
    """Right singular vectors of the sample, strongest first."""
    if not sample.size:
        return np.eye(sample.shape[1])
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1]


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products of one query and candidates, as int64 (limited to its range)."""
    limit = np.linalg.norm(q) * (np.linalg.norm(c, axis=1).max() if len(c) else 0)
    if limit < EXACT:
        return (c @ q).astype(np.int64)
    q_int = [int(x) for x in q]
    full = [sum(a * int(b) for a, b in zip(q_int, row, strict=True)) for row in c]
    return np.array([min(max(x, -(2**63)), 2**63 - 1) for x in full], dtype=np.int64)


def search_tile(q, q_rows, theta, c, c_rows, c_ids, rotate, k: int, head: int, block: int):
    """For each query (positions, scores) of its best candidates; candidates in descending length.

    ``theta``: scores that are already known to be reached k times (or -inf).
    """
    width = max(q.shape[1], c.shape[1], len(rotate))
    q, c = widen(q, width), widen(c, width)
    turn = np.eye(width)
    turn[: len(rotate), : len(rotate)] = rotate
    q_len, c_len = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    order = np.lexsort((c_ids, -c_len))
    c, c_rows, c_ids, c_len = c[order], c_rows[order], c_ids[order], c_len[order]
    q_turned, c_turned = q @ turn, c @ turn
    q_rest, c_rest = np.linalg.norm(q_turned[:, head:], axis=1), np.linalg.norm(c_turned[:, head:], axis=1)
    slack = 1e-9 * (1 + q_len.max(initial=0) * c_len.max(initial=0)) * width
    floor, found = theta.copy(), [(np.zeros(0, int), np.zeros(0, np.int64)) for _ in q]
    for at in range(0, len(c), block):
        to = min(at + block, len(c))
        live = np.flatnonzero(q_len * c_len[at] + slack >= floor)
        if not len(live):
            break
        bound = q_turned[live, :head] @ c_turned[at:to, :head].T + q_rest[live, None] * c_rest[None, at:to] + slack
        may = bound >= floor[live, None]
        may &= q_rows[live, None] != c_rows[None, at:to]
        for i, row in zip(live, may, strict=True):
            near = np.flatnonzero(row) + at
            if not len(near):
                continue
            where = np.concatenate([found[i][0], near])
            score = np.concatenate([found[i][1], exact_scores(q[i], c[near])])
            top = best(score, c_ids[where], k)
            found[i] = where[top], score[top]
            if len(top) == k:
                floor[i] = max(floor[i], float(score[top[-1]]))
    return [(order[where], score) for where, score in found]


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    scale: float = 64.0,
    group: int = 16_384,
    query_group: int = 4_096,
    sample: int = 4_096,
    head: int = 16,
    block: int = 1_024,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: each query's k highest integer inner products."""
    spark = vectors.sparkSession
    floored = valid(vectors).select("vec_id", F.transform("embedding", lambda x: x * scale).alias("v"), is_query.alias("asks"))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    ordered = in_global_order(floored.withColumn("shorter", -square), ["shorter", "vec_id"], "vectors")
    totals = sorted(ordered.groupBy("part").agg(F.count("*").alias("n")).collect())
    starts, seen = [], 0
    for t in totals:
        starts.append((t.part, seen))
        seen += t.n
    if not seen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    firsts = F.broadcast(spark.createDataFrame(starts, "part int, first long"))  # a row for each partition of the sort
    placed = ordered.join(firsts, "part").select("vec_id", "v", "asks", "shorter", (F.col("first") + F.col("pos")).alias("row"))
    held = materialise(placed.withColumn("cgroup", (F.col("row") / group).cast("int")), "vectors-ordered")
    # the longest vector of each group, one number for ``group`` rows; floored components are longer by less than one each
    longest = held.groupBy("cgroup").agg(
        F.sqrt(F.max(-F.col("shorter"))).alias("l"), F.sqrt(F.max(F.size("v")).cast("double")).alias("w"), F.count_if("asks").alias("q")
    )
    by_group = longest.orderBy("cgroup").collect()
    tops = [r.l + r.w for r in by_group]
    lengths = np.maximum.accumulate(np.array(tops)[::-1])[::-1]
    picked = held.filter(F.col("row") % max(1, seen // sample) == 0).limit(sample).select("v").toArrow()
    rotate = rotation(np.floor(matrix(picked["v"])))
    queries = held.filter("asks")
    # queries of neighbouring lengths: those of whole candidate groups, until ``query_group`` are together
    asked = np.cumsum([0, *[r.q for r in by_group[:-1]]]) // query_group
    by_length = F.element_at(F.array(*[F.lit(int(x)) for x in asked]), F.col("own") + 1)

    def tile(table: pa.Table) -> pa.Table:
        asks = table["query"].to_numpy(zero_copy_only=False)
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        rows, ids = q["row"].to_numpy(), q["vec_id"].to_numpy()
        theta = q["theta"].to_numpy()
        qv, cv = np.floor(matrix(q["v"])), np.floor(matrix(c["v"]))
        c_ids = c["vec_id"].to_numpy()
        out = search_tile(qv, rows, theta, cv, c["row"].to_numpy(), c_ids, rotate, k, head, block) if len(rows) and len(c_ids) else []
        sizes = [len(w) for w, _ in out]
        where = np.concatenate([w for w, _ in out]) if out else np.zeros(0, int)
        score = np.concatenate([s for _, s in out]) if out else np.zeros(0, np.int64)
        last = np.array([s[-1] if len(s) == k else -np.inf for _, s in out], dtype=np.float64)
        return pa.table(
            {
                "query_row": np.repeat(rows, sizes) if out else rows[:0],
                "query_id": np.repeat(ids, sizes) if out else ids[:0],
                "vec_id": c_ids[where],
                "score": score,
                "theta": np.repeat(last, sizes) if out else np.zeros(0),
            }
        )

    def visit(candidates: DataFrame, asking: DataFrame) -> DataFrame:
        dealt = in_tiles(candidates, asking, by_length)
        return dealt.groupBy("cgroup", "qgroup").applyInArrow(tile, SCHEMA)

    row = ["row", "vec_id", "v", "theta"]
    unknown = F.lit(float("-inf")).alias("theta")
    first = queries.withColumn("theta", unknown).select(*row, F.col("cgroup").alias("own"), F.array(F.lit(0)).alias("cgroups"))
    all_rows = held.withColumn("theta", unknown).select(*row, F.col("cgroup").alias("own"), "cgroup")
    seeds = materialise(visit(all_rows.filter("cgroup = 0"), first), "topk-seeds")
    if len(lengths) == 1:
        found = seeds
    else:
        reached = seeds.groupBy("query_row").agg(F.max("theta").alias("reached"))
        back = queries.join(reached, queries.row == reached.query_row, "left")
        length = F.sqrt(-F.col("shorter")) + F.sqrt(F.size("v").cast("double"))
        theta = F.coalesce("reached", F.lit(float("-inf")))
        steps = F.array(*[F.lit(float(x)) for x in lengths[1:]])
        reach = F.filter(F.sequence(F.lit(1), F.lit(len(lengths) - 1)), lambda g: length * F.element_at(steps, g) >= theta)
        rest = back.select("row", "vec_id", "v", theta.alias("theta"), F.col("cgroup").alias("own"), reach.alias("cgroups"))
        found = seeds.unionByName(visit(all_rows.filter("cgroup > 0"), rest))
    return ranked(found, ["query_row"], k).select("query_id", "rank", "vec_id", "score")
