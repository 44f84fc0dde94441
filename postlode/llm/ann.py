"""Approximate nearest neighbours by a hash-prefix forest.

Candidates are dealt by hash to shards of about ``shard`` rows. In a shard each of ``trees``
trees is the sorted array of its candidates' long hash strings (sign bits of random
projections, 32 of them). A query descends in every tree by binary search to its longest
prefix match and then ascends all trees at once, level by level, each step taking all
entries that share the shorter prefix; what is met is compared by exact cosine, in double
precision. Every row is in every tree; nothing is fitted but a seed and the mean of a bounded
sample.

A query stops when it has probably met all that is nearer than its k-th best so far: a
vector at that angle agrees with the query in a bit with probability p = 1 - angle / pi, so
it shares no prefix of l bits in any of t trees with probability (1 - p**l)**t. The ascent goes
on, the last level tree by tree, until that is at most 1 - ``recall``. So clustered data end after
few candidates and independent isotropic vectors, where nothing separates neighbours well,
after many; no share or number of candidates is set. ``README`` has measured recall.

Every query visits every shard, so a tile of one query group and one shard bounds memory,
and the shards' best are merged by query.

Rows without id or vector, zero vectors, and those with null or non-finite components take no
part. Vectors of unequal length are filled with zeros. Repeated rows are rows of their own:
only the query's own row is left out. Ties go to the smaller id. An empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import materialise
from postlode.llm.vectors import best, in_tiles, matrix, ranked, valid, widen

BITS = 32


def hashes(v: np.ndarray, planes: np.ndarray, step: int = 2_048) -> np.ndarray:
    """Hash strings of the rows, one a tree, as unsigned numbers: (trees, rows)."""
    trees = planes.shape[1] // BITS
    out = np.empty((len(v), trees), np.uint32)
    for at in range(0, len(v), step):
        bits = v[at : at + step].astype(np.float32) @ planes > 0
        out[at : at + step] = np.packbits(bits.reshape(-1, trees, BITS), axis=2, bitorder="big").view(">u4")[:, :, 0]
    return np.ascontiguousarray(out.T)


class Forest:
    """Sorted arrays of hash strings over the rows of one shard, one a tree, laid end to end: the tree's number leads each string."""

    def __init__(self, codes: np.ndarray):
        self.trees, self.size = codes.shape
        order = np.argsort(codes, axis=1, kind="stable")
        self.lead = np.arange(self.trees, dtype=np.uint64) << np.uint64(BITS)
        self.flat = (np.take_along_axis(codes, order, axis=1).astype(np.uint64) | self.lead[:, None]).ravel()
        self.order = order.astype(np.int32).ravel()

    def sharing(self, code: np.ndarray, level: int) -> list[np.ndarray]:
        """For each of the first ``len(code)`` trees the rows that share the first ``level`` bits of the query's string there."""
        string, mask = code.astype(np.uint64) | self.lead[: len(code)], np.uint64((1 << BITS - level) - 1)
        low, high = self.flat.searchsorted(string & ~mask), self.flat.searchsorted(string | mask, "right")
        return [self.order[a:b] for a, b in zip(low.tolist(), high.tolist(), strict=True)]

    def deepest(self, code: np.ndarray) -> int:
        """Bits of a query's longest prefix match in any tree: its neighbours in sorted order."""
        string = code.astype(np.uint64) | self.lead
        at = self.flat.searchsorted(string)
        first = np.arange(self.trees) * self.size
        near = np.stack([np.maximum(at - 1, first), np.minimum(at, first + self.size - 1)])
        differ = int((self.flat[near] ^ string).min())
        return BITS - min(differ.bit_length(), BITS)

    def ascend(self, code: np.ndarray, near, k: int, miss: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows that a query meets, and their scores by ``near(rows)`` (-inf: not a candidate); ``miss``: the probability to end at."""
        met, score, best, level = np.zeros(self.size, bool), np.full(self.size, -np.inf), -1.0, self.deepest(code)

        def take(rows: list[np.ndarray]) -> None:
            nonlocal best
            new = np.zeros(self.size, bool)
            new[np.concatenate(rows)] = True
            some = np.flatnonzero(new & ~met)
            met[some], score[some] = True, near(some)
            known = score[met]
            if len(known) >= k:
                best = max(best, float(np.partition(known, len(known) - k)[len(known) - k]))

        take(self.sharing(code, level))
        while level:
            p = 1 - np.arccos(np.clip(best, -1, 1)) / np.pi
            # log probability that one tree's prefix of so many bits misses
            alone = np.log1p(-np.minimum(p ** np.arange(level + 1), 1 - 1e-12))
            if self.trees * alone[level] <= np.log(miss):
                break
            last = int(np.searchsorted(self.trees * alone[: level + 1], np.log(miss), "right")) - 1
            if level - last > 2:  # far to go: what the next levels bring may shorten the way
                level = (level + last) // 2
                take(self.sharing(code, level))
                continue
            level -= 1
            # trees that must go up this level so that (1 - p**(level + 1))**(others) * (1 - p**level)**(those) is small enough
            gain = alone[level] - alone[level + 1]
            more = int(min(np.ceil((np.log(miss) - self.trees * alone[level + 1]) / gain), self.trees)) if gain < 0 else self.trees
            take(self.sharing(code[: max(more, 1)], level))
            if more < self.trees:
                break
        rows = np.flatnonzero(met & (score > -np.inf))
        return rows, score[rows]


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    trees: int = 128,
    recall: float = 0.95,
    shard: int = 16_384,
    query_group: int = 1_024,
    sample: int = 4_096,
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest by cosine that were found for each query."""
    spark = vectors.sparkSession
    some = F.exists("embedding", lambda x: x != 0)
    rows = valid(vectors).filter(some).select("vec_id", F.col("embedding").alias("v"), is_query.alias("asks"))
    held = materialise(rows.withColumn("row", F.monotonically_increasing_id()), "ann-rows")
    counted = held.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.max(F.size("v")).alias("w")).first()
    if not counted.n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    width = counted.w
    by_hash = F.xxhash64("row")
    picked = held.select("v", by_hash.alias("h")).filter(F.pmod("h", F.lit(max(1, counted.n // sample))) == 0)
    picked = widen(matrix(picked.limit(sample).select("v").toArrow()["v"]), width)
    mean = picked.mean(axis=0) if len(picked) else np.zeros(width)
    groups, qgroups = -(-counted.n // shard), max(1, -(-counted.q // query_group))

    def tile(table: pa.Table) -> pa.Table:
        asks = table["query"].to_numpy(zero_copy_only=False)
        q, c = table.filter(pa.array(asks)), table.filter(pa.array(~asks))
        rows, ids, c_rows, c_ids = (x.to_numpy() for x in (q["row"], q["vec_id"], c["row"], c["vec_id"]))
        got: list[list[np.ndarray]] = [[], [], [], []]
        if len(rows) and len(c_ids):
            qv, cv = widen(matrix(q["v"]), width), widen(matrix(c["v"]), width)
            qn = qv / np.abs(qv).max(axis=1, keepdims=True)
            cn = cv / np.abs(cv).max(axis=1, keepdims=True)
            qn, cn = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (qn, cn))
            planes = np.random.default_rng(seed).standard_normal((width, trees * BITS), np.float32)
            centre = mean / max(float(np.linalg.norm(mean)), 1e-300) * min(1.0, float(np.linalg.norm(mean)))
            forest, codes = Forest(hashes(cn - centre, planes)), hashes(qn - centre, planes)
            for i in range(len(rows)):
                near = lambda some: np.where(c_rows[some] != rows[i], cn[some] @ qn[i], -np.inf)  # noqa: B023
                met, score = forest.ascend(codes[:, i], near, k, 1 - recall)
                top = best(score, c_ids[met], k)
                for column, value in zip(got, (np.full(len(top), rows[i]), np.full(len(top), ids[i]), c_ids[met[top]], score[top]), strict=True):
                    column.append(value)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        flat = [np.concatenate(x).astype(t) if x else np.zeros(0, t) for x, t in zip(got, kinds, strict=True)]
        return pa.table(dict(zip(("query_row", "query_id", "vec_id", "score"), flat, strict=True)))

    candidates = held.select("row", "vec_id", "v", F.pmod(by_hash, F.lit(groups)).cast("int").alias("cgroup"))
    every = F.sequence(F.lit(0), F.lit(int(groups) - 1))
    asking = held.filter("asks").select("row", "vec_id", "v", every.alias("cgroups"))
    dealt = in_tiles(candidates, asking, F.pmod(F.xxhash64(F.lit(1), "row"), F.lit(qgroups)))
    found = dealt.groupBy("cgroup", "qgroup").applyInArrow(tile, "query_row long, query_id long, vec_id long, score double")
    return ranked(found, ["query_row"], k).select("query_id", "rank", "vec_id", "score")
