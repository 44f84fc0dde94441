"""Centroid clustering with integer arithmetic: Lloyd rounds over kd-trees of bounded blocks.

Vectors become integers once. Each partition builds kd-trees over blocks of at most
``block`` of its vectors; a node holds its vectors' count, integer sums and bounding box. The trees are written, one row a block, and every round reads them again: at a
node, each centroid that is strictly farther than another one from every point of the box is
pruned; a node with one centroid left is assigned whole by its count and sums, and the
vectors of a leaf with several are compared exactly. A task returns one row for each
centroid and component, summed by Spark; centroids (their number is a parameter) are all that
comes to the driver.

Arithmetic is exact: doubles hold every intermediate integer while components stay below
2**22 in size; other blocks are worked in Python's unbounded integers. Components beyond
2**62 count as 2**62 of their sign. Distances and inertias are returned as long, the largest
long standing for anything above.

Vectors of another number of components, null vectors, and those with null or non-finite
components are left out. A row without id is clustered like any other but cannot be among the
first centroids, as it has no hash. Repeated rows are vectors of their own; among rows of equal
id the smaller vector comes first. Fewer hashed vectors than ``k`` make fewer centroids; none
at all gives no rows, as there is nothing to assign to. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import materialise

LONGEST = 2**63 - 1
#: Below this size of components a double holds every intermediate of a distance exactly.
EXACT = 1 << 22
MOST = 2.0**62
BLOCK_SCHEMA = "ids array<bigint>, points binary, nodes binary, boxes binary, sums binary"


def kept(vectors: DataFrame, width: int) -> DataFrame:
    """``vec_id, v`` of the rows whose vector has ``width`` finite components."""
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return rows.filter(F.coalesce(F.size("v") == width, F.lit(False)) & ~bad)


def integers(flat: np.ndarray, width: int, scale: float) -> np.ndarray:
    return np.clip(np.floor(flat.astype(np.float64) * scale), -MOST, MOST).astype(np.int64).reshape(-1, width)


def _kind(*arrays: np.ndarray) -> type:
    """The number type in which distances of these integers are exact."""
    return float if all(not a.size or max(int(a.max()), -int(a.min())) < EXACT for a in arrays) else object


@dataclass(frozen=True)
class Tree:
    """A block's vectors in tree order; node i holds rows start to stop, its halves are child and child + 1 (-1: a leaf)."""

    ids: pa.Array
    points: np.ndarray
    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sums: np.ndarray

    @classmethod
    def build(cls, ids: pa.Array, points: np.ndarray, leaf: int) -> Tree:
        order, at, nodes, boxes = np.arange(len(points)), 0, [[0, len(points), -1]], []
        while at < len(nodes):
            start, stop, _ = nodes[at]
            some = points[order[start:stop]]
            low, high = some.min(axis=0), some.max(axis=0)
            boxes.append((low, high))
            spread = high.astype(float) - low
            axis = int(spread.argmax())
            if stop - start > leaf and spread[axis] > 0:
                middle = (stop - start) // 2
                order[start:stop] = order[start:stop][np.argpartition(some[:, axis], middle)]
                nodes[at][2] = len(nodes)
                nodes += [[start, start + middle, -1], [start + middle, stop, -1]]
            at += 1
        low, high = np.array([b[0] for b in boxes]), np.array([b[1] for b in boxes])
        points, nodes = points[order], np.array(nodes, np.int64)
        return cls(ids.take(pa.array(order)), points, nodes, low, high, cls.totals(points, nodes))

    @staticmethod
    def totals(points: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Sums of every node, from running totals."""
        exact = points if _kind(points) is float else points.astype(object)
        run = np.concatenate([exact[:1] * 0, np.cumsum(exact, axis=0)])
        return run[nodes[:, 1]] - run[nodes[:, 0]]

    def packed(self) -> list:
        sums = b"" if self.sums.dtype == object else self.sums.tobytes()
        return [self.ids, self.points.tobytes(), self.nodes.tobytes(), np.stack([self.low, self.high]).tobytes(), sums]

    @classmethod
    def unpacked(cls, row: pa.RecordBatch, i: int, width: int) -> Tree:
        ids = row.column(0)[i].values
        points, nodes, boxes, sums = (np.frombuffer(row.column(c)[i].as_buffer(), np.int64) for c in range(1, 5))
        points, nodes, boxes = points.reshape(-1, width), nodes.reshape(-1, 3), boxes.reshape(2, -1, width)
        totals = sums.reshape(-1, width) if sums.size else cls.totals(points, nodes)
        return cls(ids, points, nodes, boxes[0], boxes[1], totals)

    def settle(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Nodes assigned whole and their centroids; rows of mixed leaves and theirs."""
        kind = _kind(self.points, centroids)
        c, low, high = centroids.astype(kind), self.low.astype(kind), self.high.astype(kind)
        norm = (c * c).sum(axis=1)
        near, far = centroids.astype(float), (self.low.astype(float) + self.high) / 2
        gap = (near * near).sum(axis=1) - 2 * far @ near.T
        whole, mixed = [[], []], [[], []]
        at, alive = np.zeros(1, np.int64), np.ones((1, len(c)), bool)
        while len(at):
            best = np.where(alive, gap[at], np.inf).argmin(axis=1)
            for b in np.unique(best):
                mine = np.flatnonzero(best == b)
                away = c - c[b]
                reach = high[at[mine]] @ np.maximum(away, 0).T + low[at[mine]] @ np.minimum(away, 0).T
                alive[mine] &= ~(norm - norm[b] - 2 * reach > 0).astype(bool)
            single = alive.sum(axis=1) == 1
            whole[0].append(at[single])
            whole[1].append(best[single])
            child = self.nodes[at, 2]
            end = ~single & (child < 0)
            if end.any():
                start, stop = self.nodes[at[end], 0], self.nodes[at[end], 1]
                rows = np.concatenate([np.arange(a, b) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
                open_ = np.repeat(alive[end], stop - start, axis=0)
                apart = norm - 2 * (self.points[rows].astype(kind) @ c.T)
                # the first of equal distances is the smaller number; pruned ones may not win
                mixed[0].append(rows)
                mixed[1].append(np.where(open_, apart, apart.max() + 1).argmin(axis=1))
            down = ~single & (child >= 0)
            at, alive = np.stack([child[down], child[down] + 1], axis=1).ravel(), np.repeat(alive[down], 2, axis=0)
        joined = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (*whole, *mixed)]
        return joined[0], joined[1], joined[2], joined[3]

    def add_to(self, total: np.ndarray, centroids: np.ndarray) -> None:
        """Add to ``total`` (a row for each centroid: sums of its vectors, their count) in Python integers."""
        nodes, of_node, rows, of_row = self.settle(centroids)
        some = self.points[rows]
        exact = some if _kind(some) is float else some.astype(object)
        parts = ((self.sums[nodes], self.nodes[nodes, 1] - self.nodes[nodes, 0], of_node), (exact, np.ones(len(rows), np.int64), of_row))
        for sums, count, of in parts:
            for k in np.unique(of):
                mine = of == k
                total[k, :-1] += sums[mine].sum(axis=0).astype(object)
                total[k, -1] += int(count[mine].sum())

    def assigned(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Centroid and squared distance of each vector, in tree order."""
        nodes, of_node, rows, of_row = self.settle(centroids)
        cluster = np.empty(len(self.points), np.int64)
        cluster[rows] = of_row
        for (start, stop, _), k in zip(self.nodes[nodes].tolist(), of_node.tolist(), strict=True):
            cluster[start:stop] = k
        kind = _kind(self.points, centroids)
        off = self.points.astype(kind) - centroids.astype(kind)[cluster]
        return cluster, np.minimum((off * off).sum(axis=1), float(LONGEST) if kind is float else LONGEST).astype(np.int64)

    def add_distances(self, total: np.ndarray, centroids: np.ndarray) -> None:
        """Add to ``total`` the distances of each centroid's vectors."""
        cluster, distance = self.assigned(centroids)
        np.add.at(total[:, 0], cluster, distance.astype(object))


def plant(rows: DataFrame, width: int, scale: float, block: int, leaf: int) -> DataFrame:
    """The trees of all partitions, written: one row a block."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[pa.Array, np.ndarray]] = []

        def grown() -> pa.RecordBatch:
            tree = Tree.build(pa.concat_arrays([w[0] for w in waiting]), np.concatenate([w[1] for w in waiting]), leaf)
            ids, *binary = tree.packed()
            columns = [pa.array([ids.to_pylist()], pa.list_(pa.int64())), *(pa.array([b], pa.binary()) for b in binary)]
            waiting.clear()
            return pa.RecordBatch.from_arrays(columns, names=["ids", "points", "nodes", "boxes", "sums"])

        for batch in batches:
            at = 0
            while at < batch.num_rows:
                some = batch.slice(at, block - sum(len(w[0]) for w in waiting))
                at += some.num_rows
                waiting.append((some.column(0), integers(some.column(1).flatten().to_numpy(zero_copy_only=False), width, scale)))
                if sum(len(w[0]) for w in waiting) == block:
                    yield grown()
        if waiting:
            yield grown()

    trees = rows.select(F.col("vec_id").cast("long"), "v").mapInArrow(build, BLOCK_SCHEMA)
    # small row groups, as a task decodes one at a time
    out = materialise(trees, "trees", files={"parquet.block.size": 16 << 20})
    out.width = width
    return out


def _added(trees: DataFrame, shape: tuple[int, int], add: Callable[[Tree, np.ndarray], None]) -> np.ndarray:
    """Sum over all trees of what ``add`` adds to a matrix of integers; each task sends its entries once."""
    width = trees.width

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, object)
        for batch in batches:
            for i in range(batch.num_rows):
                add(Tree.unpacked(batch, i, width), total)
        at = np.flatnonzero(total.ravel() != 0)
        values = pa.array([Decimal(x) for x in total.ravel()[at]], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), values], names=["at", "value"])

    out = np.zeros(shape[0] * shape[1], object)
    for r in trees.mapInArrow(each, "at int, value decimal(38,0)").groupBy("at").agg(F.sum("value").alias("value")).collect():
        out[r["at"]] = int(r.value)
    return out.reshape(shape)


def first_centroids(rows: DataFrame, k: int, salt: str, width: int, scale: float) -> np.ndarray:
    """Integers of the k vectors with the smallest sha256 of ``salt`` and id, in hash order."""
    h = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256).alias("h")
    chosen = rows.filter("vec_id is not null").select(h, "v").orderBy("h", "v").limit(k).toArrow()["v"]
    return integers(chosen.combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(chosen) else np.zeros(0), width, scale)


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, scale: float = 256.0, salt: str = "2:", block: int = 4_096, leaf: int = 32
) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every kept vector."""
    rows = kept(vectors, width)
    schema = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    centroids = first_centroids(rows, k, salt, width, scale)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    trees = plant(rows, width, scale, block, leaf)
    for _ in range(rounds):
        total = _added(trees, (len(centroids), width + 1), partial(Tree.add_to, centroids=centroids))
        held = total[:, -1] > 0
        means = total[:, :-1] // np.where(held, total[:, -1], 1)[:, None]
        centroids = np.where(held[:, None], means, centroids).astype(np.int64)
    sums = _added(trees, (len(centroids), 1), partial(Tree.add_distances, centroids=centroids)).ravel()
    inertia = min(LONGEST, int(sums.sum()))
    by_cluster = np.array([min(LONGEST, int(x)) for x in sums], np.int64)
    names = np.array([hashlib.sha256(",".join(map(str, row)).encode()).hexdigest() for row in centroids.tolist()])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                tree = Tree.unpacked(batch, i, width)
                of, distance = tree.assigned(centroids)
                columns = [tree.ids, pa.array(of.astype(np.int32)), pa.array(distance), pa.array(by_cluster[of])]
                columns += [pa.array(np.full(len(of), inertia)), pa.array(names[of])]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])

    return trees.mapInArrow(assign, schema)
