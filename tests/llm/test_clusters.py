import hashlib
import random

import numpy as np
import pytest

from postlode.llm import clusters


def brute(rows, k, rounds, width, scale):
    """Lloyd's rounds in Python integers, row by row."""
    whole = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [max(-(2**62), min(2**62, x)) for x in v]) for i, v in whole]
    first = sorted((hashlib.sha256(f"2:{i}".encode()).hexdigest(), v) for i, v in whole if i is not None)[:k]
    c = [v for _, v in first]
    if not c:
        return []

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in c]
        return min(range(len(c)), key=lambda n: (d[n], n)), min(d)

    for _ in range(rounds):
        of = [near(v)[0] for _, v in whole]
        for n in range(len(c)):
            mine = [v for o, (_, v) in zip(of, whole, strict=True) if o == n]
            if mine:
                c[n] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    found = [(i, *near(v)) for i, v in whole]
    top = 2**63 - 1
    found = [(i, n, min(d, top)) for i, n, d in found]
    total = {n: min(top, sum(d for _, m, d in found if m == n)) for n in range(len(c))}
    names = [hashlib.sha256(",".join(map(str, m)).encode()).hexdigest() for m in c]
    return [(i, n, d, total[n], min(top, sum(x for _, _, x in found)), names[n]) for i, n, d in found]


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


def table(spark, rows):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], 1, "y") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, cluster int, v string")


def clustered(seed, n, width, centres):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((centres, width)) * 3
    x = at[rng.integers(0, centres, n)] + rng.standard_normal((n, width)) * 0.05
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


ODD = [(900, None), (901, []), (902, [1.0, None, 0.5]), (903, [float("nan")] * 3), (904, [float("-inf")] * 3), (905, [1.0] * 4), (None, [0.5, 0.5, -0.5])]


@pytest.mark.parametrize("seed,n,k,block,leaf", [(1, 300, 7, 4096, 32), (2, 301, 12, 50, 4), (3, 40, 40, 16, 1), (4, 5, 40, 8, 2)])
def test_equals_plain_rounds(spark, seed, n, k, block, leaf):
    rng = random.Random(seed)
    rows = clustered(seed, n, 3, 5) + ODD
    rows += [(1000 + i, [rng.choice([-1.0, 0.0, 1.0]) for _ in range(3)]) for i in range(60)]  # ties between centroids
    rows += [(3, rows[3][1])] * 5 + [(7, [9.0, 9.0, 9.0])]  # repeated rows and ids
    got = clusters.cluster(table(spark, rows).repartition(3), k=k, rounds=5, width=3, block=block, leaf=leaf)
    assert order(map(tuple, got.collect())) == order(brute([(i, None if v is None else v) for i, v in rows], k, 5, 3, 256.0))


def test_integers_beyond_doubles(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e9 + 7e3 * i, -3e8, 5.0 + i)]) for i in range(25)]
    rows += [(50, [3e38, -3e38, 1.0]), (51, [3e38, 0.0, 0.0])]
    got = clusters.cluster(table(spark, rows), k=6, width=3, block=10, leaf=2)
    assert order(map(tuple, got.collect())) == order(brute(rows, 6, 5, 3, 256.0))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0])], [(None, [1.0, 2.0, 3.0])]])
def test_nothing_to_start_from(spark, rows):
    assert clusters.cluster(table(spark, rows), k=4, width=3).collect() == []


def test_one_vector_and_all_equal(spark):
    for rows in ([(1, [1.0, 2.0, 3.0])], [(i, [1.0, 2.0, 3.0]) for i in range(200)]):
        got = clusters.cluster(table(spark, rows), k=4, width=3, block=64, leaf=8)
        assert order(map(tuple, got.collect())) == order(brute(rows, 4, 5, 3, 256.0))


def test_whole_nodes_are_assigned_and_centroids_pruned():
    """On clustered vectors most of a tree never comes to its leaves."""
    rows = clustered(5, 2000, 8, 6)
    points = clusters.integers(np.array([v for _, v in rows]).ravel(), 8, 256.0)
    import pyarrow as pa

    tree = clusters.Tree.build(pa.array([i for i, _ in rows], pa.int64()), points, 16)
    centroids = points[[0, 1, 2, 3, 5, 8, 13]]
    nodes, of_node, mixed, of_row = tree.settle(centroids)
    size = tree.nodes[nodes, 1] - tree.nodes[nodes, 0]
    assert size.sum() + len(mixed) == 2000 and size.max() > 16
    cluster, distance = tree.assigned(centroids)
    apart = ((tree.points[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (cluster == apart.argmin(axis=1)).all() and (distance == apart.min(axis=1)).all()
    total = np.zeros((7, 9), object)
    tree.add_to(total, centroids)
    for k in range(7):
        assert list(total[k]) == [*tree.points[cluster == k].sum(axis=0), (cluster == k).sum()]
