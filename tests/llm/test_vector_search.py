import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import ann, topk

ODD = [
    (9900, None),
    (9901, []),
    (9902, [1.0, None] + [0.0] * 14),
    (9903, [float("nan")] * 16),
    (9904, [float("inf")] * 16),
    (None, [1.0] * 16),
    (9905, [0.0] * 16),
    (9920, [0.0] * 16),
    (9906, [0.5] * 7),
]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 3) for i, v in rows], "vec_id long, embedding array<float>, score int")


def rows_of(seed, n=400, width=16):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, width)) * rng.uniform(0.1, 3, (n, 1))
    x[50:90] = x[10]  # ties
    return [(i, [float(np.float32(y)) for y in v]) for i, v in enumerate(x)]


def padded(rows, scale):
    keep = [(i, v) for i, v in rows if i is not None and v is not None and all(y is not None and np.isfinite(y) for y in v)]
    width = max(len(v) for _, v in keep)
    return [(i, np.array([*v, *[0.0] * (width - len(v))]) if not scale else np.floor(64 * np.array([*v, *[0.0] * (width - len(v))]))) for i, v in keep]


@pytest.mark.parametrize("seed,group,query_group", [(1, 16_384, 4_096), (2, 37, 8), (3, 100, 3)])
def test_top_k_is_exact(spark, seed, group, query_group):
    rows = rows_of(seed) + ODD + [(40, rows_of(seed)[7][1])]
    all_ = padded(rows, True)
    want = []
    for at, (i, q) in enumerate(all_):
        if i % 20 == 0:
            got = sorted((-int(q @ c), j) for k, (j, c) in enumerate(all_) if k != at)[:20]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(got)]
    out = topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, group=group, query_group=query_group, block=32, head=4)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_top_k_large_integers(spark):
    rows = [(i, [float(np.float32(x)) for x in (1e9 + 7e3 * i, -3e8, 5.0 + i)]) for i in range(25)]
    out = topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    whole = [[int(np.floor(64 * np.float64(np.float32(x)))) for x in v] for _, v in rows]
    for r in out:
        assert r.score == min(2**63 - 1, sum(a * b for a, b in zip(whole[r.query_id], whole[r.vec_id], strict=True)))


@pytest.mark.parametrize("rows", [[], [(0, [1.0, 2.0])], [(1, [1.0]), (2, [2.0])], [(20, [1.0]), (2, [2.0])]])
def test_small_tables(spark, rows):
    top = topk.top_k(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    near = ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0).collect()
    assert len(top) == len(near) == (1 if rows and rows[0][0] == 20 else 0)


def test_bounds_prune(spark):
    rng = np.random.default_rng(0)
    c = np.floor(64 * rng.standard_normal((4000, 32)) * np.linspace(3, 0.01, 32))
    seen = []
    keep = topk.exact_scores
    topk.exact_scores = lambda q, x: (seen.append(len(x)), keep(q, x))[1]
    try:
        ids = np.arange(4000)
        topk.search_tile(c[:20], ids[:20], np.full(20, -np.inf), c, ids, ids, topk.rotation(c), 10, 8, 256)
    finally:
        topk.exact_scores = keep
    assert sum(seen) < 20 * 4000 / 3


@pytest.mark.parametrize("shard", [8_192, 150])
def test_nearest_recall_and_scores(spark, shard):
    rows = rows_of(5, 1200) + ODD
    all_ = [(i, v) for i, v in padded(rows, False) if np.any(v)]
    ids, x = [i for i, _ in all_], np.array([v for _, v in all_])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=shard).collect()
    got = {}
    for r in out:
        assert abs(r.score - x[ids.index(r.query_id)] @ x[ids.index(r.vec_id)]) < 1e-12
        got.setdefault(r.query_id, []).append(r)
    hit = total = 0
    for q, some in got.items():
        some.sort(key=lambda r: r.rank)
        assert [r.rank for r in some] == [1, 2, 3, 4, 5] and q not in [r.vec_id for r in some]
        assert all((-a.score, a.vec_id) < (-b.score, b.vec_id) for a, b in zip(some, some[1:], strict=False))
        at = ids.index(q)
        best = sorted((-s, j) for k, (s, j) in enumerate(zip(x @ x[at], ids, strict=True)) if k != at)[:5]
        hit += sum(r.score >= -best[-1][0] - 1e-12 for r in some)
        total += 5
    assert len(got) == sum(i % 50 == 0 for i in ids) and hit / total >= 0.9
    again = ann.nearest(table(spark, rows), F.col("vec_id") % 50 == 0, shard=shard).collect()
    assert sorted(out) == sorted(again)


def shared_bits(a, b):
    return 32 - (int(a) ^ int(b)).bit_length()


def test_forest_finds_prefixes():
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 2**32, (4, 300), dtype=np.uint32)
    forest = ann.Forest(codes)
    for q in [*codes[:, :10].T, *rng.integers(0, 2**32, (10, 4), dtype=np.uint32)]:
        bits = np.array([[shared_bits(a, b) for a in tree] for tree, b in zip(codes, q, strict=True)])
        assert forest.deepest(q) == bits.max()
        for level in (0, 1, 5, 9, 32):
            got = forest.sharing(q, level)
            assert all(sorted(g) == np.flatnonzero(row >= level).tolist() for g, row in zip(got, bits, strict=True))


@pytest.mark.parametrize("miss", [0.5, 0.05, 1e-9])
def test_ascent_goes_on_until_a_miss_is_unlikely(miss):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((400, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    planes = rng.standard_normal((24, 6 * ann.BITS), np.float32)
    codes = ann.hashes(x, planes)
    forest = ann.Forest(codes)
    for q in range(12):
        near = lambda rows: np.where(rows != q, x[rows] @ x[q], -np.inf)  # noqa: B023, E731
        met, score = forest.ascend(codes[:, q], near, 5, miss)
        assert np.allclose(score, x[met] @ x[q]) and q not in met and len(met) >= 5
        p = 1 - np.arccos(np.sort(score)[-5]) / np.pi
        bits = np.array([[shared_bits(a, b) for a in tree] for tree, b in zip(codes, codes[:, q], strict=True)])
        # the levels that every tree has been searched down to: nothing that shares more was left out
        left = np.ones(400, bool)
        left[met] = left[q] = False
        level = [int(b[left].max(initial=-1)) + 1 for b in bits]
        assert np.prod([1 - p**n for n in level]) <= miss or not left.any()


def test_recall_on_clustered_and_isotropic_vectors(spark):
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((40, 32))
    for x in (rng.standard_normal((2500, 32)), centres[rng.integers(0, 40, 2500)] + 0.3 * rng.standard_normal((2500, 32))):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        df = spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        found = {}
        for r in ann.nearest(df, F.col("vec_id") % 50 == 0).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = sum(len(found[q] & {j for j in np.argsort(-(u @ u[q]))[:6] if j != q}) for q in range(0, 2500, 50))
        assert hits >= 0.9 * 250
