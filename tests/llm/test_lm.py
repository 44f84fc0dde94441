import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from postlode.llm import lm


def tokens(text):
    return (text or "").encode().lower().split() + ["END"]


def brute(train, texts):
    """Interpolated modified Kneser-Ney from its definition, with dictionaries."""
    uni, pairs = Counter(), Counter()
    for t in train:
        w = tokens(t)
        uni.update(w)
        pairs.update(zip(["START"] + w, w, strict=False))
    n, v = sum(uni.values()), len(uni)
    after, befores = defaultdict(list), defaultdict(set)
    for (h, w), c in pairs.items():
        after[h].append(c)
        befores[w].add(h)
    d = lm.discounts([sum(c == k for c in pairs.values()) for k in (1, 2, 3, 4)])
    cont = {w: len(h) for w, h in befores.items()}
    e = lm.discounts([sum(c == k for c in cont.values()) for k in (1, 2, 3, 4)])
    types = len(pairs)

    def single(w):
        c = cont.get(w, 0)
        rest = sum(e[min(x, 3) - 1] for x in cont.values())
        return (max(c - e[min(c, 3) - 1], 0) if c else 0) / types + rest / types / (v + 1) if types else 1 / (v + 1)

    def p(h, w):
        if h not in after:
            return single(w)
        c, total = pairs.get((h, w), 0), sum(after[h])
        g = sum(d[min(x, 3) - 1] for x in after[h]) / total
        return (max(c - d[min(c, 3) - 1], 0) if c else 0) / total + g * single(w)

    out = []
    for t in texts:
        w = tokens(t)
        base = sum(math.log10((uni[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        out.append((len(w), sum(x in uni for x in w), n, base, sum(math.log10(p(h, x)) for h, x in zip(["START"] + w, w, strict=False))))
    total = lambda h: sum(p(h, w) for w in uni) + p(h, "?")
    return out, [total(h) for h in [*list(after)[:5], "?"]]


def sample(n, seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    return [" ".join(vocab[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 40))) for _ in range(n)]


ODD = [None, "", " \t", "Unseen ÉÀ words", "w1 W1\x0bw2", "w1 " * 5000]


@pytest.mark.parametrize("at_once,keys_a_range,files", [(3_000_000, 4_000_000, 9), (50, 40, 256), (70, 9, 7)])
def test_scores_match_brute_force(spark, at_once, keys_a_range, files):
    texts = sample(150) + ODD
    df = spark.createDataFrame([(i, t, 0.5) for i, t in enumerate(texts)], "doc_id long, text string, score double")
    learn = [t for i, t in enumerate(texts) if i % 4]
    model = lm.train(df.filter("doc_id % 4 <> 0"), at_once, keys_a_range, files)
    assert len(model.pairs.files) <= files and (keys_a_range > 50 or len(model.pairs.files) > 5)
    want, totals = brute(learn, texts)
    assert all(abs(t - 1) < 1e-9 for t in totals)
    got = {r.doc_id: r for r in lm.score(df, model, at_once).collect()}
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3]
        assert math.isclose(r.base_score, w[3], rel_tol=1e-9) and math.isclose(r.score, w[4], rel_tol=1e-9), (i, r, w)


def test_nothing_to_learn_from_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    rows = lm.score(df, lm.train(df.filter("false"))).collect()
    assert [(r.score, r.base_score, r.n_known, r.train_tokens) for r in rows] == [(0.0, 0.0, 0, 0)] * 2
    empty = df.filter("false")
    assert lm.score(empty, lm.train(df)).collect() == []


def test_mixing_is_invertible_and_blocks_round_trip():
    x = np.random.default_rng(0).integers(0, 2**64, 1000, dtype=np.uint64)
    assert (lm.unmix(lm.mix(x)) == x).all()
    keys, counts = np.unique(x, return_counts=True)
    k, c = lm.unpacked(*lm.packed(keys, counts))
    assert (k == keys).all() and (c == counts).all()
