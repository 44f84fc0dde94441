import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import toxicity

CLEAN = ["ban", "tol", "mer", "sik", "vul", "dor", "fe", "lu", "né", "gra"]


def text(rng, toxic, n=None):
    words = ["".join(rng.choice(CLEAN) for _ in range(rng.randint(1, 4))) for _ in range(n or rng.randint(40, 150))]
    if toxic:
        for i in range(0, len(words), 15):
            words[i] = rng.choice(["zork" + rng.choice(CLEAN), "zork" + rng.choice(CLEAN), "idiot", "scum"])
    return " ".join(words).capitalize() + "."


def tables(spark, n=900, seed=0):
    rng = random.Random(seed)
    toxic = [rng.random() < 0.15 for _ in range(n)]
    rows = [(i, text(rng, y), "xx", 0.5, 9) for i, y in enumerate(toxic)]
    odd = [(5000, None, None, None, 1), (5001, "", "en", 0.1, 1), (None, "banana " * 9, "en", 0.1, 1), (5002, "?! \n", None, 0.2, 0)]
    odd += [(5003, "word " * 300_000, "en", 0.0, 0), (5004, "x" * 2_000_000, "en", 0.0, 0), (3, rows[3][1], "xx", 0.5, 9), (3, "other", "xx", 1.0, 1)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score double, votes int")
    labels = [(i, 1, int(y)) for i, y in enumerate(toxic) if i % 2] + [(1, 1, None), (None, 0, 1), (99_999, 1, 1)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), toxic


def test_held_out_accuracy(spark):
    docs, labels, toxic = tables(spark)
    model = toxicity.learn(docs, labels, ~toxicity.held_out(F.col("doc_id")))
    assert any(t[:1] == toxicity.PREFIX and t[1:].startswith(b"zork") for t in model.voters.of)
    rows = toxicity.score(docs, model).withColumn("held", toxicity.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held and r.doc_id is not None and r.doc_id < 900 and r.doc_id != 3]
    assert sum(r.predicted for r in held if not toxic[r.doc_id]) == 0
    assert sum(r.predicted for r in held if toxic[r.doc_id]) >= 0.95 * sum(toxic[r.doc_id] for r in held) > 20
    assert all(r.predicted == 0 for r in rows if r.doc_id is None or r.doc_id >= 5000)


def test_labels_that_may_not_be_used_change_nothing(spark):
    docs, labels, _ = tables(spark, 300, 1)
    held = toxicity.held_out(F.col("doc_id"))
    turned = labels.withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(toxicity.score(docs, toxicity.learn(docs, x, ~held)).collect(), key=repr) for x in (labels, turned))
    assert all(p.doc_id == q.doc_id and abs(p.score - q.score) < 1e-6 for p, q in zip(a, b, strict=True))


@pytest.mark.parametrize("labels", [[], [(1, 1, None)], [(0, 1, 0)], [(0, 1, 1)]])
def test_few_labels(spark, labels):
    docs, *_ = tables(spark, 60, 2)
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.score(docs, toxicity.learn(docs, known, F.lit(True))).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 for r in rows)


def test_empty_table(spark):
    docs, labels, _ = tables(spark, 20, 3)
    model = toxicity.learn(docs.filter("false"), labels, F.lit(True))
    assert toxicity.score(docs.filter("false"), model).collect() == []
    assert toxicity.score(docs, model).count() == docs.count()


def test_terms_against_counts(spark):
    rng = random.Random(5)
    rows = [(text(rng, y), y) for y in [0, 1, 0, 0] * 40] + [(None, 0), ("", 1)]
    found = toxicity.induce(spark.createDataFrame([(None if t is None else t.encode(), y) for t, y in rows], "text binary, toxic int"))
    held, n = {}, [sum(y == k for _, y in rows) for k in (0, 1)]
    for t, y in rows:
        for w in toxicity.terms(set((t or "").encode().translate(toxicity.LOWER).split())):
            held.setdefault(w, [0, 0])[y] += 1
    want = []
    for w, (c, k) in held.items():
        e = (c + 0.5) / (n[0] + 1) * n[1]
        if k >= 3 and k >= 5 * e and 2 * (k * np.log(k / e) - k + e) >= 20:
            want.append((-2 * (k * np.log(k / e) - k + e), w))
    assert found == [w for _, w in sorted(want)][:600] and len(found) > 5


def test_votes_do_not_depend_on_pieces(monkeypatch):
    voters = toxicity.Voters.of_terms([b"zork", b"^ban", b"tolmer"], 2)
    body = (text(random.Random(6), True, 400) + " You are such an IDIOT!!! f**k").encode()
    whole = voters.reader().read(body)
    monkeypatch.setattr(toxicity, "PIECE", 11)
    monkeypatch.setattr(toxicity, "REMEMBERED", 5)
    got = voters.reader().read(body)
    assert got[:2] == whole[:2] and (got[2] == whole[2]).all()
    assert whole[0] >> 2 * voters.lexicons == 0b001101  # address, masked, exclamation


def test_gates_do_not_change_what_matches():
    import re

    rng = random.Random(9)
    parts = ["You are a", "you such", "shut up", "f**k", "a!!", "!!!", "sooooo", "AAAA", "BIG BAD LOUD ROAR", "ABC", "x", "é", "\n", "#$", "ou"]
    for n in (0, 1, 2, 3, 4, *range(300)):
        t = " ".join(rng.choice(parts) for _ in range(n % 9)).encode()[: n + 1 if n < 9 else None]
        assert toxicity.matching(t) == [re.search(p, t) is not None for p in toxicity.PATTERNS.values()], t


def test_label_model_finds_accuracies_and_repeated_voters(spark):
    """Votes from known rates; voters 3 and 4 copy voter 2. Plain sums over rows give the same model."""
    rng = np.random.default_rng(7)
    y = rng.random(20_000) < 0.2
    rate = np.array([[0.02, 0.8], [0.05, 0.6], [0.1, 0.7], [0, 0], [0, 0], [0.3, 0.3]])
    bits = rng.random((len(y), 6)) < rate[:, y.astype(int)].T
    bits[:, 3] = bits[:, 4] = bits[:, 2]
    votes = bits @ (1 << np.arange(6))
    label = np.where(rng.random(len(y)) < 0.02, y, np.nan)
    rows = [(int(v), None if np.isnan(t) else float(t), 1) for v, t in zip(votes, label, strict=True)]
    patterns = spark.createDataFrame(rows, "votes long, label double, n long")
    summed = patterns.groupBy("votes", "label").agg(F.sum("n").alias("n"))
    model = toxicity.label_model(summed, 6, 0)
    # dividing the evidence of copies is no exact likelihood: within half a unit of log odds
    assert np.allclose(model.vote[:3], np.log(rate[:3, 1] / rate[:3, 0]), atol=0.5) and abs(model.vote[5]) < 0.2
    assert abs(model.prior - np.log(0.2 / 0.8)) < 0.15
    assert np.allclose(model.share[2:5], 1 / 3, atol=0.03) and model.share[0] > 0.8
    # one more round, row by row
    p = model.posterior(bits.astype(float), label.copy())
    both = np.stack([bits.T.astype(float) @ (bits * q[:, None]) for q in (1 - p, p)])
    got, weight = toxicity._expected(summed, 6, model)
    assert np.allclose(got, both) and np.allclose(weight, [(1 - p).sum(), p.sum()])


def test_linear_fit_is_at_the_minimum():
    """No small step in any direction lowers the loss much."""
    rng = np.random.default_rng(8)
    dense, hashed = rng.random((200, 4)), [np.unique(rng.integers(0, 50, 12)).astype(np.uint16) for _ in range(200)]
    y = 1 / (1 + np.exp(-(4 * dense[:, 0] - 2 + np.array([2.0 * (3 in h) for h in hashed]))))
    m = toxicity.Linear.fit(dense, hashed, y, ridge=1e-2, steps=2000, rate=0.02)

    def loss(h, d, b):
        z = b + dense @ d + np.array([h[x].sum() / len(x) ** 0.5 for x in hashed])
        return (np.logaddexp(0, z) - y * z).mean() + 5e-3 * ((h**2).sum() + (d**2).sum())

    at = loss(m.hashed, m.dense, m.bias)
    for k in range(4):
        for step in (-0.05, 0.05):
            assert loss(m.hashed, m.dense + step * (np.arange(4) == k), m.bias) > at - 1e-7
    for step in (-0.05, 0.05):
        assert loss(m.hashed + step * (np.arange(toxicity.HASHED) == 3), m.dense, m.bias) > at - 1e-7
