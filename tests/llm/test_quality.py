import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import quality


def data(n=600, seed=0):
    rng = random.Random(seed)
    good, bad = [], []
    for _ in range(n):
        w = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(5, 80))]
        good.append(" ".join(w) + ".")
        kind = rng.randrange(3)
        bad.append([" ".join(x + "###" for x in w), " ".join(w[:2] * 30), " | ".join(w).upper()][kind])
    return good, bad


def docs_and_labels(spark):
    good, bad = data()
    rows = [(i, t, "en", 7.0) for i, t in enumerate(good + bad + [None, "", "x", "é" * 9, "word " * 40_000])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    labels = [(i, int(i < 600), 0) for i in range(1200) if i % 2] + [(1, 1, 0), (5, None, 0), (None, 1, 0), (99_999, 0, 0)]
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = docs_and_labels(spark)
    trees = quality.learn(docs, labels, ~quality.held_out(F.col("doc_id")))
    rows = quality.score(docs, trees).withColumn("held_out", quality.held_out(F.col("doc_id"))).collect()
    assert len(rows) == docs.count()
    held = [r for r in rows if r.held_out and r.doc_id < 1200]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.predicted == (r.doc_id < 600) for r in held) >= 0.97 * len(held) > 100
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)


def test_flat_arrays_agree_with_a_plain_walk():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((500, 6)), rng.integers(0, 2, 500).astype(float)
    y[x[:, 2] > 0.3] = 1
    t = quality.fit(x, y, trees=12, depth=3)
    for row, s in zip(x[:50], t.scores(x[:50]), strict=True):
        total = t.base
        for k in range(12):
            i = 0
            while i < 7:
                i = 2 * i + 1 + (row[t.feature[k, i]] > t.threshold[k, i])
            total += t.leaf[k, i - 7]
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12
    assert ((t.scores(x) > 0.5) == y).mean() > 0.7  # random labels on the rest: 0.69 is what any rule can expect


@pytest.mark.parametrize("labels,want", [([], 1.0), ([(0, 1, 0)], 0.75), ([(0, 0, 0)], 0.25)])
def test_few_labels(spark, labels, want):
    docs = spark.createDataFrame([(0, "a"), (1, None)], "doc_id long, text string")
    trees = quality.learn(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), F.lit(True))
    assert [r.score for r in quality.score(docs, trees).collect()] == [want] * 2
    assert quality.score(docs.filter("false"), trees).collect() == []


def test_statistics_are_finite():
    for t in (None, b"", b" ", b"\n\n", b"|", b"\x00\xff" * 10, b"A" * 100_000):
        s = quality.statistics(t)
        assert len(s) == len(quality.NAMES) and np.isfinite(s).all()


def test_statistics_against_a_plain_count():
    """Each statistic anew, character by character."""
    import math
    import re

    rng = random.Random(3)
    texts = ["", " ", "One two two.\nONE | three!\n\nOne two two.\n", "é ü\tx 12-3\r\nAB#", *("".join(rng.choice("aB1.!| \n\té#") for _ in range(rng.randint(0, 200))) for _ in range(60))]
    for text in texts:
        raw = text.encode()
        words, lines = re.findall(r"[^ \t\n\r\x0b\x0c]+", text), [x for x in text.split("\n") if re.search(r"[^ \t\n\r\x0b\x0c]", x)]
        n, w = max(1, len(raw)), max(1, len(words))
        share = lambda test: sum(map(test, raw)) / n  # noqa: B023, E731
        classes = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", " ", "\n\r", "\t\x0b\x0c"]
        known = [share(lambda b, c=c: chr(b) in c) for c in classes]
        high = share(lambda b: b > 127)
        counts = [raw.count(bytes([b])) / n for b in set(raw)]
        lower, upper, digit, mark, exclaim, pipe, space, line, tab = known
        want = {
            "log_bytes": math.log(1 + len(raw)), "log_words": math.log(1 + len(words)), "word_length": sum(len(x.encode()) for x in words) / w,
            "longest_word": min(200, max([len(x.encode()) for x in words], default=0)), "other": (len(raw) / n) - sum(known) - high, "lower": lower, "upper": upper,
            "digit": digit, "punctuation": mark, "exclamation": exclaim, "pipe": pipe, "space": space, "line": line, "tab": tab, "non_ascii": high,
            "distinct_words": len(set(words)) / w, "repeated_word": sum(words[i] == words[i + 1] for i in range(len(words) - 1)) / w,
            "repeated_second": sum(words[i] == words[i + 2] for i in range(len(words) - 2)) / w,
            "upper_words": sum(bool(re.search("[A-Z]", x)) and not re.search("[a-z]", x) for x in words) / w,
            "symbol_words": sum(not re.search("[A-Za-z0-9]$", x) for x in words) / w, "lines": math.log(1 + len(lines)),
            "line_words": w / max(1, len(lines)), "distinct_lines": len(set(lines)) / max(1, len(lines)), "entropy": -sum(p * math.log2(p) for p in counts),
        }
        got = dict(zip(quality.NAMES, quality.statistics(raw), strict=True))
        for name, value in want.items():
            assert abs(got[name] - value) < 1e-9, (name, text)


def test_fit_against_a_search_of_all_splits():
    """Every tree anew by brute force: each node's best cut among all values of all features, then its leaves."""
    rng = np.random.default_rng(4)
    x = rng.integers(0, 9, (120, 4)).astype(float)  # fewer values than bins, so that every cut can be made
    y = ((x[:, 1] > 4) ^ (x[:, 3] > 6) ^ (rng.random(120) < 0.1)).astype(float)
    depth, rate, ridge, least = 3, 0.3, 1.0, 1.0
    got = quality.fit(x, y, trees=4, depth=depth, rate=rate, bins=64, ridge=ridge, least=least)
    mean = (y.sum() + 0.5) / 121
    total = np.full(120, np.log(mean / (1 - mean)))
    for t in range(4):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        gain = lambda rows: g[rows].sum() ** 2 / (h[rows].sum() + ridge)  # noqa: B023, E731
        leaf_of = np.zeros(120, int)

        def grow(rows, heap, level):
            if level == depth:
                leaf_of[rows] = heap - (2**depth - 1)  # noqa: B023
                return
            best = 1e-9
            for f in range(4):
                for c in np.unique(x[:, f]):
                    a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
                    if h[a].sum() >= least and h[b].sum() >= least:  # noqa: B023
                        best = max(best, gain(a) + gain(b) - gain(rows))  # noqa: B023
            f, c = got.feature[t, heap], got.threshold[t, heap]  # noqa: B023
            a, b = rows[x[rows, f] <= c], rows[x[rows, f] > c]
            made = gain(a) + gain(b) - gain(rows) if len(b) else 1e-9  # noqa: B023
            assert abs(made - best) < 1e-9
            grow(a, 2 * heap + 1, level + 1)
            grow(b, 2 * heap + 2, level + 1)

        grow(np.arange(120), 0, 0)
        want = np.array([-rate * g[leaf_of == k].sum() / (h[leaf_of == k].sum() + ridge) for k in range(2**depth)])
        assert np.allclose(got.leaf[t], want)
        total = total + want[leaf_of]
    assert np.allclose(got.scores(x), 1 / (1 + np.exp(-total)))
