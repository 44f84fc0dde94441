import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from postlode.llm import resampling


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower)


def features_of(text):
    w = words_of(text)
    return w + [" ".join(p) for p in zip(w, w[1:], strict=False)]


def brute(docs, targets, buckets=10_000, least=20, percent=25):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for of, texts in ((s, [x for _, x in docs]), (t, targets)):
        for text in texts:
            for f in features_of(text):
                of[bucket(f)] += 1
    total, wanted = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((b + 1) * (total + buckets) / ((a + 1) * (wanted + buckets)))) for a, b in zip(s, t, strict=True)]
    rows = []
    for i, text in docs:
        f = features_of(text)
        weight = sum(gain[bucket(x)] for x in f) // len(f) if f else 0
        h = None if i is None else int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([i, len(words_of(text)), len(f), weight, score, None])
    able = sorted((r for r in rows if r[0] is not None and r[1] >= least), key=lambda r: (-r[4], r[0], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return sorted(map(tuple, rows), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, t, 7, 1.5) for i, t in rows], "doc_id long, text string, rank int, weight double")


def texts(spark, rows):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(rows)], "item_id long, text string, n_words int")


def made(seed, n):
    rng = random.Random(seed)
    word = lambda: rng.choice(["red", "Blue", "grün", "x9", "日本", "don't", "A", "ÄÖ", "end."]) + rng.choice(["", "", "s", "7"])
    return [" ".join(word() for _ in range(rng.randint(0, 60))) + rng.choice(["", "\n", " -- "]) for _ in range(n)]


ODD = [(None, "no id " * 20), (None, None), (5000, None), (5001, ""), (5002, "--- ..."), (5003, "one"), (5004, "é" * 3000), (5005, "w " * 30_000)]


@pytest.mark.parametrize("seed,buckets", [(1, 10_000), (2, 17), (3, 1)])
def test_equals_brute_force(spark, seed, buckets, monkeypatch):
    docs = list(enumerate(made(seed, 120))) + ODD
    docs += [(3, docs[3][1])] * 4 + [(3, docs[8][1])] + [(6000 + i, docs[20][1]) for i in range(50)]
    targets = [*made(seed + 9, 15), None, ""]
    got = resampling.resample(table(spark, docs).repartition(3), texts(spark, targets), buckets=buckets).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, targets, buckets)


def test_pieces_of_long_texts_join(monkeypatch):
    text = " ".join(made(4, 50)).encode()
    whole = resampling.counts(text, 997)
    for piece in (1, 7, 64):
        monkeypatch.setattr(resampling, "PIECE", piece)
        n, columns, entries = resampling.counts(text, 997)
        assert n == whole[0] and (columns == whole[1]).all() and (entries == whole[2]).all()


def test_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(resampling, "ROWS", 3)
    docs, targets = list(enumerate(made(5, 40))), made(6, 5)
    got = resampling.resample(table(spark, docs), texts(spark, targets)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, targets)


@pytest.mark.parametrize("docs,targets", [([], []), ([], ["a b"]), ([(1, "a b " * 20)], []), ([(1, None)], ["a"])])
def test_empty_tables(spark, docs, targets):
    got = resampling.resample(table(spark, docs), texts(spark, targets)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(docs, targets)


def test_targets_are_preferred(spark):
    near = ["alpha beta gamma delta " * 8]
    docs = [(i, near[0] if i % 4 == 0 else f"other words number {i} " * 8) for i in range(400)]
    got = resampling.resample(table(spark, docs), texts(spark, near * 10)).collect()
    drawn = [r for r in got if r["rank"] is not None]
    # a quarter without preference; not all, as noise is added
    assert len(drawn) == 100 and np.mean([r.doc_id % 4 == 0 for r in drawn]) > 0.75
