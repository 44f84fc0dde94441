import random

import numpy as np
import pytest

from postlode.llm import copies
from tests.llm.test_simhash import brute_print

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def sets_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Numbers of the rows that stay."""
    sets, root = [sets_of(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    return [min(g, key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i)) for g in groups.values()]


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(400)}"
    line = " ".join(word() for _ in range(12))
    texts = []
    for _ in range(14):
        base = [word() for _ in range(rng.randint(3, 150))]
        group = [base]
        for _ in range(rng.randint(0, 12)):
            near = list(rng.choice(group))
            for _ in range(rng.randint(1, 4)):
                near[rng.randrange(len(near))] = word()
            group.append(near)
        texts += [" ".join(g) + rng.choice(["", " " + line]) for g in group]
    large = [word() for _ in range(100)]
    for _ in range(40):
        near = list(large)
        for _ in range(3):
            near[rng.randrange(100)] = word()
        texts.append(" ".join(near))
    texts += [None, "", " \t", "one", "ONE", texts[0].upper(), texts[0].replace(" ", "\n")]
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed,few", [(1, 16), (2, 2), (3, 5)])
def test_keep_one_matches_brute_force(spark, seed, few):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    out = copies.keep_one(docs, few=few)
    assert out.columns == ["doc_id", "text", "row"]
    kept = sorted(r.doc_id for r in out.collect())
    assert kept == sorted(brute_kept(rows)) and len(kept) < len(rows) - 20


def test_sketches_never_hide_similar_sets():
    rng = np.random.default_rng(0)
    for n in (1, 3, 40, 300, 5000):
        a = rng.integers(0, 2**64, n, dtype=np.uint64)
        for gone, new in ((0, 0), (n // 10, n // 10), (n // 5, 0), (0, n // 4), (n // 2, n // 2), (n, n)):
            b = np.concatenate([a[gone:], rng.integers(0, 2**64, new, dtype=np.uint64)])
            one, other = copies.sketch(a), copies.sketch(b)
            apart = len(np.setxor1d(a, b))
            assert copies.differing(one, other) == copies.differing(other, one) <= apart
            if copies.similar(np.sort(a), np.sort(b)):
                assert copies.may_be_similar(len(a) + len(b), one, other)
            elif n >= 300 and gone >= n // 2:
                assert not copies.may_be_similar(len(a) + len(b), one, other)


def test_stage_takes_near_copies_beyond_three_bits(spark, tmp_path):
    rng = random.Random(7)
    words = [f"w{rng.randrange(900)}" for _ in range(60)]
    one, other = " ".join(words), " ".join(words + ["a", "b", "c"])
    assert (brute_print(one) ^ brute_print(other)).bit_count() > 3
    docs = spark.createDataFrame([(2, one), (1, other)], "doc_id long, text string")
    stage = dict(corpus_pipeline.STAGES)["near-dedup"]
    assert [r.doc_id for r in stage(spark, docs, str(tmp_path)).collect()] == [1]


def test_shared_and_null_ids_and_empty(spark):
    long = "a b c d e f g h"
    rows = [(1, long), (1, "quite another text of seven words"), (None, long), (None, "z"), (None, "z"), (3, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(copies.keep_one(docs).collect(), key=str)
    assert sorted(map(str, got)) == sorted(str(r) for r in docs.collect() if tuple(r) in {rows[0], rows[1]}) + [str(docs.collect()[3])]
    assert copies.keep_one(docs.filter("false")).collect() == []
