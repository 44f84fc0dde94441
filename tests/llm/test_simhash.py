import random

import numpy as np
import pytest
import xxhash

from postlode.llm import simhash


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(prints):
    ids, out = sorted(prints), {}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids} | out


@pytest.mark.parametrize("key_bits", [1, 3, 5])
def test_links_find_all_pairs_within_three_bits(spark, key_bits):
    rng = random.Random(key_bits)
    fps = set()
    for _ in range(40):
        x = rng.getrandbits(64)
        fps.add(x)
        for _ in range(6):
            y = x
            for _ in range(rng.randint(1, 4)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
            x = rng.choice([x, y])
    prints = dict(enumerate(sorted(fps)))
    rows = [(i, int(np.uint64(f).astype(np.int64))) for i, f in prints.items()]
    nodes = spark.createDataFrame(rows, "node long, fp long")
    got = {r.node: r.component for r in simhash.components(simhash.links(nodes, key_bits=key_bits)).collect()}
    want = brute_components(prints)
    assert {i: got.get(i, i) for i in prints} == want
    assert len(set(want.values())) < len(prints)


def test_fullest_bucket_raises_key_bits(spark):
    rows = [(i, i << 6) for i in range(300)]  # one bucket at five bits
    got = simhash.components(simhash.links(spark.createDataFrame(rows, "node long, fp long"), bucket_limit=40))
    want = brute_components({i: f for i, f in rows})
    assert {r.node: r.component for r in got.collect()} == want


def test_near_duplicates(spark):
    base = [" ".join(f"w{random.Random(i * 99 + j).randrange(900)}" for j in range(120)) for i in range(12)]
    texts = base + [b.replace("w1", "W1") for b in base] + [" ".join(b.split()[:-1]) for b in base]
    texts += [None, "", " \t\n", "one", "ONE\x0btwo", "one\ntwo", "é É ß", "x" * 60_000, "a b c " * 20_000]
    docs = spark.createDataFrame([(i, t, 5) for i, t in enumerate(texts)], "doc_id long, text string, fp int")
    prints = {i: brute_print(t) for i, t in enumerate(texts)}
    want = brute_components(prints)
    rows = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits("fp").alias("fingerprint"), "component_id").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.fingerprint, r.component_id) == (f"{prints[r.doc_id]:016x}", want[r.doc_id])
    kept = sorted(r.doc_id for r in simhash.keep_one(docs).collect())
    assert kept == sorted(set(want.values()))


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, "z")], "doc_id long, text string")
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.near_duplicates(docs).collect())
    assert got == [("1", "1"), ("1", "1"), ("None", "1"), ("None", "None")]
    assert sorted(str(r.doc_id) for r in simhash.keep_one(docs).collect()) == ["1", "None"]
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_one_id_with_two_texts_joins_no_strangers(spark):
    texts = [" ".join(f"{k}{random.Random(i * 77 + j).randrange(500)}" for j in range(60)) for i, k in enumerate("abcd")]
    rows = [(1, texts[0]), (1, texts[1]), (2, texts[0]), (3, texts[1]), (None, texts[2]), (None, texts[2]), (4, texts[3])]
    docs = spark.createDataFrame([(i, t, "r", "w") for i, t in rows], "doc_id long, text string, row string, whole string")
    got = {(r.doc_id, r.fp): r.component_id for r in simhash.near_duplicates(docs).collect()}
    fp = [int(np.uint64(brute_print(t)).astype(np.int64)) for t in texts]
    assert got == {(1, fp[0]): 1, (1, fp[1]): 1, (2, fp[0]): 1, (3, fp[1]): 1, (None, fp[2]): None, (4, fp[3]): 4}
    apart = {r.doc_id: r.component_id for r in simhash.near_duplicates(docs.filter("doc_id <> 1")).collect()}
    assert apart == {2: 2, 3: 3, 4: 4}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", texts[0]), ("1", texts[1]), ("None", texts[2]), ("4", texts[3])])


def test_long_chain(spark):
    chain = [sum(3 << (2 * k) for k in range(i)) for i in range(33)]  # neighbours differ in two bits
    rows = [((i * 7) % 33, int(np.uint64(f).astype(np.int64))) for i, f in enumerate(chain)]
    got = simhash.components(simhash.links(spark.createDataFrame(rows, "node long, fp long"))).collect()
    assert {r.component for r in got} == {0} and len(got) == 33
