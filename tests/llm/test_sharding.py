import zlib

import pytest
import xxhash

from postlode.llm import sharding


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in enumerate(texts)], "doc_id long, text string, shard int, size int")


def check(rows, texts, shards=8, slack=None):
    assert len(rows) == len(texts)
    sizes = [len((t or "").encode()) + 1 for t in texts]
    held = {}
    for r in rows:
        assert r["size"] == sizes[r.doc_id] and r.text_crc32 == zlib.crc32((texts[r.doc_id] or "").encode())
        held.setdefault(r.shard, []).append(r)
    for k, got in held.items():
        assert 0 <= k < shards
        assert sorted(r.slot for r in got) == list(range(len(got)))
    total = [sum(r["size"] for r in held.get(k, [])) for k in range(shards)]
    assert max(total) - min(total) <= (slack or 2 * max(sizes) + 0.02 * sum(sizes) / shards), total


def test_shards_are_even_and_gapless(spark):
    texts = [f"text {i} " + "wörd " * (i * 37 % 101) for i in range(900)] + [None, "", ""] + ["same words"] * 40
    out = sharding.shard_by_bytes(docs_of(spark, texts)).collect()
    check(out, texts)


def test_shards_equal_brute_force(spark):
    texts = [f"text {i} " + "wörd " * (i * 37 % 101) for i in range(300)] + [None, "", ""] + ["same words"] * 40 + ["z" * 9000]
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), seed=42) + 2**63) % 2**64 - 2**63
    order = sorted(range(len(texts)), key=lambda i: (signed(texts[i] or ""), i))
    sizes = [len((t or "").encode()) + 1 for t in texts]
    want, seen, slots = {}, 0, {}
    for i in order:
        middle = seen + sizes[i] / 2
        shard = sum(middle > sum(sizes) * k / 8 for k in range(1, 8))
        want[i] = (shard, slots.setdefault(shard, 0))
        slots[shard] += 1
        seen += sizes[i]
    assert {r.doc_id: (r.shard, r.slot) for r in sharding.shard_by_bytes(docs_of(spark, texts)).collect()} == want


def test_equal_rows_are_split(spark):
    rows = spark.createDataFrame([(7, "one row that repeats", "t")] * 900, "doc_id long, text string, tie string")
    out = sharding.shard_by_bytes(rows.repartition(5)).collect()
    held = [sorted(r.slot for r in out if r.shard == k) for k in range(8)]
    assert all(x == list(range(len(x))) and len(x) in (112, 113) for x in held) and sum(map(len, held)) == 900


def test_hot_text_is_split(spark):
    texts = ["one hot text that repeats"] * 800 + [f"other {i}" for i in range(900)]
    check(sharding.shard_by_bytes(docs_of(spark, texts)).collect(), texts)


@pytest.mark.parametrize("texts", [[], [None], ["a", "b"], ["x" * 100_000] + ["y"] * 20])
def test_small_tables(spark, texts):
    rows = sharding.shard_by_bytes(docs_of(spark, texts)).collect()
    check(rows, texts, slack=1e9)


def test_reruns_agree(spark):
    df = docs_of(spark, [f"t{i % 70}" for i in range(500)])
    assert sorted(sharding.shard_by_bytes(df).collect()) == sorted(sharding.shard_by_bytes(df.repartition(7)).collect())
