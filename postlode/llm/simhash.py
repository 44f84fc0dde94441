"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits share a variant: two of opposite parity
at distance three meet where one has flipped a single bit and the other two bits of one
half of the fingerprint (of three bits two always lie in one half); at distance two or less
they meet where each has flipped at most one. So every distinct fingerprint has its variants
with at most one bit flipped, and those of odd parity also those with two bits of one half
flipped: 65 and 1,057 variants.

Variants are shuffled on a key of 2*b of their bits, and packed: a fingerprint is sent once
to each key that any of its variants has (at most 1 + b + b*b keys), and the variants are
listed there. The number of key bits is raised until the fullest bucket of distinct
fingerprints is within a limit, so no bucket's memory grows with the table or with a dense
cluster of similar texts. In a bucket every fingerprint links to one that has the same
variant within one flip; these links hold by construction (1 + 1 or 1 + 2 flips), are checked
again, and join exactly the pairs' components. Components come from alternating large-star
and small-star rounds over the links, each round written to the shared folder.

Null or blank text has fingerprint zero. Rows with equal fingerprints link whatever their
number: a node is a fingerprint, and a component is named by the smallest doc_id of its
fingerprints' rows. Rows that share a doc_id but not a fingerprint are as far apart as their
texts. A row without doc_id links like any other but names no component; one that only such
rows are in has none (null). An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, discard, materialise

RADIUS = 3
HALF = 32


def fingerprint_bytes(text: bytes | None, width: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text's word shingles; A-Z are lower-cased, other characters stay."""
    words = (text or b"").lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(words) < width:
        hashes = [digest(b" ".join(words), seed)]
    elif width == 3:
        hashes = [digest(b"%b %b %b" % w, seed) for w in zip(words, words[1:], words[2:], strict=False)]
    else:
        hashes = [digest(b" ".join(words[i : i + width]), seed) for i in range(len(words) - width + 1)]
    return majority(hashes)


def majority(hashes: list[int] | np.ndarray) -> int:
    """The number whose bits are set where over half of the hashes have them set."""
    n = len(hashes)
    bits = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = np.asarray(hashes[at : at + (1 << 16)], dtype="<u8")
        bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * bits > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed 64-bit number."""

    def each(batches):
        for b in batches:
            prints = np.fromiter((fingerprint_bytes(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    texts = bounded_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    return texts.mapInArrow(each, "doc_id long, fp long")


def _masks(b: int) -> tuple[list[int], list[int]]:
    """Key differences that variants with one flip, and with two flips in one half, can have."""
    ones = [1 << i for i in range(2 * b)]
    twos = [(1 << i | 1 << j) << side for side in (0, b) for i in range(b) for j in range(i)]
    return [0, *ones], twos


def _key(b: int):
    ones = (1 << b) - 1
    low = F.col("fp").bitwiseAND(F.lit(ones))
    high = F.shiftleft(F.shiftrightunsigned("fp", HALF).bitwiseAND(F.lit(ones)), b)
    return low.bitwiseOR(high)


def _flips(b: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each key difference: masks of the variants within one flip, and with two flips in one half, that have it."""
    one, two = [0] + [1 << i for i in range(64)], []
    for side in (0, HALF):
        two += [(1 << i | 1 << j) << side for i in range(HALF) for j in range(i)]
    ones = (1 << b) - 1
    key = lambda m: (m & ones) | ((m >> HALF) & ones) << b
    out: dict[int, tuple[list, list]] = {}
    for k, masks in enumerate((one, two)):
        for m in masks:
            out.setdefault(key(m), ([], []))[k].append(m)
    return {d: (np.array(a, np.uint64), np.array(c, np.uint64)) for d, (a, c) in out.items()}


def _bucket_links(bucket: int, fp: np.ndarray, node: np.ndarray, flips, b: int, step: int = 2000):
    """Links (two arrays of nodes) between fingerprints whose variants meet in one bucket."""
    ones = np.uint64((1 << b) - 1)
    key = (fp & ones) | (((fp >> np.uint64(HALF)) & ones) << np.uint64(b))
    odd = np.bitwise_count(fp) % 2 == 1
    differ = key ^ np.uint64(bucket)
    near, owner = [], []
    for d in np.unique(differ):
        at = np.flatnonzero(differ == d)
        masks = flips[int(d)][0]
        near.append((fp[at, None] ^ masks[None, :]).ravel())
        owner.append(np.repeat(at, len(masks)))
    near, owner = np.concatenate(near), np.concatenate(owner)
    order = np.lexsort((owner, near))
    near, owner = near[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(near) else np.zeros(0, int)
    run = np.cumsum(np.concatenate([[0], (near[1:] != near[:-1]).astype(int)])) if len(near) else np.zeros(0, int)
    centre = owner[start][run]
    left, right = [owner[owner != centre]], [centre[owner != centre]]
    even = ~odd[owner]
    values, first = np.unique(near[even], return_index=True)
    centres = owner[even][first]
    for d in np.unique(differ[odd]) if len(values) else ():
        masks = flips[int(d)][1]
        at = np.flatnonzero(odd & (differ == d))
        for i in range(0, len(at) if len(masks) else 0, step):
            some = at[i : i + step]
            far = (fp[some, None] ^ masks[None, :]).ravel()
            spot = np.minimum(np.searchsorted(values, far), len(values) - 1)
            hit = np.flatnonzero(values[spot] == far)
            left.append(some[hit // len(masks)])
            right.append(centres[spot[hit]])
    left, right = np.concatenate(left), np.concatenate(right)
    close = np.bitwise_count(fp[left] ^ fp[right]) <= RADIUS
    pairs = np.unique(np.stack([left[close], right[close]], axis=1), axis=0)
    return node[pairs[:, 0]], node[pairs[:, 1]]


def links(nodes: DataFrame, bucket_limit: int = 50_000, key_bits: int = 5) -> DataFrame:
    """``u, v``: links between nodes (``node``, distinct ``fp``) that join all pairs within three bits.

    ``key_bits`` (of each half) rises to 16 at most, until no bucket has over ``bucket_limit`` fingerprints.
    """
    b = key_bits
    while b < 16 and (nodes.groupBy(_key(b).alias("k")).count().agg(F.max("count")).first()[0] or 0) > bucket_limit:
        b += 1
    near, far = _masks(b)
    xor = lambda masks: F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: m.bitwiseXOR(F.col("k")))
    odd = F.bit_count("fp") % 2 == 1
    keyed = nodes.filter("node is not null").withColumn("k", _key(b))
    sent = keyed.select("node", "fp", F.explode(F.when(odd, F.concat(xor(near), xor(far))).otherwise(xor(near))).alias("bucket"))
    flips = _flips(b)

    def meet(group: pa.Table) -> pa.Table:
        fp = group["fp"].to_numpy().astype(np.int64).view(np.uint64)
        u, v = _bucket_links(group["bucket"][0].as_py(), fp, group["node"].to_numpy(), flips, b)
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return sent.groupBy("bucket").applyInArrow(meet, "u long, v long").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each u of distinct edges (u, v) has one v, which is no u."""
    each = edges.groupBy("u").agg(F.count("*").alias("n"))
    roots = edges.select(F.col("v").alias("root")).distinct()
    return each.join(roots, each.u == roots.root, "left").filter("n > 1 or root is not null").isEmpty()


def components(edges: DataFrame, most: int | None = None, most_rounds: int = 50) -> DataFrame:
    """``node, component``: for every node of ``edges`` (u, v) the smallest node that it reaches. ``most``: about how many edges there are at most."""
    now = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "links", most)
    for _ in range(most_rounds):
        if _are_stars(now):
            break
        most = 2 * now.count()
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, now = now, materialise(small.filter("u <> v").distinct(), "stars", most)
        discard(before)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _grouped(prints: DataFrame, bucket_limit: int, *named: Column) -> DataFrame:
    """``fp`` and the aggregates ``named`` over all rows of the fingerprint's component, one row a fingerprint."""
    rows = prints.count()
    nodes = materialise(prints.select("fp").distinct(), "nodes", rows)
    found = components(links(nodes.select(F.col("fp").alias("node"), "fp"), bucket_limit))
    placed = nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("component", "fp").alias("component"))
    placed = materialise(placed, "placed", rows)
    own = prints.groupBy("fp").agg(*named)
    names = [c for c in own.columns if c != "fp"]
    whole = own.join(placed, "fp").groupBy("component").agg(*[F.min(c).alias(c) for c in names])
    return placed.join(whole, "component").select("fp", *names)


def near_duplicates(docs: DataFrame, width: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """``doc_id, fp, component_id`` of every row: the smallest doc_id that links reach."""
    prints = materialise(fingerprints(docs, width), "prints")
    named = _grouped(prints, bucket_limit, F.min("doc_id").alias("component_id"))
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def hex_digits(fp) -> F.col:
    """A signed 64-bit number as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def keep_one(docs: DataFrame, width: int = 3, bucket_limit: int = 50_000) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest doc_id (null last), and of several such rows the first."""
    columns = docs.columns
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"))
    held = materialise(packed, "simhash-docs")
    # a row's number stands for its id while texts are fingerprinted
    numbered = fingerprints(held.select(F.col("row").alias("doc_id"), "whole.text"), width).withColumnRenamed("doc_id", "row")
    prints = materialise(numbered, "prints")
    ids = held.select("row", F.col("whole.doc_id").alias("doc_id"))
    ordered = prints.join(ids, "row").select("fp", F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row").alias("first"))
    named = _grouped(ordered, bucket_limit, F.min("first").alias("first"))
    kept = named.select("first.row").distinct()
    return held.join(kept, "row", "left_semi").select(*[F.col("whole").getField(c).alias(c) for c in columns])
