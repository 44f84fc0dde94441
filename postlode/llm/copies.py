"""Near copies by Jaccard similarity of word shingles: SimHash links first, then all other pairs by prefix filtering.

A text is the set of hashes of its five-word shingles (white space is ASCII, A-Z are
lower-cased; fewer than five words are one shingle). Equal sets become one node first. Nodes
whose SimHash fingerprints (of those shingles) the ball hashing of ``simhash`` brings together are
held against each other's texts, and those that are similar are joined.

Fingerprints within three bits are few of the pairs of similarity 0.8, so an exact pass finds
the others. Two sets of similarity s or more share an element among the first
n - ceil(s n) + 1 of each, in any order of all elements, so each node is sent to the elements of
its prefix only. The order puts shingles that are common in a sample of the documents last and is by
hash otherwise; it bears on cost, never on results. A candidate whose sets' parities by bit of
hash differ in more bits than similar sets could is no pair; every other one whose nodes are
not in one component yet is held against both texts.

Nodes that share an element are all paired where they are few. Where they are more than
``few``, each is first paired with the smallest of them, then in several turns with some neighbours in
a random order, which joins a large group of near copies in linear work; then those that are not in
one component yet are paired, over keys that still have several.

Null and blank texts are copies of each other. Of each component the row of the smallest
doc_id stays (null last), and of several such rows one; rows are told apart by number, not by
doc_id. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, discard, materialise
from postlode.llm.simhash import components, links, majority

WIDTH = 5
#: The least similarity as a fraction, so that every comparison is of whole numbers.
SHARE, OF = 4, 5
#: Least bits of a sketch; a larger set has a bit an element or more, in powers of two.
BITS = 256
#: Keys that a member carries to tell where a pair was met before.
LEAST_KEYS = 8
#: Rows of numbers that are broadcast at most.
SMALL = 200_000


def shingles(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = (text or b"").lower().split()  # bytes know only ASCII letters and white space
    if not words:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    last = max(1, len(words) - width + 1)
    return np.unique(np.array([digest(b" ".join(words[i : i + width])) for i in range(last)], np.uint64))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARE * (len(a) + len(b) - both)


def sketch(s: np.ndarray) -> bytes:
    """Bits, each the parity of how many elements fall on it, at least as many as elements (a power of two).

    The xor of the halves of a sketch is the sketch of half the bits, so sketches of unlike length compare.
    """
    bits = max(BITS, 1 << max(0, len(s) - 1).bit_length())
    return np.packbits(np.bincount((s % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).tobytes()


def folded(one: bytes, size: int) -> np.ndarray:
    """A sketch in ``size`` bytes, its own length or less."""
    return np.bitwise_xor.reduce(np.frombuffer(one, np.uint8).reshape(-1, size), axis=0)


def differing(one: bytes, other: bytes) -> int:
    """Bits in which two sketches differ: no more than elements that only one of the sets has."""
    size = min(len(one), len(other))
    return int(np.bitwise_count(folded(one, size) ^ folded(other, size)).sum())


def may_be_similar(n: int, one: bytes, other: bytes) -> bool:
    """Whether two sets of ``n`` elements together, by their sketches, can be similar."""
    return (OF + SHARE) * differing(one, other) <= (OF - SHARE) * n


def common_shingles(rows: DataFrame, sample: int = 10_000, least: int = 3, most: int = 100_000) -> np.ndarray:
    """Sorted hashes of shingles that ``least`` of about ``sample`` rows hold, the ``most`` frequent at most."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = np.concatenate([shingles(text.as_py()) for text in b.column(0)]) if b.num_rows else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], names=["key"])

    share = max(1, rows.count() // sample)
    some = rows.filter(F.pmod(F.xxhash64("row"), F.lit(share)) == 0).select(F.col("text").cast("binary").alias("text"))
    often = some.mapInArrow(each, "key long").groupBy("key").count().filter(F.col("count") >= least)
    held = often.orderBy(F.desc("count"), "key").limit(most).select("key").toArrow()["key"]
    return np.sort(held.to_numpy().astype(np.int64).view(np.uint64))


def prefixes(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """``row, doc_id, digest, n, fp, sketch, keys``: each text's set by digest, size, fingerprint and sketch, and the elements of its prefix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, sizes, prints, sketches, keys = [], [], [], [], []
            for text in b.column(2):
                s = shingles(text.as_py())
                n = len(s)
                at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
                late = common[at] == s if len(common) else np.zeros(n, bool)
                first = np.concatenate([s[~late], s[late]])[: n - -(-SHARE * n // OF) + 1 if n else 0]
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                sizes.append(n)
                prints.append(majority(s) if n else 0)
                sketches.append(sketch(s))
                keys.append(first.view(np.int64))
            flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
            ends = np.cumsum([0, *map(len, keys)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), flat)
            fp = pa.array(np.array(prints, np.uint64).view(np.int64))
            columns = [b.column(0), b.column(1), pa.array(digests, pa.binary()), pa.array(sizes, pa.int64()), fp, pa.array(sketches, pa.binary()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "doc_id", "digest", "n", "fp", "sketch", "keys"])

    texts = rows.select("row", F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return bounded_batches(texts).mapInArrow(each, "row long, doc_id long, digest binary, n long, fp long, sketch binary, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches sorted by their first, cut so that no run of equal values is parted."""
    held = None
    for b in batches:
        new = [c.to_numpy(zero_copy_only=False) for c in b.columns]
        if held is not None:
            new = [np.concatenate(c) for c in zip(held, new, strict=True)]
        if not len(new[0]):
            continue
        start = int(np.searchsorted(new[0], new[0][-1]))
        if start:
            yield [x[:start] for x in new]
        held = [x[start:] for x in new]
    if held is not None:
        yield held


def _near_size(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return OF * np.minimum(a, b) >= SHARE * np.maximum(a, b)


def candidates(nodes: DataFrame, few: int = 16) -> DataFrame:
    """``key, u, v, n``: pairs of nodes (node, n, keys, component) of unlike components that share a key (key null), and the members u, of
    size n, of keys that over ``few`` nodes have (v null)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, node, n, part in _runs(batches):
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            size = np.diff(np.append(start, len(key)))
            run = np.repeat(np.arange(len(start)), size)
            many = size[run] > few
            left, right = [np.zeros(0, int)], [np.zeros(0, int)]
            for lag in range(1, min(few, int(size.max()))):
                at = np.flatnonzero((run[lag:] == run[:-lag]) & ~many[lag:])
                left.append(at)
                right.append(at + lag)
            far = np.flatnonzero(many & (np.arange(len(key)) != start[run]))
            left.append(start[run[far]])
            right.append(far)
            a, b = np.concatenate(left), np.concatenate(right)
            near = _near_size(n[a], n[b]) & (part[a] != part[b])
            pairs = np.unique(np.stack([node[a[near]], node[b[near]]], axis=1), axis=0)
            big = np.flatnonzero(many)
            none = lambda k: pa.array([None] * k, pa.int64())
            kinds = [none(len(pairs)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1]), none(len(pairs))]
            yield pa.RecordBatch.from_arrays(kinds, names=["key", "u", "v", "n"])
            kinds = [pa.array(key[big]), pa.array(node[big]), none(len(big)), pa.array(n[big])]
            yield pa.RecordBatch.from_arrays(kinds, names=["key", "u", "v", "n"])

    sent = nodes.select(F.explode("keys").alias("key"), "node", "n", "component")
    return sent.repartition("key").sortWithinPartitions("key", "node").mapInArrow(each, "key long, u long, v long, n long")


def neighbours(members: DataFrame, turn: int, reach: int = 3) -> DataFrame:
    """``u, v``: each key's members in a random order (another each ``turn``), each with the ``reach`` next ones of unlike components."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            h = (columns[1].view(np.uint64) + np.uint64(turn + 1)) * np.uint64(0x9E3779B97F4A7C15)
            order = np.lexsort((h ^ (h >> np.uint64(29)), columns[0]))
            key, node, n, part = (c[order] for c in columns)
            pairs = [np.zeros((0, 2), np.int64)]
            for lag in range(1, reach + 1):
                a = np.flatnonzero((key[lag:] == key[:-lag]) & (part[lag:] != part[:-lag]))
                a = a[_near_size(n[a], n[a + lag])]
                pairs.append(np.stack([node[a], node[a + lag]], axis=1))
            every = np.unique(np.concatenate(pairs), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(every[:, 0]), pa.array(every[:, 1])], names=["u", "v"])

    dealt = members.select("key", "node", "n", "component").repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(each, "u long, v long")


def parted(members: DataFrame) -> DataFrame:
    """The members (key, node, n, component) of keys that have several components."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _runs(batches):
            key, part = columns[0], columns[3]
            start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            several = np.minimum.reduceat(part, start) < np.maximum.reduceat(part, start)
            some = np.repeat(several, np.diff(np.append(start, len(key))))
            yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], names=["key", "node", "n", "component"])

    dealt = members.select("key", "node", "n", "component").repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(each, "key long, node long, n long, component long")


def unjoined(members: DataFrame) -> DataFrame:
    """``u, v``: of each key's members (key, node, n, component, sketch, mine) the pairs of unlike components whose sketches allow it.

    Members of a key's largest component are not paired with one another, so the work is that of the others
    with all. ``mine`` are some of a member's least keys: a pair that has one of them in common below this key is
    left to that key. Others may be given by several keys.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, nodes, sizes, parts, sketches, lists in _runs(batches):
            edges = np.append(np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])), len(keys))
            for a, b in zip(edges, edges[1:], strict=False):
                # by size, so that a member meets only those of near size
                order = a + np.argsort(sizes[a:b], kind="stable")
                node, n, part, held, mine = nodes[order], sizes[order], parts[order], sketches[order], lists[order]
                names, count = np.unique(part, return_counts=True)
                most = part == names[count.argmax()]
                low, high = np.searchsorted(OF * n, SHARE * n, "left"), np.searchsorted(SHARE * n, OF * n, "right")
                least = np.stack([folded(x, min(map(len, held))) for x in held])  # compared at once; whole sketches follow
                for i in np.flatnonzero(~most).tolist():
                    some = np.arange(low[i], high[i])
                    some = some[(part[some] != part[i]) & (most[some] | (some > i))]
                    apart = np.bitwise_count(least[some] ^ least[i]).sum(axis=1, dtype=np.int64)
                    some = some[(OF + SHARE) * apart <= (OF - SHARE) * (n[some] + n[i])]
                    some = [j for j in some.tolist() if may_be_similar(int(n[i] + n[j]), held[i], held[j])]
                    good = [j for j in some if not len(np.intersect1d(mine[i], mine[j]))]
                    if good:
                        pair = [pa.array(np.full(len(good), node[i])), pa.array(node[good])]
                        yield pa.RecordBatch.from_arrays(pair, names=["u", "v"])

    below = F.filter("mine", lambda k: k < F.col("key")).alias("mine")
    dealt = members.select("key", "node", "n", "component", "sketch", below).repartition("key").sortWithinPartitions("key", "node")
    return dealt.mapInArrow(each, "u long, v long")


def small(df: DataFrame) -> DataFrame:
    """Numbers that the caller has written, broadcast where they are few."""
    return F.broadcast(df) if df.count() <= SMALL else df


def possible(pairs: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sketches allow that they are similar: none that is similar goes."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fits = [may_be_similar(*x) for x in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True)]
            yield b.select(["u", "v"]).filter(pa.array(fits, pa.bool_()))

    first = prints.select(F.col("row").alias("u"), F.col("n").alias("nu"), F.col("sketch").alias("su"))
    second = prints.select(F.col("row").alias("v"), F.col("n").alias("nv"), F.col("sketch").alias("sv"))
    both = pairs.join(first, "u").join(second, "v").select("u", "v", F.expr("nu + nv").alias("n"), "su", "sv")
    return both.mapInArrow(each, "u long, v long")


def verified(pairs: DataFrame, rows: DataFrame, prints: DataFrame) -> DataFrame:
    """The pairs (u, v) of rows whose texts are similar."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, of_last = None, np.zeros(0, np.uint64)
        for b in batches:
            good = np.zeros(b.num_rows, bool)
            for i, (v, one, other) in enumerate(zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True)):
                if v != last:
                    last, of_last = v, shingles(other.as_py())
                good[i] = similar(shingles(one.as_py()), of_last)
            yield b.select(["u", "v"]).filter(pa.array(good))

    # the smaller node of a pair may be that of a whole group
    found = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct()
    found = materialise(possible(found, prints), "copy-pairs")
    asked = materialise(found.select(F.col("u").alias("row")).union(found.select("v")).distinct(), "copy-rows", prints.count())
    text = F.col("text").cast("binary")
    texts = materialise(rows.join(small(asked), "row", "left_semi").select("row", text.alias("text")), "copy-texts")
    first = texts.select(F.col("row").alias("u"), F.col("text").alias("one"))
    second = texts.select(F.col("row").alias("v"), F.col("text").alias("other"))
    both = found.join(first, "u").join(second, "v").select("u", "v", "one", "other")
    out = materialise(bounded_batches(both).mapInArrow(each, "u long, v long"), "copy-links")
    discard(found, asked, texts)
    return out


def fingerprint_pairs(nodes: DataFrame) -> DataFrame:
    """``u, v``: nodes of one fingerprint, and of fingerprints that ball hashing links, each by the least node of its fingerprint."""
    lead = nodes.groupBy("fp").agg(F.min("node").alias("lead"))
    same = nodes.join(lead, "fp").select(F.col("node").alias("u"), F.col("lead").alias("v")).filter("u <> v")
    close = links(lead.select(F.col("fp").alias("node"), "fp"))
    first = lead.select(F.col("fp").alias("u"), F.col("lead").alias("a"))
    second = lead.select(F.col("fp").alias("v"), F.col("lead").alias("b"))
    return same.union(close.join(first, "u").join(second, "v").select("a", "b"))


def survivors(rows: DataFrame, prints: DataFrame, few: int = 16, turns: int = 1) -> DataFrame:
    """``row``: of each component of similar texts the row that stays."""
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    nodes = prints.groupBy("digest").agg(F.min(order).alias("first"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    most = prints.count()
    nodes = materialise(nodes.select(F.col("first.row").alias("node"), "first", "n", "fp"), "copy-nodes", most)
    near = verified(fingerprint_pairs(nodes), rows, prints)
    placed = materialise(components(near, near.count()), "copy-near", most)
    part = F.coalesce("component", "node").alias("component")
    known = small(materialise(nodes.join(placed, "node", "left").select("node", part), "copy-parts", most))
    keyed = prints.select(F.col("row").alias("node"), "n", "keys").join(known, "node")
    met = materialise(candidates(keyed, few), "copy-candidates")
    near = near.union(verified(met.filter("v is not null").select("u", "v"), rows, prints))
    placed = components(near, near.count())
    many = met.filter("v is null").select("key", F.col("u").alias("node"), "n")
    placed_in = lambda: many.join(placed, "node", "left").select("key", "node", "n", part)
    for turn in range(turns if many.head(1) else 0):
        near = near.union(verified(neighbours(placed_in(), turn), rows, prints))
        placed = components(near, near.count())
    left = materialise(parted(placed_in()), "copy-members")
    if left.head(1):
        mine = left.groupBy("node").agg(F.slice(F.array_sort(F.collect_set("key")), 1, LEAST_KEYS).alias("mine"))
        members = left.join(mine, "node").join(prints.select(F.col("row").alias("node"), "sketch"), "node")
        near = near.union(verified(unjoined(members), rows, prints))
        placed = components(near, near.count())
    discard(left)
    whole = nodes.join(placed, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    return whole.groupBy("component").agg(F.min("first").alias("first")).select("first.row")


def keep_one(docs: DataFrame, few: int = 16) -> DataFrame:
    """``docs`` with one row of each group that pairs of similar texts join."""
    columns = docs.columns
    packed = docs.select(F.monotonically_increasing_id().alias("row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole"))
    held = materialise(packed, "copy-docs")
    rows = held.select("row", F.col("whole.doc_id").alias("doc_id"), F.col("whole.text").alias("text"))
    prints = materialise(prefixes(rows, common_shingles(rows)), "copy-prints")
    most = held.count()
    kept = materialise(survivors(rows, prints, few), "copy-kept", most)
    gone = materialise(prints.select("row").join(kept, "row", "left_anti"), "copy-gone", most)
    discard(prints, kept)
    return held.join(small(gone), "row", "left_anti").select(*[F.col("whole").getField(c).alias(c) for c in columns])
