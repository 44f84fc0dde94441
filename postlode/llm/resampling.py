"""Importance resampling towards a target distribution of hashed words and word pairs.

Every text becomes a row of counts over ``buckets`` hashed features. The sparse matrix of
documents by buckets is written as compressed sparse row blocks: a table row holds the ids,
row pointers, column numbers and counts of at most ``ROWS`` documents and about ``ENTRIES``
counts (one document never has more than there are buckets). Column sums of the blocks of raw
and of target texts give two distributions and a gain for each bucket; they are one number a
bucket, whatever the input. The blocks' products with the gains give each document's weight.
Weights plus noise from a hash of the id rank the documents by a global sort, whose partition
totals turn places into ranks; the highest are drawn.

Null text holds no words. Documents without features weigh 0; with fewer than ``least_words``
words they are never drawn. A null id has no hash: such a row has a weight but no score, and is
neither counted nor drawn. Ties of score go to the smaller id; repeated rows are rows of their
own with ranks of their own. An empty table gives no rows; an empty target table is a flat one.
Of other columns none is read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, discard, materialise
from postlode.llm.sharding import in_global_order

ROWS, ENTRIES = 1_024, 1 << 18
#: A long text is split into words by so many bytes at once.
PIECE = 1 << 20
BLOCKS = "ids array<bigint>, words array<bigint>, features array<bigint>, starts binary, columns binary, counts binary"

_UPPER = bytes(range(65, 91))
_WORD = {*range(48, 58), *range(97, 123), *range(128, 256)}
#: Letters A-Z in lower case; every byte that no word holds becomes a space.
LOWER = bytes(b + 32 if b in _UPPER else b if b in _WORD else 32 for b in range(256))


def counts(text: bytes, buckets: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Number of words, and the buckets of words and of neighbouring pairs with their counts."""
    text = text.translate(LOWER)
    total, n, at, before = None, 0, 0, None
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        words = text[at:cut].split()
        at = cut
        if not words:
            continue
        single = list(map(crc32, words))
        first = 0 if before is None else 1
        left = single[:-1] if before is None else [before, *single[:-1]]
        pairs = map(crc32, [b" " + w for w in (words if first else words[1:])], left)
        found = np.fromiter(pairs, np.int64, len(left))
        found = np.bincount(np.concatenate([np.array(single, np.int64), found]) % buckets, minlength=buckets)
        total = found if total is None else total + found
        n, before = n + len(words), single[-1]
    if total is None:
        return 0, np.zeros(0, np.uint16), np.zeros(0, np.int32)
    columns = np.flatnonzero(total)
    return n, columns.astype(np.uint16), total[columns].astype(np.int32)


def matrix(texts: DataFrame, doc_id: Column, text: Column, buckets: int, kind: str) -> DataFrame:
    """The written blocks of the sparse matrix of rows by buckets."""
    if not 0 < buckets <= 1 << 16:
        raise ValueError("column numbers take 16 bits")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, columns, entries = [], [], [], []

        def block() -> pa.RecordBatch:
            starts = np.concatenate([[0], np.cumsum([len(c) for c in columns])]).astype(np.int64)
            features = [2 * w - 1 if w else 0 for w in words]
            lists = [pa.array([x], pa.list_(pa.int64())) for x in (ids, words, features)]
            flat = [starts.tobytes(), np.concatenate(columns).tobytes(), np.concatenate(entries).tobytes()]
            out = pa.RecordBatch.from_arrays([*lists, *(pa.array([x], pa.binary()) for x in flat)], names=["ids", "words", "features", "starts", "columns", "counts"])
            for x in (ids, words, columns, entries):
                x.clear()
            return out

        held = 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, c, x = counts(t.as_py() or b"", buckets)
                ids.append(i)
                words.append(n)
                columns.append(c)
                entries.append(x)
                held += len(c)
                if len(ids) >= ROWS or held >= ENTRIES:
                    yield block()
                    held = 0
        if ids:
            yield block()

    rows = texts.select(doc_id.cast("long").alias("i"), text.cast("binary").alias("t"))
    # small row groups, as a task decodes one at a time
    return materialise(bounded_batches(rows).mapInArrow(each, BLOCKS), kind, files={"parquet.block.size": 16 << 20, "compression": "zstd"})


def _csr(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    kinds = (np.int64, np.uint16, np.int32)
    starts, columns, entries = (np.frombuffer(batch.column(3 + k)[i].as_buffer(), kind) for k, kind in enumerate(kinds))
    return starts, columns, entries.astype(np.int64)


def column_sums(blocks: DataFrame, buckets: int) -> np.ndarray:
    """Counts of each bucket over all rows; a task sends each bucket once."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                _, columns, entries = _csr(batch, i)
                # doubles are exact here: a block's counts are far below 2**53
                total += np.bincount(columns, entries, buckets).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in blocks.mapInArrow(each, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    n, m, b = float(raw.sum()), float(target.sum()), len(raw)
    ratio = [(t + 1.0) * (n + b) / ((s + 1.0) * (m + b)) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]
    return np.array([math.floor(1000 * math.log(x)) for x in ratio], np.int64)


def weigh(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the mean gain of each row's features, rounded down."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                starts, columns, entries = _csr(batch, i)
                ids, words, features = (batch.column(k)[i].values for k in range(3))
                run = np.concatenate([[0], np.cumsum(gain[columns] * entries)])
                n = features.to_numpy()
                mean = (run[starts[1:]] - run[starts[:-1]]) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([ids, words, features, pa.array(mean)], names=["doc_id", "n_words", "n_features", "weight"])

    return blocks.mapInArrow(each, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, salt: str) -> Column:
    """Thousandths of Gumbel noise from the first 32 bits of sha256 of ``salt`` and id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(salt), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(
    docs: DataFrame, targets: DataFrame, buckets: int = 10_000, least_words: int = 20, percent: int = 25, salt: str = "7:"
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every document; ``rank`` is null where it is not drawn."""
    spark = docs.sparkSession
    wanted = matrix(targets, F.lit(None), F.col("text"), buckets, "target-blocks")
    target = column_sums(wanted, buckets)
    discard(wanted)
    blocks = matrix(docs, F.col("doc_id"), F.col("text"), buckets, "document-blocks")
    weighed = weigh(blocks, gains(column_sums(blocks, buckets), target))
    scored = weighed.withColumn("score", F.col("weight") + noise(F.col("doc_id"), salt))
    short = (F.col("n_words") < least_words) | F.col("doc_id").isNull()
    ordered = in_global_order(scored.withColumns({"short": short, "lowest": -F.col("score")}), ["short", "lowest", "doc_id", "n_features"], "resampling")
    discard(blocks)
    totals = sorted(ordered.groupBy("part").agg(F.count("*").alias("rows"), F.count_if(~F.col("short")).alias("able")).collect())
    drawn = percent * sum(t.able for t in totals) // 100
    offsets, seen = [], 0
    for t in totals:
        offsets.append((t.part, seen))
        seen += t.rows
    # one row for each partition of the sort: broadcast is bounded by the number of partitions
    starts = spark.createDataFrame(offsets, "part int, first long")
    place = F.col("first") + F.col("pos") + 1
    return ordered.join(F.broadcast(starts), "part").select(
        "doc_id", "n_words", "n_features", "weight", "score", F.when(~F.col("short") & (place <= drawn), place).alias("rank")
    )
