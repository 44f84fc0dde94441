"""Interpolated modified Kneser-Ney bigram model: counted in Spark, scored from memory-mapped arrays.

Words are 64-bit hashes; the sorted distinct hashes of the training text are the vocabulary,
and a word's place among them its number. A bigram is the pair of its numbers, mixed by an
invertible 64-bit function; the sorted mixed pairs and their counts are the model. Counting
runs three times over one scheme: tasks count keys over a bounded number of tokens at a time
and send them, sorted, as packed blocks by ranges of keys; a task merges one range after
another and appends it to a sorted file of the shared folder. The number of ranges follows the
counted tokens, so a range's size does not, and mixing spreads a hot context over all of them;
ranges lie in at most ``FILES`` files, and a row a file (its length and counts of counts) is all
that comes to the driver and goes to the tasks. Workers map the files into memory and look up
sorted batches of keys; where the shared folder is no file system they can map, a file is
first copied beside the worker, unlinked as soon as it is mapped.

P(w|h) = max(c(hw) - D, 0)/c(h) + g(h) * P(w), P(w) from the number of different words
before w, discounted alike, and the rest spread over the vocabulary and one unknown word.
Discounts are the closed-form three of the modified method.

Null text counts as empty: one end token. Repeated rows count each time. A row without
doc_id learns. With nothing to learn from all probabilities are one. An empty table gives
no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, local_path, new_folder, open_store

#: No word contains white space.
END = b"\n"
#: Tokens that a task counts, and scores, at a time.
TOKENS_AT_ONCE = 1_500_000
SCORED_AT_ONCE = 250_000
#: Keys of a range, about, and files that all ranges lie in at most.
KEYS_A_RANGE = 1_000_000
FILES = 4096
WORDS_KEPT = 300_000
#: Odd multipliers of an invertible mixing function (public splitmix64 constants) and their inverses modulo 2**64.
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
UNMIX = tuple(pow(m, -1, 1 << 64) for m in MIX)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX[0])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(MIX[1])
    return x ^ (x >> np.uint64(32))


def unmix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(UNMIX[1])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(UNMIX[0])
    return x ^ (x >> np.uint64(32))


class Words(dict):
    """Hashes of words, the first ``WORDS_KEPT`` different ones remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh64_intdigest(word)
        if len(self) < WORDS_KEPT:
            self[word] = found
        return found

    def of(self, text: bytes | None) -> np.ndarray:
        """Hashes of a text's words (A-Z lower-cased), then the end token's."""
        words = (text or b"").lower().split()
        words.append(END)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def packed(keys: np.ndarray, counts: np.ndarray) -> tuple[bytes, bytes]:
    """Sorted keys as compressed gaps, byte planes apart; counts compressed."""
    gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return squeeze(np.ascontiguousarray(gaps).tobytes()), squeeze(counts.astype("<u4").tobytes())


def unpacked(keys: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    expand = zstandard.ZstdDecompressor().decompress
    planes = np.frombuffer(expand(keys), np.uint8).reshape(8, -1)
    gaps = np.ascontiguousarray(planes.T).view(np.uint64).ravel()
    return np.cumsum(gaps, dtype=np.uint64), np.frombuffer(expand(counts), "<u4")


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct sorted keys and the sums of their counts."""
    if not len(keys):
        return keys, counts.astype(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[start], np.add.reduceat(counts, start)


PACKED = "part int, keys binary, counts binary"


def blocks(keys: np.ndarray, counts: np.ndarray, firsts: np.ndarray) -> pa.RecordBatch:
    """Sorted distinct keys as one packed row for each range; ``firsts``: the ranges' least keys."""
    edges = np.append(np.searchsorted(keys, firsts), len(keys))
    rows = [(s, *packed(keys[a:b], counts[a:b])) for s, (a, b) in enumerate(zip(edges, edges[1:], strict=False)) if b > a]
    columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))]
    return pa.RecordBatch.from_arrays(columns, names=["part", "keys", "counts"])


def merged(rows: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    parts = [unpacked(k, c) for k, c in rows]
    return summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))


class ArrayFile:
    """A file that grows by arrays, under a name of this attempt's own, so that repeated tasks never share one."""

    def __init__(self, folder: str, name: str):
        fs, base = open_store(folder)
        fs.create_dir(base, recursive=True)
        name = f"{name}-{uuid.uuid4().hex}.bin"
        self.uri, self.out = f"{folder}/{name}", fs.open_output_stream(f"{base}/{name}")

    def add(self, values: np.ndarray) -> None:
        self.out.write(np.ascontiguousarray(values).data)

    def close(self) -> str:
        self.out.close()
        return self.uri


_mapped: dict[str, np.ndarray] = {}


def read_array(uri: str, kind: str, n: int) -> np.ndarray:
    """A written array, mapped into memory; one mapping a worker and file."""
    if not n:
        return np.zeros(0, kind)
    if uri not in _mapped:
        path = local_path(uri)
        if len(_mapped) > 4 * FILES:
            _mapped.clear()
        if path is not None:
            _mapped[uri] = np.memmap(path, kind, "r", shape=(n,))
        else:
            fs, far = open_store(uri)
            with tempfile.TemporaryFile(prefix="lm-") as near:
                with fs.open_input_stream(far) as source:
                    while chunk := source.read(1 << 24):
                        near.write(chunk)
                near.flush()
                _mapped[uri] = np.memmap(near, kind, "r", shape=(n,))
    return _mapped[uri]


@dataclass(frozen=True)
class Store:
    """Sorted keys and their counts in files: of each file (key file, count file, length), least key and place of the first."""

    files: tuple[tuple[str, str, int], ...]
    firsts: tuple[int, ...]

    @property
    def size(self) -> int:
        return sum(n for _, _, n in self.files)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted keys: their places among all (-1: none) and their counts (0: none)."""
        place, count = np.full(len(keys), -1), np.zeros(len(keys), np.int64)
        edges = np.append(np.searchsorted(keys, np.array(self.firsts, np.uint64)), len(keys)).tolist()
        before = 0
        for (k, c, n), a, b in zip(self.files, edges, edges[1:], strict=False):
            if b > a and n:
                held, some = read_array(k, "<u8", n), keys[a:b]
                at = np.minimum(np.searchsorted(held, some), n - 1)
                hit = np.asarray(held[at]) == some
                place[a:b] = np.where(hit, at + before, -1)
                count[a:b] = np.where(hit, read_array(c, "<u8", n)[at], 0)
            before += n
        return place, count


def even_firsts(parts: int, over: int = 1 << 64) -> np.ndarray:
    return np.array([over * s // parts for s in range(parts)], dtype=np.uint64)


def batched(batches: Iterator[pa.RecordBatch], at_once: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Ids, token hashes and document lengths of about ``at_once`` tokens at a time; texts are never cut."""
    words, ids, tokens, n = Words(), [], [], 0
    for b in batches:
        for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            ids.append(i)
            tokens.append(words.of(text.as_py()))
            n += len(tokens[-1])
            if n >= at_once:
                yield ids, np.concatenate(tokens), np.array([len(t) for t in tokens])
                ids, tokens, n = [], [], 0
    if ids:
        yield ids, np.concatenate(tokens), np.array([len(t) for t in tokens])


def numbered(tokens: np.ndarray, vocabulary: Store) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (-1: unknown) and training counts of token hashes."""
    distinct, which = np.unique(tokens, return_inverse=True)
    place, count = vocabulary.find(distinct)
    return place[which], count[which]


def bigrams(numbers: np.ndarray, lengths: np.ndarray, start: int, unknown: int) -> tuple[np.ndarray, np.ndarray]:
    """Context numbers of all tokens, and the mixed keys of (context, token)."""
    numbers = np.where(numbers < 0, unknown, numbers).astype(np.uint64)
    before = np.empty_like(numbers)
    before[1:] = numbers[:-1]
    before[np.cumsum(np.append(0, lengths[:-1]))] = start
    return before, mix(before << np.uint64(32) | numbers)


@dataclass(frozen=True)
class Model:
    vocabulary: Store
    pairs: Store
    #: Files of four context and continuation counts a number, with each file's first number and the one after its last.
    contexts: tuple[tuple[str, int, int], ...]
    #: Tokens, documents.
    tokens: int
    documents: int
    #: Discounts of bigrams and of single words for counts 1, 2, 3 and over.
    pair_discounts: tuple[float, float, float]
    word_discounts: tuple[float, float, float]
    #: Words by number of different words before them: 1, 2, 3 and over.
    word_classes: tuple[int, int, int]

    @property
    def words(self) -> int:
        return self.vocabulary.size

    @property
    def types(self) -> int:
        return self.pairs.size


def discounts(n: list[int]) -> tuple[float, float, float]:
    """The three discounts from how many keys have count 1, 2, 3 and 4; k/2 where a closed form has no value in [0, k]."""
    out = []
    for k in (1, 2, 3):
        d = k / 2
        if n[0] and n[1] and n[k - 1]:
            form = k - (k + 1) * n[0] / (n[0] + 2 * n[1]) * n[k] / n[k - 1]
            d = form if 0 <= form <= k else d
        out.append(d)
    return tuple(out)


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Range, merged keys and counts of packed rows sorted by range."""
    part, rows = None, []
    for b in batches:
        for p, k, c in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
            if p != part and rows:
                yield (part, *merged(rows))
                rows = []
            part = p
            rows.append((k, c))
    if rows:
        yield (part, *merged(rows))


def _in_files(packed_rows: DataFrame, parts: int, files: int, write, schema: str) -> list:
    """Rows that ``write(ranges)`` makes of each file's ranges; a file holds neighbouring ranges."""
    dealt = packed_rows.withColumn("file", F.floor(F.col("part") * F.lit(files) / parts).cast("int"))
    dealt = dealt.repartition(files, "file").sortWithinPartitions("part").select("part", "keys", "counts")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(_ranges(batches), key=lambda x: x[0] * files // parts):
            yield pa.RecordBatch.from_pylist([write(group)])

    rows = dealt.mapInArrow(each, schema).collect()
    return sorted(rows, key=lambda r: r.file)


def _stored(packed_rows: DataFrame, folder: str, name: str, parts: int, files: int, more) -> tuple[Store, list]:
    """Packed rows in sorted files; ``more(counts)`` gives further numbers, which are summed by file."""

    def write(ranges) -> dict:
        keys, counts, n, said = ArrayFile(folder, f"{name}-keys"), ArrayFile(folder, f"{name}-counts"), 0, 0
        for part, k, c in ranges:
            keys.add(k.astype("<u8"))
            counts.add(c.astype("<u8"))
            n, said = n + len(k), said + np.array(more(c), np.int64)
        return {"file": part * files // parts, "k": keys.close(), "c": counts.close(), "n": n, "more": said.tolist()}

    rows = _in_files(packed_rows, parts, files, write, "file long, k string, c string, n long, more array<long>")
    by, first = {r.file: r for r in rows}, even_firsts(parts)
    held = tuple((by[f].k, by[f].c, by[f].n) if f in by else ("", "", 0) for f in range(files))
    return Store(held, tuple(int(first[-(-f * parts // files)]) for f in range(files))), [r.more for r in rows]


def train(docs: DataFrame, at_once: int = TOKENS_AT_ONCE, keys_a_range: int = KEYS_A_RANGE, most_files: int = FILES) -> Model:
    """Count and write the model of ``docs`` (``doc_id, text``)."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lm")
    texts = bounded_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text")))
    # a count of bytes bounds the words, and so the ranges, without reading words
    size = texts.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    parts = max(1, -(-((size[0] or 0) // 6 + size[1]) // keys_a_range))
    files = min(parts, most_files)
    even = even_firsts(parts)

    def count_words(batches):
        for _, tokens, _ in batched(batches, at_once):
            yield blocks(*np.unique(tokens, return_counts=True), even)

    vocabulary, sums = _stored(texts.mapInArrow(count_words, PACKED), folder, "words", parts, files, lambda c: [c.sum()])
    words = vocabulary.size
    start, unknown = words, words + 1
    if unknown >= 1 << 32:
        raise OverflowError("word numbers take 32 bits: over 4294967294 different words")

    def count_pairs(batches):
        for _, tokens, lengths in batched(batches, at_once):
            number, _ = numbered(tokens, vocabulary)
            yield blocks(*np.unique(bigrams(number, lengths, start, unknown)[1], return_counts=True), even)

    classes = lambda c: [np.count_nonzero(c == k) for k in (1, 2, 3, 4)]
    pairs, counted = _stored(texts.mapInArrow(count_pairs, PACKED), folder, "pairs", parts, files, classes)

    # contexts by count class (fields 0 to 2) and different words before a word (field 3), keyed by number * 4 + field
    some = max(1, -(-(words + 1) // keys_a_range))
    few = min(some, most_files)
    edges = np.append(even_firsts(some, words + 1), np.uint64(words + 1))
    step = max(1, at_once // 4)
    held = spark.createDataFrame([(k, c, n) for k, c, n in pairs.files if n], "k string, c string, n long")
    held = held.withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))))

    def count_contexts(batches):
        for b in batches:
            for k, c, n, at in zip(*(col.to_pylist() for col in b.columns), strict=True):
                pair, count = (np.array(read_array(x, "<u8", n)[at : at + step]) for x in (k, c))
                pair = unmix(pair)
                field = (np.minimum(count, 3) - 1).astype(np.uint64)
                before = (pair >> np.uint64(32)) << np.uint64(2) | field
                after = (pair & np.uint64(0xFFFFFFFF)) << np.uint64(2) | np.uint64(3)
                yield blocks(*np.unique(np.concatenate([before, after]), return_counts=True), edges[:-1] << np.uint64(2))

    def write_contexts(ranges) -> dict:
        out, said, at = ArrayFile(folder, "contexts"), 0, None
        for part, keys, counts in ranges:
            file = part * few // some
            at = int(edges[-(-file * some // few)]) if at is None else at
            first, last = int(edges[part]), int(edges[part + 1])
            out.add(np.zeros((first - at, 4), "<u4"))  # ranges without a row
            rows = np.zeros((last - first, 4), "<u4")
            rows[(keys >> np.uint64(2)).astype(int) - first, (keys & np.uint64(3)).astype(int)] = counts
            out.add(rows)
            at, said = last, said + np.array([*classes(rows[:, 3]), np.count_nonzero(rows[:, 3] >= 3)])
        return {"file": file, "uri": out.close(), "n": at, "more": said.tolist()}

    spread = held.repartition(max(1, min(4096, pairs.size // step + 1)))
    stats = _in_files(spread.mapInArrow(count_contexts, PACKED), some, few, write_contexts, "file long, uri string, n long, more array<long>")
    n = [sum(x) for x in zip(*counted, strict=True)] or [0] * 4
    m = [sum(x) for x in zip(*[r.more for r in stats], strict=True)] or [0] * 5
    by = {r.file: (r.uri, int(edges[-(-r.file * some // few)]), r.n) for r in stats}
    return Model(
        vocabulary,
        pairs,
        tuple(by[f] for f in sorted(by)),
        sum(s[0] for s in sums),
        size[1],
        discounts(n),
        discounts(m[:4]),
        (m[0], m[1], m[4]),
    )


def _context_rows(model: Model, numbers: np.ndarray) -> np.ndarray:
    """The four counts of each number (-1: zeros)."""
    out = np.zeros((4, len(numbers)), np.float64)
    for uri, first, end in model.contexts:
        mine = np.flatnonzero((numbers >= first) & (numbers < end))
        if len(mine):
            held = read_array(uri, "<u4", 4 * (end - first)).reshape(-1, 4)
            out[:, mine] = held[numbers[mine] - first].T
    return out


def token_probabilities(model: Model, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each token's probability, and its training count."""
    distinct, which = np.unique(tokens, return_inverse=True)
    place, count = model.vocabulary.find(distinct)
    number = place[which]
    ahead = _context_rows(model, place)
    d, e, types = model.pair_discounts, model.word_discounts, model.types
    if types:
        less = np.where(ahead[3] == 1, e[0], np.where(ahead[3] == 2, e[1], e[2]))
        rest = sum(a * b for a, b in zip(e, model.word_classes, strict=True)) / types
        single = np.maximum(ahead[3] - less, 0) / types + rest / (model.words + 1)
    else:
        single = np.full(len(distinct), 1 / (model.words + 1))
    start, unknown = model.words, model.words + 1
    before, keys = bigrams(number, lengths, start, unknown)
    pair, spot = np.unique(keys, return_inverse=True)
    c = model.pairs.find(pair)[1][spot].astype(np.float64)
    begin = _context_rows(model, np.array([start]))[:, 0] if types else np.zeros(4)
    left = sum(x * ahead[i] for i, x in enumerate(d))
    follow = np.empty(len(tokens))
    follow[1:] = left[which][:-1]
    total = np.empty(len(tokens))
    total[1:] = count[which][:-1]
    opens = np.cumsum(np.append(0, lengths[:-1]))
    follow[opens], total[opens] = sum(x * begin[i] for i, x in enumerate(d)), model.documents
    cut = np.where(c == 1, d[0], np.where(c == 2, d[1], d[2]))
    known = total > 0
    safe = np.where(known, total, 1)
    p = np.where(known, np.maximum(c - cut, 0) / safe + follow / safe * single[which], single[which])
    return p, count[which]


def score(docs: DataFrame, model: Model, at_once: int = SCORED_AT_ONCE) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score, perplexity`` of every text."""
    n, v = model.tokens, model.words

    def each(batches):
        for ids, tokens, lengths in batched(batches, at_once):
            p, count = token_probabilities(model, tokens, lengths)
            opens = np.cumsum(np.append(0, lengths[:-1]))
            base = np.add.reduceat(np.log10((count + 0.5) / (n + 0.5 * (v + 1))), opens)
            got = np.add.reduceat(np.log10(p), opens)
            known = np.add.reduceat((count > 0).astype(np.int64), opens)
            columns = [pa.array(ids, pa.int64()), pa.array(lengths), pa.array(known), pa.array(np.full(len(ids), n))]
            columns += [pa.array(base), pa.array(got), pa.array(10 ** np.minimum(-got / lengths, 300))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"])

    schema = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double"
    return bounded_batches(docs.select("doc_id", F.col("text").cast("binary").alias("text"))).mapInArrow(each, schema)


def train_and_score(docs: DataFrame, held_out: Column) -> DataFrame:
    """Learn from the rows that are not held out; score all."""
    held = F.coalesce(held_out, F.lit(False))
    model = train(docs.filter(~held))
    return score(docs, model)
