"""Best-fit packing of tokenised documents into sequences of fixed length.

Bounded-space online best-fit: pieces arrive one by one; a fixed number of bins is open, in
a bitset keyed by free space. A piece goes to the open bin with the least space that takes
it (the lowest set bit at or above its length); if none does, a new bin opens, and if too
many were open the fullest closes first.

Pieces (ids, lengths, checksums; no text) are written once, then dealt by hash (of the row's
number too, so that equal rows spread) to partitions of about ``pieces_per_bin_set`` pieces,
each packed by one task as they arrive in hash order. A task holds its open bins and a
lookahead of ``ahead`` pieces, of which the longest is placed first: short pieces then fill what
the long ones leave.

Null text counts as empty: one piece with the end token. Repeated rows are packed as rows of
their own. An empty table gives no rows. Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postlode.llm.common import bounded_batches, materialise

TOKENIZER = "byte_bpe_50k.json"
LENGTH = 1024
END = 2


def tokenizer_path(name: str) -> str:
    """A path as it is; a bare file name in the folder of installed public tokenizers."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE files write each byte as a printable character: printable bytes as
    themselves, the others as the characters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Encoder:
    """Token ids of a byte-level BPE file of the tokenizers library.

    Where the file's merges rise with its ids, which makes ids ranks, a rank-based encoder
    gives the same ids several times faster; else, and for texts that hold the string of an
    added token (which is one id) or on which the other fails, the tokenizers library itself
    encodes.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.slow = path, None
        self.added = [t["content"] for t in spec.get("added_tokens", ())]
        self.fast = self._ranked(spec)

    @staticmethod
    def _ranked(spec: dict):
        import public_tokenizers
        import tiktoken

        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True)
        odd = spec.get("normalizer") or before.get("add_prefix_space") or model.get("dropout") or model.get("ignore_merges")
        if not plain or odd:
            return None
        special = {t["content"] for t in spec.get("added_tokens", ())}
        byte = _byte_of_char()
        vocab = {k: v for k, v in model["vocab"].items() if k not in special}
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        if any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)) or len(vocab) != 256 + len(merges):
            return None
        ranks = {bytes(byte[c] for c in k): v for k, v in vocab.items()}
        return tiktoken.Encoding("ranked", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not any(t in text for t in self.added):
            try:
                return self.fast.encode_to_numpy(text, disallowed_special=())
            except BaseException as e:  # the library raises its panics past Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        if self.slow is None:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.slow = Tokenizer.from_file(self.path)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder a worker process and file."""
    if name not in _encoders:
        _encoders[name] = Encoder(tokenizer_path(name))
    return _encoders[name]


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` (and ``ids``) of every document's pieces.

    Documents of over ``length`` tokens, the end token included, are cut so that only the
    first piece is shorter.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last = encoder(tokenizer), np.array([end], dtype=np.uint32)
        for b in batches:
            got: list[list] = [[], [], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = np.concatenate([encode(text.as_py() or ""), last])
                n = -(-len(ids) // length)
                cut = len(ids) - (n - 1) * length
                edges = [0, *range(cut, len(ids) + 1, length)]
                for k in range(n):
                    part = ids[edges[k] : edges[k + 1]]
                    row = (doc, k, edges[k], len(part), zlib.crc32(part.astype("<u4").tobytes()), part.astype(np.int32))
                    for column, value in zip(got[: 5 + with_ids], row, strict=False):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()))
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(got[: 5 + with_ids], kinds, strict=False)], names=names)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(each, schema)


class BestFit:
    """Open bins by free space; ``place`` gives a piece's (bin, offset)."""

    def __init__(self, capacity: int, most_open: int):
        self.capacity, self.most_open = capacity, most_open
        self.spaces, self.bins, self.opened, self.open = 0, [[] for _ in range(capacity + 1)], 0, 0

    def _take(self, space: int) -> int:
        found = self.bins[space].pop()
        if not self.bins[space]:
            self.spaces ^= 1 << space
        self.open -= 1
        return found

    def place(self, size: int) -> tuple[int, int]:
        fits = self.spaces >> size
        if fits:
            space = size + (fits & -fits).bit_length() - 1
            to = self._take(space)
        else:
            to, space = self.opened, self.capacity
            self.opened += 1
        offset, space = self.capacity - space, space - size
        if space:
            if self.open == self.most_open:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            self.bins[space].append(to)
            self.spaces |= 1 << space
            self.open += 1
        return to, offset


def pack(cut: DataFrame, length: int = LENGTH, most_open: int = 1_024, ahead: int = 1_000, pieces_per_bin_set: int = 100_000) -> DataFrame:
    """``cut`` (pieces, written by the caller) with ``sequence_id`` and ``offset``."""
    n = max(1, -(-cut.count() // pieces_per_bin_set))
    names = cut.columns
    # the table is written, so a row's number is the same whenever a task runs again
    dealt = cut.withColumn("number", F.monotonically_increasing_id())
    dealt = dealt.withColumn("order", F.xxhash64("doc_id", "piece", "ids_crc32", "number"))
    dealt = dealt.repartition(n, "order").sortWithinPartitions("order", "number").drop("order", "number")
    schema = T.StructType([*dealt.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from postlode.llm.common import partition_number

        fit, first = BestFit(length, most_open), partition_number() << 40
        for b in batches:
            for at in range(0, b.num_rows, ahead):
                some = b.slice(at, ahead)
                sizes = some.column(names.index("length")).to_numpy()
                order = np.argsort(-sizes, kind="stable")
                placed = np.empty((len(sizes), 2), np.int64)
                placed[order] = [fit.place(size) for size in sizes[order].tolist()]
                columns = [*some.columns, pa.array(placed[:, 0] + first), pa.array(placed[:, 1])]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return dealt.mapInArrow(each, schema)


def pack_documents(docs: DataFrame, **options) -> DataFrame:
    """Pieces of every document with their places in sequences."""
    return pack(materialise(pieces(docs), "pieces"), **options)
