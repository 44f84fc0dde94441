import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postlode.llm import packing
from postlode.llm.common import materialise

TEXTS = ["one two three", "", None, " \n\n  x\t", "<|endoftext|> é😀", "word " * 5000, "<" * 3000, "don't we'll 123 4567", "x" * 20_000, "a\r\nb   c "]


def slow_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))
    return t.encode(text or "", add_special_tokens=False).ids


@given(st.text(max_size=80))
@settings(max_examples=150, deadline=None)
def test_fast_encoder_agrees_with_the_library(text):
    e = packing.encoder(packing.TOKENIZER)
    assert e.fast is not None
    text = text.encode("utf-8", "ignore").decode()
    assert [*e(text)] == slow.encode(text, add_special_tokens=False).ids


from tokenizers import Tokenizer  # noqa: E402

slow = Tokenizer.from_file(packing.tokenizer_path(packing.TOKENIZER))


@pytest.mark.parametrize("most_open", [1, 5, 10_000])
def test_best_fit_against_a_plain_search(most_open):
    rng = random.Random(most_open)
    fit = packing.BestFit(100, most_open)
    open_, n = {}, 0
    for _ in range(3000):
        size = rng.randint(1, 100)
        b, at = fit.place(size)
        room = [v for v in open_.values() if v >= size]
        if room:
            assert open_[b] == min(room) and at == 100 - min(room)
        else:
            assert b == n and at == 0
            n += 1
            open_[b] = 100
            if size < 100 and len(open_) > most_open:
                gone = [k for k, v in open_.items() if v == min(v for j, v in open_.items() if j != b) and k != b]
                shut = [k for k in gone if k not in [x for s in fit.bins for x in s]]
                assert len(shut) == 1
                del open_[shut[0]]
        open_[b] -= size
        if not open_[b]:
            del open_[b]


def test_packing_is_a_round_trip(spark):
    texts = TEXTS + [f"text {i} " * (i * 17 % 300) for i in range(300)] + TEXTS[:2]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, piece int")
    rows = packing.pack_documents(docs).collect()
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_seq.setdefault(r.sequence_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, t in enumerate(texts):
        ids = np.array([*slow_ids(t), 2], dtype="<u4")
        got = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in got] == list(range(len(got)))
        assert len(got) == -(-len(ids) // 1024) and all(r.length == 1024 for r in got[1:])
        at = 0
        for r in got:
            assert r.start == at and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for got in by_seq.values():
        at = 0
        for r in sorted(got, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
    total = sum(r.length for r in rows)
    assert len(by_seq) <= 1.02 * total / 1024 + 2
    ids = packing.pieces(docs, with_ids=True).filter("doc_id = 0").first().ids
    assert ids == [*slow_ids(texts[0]), 2]


def test_special_token_strings_are_one_id(spark):
    text = "a <|endoftext|> b"
    ids = packing.pieces(spark.createDataFrame([(0, text)], "doc_id long, text string"), with_ids=True).first().ids
    assert ids == [64, 220, 50256, 275, 2]


def test_packing_equals_a_plain_search_in_hash_order(spark):
    docs = spark.createDataFrame([(i, f"text {i} " * (i * 37 % 301)) for i in range(700)], "doc_id long, text string")
    cut = materialise(packing.pieces(docs), "test")
    rows = packing.pack(cut, most_open=6, ahead=16).collect()
    number = cut.withColumn("number", F.monotonically_increasing_id()).selectExpr("doc_id", "piece", "xxhash64(doc_id, piece, ids_crc32, number) as h", "length").collect()
    arrive, open_, want, opened = sorted(number, key=lambda r: r.h), {}, {}, 0
    for at in range(0, len(arrive), 16):
        for r in sorted(arrive[at : at + 16], key=lambda r: -r.length):
            room = {b: v for b, v in open_.items() if v >= r.length}
            if room:
                space = min(room.values())
                want[r.doc_id, r.piece] = 1024 - space
                to = next(b for b, v in room.items() if v == space)
                open_[to] -= r.length
                if not open_[to]:
                    del open_[to]
            else:
                want[r.doc_id, r.piece] = 0
                opened += 1
                if r.length < 1024:
                    if len(open_) == 6:
                        del open_[min(open_, key=lambda b: (open_[b], b))]
                    open_[opened] = 1024 - r.length
    assert {(r.doc_id, r.piece): r.offset for r in rows} == want
    assert len({r.sequence_id for r in rows}) == opened


def test_equal_rows_spread(spark):
    docs = spark.createDataFrame([(5, "the same row again", "n", 0)] * 900, "doc_id long, text string, number string, order int")
    rows = packing.pack_documents(docs, pieces_per_bin_set=100).collect()
    tasks = [sum(r.sequence_id >> 40 == k for r in rows) for k in range(9)]
    assert len(rows) == 900 and max(tasks) < 200
    used = sorted({(r.sequence_id, r.offset) for r in rows})
    assert len(used) == 900


def test_empty_table(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []
