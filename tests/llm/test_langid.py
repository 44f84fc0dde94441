import itertools
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from postlode.llm import langid

PARTS = {"aa": ["the", "ing", "th", "er", "and", "sh"], "bb": ["der", "sch", "ung", "ein", "ich", "keit"], "cc": ["que", "ción", "ado", "los", "mente", "ño"]}


def text(rng, lang, n):
    return " ".join("".join(rng.choice(PARTS[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus(n=240):
    rng = random.Random(0)
    return [(i, text(rng, lang := list(PARTS)[i % 3], rng.randint(1, 90)), lang) for i in range(n)]


@pytest.mark.parametrize("window", [1, 2, 3, 50])
def test_marginals_match_enumeration(window):
    rng = np.random.default_rng(window)
    lengths = np.array([5, 1, 7, 2, 3])
    e, a = rng.random((lengths.sum(), 3)) + 0.01, rng.random((3, 3)) + 0.01
    got, at = langid.marginals(e, lengths, a, window), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            p = a[:, path[0]].sum() * e[at, path[0]]
            for i in range(1, n):
                p *= a[path[i - 1], path[i]] * e[at + i, path[i]]
            for i, label in enumerate(path):
                want[i, label] += p
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_long_chain_is_stable():
    e = np.full((20_000, 2), 0.5)
    e[:10_000, 0], e[10_000:, 1] = 1e-3, 1e-3
    p = langid.marginals(e, np.array([20_000]), np.array([[0.9, 0.1], [0.1, 0.9]]))
    assert np.isfinite(p).all() and (p[:9_990, 1] > 0.9).all() and (p[10_010:, 0] > 0.9).all()


def test_gradient_parts_match_enumeration():
    rng = np.random.default_rng(1)
    e, a = rng.random((2, 4, 2)), rng.random((2, 2))
    word, pairs = langid._pair_sums(e, a)
    both = np.zeros((2, 2))
    for s in range(2):
        z = 0
        part = np.zeros((2, 2))
        for path in itertools.product(range(2), repeat=5):  # the first is the label before the text
            p = np.prod([a[x, y] * e[s, i, y] for i, (x, y) in enumerate(zip(path, path[1:], strict=False))])
            z += p
            for x, y in zip(path, path[1:], strict=False):
                part[x, y] += p
        both += part / z
    assert np.allclose(pairs, both)
    assert np.allclose(word, langid.marginals(e.reshape(8, 2), np.array([4, 4]), a).reshape(2, 4, 2))


def test_held_out_accuracy_and_code_switching(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    field = langid.learn(docs, ~langid.held_out(F.col("doc_id")), steps=120)
    assert field.labels == ("aa", "bb", "cc")
    rng = random.Random(9)
    odd = [(900, None, "aa"), (901, "", "bb"), (902, "123 --- 4!", None), (903, text(rng, "aa", 10) + " " + text(rng, "cc", 400), None), (904, text(rng, "bb", 30_000), None), (905, "ЖЖ", None)]
    out = {r.doc_id: r for r in langid.predict(docs.union(spark.createDataFrame(odd, docs.schema)), field, at_once=2_000).collect()}
    assert len(out) == len(rows) + len(odd)
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(out[i].lang_pred == lang for i, lang in held) >= 0.97 * len(held) > 50
    assert [out[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and out[902].score == 0
    assert out[903].lang_pred == "cc" and 0.9 < out[903].score < 1
    assert out[904].lang_pred == "bb" and out[905].lang_pred in field.labels
    words = text(rng, "aa", 40).split() + text(rng, "bb", 40).split()
    p = langid.marginals(field.emissions(words), np.array([80]), np.exp(field.transitions))
    assert (p[:40].argmax(axis=1) == 0).mean() > 0.9 and (p[40:].argmax(axis=1) == 1).mean() > 0.9


def test_every_part_of_every_text_is_drawn_alike(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(langid, "fit", lambda spans, **_: seen.append(spans))
    late = "early " * 5_000 + "late " * 15_000
    docs = spark.createDataFrame([(0, late, "aa", 0.5)] + [(i, "copy of a text", "zz", 0.5) for i in range(1, 900)] + [(999, "ende gut", "zz", 0.5)], "doc_id long, text string, lang string, share double")
    langid.learn(docs, F.lit(True), rows=20)
    (spans,) = seen
    count = {lang: sum(x == lang for x, _ in spans) for lang in ("aa", "zz")}
    assert 5 < count["aa"] <= 20 and count["zz"] == 2
    words = [w for lang, ws in spans if lang == "aa" for w in ws]
    assert set(words) == {"early", "late"} and words.count("late") > words.count("early")
    with pytest.raises(ValueError):
        langid.learn(docs.withColumn("lang", F.col("doc_id").cast("string")), F.lit(True))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "words here", None)], "doc_id long, text string, lang string")
    field = langid.learn(docs, F.lit(True))
    assert [(r.lang_pred, r.score) for r in langid.predict(docs, field).collect()] == [("und", 0.0)]
    assert langid.predict(docs.filter("false"), field).collect() == []


def test_all_letters_of_a_long_word_count(spark, monkeypatch):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    field = langid.learn(docs, ~langid.held_out(F.col("doc_id")), steps=120)
    rng = random.Random(4)
    join = lambda first, then, by: by.join((text(rng, first, 30) + " " + text(rng, then, 1_500)).split()) + by + "".join(text(rng, first, 3).split())
    long = [(1, join("aa", "bb", "_"), None), (2, join("bb", "cc", "/"), None), (3, join("cc", "aa", "\u200b"), None)]
    out = langid.predict(spark.createDataFrame(long, docs.schema), field).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "bb", 2: "cc", 3: "aa"}
    words = ["the", "x" * 90, *text(rng, "bb", 50).split()]
    whole = field.emissions(words)
    monkeypatch.setattr(langid, "AT_ONCE", 7)
    assert np.allclose(field.emissions(words), whole)


def test_texts_without_white_space_teach_and_are_told(spark):
    """A language whose texts are of one unspaced run, longer than a passage; some are joined by marks instead."""
    rng = random.Random(6)
    signs = [chr(0x4E00 + 7 * i) for i in range(300)]
    spaced = lambda i: (i, text(rng, "aa", 900), "en")
    unspaced = lambda i: (i, ("。" if i % 3 else "").join("".join(rng.choice(signs) for _ in range(60)) for _ in range(100)), "zh")
    joined = lambda i: (i, "_".join(text(rng, "bb", 900).split()), "de")
    docs = spark.createDataFrame([(spaced, unspaced, joined)[i % 3](i) for i in range(240)], "doc_id long, text string, lang string")
    assert docs.filter("lang <> 'en'").selectExpr("min(length(text))").first()[0] > 4_000
    field = langid.learn(docs, ~langid.held_out(F.col("doc_id")), steps=120)
    assert field.labels == ("de", "en", "zh")
    out = langid.predict(docs, field).join(docs, "doc_id").filter(langid.held_out(F.col("doc_id"))).collect()
    assert len(out) > 50 and all(r.lang_pred == r.lang for r in out)


def test_elements_keep_every_letter():
    for t in ("", " ", "a b", "x" * 39, "x" * 40 + " y", "ab" * 1_000 + " c " + "d" * 41):
        got = langid.elements(t)
        assert "".join(got) == "".join(t.split()) and max(map(len, got), default=0) <= langid.WIDEST


def test_one_word_of_ten_megabytes(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string, lang string")
    field = langid.learn(docs, F.lit(True), steps=60)
    long = spark.range(1).selectExpr("id as doc_id", "repeat('schung', 1700000) as text", "cast(null as string) as lang")
    assert [r.lang_pred for r in langid.predict(long, field).collect()] == ["bb"]
