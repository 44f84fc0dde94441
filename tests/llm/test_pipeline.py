import random

import pytest
from pyspark.sql import functions as F

from postlode.llm import mixing, quality
from tests.llm.test_copies import brute_kept
from tests.llm.test_packing import slow_ids
from tests.llm.test_secrets import brute as spans_of

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, folder):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 9)))
    texts = []
    for i in range(160):
        words = [word() for _ in range(rng.randint(20, 120))]
        texts.append(" ".join(words) + "." if i % 4 else " ".join(w + "###" for w in words))
    texts += [texts[1]] * 5 + [texts[2].replace("e", "E")] + [texts[3] + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end']
    texts += [None, "", "password: hunter2hunter2 " + texts[5]]
    texts += [" ".join(word() for _ in range(40)) + ' api_key="AKe93jdK3jdkW02lfmQz83kd" and so on.']
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 > 0), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows


def test_stages_and_run_match_brute_force(spark, tmp_path):
    rows = make(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    trees = quality.learn(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), ~quality.held_out(F.col("doc_id")))
    scores = {r.doc_id: r.score for r in quality.score(docs, trees).collect()}
    expect = [r for r in rows if scores[r[0]] >= 0.3]
    assert 100 < len(expect) < 160 and all(r[0] % 4 or r[0] >= 160 for r in expect)
    out = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/out{k}")
        docs = spark.read.parquet(f"{tmp_path}/out{k}")
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out[k] = [tuple(r) for r in docs.collect()]
    assert sorted(out[0], key=str) == sorted(expect, key=str)

    expect = [expect[i] for i in brute_kept([(r[0], r[1]) for r in expect])]
    assert len(expect) < len(out[0]) and sorted(out[1], key=str) == sorted(expect, key=str)

    masked = []
    for i, t, *rest, n in expect:
        text, at = "", 0
        found = [tuple(map(int, f.split(":")[1:])) for f in spans_of(t)[4].split(",") if f]
        for s, e in sorted(found):
            text += (t[at:s] + "[SECRET]") if s >= at else ""
            at = max(at, e)
        text = text + t[at:] if found else t
        masked.append((i, text, *rest, len(text) if found else n))
    assert sorted(out[2], key=str) == sorted(masked, key=str) and any("[SECRET]" in (r[1] or "") for r in masked)

    size = {r[0]: len((r[1] or "").split()) for r in masked}
    sources = sorted({r[3] for r in masked})
    totals = [sum(size[r[0]] for r in masked if r[3] == s) for s in sources]
    for s, want in zip(sources, mixing.targets(totals, [1, 2, 3]), strict=True):
        assert abs(sum(len(r[1].split()) for r in out[3] if r[3] == s) - want) <= 1
    original = {r[0]: r for r in masked}
    for r in out[3]:
        assert r[1] in original[r[0]][1] and r[2:4] == original[r[0]][2:4] and r[4] == len(r[1])
    assert max(sum(r[0] == i for r in out[3]) for i in size) == 2  # the third source is taken 1.5 times

    assert sum(r[3] for r in out[4]) == sum(len(slow_ids(r[1])) + 1 for r in out[3])
    fill = {}
    for r in out[4]:
        fill[r[5]] = fill.get(r[5], 0) + r[3]
    assert max(fill.values()) <= 1024
    assert len(fill) <= 1.05 * sum(fill.values()) / 1024 + 2
    whole = [tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert sorted(whole) == sorted(r[:5] for r in out[4])


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
