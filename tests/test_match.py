import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postlode.functions.match import Index, alone, has_substring, has_term, occurring


def by_terms(text, terms):
    bits = 0
    for n, (term, alone_) in enumerate(terms):
        if re.search(alone([term]), text) if alone_ else term in text:
            bits |= 1 << n
    return bits


def test_one_pass_finds_what_single_searches_find():
    rng = random.Random(1)
    parts = ["ai", "a", "ops", "n8", "n", "c+", "+", "no", "-co", "de", "уда", "л", "ß", " ", "ab", "c", ".", "1"]
    terms = [("ai", True), ("ai", False), ("aiops", False), ("a", True), ("n8n", True), ("c++", False), ("no-code", False), ("уда", True), ("удал", False), ("ß", False), ("ab", True), ("abc", False), (" c ", False)]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 9)))
        assert occurring(text, tuple(terms)) == by_terms(text, terms), text


@pytest.mark.parametrize("many", [1, 64, 300])
def test_masks_agree_with_plain_tests(spark, many):
    rng = random.Random(many)
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(1, 5))) or "x" for _ in range(many)]
    lists = [[rng.choice(words) for _ in range(4)] for _ in range(8)]
    texts = ["".join(rng.choice("abcdeé  ") for _ in range(rng.randint(0, 60))) for _ in range(150)] + ["", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i long, low string")
    index = Index()
    marked = index.on("_m_")
    tests = {f"t{k}": has_term(marked, x) for k, x in enumerate(lists)} | {f"s{k}": has_substring(marked, x) for k, x in enumerate(lists)}
    plain = {f"t{k}": has_term(F.col("low"), x) for k, x in enumerate(lists)} | {f"s{k}": has_substring(F.col("low"), x) for k, x in enumerate(lists)}
    searched, names = index.search(df, "_m_", "low")
    assert len(names) == index.count
    got = {r.i: r.asDict() for r in searched.select("i", *(c.alias(n) for n, c in tests.items())).collect()}
    want = {r.i: r.asDict() for r in df.na.fill({"low": ""}).select("i", *(c.alias(n) for n, c in plain.items())).collect()}
    assert got == want


def test_few_texts_reach_a_worker_at_once(spark):
    """3,000 rows of one partition come to Python in short batches, whatever the session had before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, "10000")
    try:
        index = Index()
        marked = has_term(index.on("_m_"), ["ai"])
        searched, _ = index.search(spark.range(3000, numPartitions=1).withColumn("low", F.lit("ai agent")), "_m_", "low")
        sizes = searched.filter(marked).select("id").mapInArrow(lambda batches: (pa.record_batch([pa.array([b.num_rows])], ["n"]) for b in batches), "n long")
        got = [r.n for r in sizes.collect()]
    finally:
        spark.conf.set(name, before)
    assert sum(got) == 3000 and max(got) <= 500
