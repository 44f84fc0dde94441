"""The catalog's queries against their SQL twins, and its operators on small cases."""

from __future__ import annotations

import glob
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions import classify, match, pay, text
from postlode.functions.score import with_facts
from postlode.operators.barrier import seal
from postlode.operators.queries import search_queries
from postlode.plans.catalog import QUERIES, SQL
from postlode.schema import conform, text_blob

SF = "/root/testdata/sf0.001"
COMPARED = (
    "clean_field", "normalize_url", "html_to_text", "detect_location", "detect_remote", "company_size", "score_breakdown", "dedup_exact", "usage_monthly",
    "board_slugs", "guess_company", "bad_company", "board_lever", "board_flat", "search_postings", "page_postings", "thread_postings", "merge_description",
    "dedup_fuzzy", "collapse_titles", "similar_titles", "upsert_buckets", "scan_by_score", "usage_guard_stream", "fetch_answers", "fetch_breaker", "nested_postings",
    "board_searches", "board_list", "feed_of_companies", "feed_of_any_kind", "csv_rows", "search_engines", "page_boards", "discovered_boards", "dashboard_metrics",
)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


@pytest.mark.parametrize("name", COMPARED)
def test_query_equals_its_sql(spark, duck, name):
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    cursor = duck.execute(SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == columns
    expected = sorted(repr([row[names.index(c)] for c in columns]) for row in cursor.fetchall())
    assert sorted(repr([row[c] for c in columns]) for row in found.collect()) == expected


def test_index_agrees_with_direct_search(spark):
    lists = [("ai", "llm", "c++", "new york", "ии", "it's", "ki "), ("a i", "n8n", "agent", "agents"), ()]
    texts = ["", "ai", "paid", "main ai.", "xai9", "c++ in new york", "автоматизации ии", "it's a n8n_agent", "ai\u00e4", "ki", "the ki is", "\\llm'", "llmé"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("low", F.concat(F.lit(" "), F.lower("t"), F.lit(" ")))
    index = match.Index()
    marks = index.on("_m_")
    asked = [f(marks, terms).alias(f"x{i}{j}") for i, f in enumerate((match.has_term, match.has_substring)) for j, terms in enumerate(lists)]
    plain = [f(F.col("low"), terms).alias(f"y{i}{j}") for i, f in enumerate((match.has_term, match.has_substring)) for j, terms in enumerate(lists)]
    rows = index.search(df, "_m_", "low")[0].select("t", *asked, *plain).collect()
    for r in rows:
        assert [r[a] for a in r.asDict() if a[0] == "x"] == [r[a] for a in r.asDict() if a[0] == "y"], r
    many = match.Index()
    found = match.has_term(many.on("_n_"), [f"term{i:03}x" for i in range(200)])
    one, masks = many.search(spark.createDataFrame([(" term199x ",), (" none ",)], "low string"), "_n_", "low")
    assert len(masks) == many.count == 4
    assert [r.x for r in one.select(found.alias("x")).collect()] == [True, False]


def test_plans_search_each_term_once(spark):
    for name in ("relevance_score", "detect_skills"):
        plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        searched = re.findall(r"Contains\((\w+)#\d+, ([^)]*)\)", plan)
        repeated = [x for x in set(searched) if searched.count(x) > 1 and x[0] in ("_low", "_text", "_low_words", "_text_words", "_title", "_title_words")]
        assert not repeated
        # one pass for the whole text and one for the place, then one for text and title
        assert plan.count("ArrowEvalPython") <= 4


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def test_seal_keeps_rows_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 3)], "x int, y string, z int")
    sealed = seal(df, "y")
    assert sealed.columns == df.columns
    assert sorted(sealed.collect(), key=lambda r: r.x) == sorted(df.collect(), key=lambda r: r.x)


def test_search_queries_are_numbered_without_gaps(spark):
    places = [r.place for r in search_queries(spark).orderBy("place").collect()]
    assert places == list(range(1, len(places) + 1))


def test_text_functions_on_edges(spark):
    df = spark.createDataFrame([("",), ("  a \t b ",)], "v string")
    assert [r[0] for r in df.select(text.clean_field(F.col("v"))).collect()] == ["", "a b"]


def test_size_limit(spark):
    df = spark.createDataFrame([("1,001+",), ("1-50",), ("unknown",)], "v string")
    assert [r[0] for r in df.select(classify.exceeds_employees(F.col("v"))).collect()] == [True, False, False]


def test_places_by_whole_value_or_by_every_part(spark):
    cases = {"Egypt": True, "Cairo": True, "Cairo, Egypt": True, "Remote": True, "London Fintech Ltd": False, "FlowPilot AI": False, "": False}
    df = spark.createDataFrame([(v,) for v in cases], "v string")
    found = {r.v: r.place for r in df.select("v", classify.is_place(F.col("v")).alias("place")).collect()}
    assert found == cases


@pytest.mark.parametrize("name", ["filter_dashboard", "company_overlap", "pipeline_counters"])
def test_scores_are_computed_once(spark, name):
    """What a sort or several branches read is no longer computed by them: no search is left in the plan."""
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def whole_plan(spark, name):
    limit = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "10000")
    try:
        return QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set(limit, before)


@pytest.mark.parametrize("name", ["presenter", "dashboard_pickers", "compensation"])
def test_pay_patterns_pass_over_a_text_once(spark, name):
    """Each of the five patterns stands in the plan once, however many answers ask for its matches."""
    plan = whole_plan(spark, name)
    assert [plan.count(f"(?U){p}, 0)") for p in pay.NEEDED] == [1] * 5


def test_pay_is_the_same_by_marks_and_by_text(spark):
    texts = ["", "50.000 EUR year", "3.900 eur month, 40 hours", "EUR 60k p.a.", "20 Stunden pro Woche", "38 std/week, 45k EUR jaehrlich", "week 12 hours 100 annum", "nothing 12", "4 monat, 90 jahr", "İ 50k year Σ"]
    rows = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate([*((t, "") for t in texts), *(("", t) for t in texts), *zip(texts, texts[::-1])])], "i int, salary string, job_description string")
    facts = with_facts(conform(rows, "i"))
    plain = pay.read(conform(rows, "i").withColumn("t", pay.searched(F.col("salary"), text_blob())), "paid", "t")
    want = {r.i: r.paid for r in plain.select("i", "paid").collect()}
    assert {r.i: r._paid for r in facts.select("i", "_paid").collect()} == want
    assert {r.salary_target_met for r in want.values()} == {r.hours_target_met for r in want.values()} == {"yes", "no", "unknown"}


def test_size_patterns_and_places_are_read_once(spark):
    """No rule of sizes or places does its searches anew, nor lowers the text for them."""
    pickers, presenter = whole_plan(spark, "dashboard_pickers"), whole_plan(spark, "presenter")
    assert [pickers.count(f"(?U){p}, 0)") for p in lx.SIZE_PATTERNS] == [1] * 3
    assert "lower(coalesce(_text" not in pickers and "lower(_text" in pickers
    assert presenter.count(r"\p{L}+|[^\p{L}]+, 0)") == 1


def test_fields_are_cleaned_alike_with_and_without_odd_characters(spark):
    """Every character of the ranges that decide, beside spaces, tabs and newlines, against the definition in Python."""
    odd = [chr(c) for c in (*range(0x100), 0x167F, 0x1680, 0x1681, 0x180E, *range(0x1FFF, 0x2030), 0x205E, 0x205F, 0x2060, 0x2FFF, 0x3000, 0x3001, 0x400, 0xFEFF, 0xFFFD, 0x1F600)]
    around = ["a{}b", "{}", " a {} b\n", "\t{}\n{}c  d", "a\n{}\n\nb", "é{}  ü"]
    texts = [t.format(c, c) for c in odd for t in around] + ["", " ", "\n", "a \n b\t\tc", "  a  ", None]
    white = r"[\t-\r\x1c-\x1f \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"
    clean = lambda t: None if t is None else re.sub(white, " ", re.sub("[\x00-\x08\x0b-\x1f\ufffd]", "", t)).strip(" ")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", text.clean_field(F.col("t")).alias("c")).collect()}
    assert [(texts[i], c) for i, c in got.items() if c != clean(texts[i])] == []
