import pytest
from pyspark.sql import functions as F

from postlode.functions.classify import exceeds_employees
from postlode.functions.score import score
from postlode.operators.enrich import enrich
from postlode.plans import pipeline
from postlode.sources.registry import read_sources


@pytest.fixture(scope="module")
def rows(spark):
    return read_sources(spark, {"mock": ""})


def test_scores_of_the_literal_rows(spark, rows):
    got = {r.job_title: r for r in score(enrich(rows)).collect()}
    points = {t: r.relevance_score for t, r in got.items()}
    assert points["Junior AI Automation Specialist"] >= 80 and got["Junior AI Automation Specialist"].priority_level == "urgent"
    assert points["MCP Integration Engineer"] >= 70 and points["AI Automation Engineer"] >= 70
    assert points["AI Workflow Specialist"] < points["Junior AI Automation Specialist"]
    assert points["Senior QA Automation Engineer"] < 50 and points["Graphic Designer - AI Content"] == 0


def test_large_company_is_removed(spark, rows):
    kept = enrich(rows).filter(~exceeds_employees(F.col("company_size")))
    assert "AI Automation Engineer" not in [r.job_title for r in kept.collect()] and kept.count() == 5


def test_run_over_the_literal_rows(spark, rows):
    out = pipeline.in_rank_order(pipeline.run(rows).exportable).collect()
    assert [r.job_title for r in out][:2] == ["Junior AI Automation Specialist", "MCP Integration Engineer"]
    assert all(r.relevance_score >= 60 for r in out)


def test_limit_keeps_the_first_rows(spark):
    assert [r.job_title for r in read_sources(spark, {"mock": ""}, limit=2).orderBy("_seq").collect()] == ["Junior AI Automation Specialist", "MCP Integration Engineer"]
