import json
import zipfile
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from postlode.operators import office, sinks
from postlode.operators.queries import discover, discovery_queries
from postlode.operators.reports import present
from postlode.schema import conform

STAMP = "2025-01-01T00:00:00+00:00"


def records(spark):
    rows = [
        ("Keep <&> Co\x01", "Junior AI Specialist", 90, "urgent", "11-50", "50.000 EUR year, 36 hours", "a  b", 0),
        ("Drop Co", "AI Workflow Specialist", 70, "high", "unknown", "", "é" * 2000, 1),
        ("Huge", "AI Engineer", 65, "medium", "1,001+", "", "", 2),
    ]
    names = "company_name string, job_title string, relevance_score int, priority_level string, company_size string, salary string, job_description string, _seq long"
    return present(conform(spark.createDataFrame(rows, names), "_seq"), STAMP, "_seq").orderBy("_seq").drop("_seq")


def test_workbook_is_read_back(spark, tmp_path):
    path = f"file://{tmp_path}/x.xlsx"
    office.write_workbook(records(spark), path)
    got = office.read_reviewed(spark, path, include_dismissed=True).orderBy("_seq").collect()
    assert [r.company for r in got] == ["Keep <&> Co", "Drop Co"] and [r.score for r in got] == [90, 70]
    assert got[0].salary_target_met == "yes" and got[1].description.endswith("...") and got[0].search_run_at == STAMP
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        assert z.testzip() is None
        for n in z.namelist():
            ElementTree.fromstring(z.read(n))
        book = z.read("xl/workbook.xml").decode()
        assert 'name="Overview"' in book and 'name="Job Details"' in book
        sheet = z.read("xl/worksheets/sheet2.xml").decode()
    assert [office.letters(i) for i in (1, 26, 27, 41, 703)] == ["A", "Z", "AA", "AO", "AAA"]
    assert 'sqref="AO2:AO4"' in sheet and "OR($AO2=" in sheet.replace("&quot;", '"')


def edited(tmp_path, name, change):
    with zipfile.ZipFile(tmp_path / "x.xlsx") as z:
        parts = {n: z.read(n).decode() for n in z.namelist()}
    parts["xl/worksheets/sheet2.xml"] = change(parts["xl/worksheets/sheet2.xml"])
    with zipfile.ZipFile(tmp_path / name, "w") as z:
        for n, text in parts.items():
            z.writestr(n, text)
    return f"file://{tmp_path}/{name}"


def test_dismissed_rows_and_missing_columns(spark, tmp_path):
    office.write_workbook(records(spark), f"file://{tmp_path}/x.xlsx")
    said = lambda v: f'<is><t xml:space="preserve">{v}</t></is></c>'
    gone = edited(tmp_path, "y.xlsx", lambda s: s.replace('<c r="AO3" s="0" t="inlineStr">' + said("no"), '<c r="AO3" s="0" t="inlineStr">' + said(" Yes")))
    assert [r.company for r in office.read_reviewed(spark, gone).collect()] == ["Keep <&> Co"]
    assert office.read_reviewed(spark, gone, True).count() == 2
    with pytest.raises(ValueError, match="Dismissed"):
        office.read_reviewed(spark, edited(tmp_path, "z.xlsx", lambda s: s.replace("Dismissed?", "Other")))
    document = f"file://{tmp_path}/d.docx"
    office.write_document(office.read_reviewed(spark, gone), document)
    text = zipfile.ZipFile(tmp_path / "d.docx").read("word/document.xml").decode()
    assert "Keep &lt;&amp;&gt; Co" in text and "Drop Co" not in text and "Dismissed" not in text


def test_document_and_empty_reports(spark, tmp_path):
    office.write_document(records(spark), f"file://{tmp_path}/a.docx")
    text = "".join(ElementTree.fromstring(zipfile.ZipFile(tmp_path / "a.docx").read("word/document.xml")).itertext())
    assert "1. Junior AI Specialist" in text and "Score 90" in text and "Average Score75.0" in text and "Next step" not in text
    none = records(spark).filter("false")
    office.write_document(none, f"file://{tmp_path}/b.docx", today="2025-01-02")
    assert "No postings" in zipfile.ZipFile(tmp_path / "b.docx").read("word/document.xml").decode()
    office.write_workbook(none, f"file://{tmp_path}/b.xlsx")
    assert office.read_reviewed(spark, f"file://{tmp_path}/b.xlsx").count() == 0
    with pytest.raises(ValueError):
        office.bounded(records(spark), most=2)


def test_small_state_files(spark, tmp_path):
    at = f"file://{tmp_path}/s.yaml"
    stored = spark.createDataFrame([("greenhouse", ["existing", "no"])], "provider string, slugs array<string>")
    sinks.write_slugs(stored, at)
    answers = [{"query": "q", "data": {"organic_results": [{"link": u} for u in ("https://jobs.lever.co/Acme/x", "https://boards.greenhouse.io/newco/jobs/1", "https://news.org")]}}]
    captured = spark.createDataFrame([("f", json.dumps(a)) for a in answers], "_file string, body string")
    found = {r.provider: r for r in discover(captured, sinks.read_slugs(spark, at)).collect()}
    assert found["greenhouse"].merged == ["existing", "newco", "no"] and found["greenhouse"].added == ["newco"] and found["lever"].added == ["acme"]
    sinks.write_slugs(discover(captured, sinks.read_slugs(spark, at)).selectExpr("provider", "merged as slugs"), at)
    back = {r.provider: r.slugs for r in sinks.read_slugs(spark, at).collect()}
    assert back == {"greenhouse": ["existing", "newco", "no"], "lever": ["acme"]}
    assert sinks.read_slugs(spark, at + "x").count() == 0
    usage = spark.createDataFrame([("2025-01", "a", 3), ("2024-12", "a", 9)], "month string, provider string, used bigint")
    sinks.write_usage(usage, f"file://{tmp_path}/u.json", "2025-01")
    sinks.write_usage(usage, f"file://{tmp_path}/u.json", "2025-01")
    assert [tuple(r) for r in sinks.read_usage(spark, f"file://{tmp_path}/u.json", "2025-01").collect()] == [("2025-01", "a", 3)]
    assert sinks.read_usage(spark, f"file://{tmp_path}/u.json", "2025-02").count() == 0
    sinks.write_captures(spark.createDataFrame([(1, 'site:x "AI"', '{"a": 1}')], "place int, query string, data string"), f"file://{tmp_path}/c")
    assert json.loads((tmp_path / "c" / "01_site_x_ai.json").read_text()) == {"query": 'site:x "AI"', "data": {"a": 1}}
    assert sinks.write_sheets(usage) is False and sinks.write_notes(usage) is False


def test_discovery_is_capped_and_spans_boards():
    every = discovery_queries(99)
    assert len(every) == 5 and every[0] == 'site:boards.greenhouse.io "AI engineer"' and every[4] == 'site:boards.greenhouse.io "AI automation"'


def test_console_lines(spark):
    rows = conform(spark.createDataFrame([("Bücher\n AI", 7, 0), ("x" * 99, 9, 1)], "job_title string, relevance_score int, _seq long"), "_seq")
    assert sinks.top_lines(rows) == ["1.   9  " + "x" * 80 + " |  | ", "2.   7  Bcher AI |  | "]


def test_boards_share_one_limit_in_order(spark, tmp_path):
    from postlode.sources.registry import read_sources

    for board, names in (("greenhouse", ("b", "a")), ("lever", ("c",))):
        (tmp_path / board).mkdir()
        for n in names:
            jobs = [{"title": f"AI {n}{i}", "text": f"AI {n}{i}"} for i in range(2)]
            (tmp_path / board / f"{n}.json").write_text(json.dumps({"jobs": jobs} if board == "greenhouse" else jobs))
    for board in ("ashby", "workable"):
        (tmp_path / board).mkdir()
        (tmp_path / board / "z.json").write_text("{}")
    got = read_sources(spark, {"ats": str(tmp_path)}, limit=5).orderBy("_seq").collect()
    assert [r.job_title for r in got] == ["AI a0", "AI a1", "AI b0", "AI b1", "AI c0"]
    from postlode.sources.boards import ats

    listed = ats(spark, str(tmp_path), {"greenhouse": ["b", "none", "a"], "lever": []}).orderBy("_file", "_at").collect()
    assert [r.job_title for r in listed] == ["AI b0", "AI b1", "AI a0", "AI a1"]
