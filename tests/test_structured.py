import html
import json

from pyspark.sql import functions as F

from postlode.functions.text import html_to_text, unescape
from postlode.sources import structured, threads
from postlode.sources.registry import parse_bool, read_sources


def page(*bodies, kind="application/ld+json"):
    scripts = "".join(f'<script type="{kind}">{b if isinstance(b, str) else json.dumps(b)}</script>' for b in bodies)
    return f"<html><head>{scripts}</head><body>x</body></html>"


ONE = {
    "@type": "JobPosting", "@id": "#oferta-7", "title": "Operadora de agentes LLM &ndash; turno  tarde", "validThrough": "2031-12-31", "datePosted": "2031-11-30",
    "hiringOrganization": {"@type": "EducationalOrganization", "name": " Liceo\tPacífico ", "url": "https://join.com/companies/liceo", "logo": "l.png"},
    "jobLocation": {"@type": "Place", "address": {"@type": "PostalAddress", "addressLocality": " Valparaíso", "addressRegion": "", "addressCountry": "CL"}},
    "description": "<ul><li>Cuida &lt;b&gt;agentes&lt;/b&gt;</li><li>de lunes a jueves</li></ul>",
    "baseSalary": {"@type": "MonetaryAmount", "currency": "CLP", "value": {"@type": "QuantitativeValue", "value": 1500000, "unitText": "MONTH"}},
}


def fields_of(spark, pages):
    """By page: the fields of its posting, None where it has none."""
    df = spark.createDataFrame([(i, p) for i, p in enumerate(pages)], "i int, html string")
    rows = structured.with_posting(df, "i").select("i", *[c.alias(n) for n, c in structured.posting_fields(F.col("p")).items()]).collect()
    got = {r.i: {k: v for k, v in r.asDict().items() if k != "i"} for r in rows}
    return [got.get(i) for i in range(len(pages))]


def test_fields_of_a_posting(spark):
    assert fields_of(spark, [page(ONE)]) == [
        {
            "title": "Operadora de agentes LLM – turno tarde", "company": "Liceo Pacífico", "location": "Valparaíso, CL", "remote_type": "",
            "description": "Cuida agentes de lunes a jueves", "date_posted": "2031-11-30", "salary": "CLP 1500000 MONTH",
        }
    ]


def test_where_postings_stand(spark):
    noise, second = {"@type": "FAQPage", "name": "JobPosting"}, {**ONE, "@type": ["Thing", "JobPosting"], "title": ["Otra", "y"]}
    deep = second
    for i in range(20):
        deep = [noise, deep] if i % 2 else {"@graph": deep}
    pages = [
        page({"@context": "x", "@graph": [noise, second, ONE]}),
        page("{not json, JobPosting", noise, [[[second]]], ONE),
        page(deep),
        page([noise, ONE, second]),
        page({**ONE, "@graph": [second]}),
        page(noise), page("[]"), "<p>JobPosting</p>", None, "", page(ONE, kind="application/json"),
    ]
    first = "Operadora de agentes LLM – turno tarde"
    assert [g and g["title"] for g in fields_of(spark, pages)] == ["Otra"] * 3 + [first] * 2 + [None] * 6


def test_fields_of_other_shapes(spark):
    cases = [
        ({"jobLocation": [], "jobLocationType": "telecommute"}, {"location": "Remote", "remote_type": "remote"}),
        ({"jobLocation": [{"address": {"addressLocality": "Arica", "addressRegion": "XV", "addressCountry": "CL"}}, {}]}, {"location": "Arica, XV"}),
        ({"jobLocation": {"address": "Arica"}}, {"location": "", "remote_type": ""}),
        ({"hiringOrganization": "Hnos. D&iacute;az"}, {"company": "Hnos. Díaz"}),
        (dict.fromkeys(("hiringOrganization", "title", "description", "baseSalary")), {"company": "", "title": "", "description": "", "salary": ""}),
        ({"baseSalary": {"currency": "CLP", "value": 700}}, {"salary": "CLP 700"}),
        ({"baseSalary": {"currency": "CLP", "value": {"minValue": 7, "maxValue": 9, "unitText": "HOUR"}}}, {"salary": "CLP 7-9 HOUR"}),
        ({"baseSalary": "mucho"}, {"salary": ""}),
    ]
    got = fields_of(spark, [page({**ONE, **change}) for change, _ in cases])
    for fields, (_, want) in zip(got, cases, strict=True):
        assert {k: fields[k] for k in want} == want


def test_stored_pages_become_postings(spark, tmp_path):
    at = "https://join.com/companies/"
    pages = [
        {"url": at + "liceo/7-llm?x=1", "status": 200, "html": page(ONE)},
        {"url": at + "liceo/7-llm", "status": 200, "html": page({**ONE, "title": "LLM otra vez"})},
        {"url": at + "gone/1-expired", "status": 410, "html": page(ONE)},
        {"url": at + "sales/2-exec", "status": 200, "html": page({**ONE, "title": "Senior Account Executive"})},
        {"url": at + "liceo", "status": 200, "html": page(ONE)},
        {"url": at + "bare/3-ai", "status": 200, "html": "<html></html>"},
    ]
    (tmp_path / "p.json").write_text(json.dumps(pages), encoding="utf-8")
    (row,) = read_sources(spark, {"join": str(tmp_path)}).collect()
    assert (row.job_title, row.company_name, row.location, row.job_url, row.company_size) == ("Operadora de agentes LLM – turno tarde", "Liceo Pacífico", "Valparaíso, CL", at + "liceo/7-llm", "unknown")
    heads = spark.createDataFrame([(at + "liceo", "<p>11 - 50 employees</p>"), (at + "liceo", ""), ("x", "9+ employees")], "url string, html string")
    stored = spark.createDataFrame([("f", i, p["url"], p["status"], p["html"]) for i, p in enumerate(pages)], "_file string, _at int, url string, status int, html string")
    (row,) = structured.page_postings(stored, heads).collect()
    assert (row.company_size, row.company_size_source) == ("11-50", "join.com company page")


THREAD = {
    "title": "Ask: Who is hiring? (June 2025)",
    "children": [
        {"text": 'Flow AI | <a href="https:&#x2F;&#x2F;flow.ai/jobs">flow.ai</a> | Remote (EU) | Senior AI Engineer<p>We build AI agent workflows with n8n.</p>'},
        {"text": "BoxCo | Berlin, Germany | ONSITE | Warehouse Associate<p>Pack and ship orders.</p>"},
        {"text": "A meta comment about AI without a pipe.<p>a | b</p>"},
        {"text": "*Scrib (Backed by X Capital) | Senior+ Engineers, Tech Lead | $175,000 - $300,000 | Munich, Germany<p>LLM tools, hybrid or remote."},
        {"text": "(https://only.url) | AI"}, {"dead": True}, {"text": None},
    ],
}


def test_thread_comments_become_postings(spark, tmp_path):
    (tmp_path / "1.json").write_text(json.dumps(THREAD), encoding="utf-8")
    (tmp_path / "2.json").write_text(json.dumps({**THREAD, "title": "Who wants to be hired?"}), encoding="utf-8")
    rows = read_sources(spark, {"hackernews": str(tmp_path)}).orderBy("_seq").collect()
    got = [(r.company_name, r.job_title, r.location, r.remote_type, r.job_url) for r in rows]
    assert got == [("Flow AI", "Senior AI Engineer", "", "remote", "https://flow.ai/jobs"), ("Scrib", "Engineers", "Munich, Germany", "hybrid", "")]


def test_latest_thread_is_the_hiring_one(spark):
    hits = {"hits": [{"objectID": "9", "title": "Who wants to be hired?"}, {"objectID": "7", "title": "Who is hiring?"}, {"objectID": "5", "title": "Who is hiring?"}]}
    answers = spark.createDataFrame([("f", json.dumps(hits))], "_file string, body string")
    assert [r.id for r in threads.latest_thread(spark, answers).collect()] == ["7"]


def test_thread_pieces(spark):
    cases = {"*Scribd": "Scribd", "NewCo (Backed by Sequoia Capital)": "NewCo", "Acme (https://acme.com)": "Acme", "Beta backed by all": "Beta", "https://x.y": ""}
    df = spark.createDataFrame(list(cases.items()), "v string, want string")
    assert all(r.got == r.want for r in df.select("want", threads.company(F.col("v")).alias("got")).collect())
    pieces = F.array(*[F.lit(x) for x in ("Senior+ Engineers, Tech Lead", "$175,000 - $300,000", "www.a.b, c", "Berlin, Germany")])
    assert spark.range(1).select(threads.location(pieces)).first()[0] == "Berlin, Germany"


def test_character_references_are_decoded_as_the_standard_library_does(spark):
    texts = ["&amp;lt; &#8211; &#x27;x&#X2014; &uuml;&Uuml;&nbsp;&rarr;", "&#128;&#150;&#0;&#xD800;&#99999999;&#99999999999999999999;&#xFFFFFFFFFFFFFFFFF; &amp &#39 &unknown; & &; &#; &#x; a&b", "plain", "", "&euro;&hellip;&apos;&copy;&NotEqualTilde;"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(unescape(F.col("t"))).collect()]
    assert got == [html.unescape(t) for t in texts]
    assert df.select(html_to_text(F.lit("<p>a&lt;b&gt;</p>&#8211;<br>c"))).first()[0] == "a<b> – c"


def test_switches():
    assert [parse_bool(x) for x in ("1", " Yes", "on", "TRUE", "y", True, "0", "", "no", False)] == [True] * 6 + [False] * 4
