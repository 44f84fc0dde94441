import json

from pyspark.sql import functions as F

from postlode.plans import catalog
from postlode.schema import COLUMNS, conform
from postlode.sources import boards, captures, feeds
from postlode.sources.registry import read_sources
from postlode.state import PostingTable
from postlode.streaming.incremental import guarded_calls, monthly_calls, track


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(folder)


def test_flat_board_skips_notices_and_formats_pay(spark, tmp_path):
    items = [
        {"legal": "notice"}, "text",
        {"position": "AI Agent Engineer", "company": "A", "tags": ["llm", "python"], "salary_min": 10, "salary_max": 20, "description": "<p>Build&nbsp;agents</p>"},
        {"position": "Cook", "location": None, "salary_min": 5},
    ]
    rows = boards.remoteok(spark, put(tmp_path / "a", "x.json", items)).collect()
    assert [(r.job_title, r.salary, r.required_skills, r.job_description, r.location) for r in rows] == [("AI Agent Engineer", "10-20", "llm, python", "Build agents", "Remote")]


def test_searches_give_each_address_once(spark, tmp_path):
    path = put(tmp_path / "r", "1.json", {"jobs": [{"title": "A", "url": "u"}, {"title": "B", "url": "v"}]})
    put(tmp_path / "r", "2.json", {"jobs": [{"title": "C", "url": "u"}]})
    put(tmp_path / "r", "3.json", "not json")
    assert sorted(r.job_title for r in boards.remotive(spark, path).collect()) == ["A", "B"]


def test_company_boards(spark, tmp_path):
    g = put(tmp_path / "g", "acme-labs.json", {"jobs": [{"title": "AI Engineer", "location": {"name": "Berlin"}, "content": "<b>x</b>"}, {"title": "Cook"}]})
    v = put(tmp_path / "l", "beta.json", [{"text": "Automation Lead", "categories": {"location": "Paris", "team": "Ops"}, "applyUrl": "u", "createdAt": 5}])
    s = put(tmp_path / "s", "c.json", {"jobs": [{"title": "ML Engineer", "isRemote": True, "descriptionHtml": "<i>h</i>"}]})
    w = put(tmp_path / "w", "d.json", {"name": "Delta", "jobs": [{"title": "LLM Engineer", "city": "Rome", "country": "Italy", "workplace_type": "Hybrid"}]})
    rows = read_sources(spark, {"greenhouse": g, "lever": v, "nobody": "", "ashby": s, "workable": w, "yc": ""}).orderBy("_seq").collect()
    got = [(r._seq, r.company_name, r.location, r.remote_type, r.source_platform, r.job_description) for r in rows]
    assert got == [
        (0, "Acme Labs", "Berlin", "unknown", "greenhouse:acme-labs", "x"),
        (1, "Beta", "Paris", "unknown", "lever:beta", "Ops"),
        (2, "C", "", "remote", "ashby:c", "h"),
        (3, "Delta", "Rome Italy", "hybrid", "workable:d", ""),
    ]


def test_feeds(spark, tmp_path):
    items = (
        "<item><title>Acme: AI Engineer</title><link>http://a/1</link><region>EU</region><description>&lt;p&gt;Hi&lt;/p&gt;</description></item>"
        "<item><title>KI Spezialist:in LLM</title><link>http://a/2</link><dc:creator>Beta</dc:creator></item>"
        "<item><title>LLM Engineer at Gamma</title><link>http://a/3</link></item><item><title>Cook</title></item>"
    )
    path = put(tmp_path / "f", "www.feed.org.xml", f'<rss xmlns:dc="http://d"><channel>{items}</channel></rss>')
    got = sorted((r.job_url, r.company_name, r.job_title, r.location, r.source_platform) for r in feeds.rss(spark, path).collect())
    assert got == [
        ("http://a/1", "Acme", "AI Engineer", "EU", "rss:feed.org"),
        ("http://a/2", "Beta", "KI Spezialist:in LLM", "Remote", "rss:feed.org"),
        ("http://a/3", "Gamma", "LLM Engineer", "Remote", "rss:feed.org"),
    ]
    assert sorted((r.company_name, r.job_title) for r in feeds.weworkremotely(spark, path).collect())[0] == ("", "LLM Engineer at Gamma")


def test_a_link_gone_for_one_answer_stays_in_another(spark, tmp_path):
    """Two pages of one address, of which one is gone; the query names a page's status by its answer."""
    rows = [(5, "https://acme.dev/x/1"), (7, "https://acme.dev/x/1"), (10, "https://b.dev/x/2"), (11, "https://c.dev/x/3")]
    spark.createDataFrame(rows, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = catalog.QUERIES["search_postings"](spark, str(tmp_path))
    assert sorted(r.job_url for r in got.collect()) == ["https://acme.dev/x/1", "https://c.dev/x/3"]


def test_captures_drop_noise_and_dead_links(spark, tmp_path):
    found = [{"title": "AI Engineer at Acme", "link": "https://acme.dev/x/1", "snippet": "Remote Germany"}, {"title": "gone", "link": "https://b.dev/x/2"}, {"title": "", "link": "x"}]
    path = put(tmp_path / "c", "01.json", {"query": '"AI" "Berlin"', "data": {"organic_results": found}})
    status = spark.createDataFrame([("https://b.dev/x/2", 404)], "link string, status int")
    (row,) = captures.search_results(spark, path, status=status).collect()
    assert (row.company_name, row.location, row.source_platform) == ("Acme", "Remote Germany", "serpapi:acme.dev")
    brave = put(tmp_path / "b", "1.json", {"web": {"results": [{"title": "AI Engineer at Acme", "url": "https://acme.dev/x/1"}]}})
    assert captures.search_results(spark, brave, "brave").count() == 1


def test_csv_and_no_source(spark, tmp_path):
    rows = feeds.manual(spark, put(tmp_path / "m", "m.csv", 'job_title,salary\n"AI, Engineer",\n')).collect()
    assert [(r.job_title, r.salary, r.relevance_score) for r in rows] == [("AI, Engineer", "", 0)]
    empty = read_sources(spark, {})
    assert empty.count() == 0 and set(COLUMNS) < set(empty.columns)


def test_stream_upserts_all_and_reports_new_rows(spark, tmp_path):
    table, fresh = PostingTable(spark, str(tmp_path / "t")), []
    source = str(tmp_path / "in")
    for n, urls in enumerate((["http://a/1", "http://a/2"], ["http://a/2", "http://a/3"])):
        rows = spark.createDataFrame([(u, f"t{n}", i) for i, u in enumerate(urls)], "job_url string, job_title string, _seq long")
        rows.write.mode("append").parquet(source)
        stream = spark.readStream.schema("job_url string, job_title string, _seq long").parquet(source)
        track(conform(stream, "_seq"), table, lambda d, _: fresh.append(sorted(r.job_url for r in d.collect())), str(tmp_path / "cp")).awaitTermination()
    assert fresh == [["http://a/1", "http://a/2"], ["http://a/3"]]
    assert sorted((r.job_url, r.job_title) for r in table.read().collect()) == [("http://a/1", "t0"), ("http://a/2", "t1"), ("http://a/3", "t1")]


def test_monthly_calls(spark):
    calls = spark.sql("SELECT 'p' AS provider, timestamp'2025-01-31 23:00:00' AS ts UNION ALL SELECT 'p', timestamp'2025-02-01 00:00:00'")
    assert sorted(tuple(r) for r in monthly_calls(calls).collect()) == [("2025-01", "p", 1), ("2025-02", "p", 1)]


def files(folder):
    return {str(p.relative_to(folder)): p.stat().st_mtime_ns for p in folder.rglob("rows/**/*.parquet")}


def test_a_batch_rewrites_its_buckets_only(spark, tmp_path):
    table = PostingTable(spark, str(tmp_path / "t"), buckets=8)
    urls = [f"http://a/{i}" for i in range(60)]
    rows = lambda some, title, score: conform(
        spark.createDataFrame([(u, u, title, score, i) for i, u in enumerate(some)], "job_url string, deduplication_key string, job_title string, relevance_score int, _seq long"), "_seq"
    )
    table.upsert(rows(urls, "one", 40))
    before, ids = files(tmp_path / "t"), {r.job_url: r.id for r in table.read().collect()}
    assert sorted(ids.values()) == list(range(1, 61))
    held = table.manifest()[0]
    table.upsert(rows(["http://a/7", "http://new"], "two", 90))
    after = table.manifest()[0]
    changed = {b for b in after if after[b] != held.get(b)}
    assert 1 <= len(changed) <= 2
    new = {f: t for f, t in files(tmp_path / "t").items() if f not in before}
    assert all(files(tmp_path / "t")[f] == t for f, t in before.items()) and {int(f.split("_bucket=")[1].split("/")[0]) for f in new} == changed
    got = {r.job_url: (r.id, r.job_title) for r in table.read().collect()}
    assert got == {**{u: (ids[u], "one") for u in urls}, "http://a/7": (ids["http://a/7"], "two"), "http://new": (61, "two")}
    table.set_status(ids["http://a/9"], "applied")
    assert [r.job_url for r in table.read().filter("application_status = 'applied'").collect()] == ["http://a/9"]
    assert len([b for b, v in table.manifest()[0].items() if v != after[b]]) == 1
    best = table.at_least(80)
    assert {r.job_url for r in best.collect()} == {"http://a/7", "http://new"}
    scan = best._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_band" in scan or "_band" in scan.split("PartitionFilters:")[1].split("]")[0]
    read = spark.read.option("basePath", f"{tmp_path}/t/rows").parquet(*[f"{tmp_path}/t/rows/version={v}/_bucket={b}" for b, v in table.manifest()[0].items()])
    assert {r[0].split("_band=")[1].split("/")[0] for r in read.filter("_band >= 8").select("_metadata.file_path").distinct().collect()} == {"9"}
    assert set(table.at_least(0).collect()) >= set(best.collect())


def test_guard_starts_anew_each_month_and_keeps_its_count_between_batches(spark, tmp_path):
    schema = "event_id long, provider string, ts timestamp"
    batches = [
        [(1, "p", "2025-01-30 10:00:00"), (2, "p", "2025-01-30 09:00:00"), (3, "q", "2025-01-30 09:00:00")],
        [(4, "p", "2025-01-31 10:00:00"), (5, "p", "2025-02-01 00:00:00"), (6, "p", "2025-02-01 00:00:01")],
        [(7, "p", "2025-02-03 00:00:00"), (8, "p", "2025-02-02 00:00:00"), (9, "q", "2025-02-02 00:00:00")],
    ]
    for n, rows in enumerate(batches):
        df = spark.createDataFrame(rows, "event_id long, provider string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        writer = guarded_calls(stream, {"p": 4}, 0.75).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        writer.trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = spark.read.schema("event_id long, provider string").parquet(str(tmp_path / "out")).collect()
    assert sorted(r.event_id for r in got) == [1, 2, 3, 4, 5, 6, 8, 9]
