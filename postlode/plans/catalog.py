"""Queries over the driver's tables, by name, with their SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions import classify, pay, results, text
from postlode.operators import dedup, fetchlog, joins, order, reports, similar
from postlode.operators.enrich import enrich
from postlode.operators import queries as searches
from postlode.plans import likeness
from postlode.plans import oracle as o
from postlode.plans import pipeline
from postlode.plans.views import TEMPLATES, documents, postings, raw_postings, titled
from postlode.schema import SCORES, text_blob
from postlode.state import PostingTable, pinned, scratch
from postlode.streaming.incremental import guarded_calls

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

STAMP = "2025-01-01T00:00:00+00:00"


def query(sql: str | None = None):
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = o.squeezed(sql)
        return f

    return put


def enriched(spark: SparkSession, d: str) -> DataFrame:
    return enrich(postings(spark, d))


def scored(spark: SparkSession, d: str, keep_pay: bool = False) -> DataFrame:
    from postlode.functions.score import score

    return score(enriched(spark, d), keep_pay=keep_pay)


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# ---- sources and limits ----


@query(f"""WITH {o.RAW} SELECT source_platform, count(*) AS n, min(seq) AS first_seq, max(seq) AS last_seq FROM raw GROUP BY source_platform""")
def scan_union_sources(spark, d):
    """Sources one after another, with their row counts."""
    rows = raw_postings(spark, d)
    halves = [rows.filter("_seq % 2 = 0"), rows.filter("_seq % 2 = 1")]
    both = halves[0].unionByName(halves[1])
    return both.groupBy("source_platform").agg(F.count("*").alias("n"), F.min("_seq").alias("first_seq"), F.max("_seq").alias("last_seq"))


@query(f"""WITH {o.RAW}, r AS (SELECT source_platform, seq, row_number() OVER (PARTITION BY source_platform ORDER BY seq) AS n FROM raw)
SELECT source_platform, seq FROM r WHERE n <= 50""")
def source_limit(spark, d):
    """Each source's first 50 rows (L4)."""
    return order.limit_per_source(raw_postings(spark, d), 50).select("source_platform", F.col("_seq").alias("seq"))


# ---- text ----


@query(f"SELECT doc_id, {o.tidy('text')} AS cleaned FROM documents")
def clean_field(spark, d):
    """Texts without control characters, white space collapsed (F1)."""
    return documents(spark, d).select("doc_id", text.clean_field(F.col("text")).alias("cleaned"))


@query(f"WITH {o.RAW} SELECT seq, md5(concat_ws(' ', job_title, company_name, location, '', '', '', job_description, '', '', salary, 'unknown')) AS digest FROM raw")
def text_blob_digest(spark, d):
    """Digest of the searched text (F2)."""
    return postings(spark, d).select(F.col("_seq").alias("seq"), F.md5(text_blob()).alias("digest"))


@query(f"""WITH {o.RAW}, {o.prepared('raw')} SELECT seq, normalized_title, normalized_company, {o._TITLE_CORE} AS title_core, mark AS signature, url, deduplication_key FROM keyed_rows""")
def normalize_text(spark, d):
    """Normalised title and company, title core, signature, address and key."""
    p = dedup.prepare(postings(spark, d))
    return p.select(
        F.col("_seq").alias("seq"), "normalized_title", "normalized_company", text.title_core(F.col("normalized_title")).alias("title_core"),
        F.col("_signature").alias("signature"), F.col("job_url").alias("url"), "deduplication_key",
    )


_HOST = "regexp_replace(lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)), '^www\\.', '')"


@query(f"""SELECT page_id, {o.url('url')} AS normal, {_HOST} AS domain, CASE WHEN len(string_split({_HOST}, '.')) < 2 THEN {_HOST} ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END AS root_domain FROM pages""")
def normalize_url(spark, d):
    """Addresses normalised; host and root domain."""
    u = F.col("url")
    host = text.domain(u)
    return table(spark, d, "pages").select("page_id", text.normalize_url(u).alias("normal"), host.alias("domain"), text.root_domain(host).alias("root_domain"))


def _html_sql(x: str = "html", drop: tuple[str, ...] = ("script", "style", "noscript", "svg")) -> str:
    x = f"regexp_replace({x}, '(?s)<!--.*?-->', ' ', 'g')"
    for tag in drop:
        x = f"regexp_replace({x}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    x = f"regexp_replace({x}, '<[/!?]?[A-Za-z][^>]*>', ' ', 'g')"
    # the references that the pages hold, and a few more; & last, so that nothing is decoded twice
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"'), ("lt", "<"), ("gt", ">"), ("nbsp", " "), ("#39", chr(39)), ("euro", "€"), ("ndash", "–")):
        x = f"replace({x}, '&{name};', {o.quote(char)})"
    return f"trim(regexp_replace(regexp_replace({x}, '&amp;?', '&', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT page_id, {_html_sql()} AS plain FROM pages")
def html_to_text(spark, d):
    """Text of whole pages."""
    return table(spark, d, "pages").select("page_id", text.html_to_text(F.col("html"), ("script", "style", "noscript", "svg")).alias("plain"))


@query("""SELECT event_type, count(*) AS n, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY event_type""")
def json_props(spark, d):
    """A value inside JSON, summed."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.sum(k).alias("total"))


@query(f"WITH {o.RAW} SELECT seq, CASE WHEN length({o.tidy('job_description')}) <= 1200 THEN {o.tidy('job_description')} ELSE rtrim({o.tidy('job_description')}[1:1199]) || '...' END AS short FROM raw")
def shorten(spark, d):
    """Descriptions cut for display."""
    return raw_postings(spark, d).select(F.col("_seq").alias("seq"), text.shorten(F.col("job_description"), 1200).alias("short"))


_FREE = "regexp_replace(regexp_replace(location, '(?i)\\b(remote|hybrid|on-?site|online|work\\s*from\\s*home|wfh|home\\s*office|anywhere|worldwide|distributed|global)\\b', ' ', 'g'), '[/|()\\[\\]–—-]+', ' ', 'g')"
_FREE = f"trim(regexp_replace(regexp_replace({_FREE}, '\\s*,\\s*', ', ', 'g'), '\\s+', ' ', 'g'), ' ,')"
_SHOWN_SQL = f"""shown AS (
    SELECT *, CASE WHEN regexp_matches({_FREE}, '\\p{{L}}') THEN {_FREE} ELSE '' END AS free,
           concat_ws(', ', nullif(city, ''), nullif({o.titled('country')}, '')) AS made FROM scored
), ranks AS (
    SELECT *, [CASE WHEN contains(free, ',') THEN 1 ELSE 0 END, len(string_split(free, ' ')), length(free)] AS a,
           [CASE WHEN contains(made, ',') THEN 1 ELSE 0 END, len(string_split(made, ' ')), length(made)] AS b FROM shown
), located AS (
    SELECT *, CASE WHEN free = '' AND made = '' THEN 'Unknown' WHEN made = '' THEN free WHEN free = '' THEN made WHEN a >= b THEN free ELSE made END AS display FROM ranks
)"""


@query(f"WITH {o.SCORED}, {_SHOWN_SQL} SELECT seq, display AS location FROM located")
def display_location(spark, d):
    """The place that reports show."""
    p = enriched(spark, d)
    return p.select(F.col("_seq").alias("seq"), text.display_location(F.col("city"), F.col("country"), F.col("location")).alias("location"))


# ---- predicates and classifiers ----


@query(f"WITH {o.RAW} SELECT seq FROM raw WHERE {o.term('lower(job_description)', o._RELEVANT_TERMS)}")
def relevance_filter(spark, d):
    """Postings whose description names AI or a workflow tool."""
    return raw_postings(spark, d).filter(classify.is_relevant(F.lower("job_description"))).select(F.col("_seq").alias("seq"))


@query(f"WITH {o.RAW} SELECT seq, {o.term('lower(job_title)', lx.BOARD_TITLE_TERMS)} AS relevant FROM raw")
def board_title_filter(spark, d):
    """Titles that boards are searched for."""
    return raw_postings(spark, d).select(F.col("_seq").alias("seq"), classify.is_board_title(F.lower("job_title")).alias("relevant"))


_PATH = "lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1))"
_ROOT = f"CASE WHEN len(string_split({_HOST}, '.')) < 2 THEN {_HOST} ELSE array_to_string(string_split({_HOST}, '.')[-2:], '.') END"
_TITLED = f"templates(k, title, company, location, salary, wording) AS (VALUES {o._VALUES}), r AS (SELECT page_id, url, title || ' | ' || company AS title FROM pages JOIN templates ON page_id % {len(TEMPLATES)} = k)"
_IN = lambda x, names: f"{x} IN ({', '.join(map(o.quote, names))})"


@query(f"""WITH {_TITLED}, h AS (SELECT *, {_HOST} AS host, {_ROOT} AS root, {_PATH} AS path, lower(title) AS low FROM r)
SELECT page_id, ({_IN('host', lx.BLOCKED_DOMAINS)} OR {_IN('root', lx.BLOCKED_DOMAINS)} OR {o.holds('host', ('magazine', 'wikipedia', 'wikihow'))}
    OR {o.holds('path', lx.HARD_NOISY_PATHS)} OR ({_IN('root', lx.WEAK_AGGREGATORS)} AND {o.holds('path', lx.NOISY_PATHS)})
    OR {o.holds('low', lx.NOISY_TITLES)} OR regexp_matches(low, '\\b\\d{{3,}}[,\\d]*\\+?\\s+')
    OR ({_IN('root', lx.WEAK_AGGREGATORS)} AND length(trim(path, '/')) <= 2)) AS noise FROM h""")
def noise_filter(spark, d):
    """Search results that are no postings (P5)."""
    return _page_results(spark, d).select("page_id", results.is_noise(F.col("title"), F.col("url")).alias("noise"))


def _page_results(spark, d):
    rows = spark.createDataFrame([(i, f"{t[0]} | {t[1]}") for i, t in enumerate(TEMPLATES)], "_k long, title string")
    pages = table(spark, d, "pages").select("page_id", "url")
    return pages.join(F.broadcast(rows), pages.page_id % len(TEMPLATES) == rows["_k"]).drop("_k")


_PLACES = ", ".join(map(o.quote, classify.place_names()))


def _place_sql(x: str) -> str:
    clean = f"lower(trim(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ,-–—|'))"
    parts = f"list_filter(list_transform(regexp_split_to_array({clean}, '[,/]'), lambda w: trim(w)), lambda w: w <> '')"
    return f"({clean} IN ({_PLACES}) OR (len({parts}) > 1 AND len(list_filter({parts}, lambda w: w NOT IN ({_PLACES}))) = 0))"


def _bad_sql(x: str) -> str:
    key = f"lower(trim(trim(regexp_replace({x}, '\\s+', ' ', 'g')), ' ()[].,'))"
    words = "department|abteilung|team|jetzt bewerben|bewerben|apply now|work from home|home office|remote jobs|freelancers?"
    roles = "specialist|engineer|developer|workflow|workflows|automation|automate|manager|analyst|intern|consultant|architect|recruiter"
    names = "('', 'unknown', 'apply', 'careers', 'jobs', 'remote', 'hybrid', 'new', 'work from home', 'freelance')"
    return (
        f"({key} IN {names} OR {_place_sql(x)} OR length(regexp_replace({x}, '[^\\p{{L}}]', '', 'g')) < 2"
        f" OR regexp_matches({key}, '^[a-z0-9][a-z0-9-]*\\.[a-z]{{2,}}(?:\\.[a-z]{{2,}})?$') OR regexp_extract({key}, '[a-zäöüß0-9&.+-]+') IN ({_PLACES})"
        f" OR regexp_matches({key}, '\\b({words})\\b') OR regexp_matches({key}, '\\b({roles})\\b'))"
    )


def _company_sql(x: str) -> str:
    out = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'), ' -–—|')"
    out = f"regexp_replace({out}, '(?i)\\s+(Djinni|JazzHR|Greenhouse|Lever|Ashby|Workable|Built In.*|Jetzt bewerben.*|Apply Now.*)$', '')"
    out = f"trim(regexp_replace({out}, '(?i)\\s+(in|im|for|at|bei|f[uü]r)$', ''), ' -–—|')"
    return f"coalesce(nullif({out}, ''), 'Unknown')"


_AFTER = "(?i)(?:\\bat\\s+|\\bbei\\s+|@\\s*)([^|,–—-]+)"
_GUESSED = f"""split AS (SELECT *, regexp_matches(title, '{_AFTER}') AS after, {_company_sql(f"regexp_extract(title, '{_AFTER}', 1)")} AS named,
    list_filter(list_transform(regexp_split_to_array(title, '\\s[-|–—]\\s'), lambda w: trim(w)), lambda w: w <> '') AS pieces,
    list_filter(string_split(host, '.'), lambda w: w NOT IN ('com', 'co', 'io', 'jobs', 'careers', {', '.join(map(o.quote, lx.GEO_DOMAIN_PARTS))})) AS parts FROM hosts),
tails AS (SELECT *, {_company_sql('pieces[-2]')} AS before, list_transform(list_filter(list_reverse(pieces[2:]), lambda w:
    lower(w) NOT IN ('jazzhr', 'greenhouse', 'lever', 'workable', 'ashby', 'apply', 'careers', 'jobs') AND NOT regexp_matches(lower(w), '\\b(remote|hybrid|job|jobs|career|careers)\\b')
    AND NOT {_bad_sql(_company_sql('w'))}), lambda w: {_company_sql('w')}) AS usable, {o.titled("replace(parts[1], '-', ' ')")} AS made FROM split),
guessed AS (SELECT *, CASE WHEN after AND NOT {_bad_sql('named')} THEN named WHEN len(pieces) >= 2 AND contains(lower(pieces[-1]), 'built in') AND NOT {_bad_sql('before')} THEN before
    WHEN {_IN('host', lx.BOARD_DOMAINS)} OR {_IN('root', lx.BOARD_DOMAINS)} THEN 'Unknown' WHEN len(usable) > 0 THEN usable[1]
    WHEN {_bad_sql("coalesce(made, 'Unknown')")} THEN 'Unknown' ELSE made END AS company FROM tails)"""


def _title_sql(x: str) -> str:
    out = f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
    ends = "Jobs?|Careers?|Apply|LinkedIn|Built In.*|Strider Jobs|Visa Sponsorship Jobs|Jetzt bewerben.*|Remote Jobs on.*"
    out = f"regexp_replace({out}, '(?i)\\s*\\|\\s*({ends}).*$', '')"
    out = f"regexp_replace({out}, '(?i)\\s*[-–—]\\s*(Jetzt bewerben|Apply Now|Work From Home)!?.*$', '')"
    return f"trim({out}, ' -–—|')[1:160]"


@query(f"""WITH {_TITLED}, hosts AS (SELECT *, {_HOST} AS host, {_ROOT} AS root FROM r), {_GUESSED} SELECT page_id, title, company, {_title_sql('title')} AS clean FROM guessed""")
def guess_company(spark, d):
    """Company guessed from a result's title and host."""
    r = _page_results(spark, d)
    return r.select("page_id", "title", results.guess_company(F.col("title"), text.domain(F.col("url"))).alias("company"), text.clean_title(F.col("title")).alias("clean"))


_PLACE_PARTS = "list_filter(list_transform(regexp_split_to_array(clean, '[,/]'), lambda p: trim(p)), lambda p: p <> '')"


@query(f"""WITH {o.RAW}, c AS (SELECT seq, lower(trim(trim(regexp_replace(v, '\\s+', ' ', 'g')), ' ,-–—|')) AS clean, which
    FROM (SELECT seq, location AS v, 'location' AS which FROM raw UNION ALL SELECT seq, company_name, 'company' FROM raw))
SELECT seq, which, (clean IN ({_PLACES}) OR (len({_PLACE_PARTS}) > 1 AND len(list_filter({_PLACE_PARTS}, lambda p: p NOT IN ({_PLACES}))) = 0)) AS place FROM c""")
def location_name(spark, d):
    """Values that are places."""
    r = raw_postings(spark, d)
    both = r.select(F.col("_seq").alias("seq"), F.col("location").alias("v"), F.lit("location").alias("which")).union(
        r.select(F.col("_seq"), F.col("company_name"), F.lit("company"))
    )
    return both.select("seq", "which", classify.is_place(F.col("v")).alias("place"))


@query(f"WITH {o.RAW} SELECT seq, {_bad_sql('company_name')} AS bad, {_bad_sql('job_title')} AS bad_title FROM raw")
def bad_company(spark, d):
    """Values that cannot be companies."""
    r = raw_postings(spark, d)
    return r.select(F.col("_seq").alias("seq"), results.is_bad_company(F.col("company_name")).alias("bad"), results.is_bad_company(F.col("job_title")).alias("bad_title"))


@query(f"SELECT doc_id, {o.language('text')} AS language FROM documents")
def detect_language(spark, d):
    """Language of real prose by hints."""
    return documents(spark, d).select("doc_id", classify.language(F.col("text")).alias("language"))


@query(f"WITH {o.RAW} SELECT seq, {o.remote('lower(job_description)')} AS remote_type FROM raw")
def detect_remote(spark, d):
    """Way of working."""
    return raw_postings(spark, d).select(F.col("_seq").alias("seq"), classify.remote_type(F.lower("job_description")).alias("remote_type"))


@query(f"WITH {o.RAW} SELECT seq, {o.seniority('lower(job_description)')} AS seniority FROM raw")
def detect_seniority(spark, d):
    """Level (C3)."""
    return raw_postings(spark, d).select(F.col("_seq").alias("seq"), classify.seniority(F.lower("job_description")).alias("seniority"))


@query(f"WITH {o.ENRICHED} SELECT seq, city, country, region FROM enriched")
def detect_location(spark, d):
    """City, country and region (C4)."""
    return enriched(spark, d).select(F.col("_seq").alias("seq"), "city", "country", "region")


@query(f"WITH {o.ENRICHED} SELECT seq, required_skills FROM enriched")
def detect_skills(spark, d):
    """The first 18 skills named."""
    return enriched(spark, d).select(F.col("_seq").alias("seq"), "required_skills")


@query(f"WITH {o.RAW} SELECT seq, {o.size('lower(job_description)', False)} AS size, {o.size('lower(job_description)', True)} AS source FROM raw")
def company_size(spark, d):
    """Company size read from text."""
    r = raw_postings(spark, d).withColumn("s", classify.company_size(F.col("job_description")))
    return r.select(F.col("_seq").alias("seq"), F.col("s.size").alias("size"), F.col("s.source").alias("source"))


@query(f"WITH {o.ENRICHED} SELECT seq, company_size, company_size_source FROM enriched")
def size_override_join(spark, d):
    """Sizes with the curated list's on top."""
    return enriched(spark, d).select(F.col("_seq").alias("seq"), "company_size", "company_size_source")


@query(f"WITH {o.ENRICHED} SELECT seq, {o.floor_of('company_size')} AS least FROM enriched WHERE NOT {o.too_large('company_size')}")
def employee_filter(spark, d):
    """Postings of companies that are not too large."""
    e = enriched(spark, d).filter(~classify.exceeds_employees(F.col("company_size")))
    return e.select(F.col("_seq").alias("seq"), classify.employee_floor(F.col("company_size")).alias("least"))


@query(f"WITH {o.PAID} SELECT seq, salary_found, salary_target_met, hours_found, hours_target_met, salary_hour_notes FROM paid")
def compensation(spark, d):
    """Pay and hours against targets."""
    e = enriched(spark, d)
    e = e.select(F.col("_seq").alias("seq"), pay.searched(F.col("salary"), text_blob()).alias("t"))
    return pay.read(e, "paid", "t").select("seq", "paid.*")


@query(f"WITH {o.ENRICHED} SELECT seq, {o.low_cost('salary', 'location', o.BLOB)} AS reason FROM enriched")
def low_cost_filter(spark, d):
    """Why postings count as low-wage."""
    e = enriched(spark, d)
    return e.select(F.col("_seq").alias("seq"), classify.low_cost_reason(F.col("salary"), F.col("location"), text_blob()).alias("reason"))


# ---- scoring ----


@query(f"WITH {o.SCORED} SELECT seq, {', '.join(SCORES)} FROM scored")
def score_breakdown(spark, d):
    """The eight components."""
    return scored(spark, d).select(F.col("_seq").alias("seq"), *SCORES)


@query(f"WITH {o.SCORED} SELECT seq, relevance_score, priority_level, company_fit FROM scored")
def relevance_score(spark, d):
    """Clamped sum, priority, kind of company."""
    return scored(spark, d).select(F.col("_seq").alias("seq"), "relevance_score", "priority_level", "company_fit")


@query(f"WITH {o.SCORED} SELECT seq, reason_for_score FROM scored")
def explain(spark, d):
    """The reasons for each score."""
    return scored(spark, d).select(F.col("_seq").alias("seq"), "reason_for_score")


@query(f"WITH {o.SCORED} SELECT seq, relevance_score, CAST(row_number() OVER (ORDER BY relevance_score DESC, seq) AS INTEGER) AS rank FROM scored QUALIFY rank <= 5")
def topk(spark, d):
    """The five best postings (L1, L3)."""
    return order.ranked(scored(spark, d), 5).select(F.col("_seq").alias("seq"), "relevance_score", "rank")


# ---- duplicates ----


@query(f"WITH RECURSIVE {o.RAW}, {o.prepared('raw')}, {o.GREEDY} SELECT seq, deduplication_key FROM unique_rows")
def dedup_exact(spark, d):
    """Postings kept by the greedy pass over addresses and signatures."""
    return dedup.drop_repeats(dedup.prepare(postings(spark, d))).select(F.col("_seq").alias("seq"), "deduplication_key")


@query(likeness.collapsed(f"{o.RAW}, {o.prepared('raw')}, {o.GREEDY}, {likeness.held('unique_rows')}"))
def dedup_fuzzy(spark, d):
    """Postings after merging similar ones."""
    kept = dedup.deduplicate(postings(spark, d))
    return kept.select(F.col("_seq").alias("seq"), "job_title", "company_name", "salary")


@query(likeness.SIMILAR)
def similar_titles(spark, d):
    """Pairs of similar title cores inside a block, with their ratios."""
    rows = dedup.drop_repeats(dedup.prepare(titled(spark, d)))
    return similar.similar_pairs(dedup.cores(rows).groupBy("grp", "text").agg(F.min("id").alias("id")), 0.86)


@query(likeness.collapsed(likeness.TITLED_ROWS))
def collapse_titles(spark, d):
    """Postings with whole documents for descriptions, similar ones merged in order."""
    kept = dedup.deduplicate(titled(spark, d), ("job_title", "company_name", "salary"))
    return kept.select(F.col("_seq").alias("seq"), "job_title", "company_name", "salary")


# ---- state ----


@query(f"""WITH {o.RAW}, {o.prepared('raw')} SELECT seq FROM keyed_rows k WHERE seq % 2 = 1
AND NOT EXISTS (SELECT 1 FROM keyed_rows s WHERE s.seq % 2 = 0 AND s.deduplication_key <> '' AND s.deduplication_key = k.deduplication_key)""")
def new_only_anti_join(spark, d):
    """Rows of one run that an earlier run did not have."""
    p = dedup.prepare(postings(spark, d))
    return joins.unseen(p.filter("_seq % 2 = 1"), p.filter("_seq % 2 = 0")).select(F.col("_seq").alias("seq"))


@query(f"""WITH {o.RAW}, {o.prepared('raw')},
a AS (SELECT deduplication_key AS key, arg_max(job_title, seq) AS title, arg_min(seq, seq) AS made, arg_max(seq, seq) AS changed FROM keyed_rows WHERE seq % 2 = 0 GROUP BY 1),
b AS (SELECT deduplication_key AS key, arg_max(job_title, seq) AS title, arg_min(seq, seq) AS made, arg_max(seq, seq) AS changed FROM keyed_rows WHERE seq % 2 = 1 GROUP BY 1)
SELECT coalesce(a.key, b.key) AS deduplication_key, coalesce(b.title, a.title) AS job_title, CAST(coalesce(a.made, b.made) AS VARCHAR) AS created_at, CAST(coalesce(b.changed, a.changed) AS VARCHAR) AS updated_at
FROM a FULL JOIN b ON a.key = b.key""")
def upsert_merge(spark, d):
    """Two runs merged by key: creation stays the first's, the rest is the last's."""
    p = dedup.prepare(postings(spark, d)).withColumns({"created_at": F.col("_seq").cast("string"), "updated_at": F.col("_seq").cast("string")})
    p = p.select("deduplication_key", "job_title", "created_at", "updated_at", "_seq")
    stored = joins.latest_per_key(p.filter("_seq % 2 = 0"), "deduplication_key", "_seq").drop("_seq")
    return joins.merge(stored, p.filter("_seq % 2 = 1"))


def _marked(spark, d):
    p = dedup.prepare(postings(spark, d)).withColumns({"created_at": F.col("_seq").cast("string"), "updated_at": F.col("_seq").cast("string")})
    return p.withColumn("relevance_score", (F.col("_seq") % 101).cast("int"))


@query(f"""WITH {o.RAW}, {o.prepared('raw')},
a AS (SELECT deduplication_key AS key, arg_max(job_title, seq) AS title, arg_min(seq, seq) AS made, arg_max(seq, seq) AS changed FROM keyed_rows WHERE seq % 2 = 0 GROUP BY 1),
b AS (SELECT deduplication_key AS key, arg_max(job_title, seq) AS title, arg_min(seq, seq) AS made, arg_max(seq, seq) AS changed FROM keyed_rows WHERE seq % 2 = 1 GROUP BY 1),
ids AS (SELECT key, row_number() OVER (ORDER BY key) AS id FROM a
        UNION ALL SELECT key, (SELECT count(*) FROM a) + row_number() OVER (ORDER BY key) FROM b WHERE key NOT IN (SELECT key FROM a))
SELECT CAST(id AS BIGINT) AS id, key AS deduplication_key, coalesce(b.title, a.title) AS job_title, CAST(coalesce(a.made, b.made) AS VARCHAR) AS created_at, CAST(coalesce(b.changed, a.changed) AS VARCHAR) AS updated_at
FROM ids LEFT JOIN a USING (key) LEFT JOIN b USING (key)""")
def upsert_buckets(spark, d):
    """Two batches upserted into a stored table, which rewrites the buckets of their keys."""
    stored = PostingTable(spark, scratch(spark, "postings"))
    rows = _marked(spark, d)
    for turn in (0, 1):
        stored.upsert(rows.filter(F.col("_seq") % 2 == turn))
    return stored.read().select("id", "deduplication_key", "job_title", "created_at", "updated_at")


@query(f"""WITH {o.RAW}, {o.prepared('raw')}, last AS (SELECT deduplication_key, arg_max(seq % 101, seq) AS score FROM keyed_rows GROUP BY 1)
SELECT deduplication_key, CAST(score AS INTEGER) AS relevance_score FROM last WHERE score >= 74""")
def scan_by_score(spark, d):
    """Stored rows of at least a score, from files of its bands."""
    stored = PostingTable(spark, scratch(spark, "postings"))
    stored.upsert(_marked(spark, d))
    return stored.at_least(74).select("deduplication_key", "relevance_score")


# ---- searches, reports, comparisons, usage ----


def _query_sql() -> str:
    terms = ["Remote", "Hybrid", *[t for t in lx.REGION_TERMS["worldwide"] if t != "Remote"]]
    rows = lambda xs: ", ".join(f"({i}, {o.quote(x)})" for i, x in enumerate(xs))
    n = len(terms)
    return f"""WITH t(i, title) AS (VALUES {rows(lx.PRIORITY_TITLES)}), c(i, q) AS (VALUES {rows(lx.CONCEPT_QUERIES)}), r(j, region) AS (VALUES {rows(terms)}),
s(i, site) AS (VALUES {rows(lx.SEARCH_SITES)}), g(k, title) AS (VALUES {rows(lx.TARGET_TITLES[:24])}),
every AS (
    SELECT 0 AS a, i AS b, 0 AS c, 0 AS d, '"' || title || '" "' || region || '"' AS query FROM t JOIN r ON i % {n} = j
    UNION ALL SELECT 1, i, 0, 0, q || ' "' || region || '" job' FROM c JOIN r ON i % {n} = j
    UNION ALL SELECT 2, i, j, k, site || ' "' || title || '" "' || region || '"' FROM s, r, g
)
SELECT CAST(row_number() OVER (ORDER BY a, b, c, d) AS INTEGER) AS place, query FROM every"""


@query(_query_sql())
def query_product(spark, d):
    """Search queries from titles, places and sites."""
    return searches.search_queries(spark, "worldwide", True)


_PRESENTED = f"""{o.SCORED}, {_SHOWN_SQL}"""


@query(f"""WITH {_PRESENTED} SELECT seq, relevance_score AS score, priority_level AS priority, job_title AS title,
CASE WHEN company_name = '' THEN 'Unknown' ELSE company_name END AS company, company_fit, company_size, display AS location,
CASE WHEN city = '' THEN 'Unknown' ELSE city END AS city, CASE WHEN country = '' THEN 'Unknown' ELSE country END AS country, region, remote_type, seniority,
CASE WHEN salary = '' THEN 'Not listed' ELSE salary END AS salary, salary_target_met, hours_target_met, salary_hour_notes,
CASE WHEN required_skills = '' THEN 'Not extracted' ELSE required_skills END AS skills, source_platform AS source, reason_for_score AS reason, 'new' AS status, 'no' AS dismissed FROM located""")
def presenter(spark, d):
    """Report rows."""
    columns = "seq score priority title company company_fit company_size location city country region remote_type seniority salary salary_target_met hours_target_met salary_hour_notes skills source reason status dismissed"
    return reports.present(scored(spark, d, keep_pay=True), STAMP, "_seq").withColumnRenamed("_seq", "seq").select(*columns.split())


@query(f"""WITH {o.SCORED} SELECT count(*) AS exported, CAST(round_even(avg(relevance_score), 1) AS DOUBLE) AS average_score, count_if(priority_level = 'urgent') AS urgent,
count_if(priority_level = 'high') AS high, count_if(salary_target_met = 'yes') AS salary_target, count_if(hours_target_met = 'yes') AS hours_target FROM scored""")
def report_summary(spark, d):
    """A report's head (A1)."""
    return reports.summary(reports.present(scored(spark, d, keep_pay=True), STAMP))


_WHERE = "lower(job_title || ' ' || location || ' ' || country)"
_NAMED = "company_name NOT IN ('', 'Unknown')"


@query(f"""WITH {o.SCORED} SELECT seq % 2 AS side, count(*) AS kept, count_if(relevance_score >= 50) AS ge50, count_if(relevance_score >= 60) AS ge60, count_if(relevance_score >= 80) AS ge80,
count_if(relevance_score >= 50 AND {o.holds('lower(job_title)', lx.TARGET_HINTS)}) AS target_hits, count_if(relevance_score >= 50 AND {o.holds(_WHERE, lx.DACH_HINTS)}) AS dach_hits,
count(DISTINCT CASE WHEN relevance_score >= 50 AND {_NAMED} THEN company_name END) AS companies, count_if(relevance_score >= 50 AND NOT ({_NAMED})) AS unknown_company
FROM scored WHERE NOT {o.too_large('company_size')} GROUP BY 1""")
def run_metrics(spark, d):
    """Two runs compared (A3)."""
    s = scored(spark, d).filter(~classify.exceeds_employees(F.col("company_size"))).withColumn("side", F.col("_seq") % 2)
    return reports.run_metrics(s)


@query(f"""WITH {o.SCORED}, a AS (SELECT DISTINCT company_name FROM scored WHERE seq % 24 < 14 AND relevance_score >= 50 AND {_NAMED}), b AS (SELECT DISTINCT company_name FROM scored WHERE seq % 24 >= 12 AND relevance_score >= 50 AND {_NAMED})
SELECT company_name, 'both' AS side FROM (FROM a INTERSECT FROM b) UNION ALL SELECT company_name, 'left' FROM (FROM a EXCEPT FROM b) UNION ALL SELECT company_name, 'right' FROM (FROM b EXCEPT FROM a)""")
def company_overlap(spark, d):
    """Companies that two runs share or have alone."""
    s = pinned(scored(spark, d).filter("relevance_score >= 50").select("_seq", "company_name"))  # read by both sides
    return reports.company_overlap(s.filter("_seq % 24 < 14"), s.filter("_seq % 24 >= 12"))


@query(f"""WITH {o.SCORED} SELECT seq, relevance_score, region FROM scored WHERE relevance_score >= 40 AND region IN ('dach', 'europe') AND priority_level IN ('urgent', 'high', 'medium', 'low')""")
def filter_dashboard(spark, d):
    """Rows that a dashboard's choices leave."""
    rows = scored(spark, d).select("_seq", "relevance_score", "region", "priority_level", "seniority", "date_found")
    rows = pinned(rows.filter("relevance_score >= 40"))  # a sort reads its rows twice, first for the bounds of its ranges
    s = reports.dashboard(rows, 40, region=["dach", "europe"], priority_level=["urgent", "high", "medium", "low"], seniority=[])
    return s.select(F.col("_seq").alias("seq"), "relevance_score", "region")


@query(f"""WITH {o.SCORED} SELECT count(*) AS jobs, count(*) FILTER (priority_level = 'urgent') AS urgent, CAST(coalesce(round_even(avg(relevance_score), 1), 0) AS DOUBLE) AS average_score
FROM scored WHERE relevance_score >= 40 AND region IN ('dach', 'europe')""")
def dashboard_metrics(spark, d):
    """Counts and average of the rows that a dashboard shows."""
    return reports.dashboard_metrics(reports.dashboard(scored(spark, d), 40, region=["dach", "europe"]))


@query(f"WITH {o.SCORED} " + " UNION ALL ".join(f"SELECT DISTINCT '{c}' AS picker, {c} AS value FROM scored" for c in reports.PICKED))
def dashboard_pickers(spark, d):
    """The values that a dashboard offers for each of its choices (A4)."""
    return reports.pickers(scored(spark, d))


LIMITS = (("click", 20), ("error", 3000), ("view", 60))
_LIMIT_SQL = "limits(provider, lim) AS (VALUES " + ", ".join(f"('{p}', {n})" for p, n in LIMITS) + ")"


def _calls(spark, d):
    limits = spark.createDataFrame(list(LIMITS), "provider string, limit int")
    calls = table(spark, d, "events").select("event_id", F.col("event_type").alias("provider"), F.col("ts").cast("timestamp").alias("ts"))
    return calls, F.broadcast(limits)


@query(f"""WITH {_LIMIT_SQL}, used AS (SELECT strftime(ts, '%Y-%m') AS month, event_type AS provider, count(*) AS used FROM events GROUP BY ALL)
SELECT month, provider, used, CAST(lim AS INTEGER) AS "limit", CASE WHEN lim IS NULL THEN NULL ELSE greatest(0, lim - used) END AS remaining, CAST(round_even(100.0 * used / lim, 1) AS DOUBLE) AS percent,
coalesce(used + 1 > floor(lim * 0.95), false) AS blocked,
CASE WHEN lim IS NULL THEN 'free' WHEN used + 1 > floor(lim * 0.95) THEN 'blocked' WHEN 100.0 * used / lim >= 80 THEN 'near limit' ELSE 'ok' END AS status FROM used LEFT JOIN limits USING (provider)""")
def usage_monthly(spark, d):
    """Calls of each provider and month against limits."""
    u = reports.monthly_usage(*_calls(spark, d))
    return u.withColumn("remaining", F.when(F.col("limit").isNotNull(), F.col("remaining")))


@query(f"""WITH {_LIMIT_SQL}, r AS (SELECT event_id, event_type AS provider, row_number() OVER (PARTITION BY event_type, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, provider FROM r LEFT JOIN limits USING (provider) WHERE lim IS NULL OR n <= floor(lim * 0.95)""")
def usage_guard(spark, d):
    """Calls that the monthly guard lets through."""
    return reports.allowed_calls(*_calls(spark, d)).select("event_id", "provider")


@query(SQL["usage_guard"])
def usage_guard_stream(spark, d):
    """The same from a stream of ten files, with a provider's month and count as state."""
    calls = _calls(spark, d)[0]
    source, out, checkpoint = (scratch(spark, k) for k in ("calls", "allowed", "checkpoint"))
    first, last = calls.agg(F.min("ts").cast("double").alias("a"), F.max("ts").cast("double").alias("b")).first()
    part = lambda i: first + (last - first + 1) * i / 10
    for i in range(10):  # files in order of time, as a feed leaves them
        at = F.col("ts").cast("double")
        calls.filter((at >= part(i)) & (at < part(i + 1))).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(calls.schema).option("maxFilesPerTrigger", 1).parquet(source)
    allowed = guarded_calls(stream, dict(LIMITS))
    allowed.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(allowed.schema).parquet(out)


#: Events as a log of fetches of pages: views find nothing new, errors fail, purchases get no answer.
_LOG_SQL = """log AS (
    SELECT event_id AS seq, ts AS moment, url, CAST(ts AS DATE) AS run, regexp_extract(url, '://([^/?#]+)', 1) AS host,
           CASE event_type WHEN 'view' THEN 304 WHEN 'error' THEN 500 WHEN 'purchase' THEN NULL ELSE 200 END AS status,
           CASE WHEN event_id % 3 > 0 THEN md5(html || event_id) END AS etag, event_id || ' ' || html AS body
    FROM events JOIN pages ON user_id % 50 = page_id
)"""


def _log(spark, d):
    e, p = table(spark, d, "events"), table(spark, d, "pages").select("page_id", "url", "html")
    kind, n = F.col("event_type"), F.col("event_id").cast("string")
    rows = e.join(p, e.user_id % 50 == p.page_id)
    return rows.select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), "url", F.col("ts").cast("date").alias("run"), F.regexp_extract("url", "://([^/?#]+)", 1).alias("host"),
        F.when(kind == "view", 304).when(kind == "error", 500).when(kind != "purchase", 200).alias("status"),
        F.when(F.col("event_id") % 3 > 0, F.md5(F.concat("html", n))).alias("etag"), F.lit(None).cast("string").alias("last_modified"), F.concat(n, F.lit(" "), "html").alias("body"),
    )


@query(f"""WITH {_LOG_SQL}, asked AS (
    SELECT *, last_value(CASE WHEN status = 200 AND etag IS NOT NULL THEN seq END IGNORE NULLS) OVER (PARTITION BY url ORDER BY moment, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS stored FROM log
), answers AS (SELECT seq, CASE WHEN status = 304 THEN coalesce(stored, seq) ELSE seq END AS answer FROM asked)
SELECT a.seq, a.answer, l.status, md5(l.body) AS digest FROM answers a JOIN log l ON l.seq = a.answer""")
def fetch_answers(spark, d):
    """What each request of a log is answered with, stored responses for unchanged pages."""
    return fetchlog.responses(_log(spark, d), "status", "body").select("seq", "answer", "status", F.md5("body").alias("digest"))


@query(f"""WITH {_LOG_SQL}, bad AS (SELECT *, coalesce(status >= 400, true) AS bad FROM log),
islands AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER (PARTITION BY run, host ORDER BY moment, seq) AS island FROM bad),
counted AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY run, host, island ORDER BY moment, seq) AS n FROM islands),
opened AS (SELECT run, host, min((moment, seq)) AS opened FROM counted WHERE bad AND n >= 5 GROUP BY run, host)
SELECT seq, host, coalesce((moment, seq) > opened, false) AS blocked FROM log LEFT JOIN opened USING (run, host)""")
def fetch_breaker(spark, d):
    """Requests of a log that the breaker of their host would have held back."""
    return fetchlog.blocked(_log(spark, d).drop("body")).select("seq", "host", "blocked")


BOARD_URLS = (
    "https://boards.greenhouse.io/acme/jobs/1", "https://boards.greenhouse.io/embed/job_board?for=Beta", "https://jobs.lever.co/gamma/77", "https://jobs.lever.co/",
    "https://jobs.ashbyhq.com/delta%20x", "https://jobs.ashbyhq.com/Delta", "https://apply.workable.com/epsilon/j/9", "https://zeta.workable.com/", "https://example.com/acme", "https://boards.greenhouse.io/acme",
)


@query("""SELECT * FROM (VALUES ('ashby', ['delta']), ('greenhouse', ['acme', 'beta']), ('lever', ['gamma']), ('workable', ['epsilon', 'zeta'])) t(provider, slugs)""")
def board_slugs(spark, d):
    """Boards named by addresses."""
    return searches.collect_slugs(spark.createDataFrame([(u,) for u in BOARD_URLS], "link string"))


_BOARD = """CASE page_id % 5 WHEN 0 THEN 'greenhouse' WHEN 1 THEN 'lever' WHEN 2 THEN 'ashby' WHEN 3 THEN 'workable' END"""


_SLUGS = f"""named AS (SELECT page_id, {_BOARD} AS provider, regexp_extract(url, '://([^./?#]+)', 1) || '-' || page_id % 11 AS slug FROM pages),
slugs AS (SELECT provider, page_id % 3 = 0 AS found, list_sort(list_distinct(list(slug))) AS slugs FROM named WHERE provider IS NOT NULL GROUP BY GROUPING SETS ((provider, page_id % 3 = 0), (provider)))"""


def _board_links(spark, d) -> DataFrame:
    n = F.col("page_id")
    slug = F.concat(F.regexp_extract("url", "://([^./?#]+)", 1), F.lit("-"), (n % 11).cast("string"))
    at = lambda before, after: F.concat(F.lit(before), slug, F.lit(after))
    link = (
        F.when(n % 5 == 0, at("https://boards.greenhouse.io/", "/jobs/1"))
        .when(n % 5 == 1, at("https://jobs.lever.co/", ""))
        .when(n % 5 == 2, at("https://jobs.ashbyhq.com/", "?x=1"))
        .when(n % 5 == 3, at("https://apply.workable.com/", "/j/9"))
        .otherwise(F.col("url"))
    )
    return table(spark, d, "pages").select("page_id", link.alias("link"))


@query(f"WITH {_SLUGS} SELECT provider, slugs FROM slugs WHERE found IS NULL")
def page_boards(spark, d):
    """Boards named by the addresses of pages."""
    return searches.collect_slugs(_board_links(spark, d))


@query(f"""WITH {_SLUGS} SELECT provider, list_sort(list_distinct(list_concat(coalesce(a.slugs, []), coalesce(b.slugs, [])))) AS merged,
list_sort(list_filter(coalesce(b.slugs, []), lambda x: NOT list_contains(coalesce(a.slugs, []), x))) AS added
FROM (SELECT * FROM slugs WHERE NOT found) a FULL JOIN (SELECT * FROM slugs WHERE found) b USING (provider)""")
def discovered_boards(spark, d):
    """Stored boards and those that search answers name."""
    links = _board_links(spark, d)
    stored = searches.collect_slugs(links.filter("page_id % 3 <> 0"))
    answer = F.to_json(F.struct(F.struct(F.array(F.struct("link")).alias("organic_results")).alias("data")))
    return searches.discover(links.filter("page_id % 3 = 0").select(F.lit("a.json").alias("_file"), answer.alias("body")), stored)


_RUN = f"""WITH RECURSIVE {o.SCORED}, {o.prepared('scored')}, {o.GREEDY}
SELECT seq, relevance_score, priority_level, deduplication_key, company_size, reason_for_score FROM unique_rows
WHERE NOT {o.too_large('company_size')} AND {o.low_cost('salary', 'location', o.BLOB)} = ''"""


@query(f"{_RUN} AND relevance_score >= 60")
def pipeline_e2e(spark, d):
    """The whole run without the fuzzy pass: enrich, deduplicate, score, filter (section 3.1)."""
    done = pipeline.run(postings(spark, d), config=pipeline.RunConfig(fuzzy=False)).exportable
    return done.select(F.col("_seq").alias("seq"), "relevance_score", "priority_level", "deduplication_key", "company_size", "reason_for_score")


@query(f"""WITH RECURSIVE {o.SCORED}, {o.prepared('scored')}, {o.GREEDY}, marked AS MATERIALIZED (SELECT *, {o.too_large('company_size')} AS large, {o.low_cost('salary', 'location', o.BLOB)} AS low_cost FROM unique_rows)
SELECT (SELECT count(*) FROM raw) AS raw, (SELECT count(*) FROM raw) - count(*) AS duplicates_removed, count_if(large) AS large_removed, count_if(NOT large AND low_cost <> '') AS low_cost_removed,
count_if(NOT large AND low_cost = '') AS scored, count_if(NOT large AND low_cost = '') AS new, count_if(NOT large AND low_cost = '' AND relevance_score >= 60) AS exported FROM marked""")
def pipeline_counters(spark, d):
    """Counts of a run's stages (A2)."""
    return pipeline.run(postings(spark, d), config=pipeline.RunConfig(fuzzy=False)).counters()


@query(likeness.FULL_RUN)
def pipeline_full(spark, d):
    """The whole run with the fuzzy pass."""
    done = pipeline.run(postings(spark, d)).ranked
    return done.select(F.col("_seq").alias("seq"), "relevance_score", "priority_level", "company_name")


from postlode.plans import payloads  # noqa: E402, F401  (registers its queries)
