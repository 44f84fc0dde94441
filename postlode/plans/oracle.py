"""DuckDB SQL that states the queries' results on the same tables, written apart from the Spark plans."""

from __future__ import annotations

import re

from postlode import lexicon as lx
from postlode.plans.views import TEMPLATES


def quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def holds(text: str, terms) -> str:
    return "(" + " OR ".join(f"contains({text}, {quote(t)})" for t in terms) + ")"


def term(text: str, terms) -> str:
    """Short terms stand alone, others occur anywhere."""
    tests = []
    for t in terms:
        if len(t) <= 3 and t.isalnum():
            tests.append(f"regexp_matches({text}, {quote('(^|[^a-z0-9])' + t + '($|[^a-z0-9])')})")
        else:
            tests.append(f"contains({text}, {quote(t)})")
    return "(" + " OR ".join(tests) + ")"


def cases(pairs, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {test} THEN {value}" for test, value in pairs) + f" ELSE {default} END"


_VALUES = ", ".join("(" + ", ".join([str(i), *map(quote, t)]) + ")" for i, t in enumerate(TEMPLATES))

RAW = f"""templates(k, title, company, location, salary, wording) AS (VALUES {_VALUES}),
raw AS (
    SELECT doc_id AS seq, title AS job_title, company AS company_name, location, salary, source AS source_platform,
           wording || ' ' || coalesce(text, '') AS job_description,
           CASE WHEN doc_id % 5 = 0 THEN ''
                ELSE (CASE WHEN doc_id % 2 = 0 THEN 'https://Jobs.Example.com' ELSE 'https://jobs.example.com' END) || '/Post/'
                     || CAST(doc_id - doc_id % 3 AS VARCHAR)
                     || (CASE WHEN doc_id % 7 = 0 THEN '/?utm_source=feed&id=5#top' WHEN doc_id % 7 = 1 THEN '?id=5&ref=x' ELSE '?id=5' END)
           END AS job_url
    FROM documents JOIN templates ON doc_id % {len(TEMPLATES)} = k
)"""


def tidy(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '[\\x00-\\x08\\x0B-\\x1F\\x{{FFFD}}]', '', 'g'), '\\s+', ' ', 'g'))"


def language(x: str) -> str:
    padded = f"(' ' || lower({x}) || ' ')"
    return cases(
        [(f"regexp_matches({x}, '[\\x{{0400}}-\\x{{04FF}}]')", "'ru'"), (f"({holds(padded, lx.GERMAN_HINTS)} OR regexp_matches({padded}, '[äöüß]'))", "'de'"), (f"regexp_matches({x}, '\\S')", "'en'")],
        "'unknown'",
    )


def remote(low: str) -> str:
    return cases([(holds(low, lx.REMOTE_TERMS), "'remote'"), (holds(low, lx.HYBRID_TERMS), "'hybrid'"), (holds(low, ("onsite", "on-site", "office", "büro")), "'onsite'")], "'unknown'")


def seniority(low: str) -> str:
    junior, senior = holds(low, lx.JUNIOR_TERMS), holds(low, lx.SENIOR_TERMS)
    return cases(
        [(f"{senior} AND {junior}", "'junior'"), (senior, "'senior'"), (holds(low, ("working student", "werkstudent")), "'working_student'"),
         (holds(low, ("intern", "praktikum", "стаж")), "'internship'"), (holds(low, ("graduate", "trainee", "associate")), "'entry_level'"), (junior, "'junior'")],
        "'unknown'",
    )


def city(low: str) -> str:
    return cases([(f"contains({low}, {quote(c.lower())})", quote(c)) for c in lx.CITY_HINTS], "''")


def _by_city(c: str, field: int, default: str) -> str:
    return cases([(f"{c} = {quote(name)}", quote(facts[field])) for name, facts in lx.CITY_HINTS.items()], default)


def country(low: str, c: str) -> str:
    return cases([(holds(low, hints), quote(name)) for name, hints in lx.COUNTRY_HINTS.items()], _by_city(c, 0, "''"))


def region(low: str, c: str) -> str:
    rest = f"CASE WHEN contains({low}, 'remote') THEN 'worldwide' ELSE 'unknown' END"
    return cases([(holds(low, hints), quote(name)) for name, hints in lx.REGION_HINTS.items()], _by_city(c, 1, rest))


def skills(low: str) -> str:
    terms = dict.fromkeys((*lx.AI_TERMS, *lx.AUTOMATION_TERMS, *lx.ENGINEERING_TERMS))
    items = ", ".join(f"CASE WHEN {term(low, [t])} THEN {quote(t)} END" for t in terms)
    return f"array_to_string(list_filter([{items}], lambda x: x IS NOT NULL)[1:18], ', ')"


def bucket(n: str) -> str:
    return cases([(f"{n} BETWEEN {a} AND {b}", quote(label)) for a, b, label in lx.EMPLOYEE_BUCKETS], quote(lx.OPEN_BUCKET))


_COUNT, _PEOPLE = "(\\d{1,3}(?:,\\d{3})?)", "(employees|people|team members)"
_RANGE = f"{_COUNT}\\s*[-–]\\s*{_COUNT}\\s+{_PEOPLE}"
_PLUS = f"{_COUNT}(\\+?)\\s+{_PEOPLE}"
_TEAM = "(team of|team size|company of)\\s+(\\d{1,4})"


def size(low: str, source: bool) -> str:
    got = lambda p, g: f"regexp_extract({low}, '{p}', {g})"
    n = lambda x: f"CAST(replace({x}, ',', '') AS INTEGER)"
    show = lambda x: f"format('{{:,}}', {n(x)})"
    said = "'posting text'"
    words = [(("enterprise", "corporation", "konzern", "large company"), "1,001+", "inferred from company wording"),
             (("startup", "early-stage", "early stage", "seed stage"), "1-50", "inferred from startup wording"),
             (("mittelstand", "sme", "small business", "mid-market"), "51-500", "inferred from SME wording")]
    return cases(
        [(f"{got(_RANGE, 1)} <> ''", said if source else f"{show(got(_RANGE, 1))} || '-' || {show(got(_RANGE, 2))}"),
         (f"{got(_PLUS, 1)} <> '' AND {got(_PLUS, 2)} = '+'", said if source else f"{show(got(_PLUS, 1))} || '+'"),
         (f"{got(_PLUS, 1)} <> ''", said if source else bucket(n(got(_PLUS, 1)))),
         (f"{got(_TEAM, 2)} <> ''", said if source else bucket(n(got(_TEAM, 2)))),
         *[(holds(low, t), quote(b if source else a)) for t, a, b in words]],
        "''" if source else "'unknown'",
    )


def plain(x: str, suffixes) -> str:
    out = f"regexp_replace(strip_accents(lower({x})), '[^\\x00-\\x7F]', '', 'g')"
    out = f"trim(regexp_replace(regexp_replace({out}, '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    for s in suffixes:
        out = f"trim(regexp_replace({out}, ' {s}$', ''))"
    return out


def core(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace({x}, '\\b({'|'.join(lx.TITLE_NOISE)})\\b', ' ', 'g'), '\\s+', ' ', 'g'))"


def url(x: str) -> str:
    """For addresses with a scheme and plain parameters."""
    query = f"list_filter(string_split(regexp_extract({x}, '\\?([^#]*)', 1), '&'), lambda p: regexp_matches(p, '=.') AND lower(string_split(p, '=')[1]) NOT IN ({', '.join(map(quote, lx.TRACKING_PARAMETERS))}))"
    base = f"lower(regexp_extract({x}, '^[a-zA-Z]+://[^/?#]*')) || regexp_replace(regexp_extract({x}, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/+$', '')"
    return f"CASE WHEN {x} = '' THEN '' ELSE {base} || CASE WHEN len({query}) > 0 THEN '?' || array_to_string({query}, '&') ELSE '' END END"


_SIZES = ", ".join(f"({i}, {quote(k)}, {quote(v)})" for i, (k, v) in enumerate(lx.COMPANY_SIZES.items()))
BLOB = "concat_ws(' ', job_title, company_name, location, city, country, region, job_description, required_skills, '', salary, company_size)"

ENRICHED = f"""{RAW},
cleaned AS (
    SELECT seq, source_platform, job_url, {tidy('job_title')} AS job_title, {tidy('company_name')} AS company_name,
           {tidy('location')} AS location, {tidy('job_description')} AS job_description, {tidy('salary')} AS salary FROM raw
),
texts AS (
    SELECT *, concat_ws(' ', job_title, company_name, location, '', '', '', job_description, '', '', salary, 'unknown') AS words FROM cleaned
),
lowered AS (SELECT *, lower(words) AS low, lower(location) AS place FROM texts),
sized(i, name, n) AS (VALUES {_SIZES}),
keyed AS (SELECT {plain('name', lx.COMPANY_SUFFIXES)} AS k, arg_max(n, i) AS n FROM sized GROUP BY 1),
labels_of AS (SELECT k, CASE WHEN regexp_matches(n, '^[0-9]+$') THEN {bucket('CAST(n AS BIGINT)')} ELSE n END AS label FROM keyed WHERE k <> ''),
placed AS MATERIALIZED (
    SELECT *, CASE WHEN location <> '' AND {region('place', city('place'))} <> 'unknown' THEN place ELSE low END AS whereabouts FROM lowered
),
enriched AS MATERIALIZED (
    SELECT seq, source_platform, job_url, job_title, company_name, location, job_description, salary,
           {remote('low')} AS remote_type, {seniority('low')} AS seniority, {language('words')} AS language,
           {region('whereabouts', city('whereabouts'))} AS region, {country('whereabouts', city('whereabouts'))} AS country,
           {city('whereabouts')} AS city, {skills('low')} AS required_skills,
           {holds('low', ('startup', 'early-stage', 'saas', 'y combinator'))} AS is_startup_likely,
           coalesce(label, {size('low', False)}) AS company_size,
           CASE WHEN label IS NOT NULL THEN 'size override file' ELSE {size('low', True)} END AS company_size_source
    FROM placed LEFT JOIN labels_of ON k = {plain('company_name', lx.COMPANY_SUFFIXES)}
)"""


def _pay(low: str) -> dict[str, str]:
    """Lists of yearly and monthly amounts and weekly hours."""
    amount = "(?:[.,](\\d{3}))?\\s?k?\\s?(?:eur|euro|brutto)?\\s?"
    year = "(\\d{2,3})" + amount + "(?:year|jahr|jaehrlich|p\\.a\\.|per year|annum)"
    month = "(\\d{1,2})" + amount + "(?:month|monat|monatlich|monthly)"
    short = "(?:eur|euro)\\s?(\\d{2,3})(?:[.,](\\d{3}))?\\s?k"
    week = "(\\d{2})\\s?(?:h|std\\.?|stunden)\\s?(?:/|pro|per)?\\s?(?:woche|week|weekly)"
    hours = "(\\d{2})\\s?(?:stunden|hours)"
    every = lambda p, g: f"regexp_extract_all({low}, '{p}', {g})"
    values = lambda p: (
        f"list_transform(list_zip({every(p, 1)}, {every(p, 2)}), lambda z: CASE WHEN coalesce(z[2], '') <> '' "
        f"THEN CAST(z[1] || z[2] AS INTEGER) ELSE CAST(z[1] AS INTEGER) * 1000 END)"
    )
    return {
        "years": f"list_concat({values(year)}, {values(short)})",
        "months": values(month),
        "hours": f"list_transform(list_concat({every(week, 1)}, {every(hours, 1)}), lambda x: CAST(x AS INTEGER))",
    }


_P = _pay("lower(salary || ' ' || blob)")
PAID = f"""{ENRICHED},
blobs AS (SELECT *, {BLOB} AS blob FROM enriched),
lists AS (SELECT *, lower(blob) AS text, lower(job_title) AS title, {_P['years']} AS years, {_P['months']} AS months, {_P['hours']} AS weekly FROM blobs),
flags AS (
    SELECT *, len(years) + len(months) > 0 AS paid, len(weekly) > 0 AS timed,
           len(list_filter(years, lambda v: v >= {lx.YEARLY_LEAST})) + len(list_filter(months, lambda v: v >= {lx.MONTHLY_LEAST})) > 0 AS paid_well,
           len(list_filter(weekly, lambda v: v <= {lx.HOURS_MOST})) > 0 AS short_week FROM lists
),
paid AS MATERIALIZED (
    SELECT *, CASE WHEN paid THEN 'yes' ELSE 'unknown' END AS salary_found,
           CASE WHEN paid_well THEN 'yes' WHEN paid THEN 'no' ELSE 'unknown' END AS salary_target_met,
           CASE WHEN timed THEN 'yes' ELSE 'unknown' END AS hours_found,
           CASE WHEN short_week THEN 'yes' WHEN timed THEN 'no' ELSE 'unknown' END AS hours_target_met,
           (CASE WHEN paid_well THEN 'salary target met' WHEN NOT paid THEN 'salary not found' ELSE 'salary target not met' END) || '; ' ||
           (CASE WHEN short_week THEN 'weekly hours target met' WHEN NOT timed THEN 'weekly hours not found' ELSE 'weekly hours target not met' END) AS salary_hour_notes
    FROM flags
)"""


def points(*pairs) -> str:
    return "(" + " + ".join(f"CASE WHEN {test} THEN {n} ELSE 0 END" for n, test in pairs) + ")"


_TARGET, _ROLE, _AI = term("title", lx.TARGET_TITLES), term("title", lx.ROLE_TITLE_TERMS), term("text", lx.AI_TERMS)
_AUTO, _SENIOR, _JUNIOR = term("text", lx.AUTOMATION_TERMS), term("text", lx.SENIOR_TERMS), term("text", lx.JUNIOR_TERMS)
_RELEVANT_TERMS = tuple(dict.fromkeys((*lx.AI_TERMS, *lx.EXTRA_AI_TERMS, *lx.AUTOMATION_TOOL_TERMS)))
_YEARS = "(regexp_matches(text, '\\b([5-9]|10)\\+?\\s*(years|jahre)\\b') OR regexp_matches(text, '\\b([5-9]|10)\\+?\\s*лет($|[^\\p{L}\\d_])'))"
_NEAR = "region IN ('dach', 'europe', 'worldwide')"
_COMPONENTS = {
    "title_fit_score": points((25, "f_target"), (5, "f_role")),
    "seniority_fit_score": points((20, "f_junior")),
    "remote_fit_score": points((15, f"(remote_type IN ('remote', 'hybrid') OR {term('text', ('remote', 'hybrid', 'homeoffice', 'удал'))})")),
    "skill_fit_score": points((15, "f_auto"), (15, "f_ai")),
    "geography_fit_score": points((10, f"({_NEAR} OR contains(text, 'remote europe'))"), (5, "language IN ('de', 'en', 'ru')")),
    "compensation_fit_score": points((8, "salary_target_met = 'yes'"), (7, "hours_target_met = 'yes'")),
    "company_fit_score": points((10, f"({term('text', lx.STARTUP_TERMS)} OR is_startup_likely)")),
    "penalty_score": points(
        (-15, "salary_target_met = 'no'"), (-5, "salary_target_met = 'unknown'"), (-15, "hours_target_met = 'no'"), (-5, "hours_target_met = 'unknown'"),
        (-30, "f_senior"), (-20, term("title", lx.SENIOR_TERMS)), (-20, "f_years"), (-10, "(remote_type = 'onsite' AND region NOT IN ('dach', 'europe'))"),
        (-10, f"({term('text', lx.QA_TERMS)} AND NOT {term('text', (*lx.AI_TERMS, *lx.AUTOMATION_TERMS[:8]))})"),
        (-45, f"NOT (f_target OR {term('title', _RELEVANT_TERMS)})"), (-20, f"(NOT f_target AND {term('title', lx.OFF_TARGET_TITLE_TERMS)})"),
        (-25, "NOT f_role"), (-100, term("title", lx.UNRELATED_TITLE_TERMS)),
    ),
}
_FIT = cases(
    [(holds("text", ("enterprise", "corporation", "konzern", "10,000+", "10000+")), "'enterprise'"),
     (holds("text", ("startup", "early-stage", "seed", "series a", "y combinator", "yc")), "'startup'"),
     (holds("text", ("gmbh", "agency", "agentur", "consulting", "beratung", "saas", "b2b")), "'sme/mid-market'")],
    "'unknown'",
)
_REASONS = [
    ("f_target", "'title strongly matches an AI automation or applied AI target role'"), ("f_junior", "'junior or entry-level signals were found'"),
    ("remote_type IN ('remote', 'hybrid')", "remote_type || ' work is available'"), ("f_auto", "'automation, no-code, or workflow keywords are present'"),
    ("f_ai", "'AI, LLM, or agent keywords are present'"), (_NEAR, "'region matches the target geography'"),
    ("salary_target_met = 'yes'", "'compensation target is met'"), ("hours_target_met = 'yes'", "'weekly hours target is met'"),
]
_CAUTIONS = [
    ("salary_target_met <> 'yes'", "'compensation status is ' || salary_target_met"), ("hours_target_met <> 'yes'", "'weekly hours status is ' || hours_target_met"),
    ("f_senior", "'senior or lead signals reduce the score'"), ("f_years", "'more than 5 years of experience are mentioned'"),
]


def _joined(pairs) -> str:
    return "concat_ws('; ', " + ", ".join(f"CASE WHEN {t} THEN {v} END" for t, v in pairs) + ")"


SCORED = f"""{PAID},
tested AS (
    SELECT *, {_TARGET} AS f_target, {_ROLE} AS f_role, {_AI} AS f_ai, {_AUTO} AS f_auto, {_SENIOR} AS f_senior, {_JUNIOR} AS f_junior, {_YEARS} AS f_years FROM paid
),
parts AS (SELECT *, {', '.join(f'{e} AS {n}' for n, e in _COMPONENTS.items())} FROM tested),
summed AS (SELECT *, greatest(0, least(100, {' + '.join(_COMPONENTS)})) AS relevance_score FROM parts),
scored AS MATERIALIZED (
    SELECT *, {_FIT} AS company_fit,
           CASE WHEN relevance_score >= 80 THEN 'urgent' WHEN relevance_score >= 70 THEN 'high' WHEN relevance_score >= 60 THEN 'medium' ELSE 'low' END AS priority_level,
           (CASE WHEN {_joined(_REASONS)} = '' THEN 'only weak target-role signals were detected' ELSE {_joined(_REASONS)} END)
           || (CASE WHEN {_joined(_CAUTIONS)} = '' THEN '' ELSE '. Caveats: ' || {_joined(_CAUTIONS)} END) || '.' AS reason_for_score
    FROM summed
)"""

_LOC = plain("location", lx.TITLE_SUFFIXES)
_TITLE_CORE = core(plain("job_title", lx.TITLE_SUFFIXES))
_PLACE_KEY = f"CASE WHEN contains({_LOC}, 'remote') THEN 'remote' ELSE {_LOC}[1:30] END"


def prepared(source: str) -> str:
    return f"""prepared AS (
    SELECT *, {url('job_url')} AS url, {plain('job_title', lx.TITLE_SUFFIXES)} AS normalized_title, {plain('company_name', lx.TITLE_SUFFIXES)} AS normalized_company,
           concat_ws('|', nullif({_TITLE_CORE}, ''), nullif({plain('company_name', lx.TITLE_SUFFIXES)}, ''), nullif({_PLACE_KEY}, '')) AS mark
    FROM {source}
),
keyed_rows AS (SELECT *, CASE WHEN url <> '' THEN url ELSE mark END AS deduplication_key, row_number() OVER (ORDER BY seq) AS n FROM prepared)"""


#: The greedy pass in order: each row is kept unless its URL or signature was kept before.
GREEDY = """walk(n, urls, marks, kept) AS (
    SELECT CAST(0 AS BIGINT), CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]), false
    UNION ALL
    SELECT k.n,
           CASE WHEN ok AND url <> '' THEN list_append(urls, url) ELSE urls END,
           CASE WHEN ok THEN list_append(marks, mark) ELSE marks END,
           ok
    FROM (
        SELECT r.n, r.url, r.mark, w.urls, w.marks,
               NOT ((r.url <> '' AND list_contains(w.urls, r.url)) OR list_contains(w.marks, r.mark)) AS ok
        FROM walk w JOIN keyed_rows r ON r.n = w.n + 1
    ) k
),
unique_rows AS (SELECT r.* FROM keyed_rows r JOIN walk w ON w.n = r.n WHERE w.kept)"""


def floor_of(label: str) -> str:
    low = f"lower(trim({label}))"
    return f"CASE WHEN {low} <> 'unknown' AND regexp_extract({low}, '\\d[\\d,]*') <> '' THEN CAST(replace(regexp_extract({low}, '\\d[\\d,]*'), ',', '') AS BIGINT) END"


def too_large(label: str) -> str:
    return f"coalesce(CASE WHEN contains({label}, '+') THEN {floor_of(label)} >= {lx.MOST_EMPLOYEES} ELSE {floor_of(label)} > {lx.MOST_EMPLOYEES} END, false)"


def low_cost(salary: str, location: str, blob: str) -> str:
    text = f"lower(concat_ws(chr(10), {salary}, {location}, {blob}))"
    pay = f"trim(regexp_extract({text}, {quote('(?:' + '|'.join(lx.LOW_COST_PAY) + ')')}))"
    place = f"trim(regexp_extract({text}, {quote(chr(92) + 'b(?:' + '|'.join(lx.LOW_COST_PLACES) + ')' + chr(92) + 'b')}))"
    return f"CASE WHEN {pay} <> '' THEN 'low-wage-region pay (' || {pay} || ')' WHEN {place} <> '' THEN 'low-wage region (' || {place} || ')' ELSE '' END"


def titled(x: str) -> str:
    """Letter runs capitalised."""
    return f"array_to_string(list_transform(regexp_extract_all({x}, '\\p{{L}}+|[^\\p{{L}}]+'), lambda r: upper(r[1:1]) || lower(r[2:])), '')"


def squeezed(sql: str) -> str:
    return re.sub(r"\n\s+", "\n", sql).strip()
