"""Postings that pages publish as structured data: JSON-LD objects of type JobPosting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.functions import classify, results
from postlode.functions.text import collapse, html_to_text, unescape
from postlode.operators.barrier import seal
from postlode.sources.boards import mapped, relevant
from postlode.sources.payload import field, files, first, objects
from postlode.state import pinned

KIND = "JobPosting"
SCRIPT = r"""(?is)<script\b[^>]*\btype\s*=\s*["']?application/ld\+json\b[^>]*>(.*?)</script\s*>"""
_NONE = "array<variant>"


def unnested(values: DataFrame, keep: Callable[[Column], Column]) -> DataFrame:
    """Objects of JSON values for which ``keep`` holds, one row each, however deep lists and graphs hold them.

    ``values`` has v (variant) and path (array of int) beside other columns; a value's parts have longer
    paths, so paths sort as the document does. Each round takes one level apart, of values that still
    hold others, and writes it; rounds follow the depth of the deepest value.
    """
    others = [c for c in values.columns if c not in ("v", "path")]
    found, level = None, values
    while True:
        listed = F.try_variant_get("v", "$", _NONE)
        graph = F.try_variant_get("v", '$["@graph"]', "variant")
        level = pinned(level.select(*others, "path", "v", F.coalesce(listed, F.when(graph.isNotNull(), F.array(graph))).alias("parts"), listed.isNull().alias("single")))
        own = level.filter("single").filter(keep(F.col("v"))).select(*others, "path", "v")
        found = own if found is None else found.union(own)
        level = level.filter("parts is not null").select(*others, "path", F.posexplode("parts").alias("_nth", "v")).withColumn("path", F.array_append("path", F.col("_nth")))
        if level.isEmpty():
            return found


def _is_posting(x: Column) -> Column:
    kinds = F.try_variant_get(x, '$["@type"]', "array<string>")
    return F.coalesce(F.array_contains(kinds, KIND), F.try_variant_get(x, '$["@type"]', "string") == KIND, F.lit(False))


def with_posting(pages: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and ``p``: the first JobPosting among a page's JSON-LD scripts (column html), as a variant; pages without one are left out."""
    bodies = F.filter(F.regexp_extract_all(F.when(F.col("html").contains(KIND), F.col("html")).otherwise(""), F.lit(SCRIPT), F.lit(1)), lambda b: b.contains(KIND))
    parsed = pages.select(*keys, F.posexplode(bodies).alias("_nth", "body")).select(*keys, F.array("_nth").alias("path"), F.try_parse_json("body").alias("v"))
    found = unnested(parsed.filter("v is not null"), _is_posting).select(*keys, F.struct("path", F.to_json("v").alias("json")).alias("one"))
    return found.groupBy(*keys).agg(F.parse_json(F.min("one")["json"]).alias("p"))


def _text(of: Column, path: str) -> Column:
    """The text at a path, of a list its first item; empty where it is missing, null, false or zero."""
    listed = F.try_variant_get(of, path, "array<string>")
    value = F.when(listed.isNotNull(), F.get(listed, 0)).otherwise(F.try_variant_get(of, path, "string"))
    return F.when(value.isin("false", "0"), "").otherwise(F.coalesce(value, F.lit("")))


def posting_fields(p: Column) -> dict[str, Column]:
    """title, company, location, remote_type, description, date_posted and salary of a JobPosting, empty where unknown."""
    text = lambda path: _text(p, path)
    away = F.upper(text("$.jobLocationType")) == "TELECOMMUTE"
    place = F.coalesce(F.try_variant_get(p, "$.jobLocation[0]", "variant"), F.try_variant_get(p, "$.jobLocation", "variant"))
    at = lambda name: F.trim(_text(place, f"$.address.{name}"))
    parts = [F.nullif(x, F.lit("")) for x in (at("addressLocality"), first(at("addressRegion"), at("addressCountry")))]
    low, high = first(text("$.baseSalary.value.minValue"), text("$.baseSalary.value.value")), text("$.baseSalary.value.maxValue")
    amount = F.concat_ws("-", F.nullif(low, F.lit("")), F.nullif(high, F.lit("")))
    nested = F.try_variant_get(p, "$.baseSalary.value", "map<string,variant>").isNotNull()
    pay = [text("$.baseSalary.currency"), F.when(nested, amount).otherwise(text("$.baseSalary.value")), text("$.baseSalary.value.unitText")]
    said = F.when(F.concat(pay[1], pay[2]) == "", F.when(nested, pay[0]).otherwise("")).otherwise(F.concat_ws(" ", *[F.nullif(x, F.lit("")) for x in pay]))
    organisation = F.try_variant_get(p, "$.hiringOrganization", "map<string,variant>").isNotNull()
    company = F.when(organisation, text("$.hiringOrganization.name")).otherwise(text("$.hiringOrganization"))
    none = F.lit("")
    return {
        "title": collapse(unescape(text("$.title"))),
        "company": collapse(unescape(company)),
        "location": first(collapse(F.concat_ws(", ", *parts)), F.when(away, "Remote").otherwise(none)),
        "remote_type": F.when(away, "remote").otherwise(none),
        "description": html_to_text(unescape(text("$.description")), limit=7000),
        "date_posted": text("$.datePosted"),
        "salary": collapse(said),
    }


def page_postings(pages: DataFrame, headcounts: DataFrame | None = None) -> DataFrame:
    """Postings of stored pages (``_file, _at, url, status, html``), by their structured data.

    An address counts once, its first page holds; pages that are gone or hold no posting, and titles that
    are not searched for, are left out. ``headcounts`` (url, html): company pages that may name employees (J6).
    """
    link = F.substring_index("url", "?", 1)
    rows = pages.select("_file", "_at", link.alias("link"), "status", "html").filter(results.is_posting_url(F.col("link")))
    turn = F.row_number().over(Window.partitionBy("link").orderBy("_file", "_at"))
    rows = rows.withColumn("_turn", turn).filter("_turn = 1 and coalesce(status, 200) < 400")
    rows = with_posting(rows, "_file", "_at", "link")
    company_page = F.when(F.try_variant_get("p", "$.hiringOrganization", "map<string,variant>").isNotNull(), _text(F.col("p"), "$.hiringOrganization.url"))
    told = rows.select("_file", "_at", "link", company_page.alias("company_page"), *[c.alias(f"p_{n}") for n, c in posting_fields(F.col("p")).items()])
    told = seal(told, *[c for c in told.columns if c.startswith("p_")]).filter("p_title <> ''")
    size = F.lit("")
    if headcounts is not None:
        known = headcounts.groupBy(F.col("url").alias("company_page")).agg(F.max(classify.headcount(F.col("html"))).alias("headcount"))
        told, size = told.join(known, "company_page", "left"), F.coalesce("headcount", F.lit(""))
    told = relevant(told, F.col("p_title"))
    return mapped(
        told,
        job_title=F.substring("p_title", 1, 160), company_name=first(F.substring("p_company", 1, 80), F.lit("Unknown")), location=first(F.col("p_location"), F.lit("Unknown")),
        remote_type=F.when(F.col("p_remote_type") != "", "remote").otherwise("unknown"), source_platform=F.lit("join.com"), source_type=F.lit("feed"),
        job_url=F.col("link"), date_posted=F.col("p_date_posted"), job_description=F.col("p_description"), salary=F.col("p_salary"),
        company_size=first(size, F.lit("unknown")), company_size_source=F.when(size != "", "join.com company page").otherwise(""),
    )


def join(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Stored pages as arrays of objects with url, status and html."""
    rows = objects(files(spark, path))
    return page_postings(rows.select("_file", "_at", field("url").alias("url"), F.nullif(field("status"), F.lit("")).try_cast("int").alias("status"), field("html").alias("html")))
