"""RSS and Atom feeds through the XML reader, and CSV files of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions.text import html_to_text, strip_white
from postlode.schema import conform
from postlode.sources.boards import mapped, relevant
from postlode.sources.payload import first

_TEXTS = (
    "title", "description", "encoded", "content", "summary", "companyName", "company", "creator", "location",
    "locationRestriction", "region", "country", "skills", "pubDate", "updated", "published",
)
_SCHEMA = ", ".join([*(f"{t} string" for t in _TEXTS), "link struct<_VALUE: string, _href: string>", "author struct<_VALUE: string, name: string>"])


def elements(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """Elements of one tag in file order; prefixes of names are dropped."""
    read = spark.read.format("xml").options(rowTag=tag, ignoreNamespace=True).schema(_SCHEMA).load(path)
    return read.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))


def _text(name: str) -> Column:
    return strip_white(F.coalesce(F.col(name), F.lit("")))


def weworkremotely(spark: SparkSession, path: str) -> DataFrame:
    """Titles are "company: role" (S4, F28)."""
    raw = _text("title")
    role = strip_white(F.regexp_replace(raw, r"^[^:]*:", ""))
    company = F.when(raw.contains(":"), strip_white(F.substring_index(raw, ":", 1))).otherwise("")
    place = F.concat_ws(" ", F.nullif(_text("region"), F.lit("")), F.nullif(_text("country"), F.lit("")))
    rows = mapped(
        elements(spark, path, "item"),
        job_title=first(role, raw), company_name=company, location=first(place, F.lit("Remote")), remote_type=F.lit("remote"), region=F.lit("worldwide"),
        source_platform=F.lit("weworkremotely"), job_url=_text("link._VALUE"), date_posted=_text("pubDate"),
        job_description=html_to_text(_text("description")), required_skills=_text("skills"),
    )
    return relevant(rows, F.concat_ws(" ", "job_title", "required_skills", "job_description"))


def rss(spark: SparkSession, path: str) -> DataFrame:
    """Any feed, by its titles; a company comes from its tag, "company: role" or "role at company" (S14, F12).

    The host in ``source_platform`` is the file's name.
    """
    raw = _text("title")
    rows = relevant(elements(spark, path, "item").unionByName(elements(spark, path, "entry")), raw)
    tagged = first(_text("companyName"), _text("company"), _text("creator"), F.substring(first(_text("author.name"), _text("author._VALUE")), 1, 80))
    colon = raw.contains(": ")
    at = F.regexp_extract(raw, r"(?iU)\bat\s+(.+)$", 1)
    before = strip_white(F.regexp_extract(raw, r"(?iU)^(.*?)\bat\s+.+$", 1))
    company = F.when(tagged != "", tagged).when(colon, strip_white(F.substring_index(raw, ": ", 1))).otherwise(strip_white(at))
    role = strip_white(F.regexp_replace(raw, r"(?s)^.*?: ", ""))
    title = F.when(tagged != "", raw).when(colon, first(role, raw)).when(at != "", first(before, raw)).otherwise(raw)
    host = F.regexp_replace(F.regexp_extract("_file", r"([^/]+?)(?:\.(?:xml|rss))?$", 1), r"^www\.", "")
    return mapped(
        rows,
        job_title=F.substring(title, 1, 120), company_name=F.substring(company, 1, 80), remote_type=F.lit("remote"),
        location=first(*[_text(c) for c in ("location", "locationRestriction", "region", "country")], F.lit("Remote")),
        source_platform=F.concat(F.lit("rss:"), host), source_type=F.lit("feed"), job_url=first(_text("link._VALUE"), _text("link._href")),
        date_posted=first(_text("pubDate"), _text("updated"), _text("published")),
        job_description=html_to_text(first(*[_text(c) for c in ("description", "encoded", "content", "summary")])), required_skills=_text("skills"),
    )


def manual(spark: SparkSession, path: str) -> DataFrame:
    """CSV with the row's column names in its head; a value of the wrong type fails the source."""
    read = spark.read.csv(path, header=True, multiLine=True, escape='"')
    placed = read.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    return conform(placed, "_file", "_at")
