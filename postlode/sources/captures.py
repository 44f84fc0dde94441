"""Stored web-search answers as postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode.functions import results
from postlode.functions.text import clean_title, clean_url, domain
from postlode.sources.boards import mapped
from postlode.sources.payload import field, files, objects

#: Path of the list and the names of title, link and snippet in each engine's answers.
ENGINES = {
    "cached": ("organic_results", "title", "link", "snippet"),
    "duckduckgo": ("", "title", "href", "body"),
    "brave": ("results", "title", "url", "description"),
}


def search_results(spark: SparkSession, path: str, engine: str = "cached", status: DataFrame | None = None) -> DataFrame:
    """Results that are postings, in file and list order.

    A file is an answer, or ``{query, data}`` around one. ``status`` (link, status): links known
    to be gone are dropped, unknown ones kept. With a column ``_file`` a status holds for that answer's
    link only: the same link may stand in another that was asked when the page was there.
    """
    where, title_at, link_at, about_at = ENGINES[engine]
    body = F.col("body")
    wrapped = F.coalesce(F.get_json_object(body, "$.data"), body)
    answers = files(spark, path).select("_file", F.coalesce(F.get_json_object(body, "$.query"), F.lit("")).alias("_query"), wrapped.alias("body"))
    if engine == "brave":
        answers = answers.withColumn("body", F.get_json_object("body", "$.web"))
    rows = objects(answers, where).select(
        "_file", "_at", "_query", field(title_at).alias("title"), clean_url(field(link_at)).alias("link"), field(about_at).alias("about")
    )
    rows = rows.filter((F.col("title") != "") & (F.col("link") != "") & ~results.is_noise(F.col("title"), F.col("link")))
    if status is not None:
        by = [c for c in ("_file", "link") if c in status.columns]
        known = status.groupBy(*by).agg(F.max("status").alias("_status"))
        rows = rows.join(known, by, "left").filter(~results.is_dead(F.col("_status")))
    host = domain(F.col("link"))
    return mapped(
        rows,
        job_title=clean_title(F.col("title")), company_name=results.guess_company(F.col("title"), host), location=results.guess_location(F.col("_query"), F.col("about")),
        source_platform=F.concat(F.lit("serpapi:"), host), job_url=F.col("link"), job_description=F.col("about"),
    )
