"""Search queries made from titles, places and sites; board slugs collected from results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.results import board_slug
from postlode.operators.joins import round_robin
from postlode.operators.order import numbered


def region_terms(region: str, remote: bool, profile: lx.TargetingProfile) -> list[str]:
    terms = list(profile.region_terms.get(region.lower(), (region,)))
    if remote and region.lower() == "worldwide":
        terms = ["Remote", "Hybrid", *terms]
    return list(dict.fromkeys(terms))


def _placed(spark: SparkSession, values, place: str, value: str) -> DataFrame:
    """A literal list of a few dozen entries, in one partition: products of such lists stay small."""
    return spark.createDataFrame(list(enumerate(values)), f"{place} int, {value} string").coalesce(1)


def search_queries(
    spark: SparkSession, region: str = "worldwide", remote: bool = True, limit: int | None = None, profile: lx.TargetingProfile | None = None
) -> DataFrame:
    """``place`` (from 1) and ``query``: titles with places in turn, concepts likewise, then sites with every place and title."""
    profile = profile or lx.TargetingProfile()
    places = _placed(spark, region_terms(region, remote, profile), "j", "region")
    quoted = lambda c: F.concat(F.lit('"'), F.col(c), F.lit('"'))
    titles = round_robin(_placed(spark, profile.search_priority_titles, "i", "title"), places, "i", "j")
    concepts = round_robin(_placed(spark, profile.search_concept_queries, "i", "concept"), places, "i", "j")
    sites = _placed(spark, profile.search_sites, "i", "site")
    wanted = _placed(spark, profile.target_titles[:24], "k", "title")
    zero = F.lit(0)
    parts = [
        titles.select(zero.alias("a"), F.col("i").alias("b"), zero.alias("c"), zero.alias("d"), F.concat_ws(" ", quoted("title"), quoted("region")).alias("query")),
        concepts.select(F.lit(1), "i", zero, zero, F.concat_ws(" ", "concept", quoted("region"), F.lit("job"))),
        # literal lists of a few dozen entries each
        sites.crossJoin(places).crossJoin(wanted).select(F.lit(2), "i", "j", "k", F.concat_ws(" ", "site", quoted("title"), quoted("region"))),
    ]
    every = parts[0].union(parts[1]).union(parts[2])
    if limit is not None:
        every = every.orderBy("a", "b", "c", "d").limit(limit)
    return numbered(every, ["a", "b", "c", "d"], "n").select((F.col("n") + 1).cast("int").alias("place"), "query")


def collect_slugs(found: DataFrame) -> DataFrame:
    """``provider, slugs``: different lower-cased slugs of ``link`` addresses, sorted."""
    named = found.select(board_slug(F.col("link")).alias("b")).filter("b is not null")
    return named.groupBy(F.col("b.provider").alias("provider")).agg(F.sort_array(F.collect_set(F.lower(F.trim("b.slug")))).alias("slugs"))


def merge_slugs(stored: DataFrame, found: DataFrame) -> DataFrame:
    """``provider, merged, added`` of two ``provider, slugs`` frames, sorted."""
    a, b = stored.withColumnRenamed("slugs", "old"), found.withColumnRenamed("slugs", "new")
    none = F.array().cast("array<string>")
    old, new = F.coalesce("old", none), F.coalesce("new", none)
    return a.join(b, "provider", "full_outer").select(
        "provider", F.array_sort(F.array_union(old, new)).alias("merged"), F.array_sort(F.array_except(new, old)).alias("added")
    )


def discovery_queries(limit: int = lx.MOST_DISCOVERY_SEARCHES) -> list[str]:
    """Searches for company boards: each keyword on every board's site, cut at the most that a run may ask."""
    every = [f'site:{site} "{keyword}"' for keyword in lx.DISCOVERY_KEYWORDS for site in lx.BOARD_SITES.values()]
    return every[: min(limit, lx.MOST_DISCOVERY_SEARCHES)]


def discover(answers: DataFrame, stored: DataFrame) -> DataFrame:
    """``provider, merged, added`` of stored slugs and those that search answers (``_file, body``) name."""
    from postlode.sources.payload import field, objects

    body = F.coalesce(F.get_json_object("body", "$.data"), F.col("body"))
    links = objects(answers.withColumn("body", body), "organic_results").select(field("link").alias("link"))
    return merge_slugs(stored, collect_slugs(links))
