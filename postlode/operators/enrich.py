"""Cleaning and filling of postings: one projection over all sources together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.functions import classify
from postlode.functions.match import Index, search
from postlode.functions.text import clean_field
from postlode.operators.barrier import seal
from postlode.operators.joins import with_size_override
from postlode.schema import COLUMNS, text_blob

CLEANED = ("job_title", "company_name", "location", "job_description", "salary")


def _unless_known(name: str, value: Column) -> Column:
    return F.when(F.col(name) != "unknown", F.col(name)).otherwise(value)


def enrich(df: DataFrame, sizes: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Postings with unset fields filled from their text; columns beyond the row's stay.

    The text is taken once, before place, skills and size are filled. A location that gives a
    region is read by itself, else the whole text. A size from ``sizes`` (company to size)
    wins over any other.
    """
    extra = [c for c in df.columns if c not in COLUMNS]
    df = df.withColumns({c: clean_field(F.col(c)) for c in CLEANED})
    df = df.withColumn("_text", text_blob())
    padded = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    df = df.withColumns({"_low": padded("_text"), "_place": padded("location")})

    # every term has a bit, and one pass over a text finds them all; the classifiers are tests of bits
    index, of_place = Index(), Index()
    low, place, where = index.on("_low_"), index.on("_place_"), index.on("_where_")
    own = (F.col("location") != "") & (classify.location_region(place, classify.location_city(place)) != "unknown")
    filled = lambda name, value: F.when(F.col(name) != "", F.col(name)).otherwise(value)
    city = F.col("_city")
    places = {
        "region": F.when(~F.col("region").isin("", "unknown"), F.col("region")).otherwise(classify.location_region(where, city)),
        "country": filled("country", classify.location_country(where, city)),
        "city": filled("city", city),
    }
    found_city = classify.location_city(where)
    of_place.bits, of_places = dict(index.bits), index.count  # the first bits; a place is searched for no others
    sizes_found = dict(zip(("_size_0", "_size_1", "_size_2"), classify.size_matches(F.col("_low"), low)))
    others = {
        "remote_type": _unless_known("remote_type", classify.remote_type(low)),
        "seniority": _unless_known("seniority", classify.seniority(low)),
        "language": _unless_known("language", classify.language(F.col("_text"), low)),
        "required_skills": filled("required_skills", classify.skills(low)),
        "is_startup_likely": F.col("is_startup_likely") | classify.startup_likely(low),
        "_size": classify.company_size(F.col("_text"), low, [F.col(c) for c in sizes_found]),
    }
    df, masks = search(df, (index, "_low_", "_low"), (of_place, "_place_", "_place"))
    df = seal(df, *[m for m in masks if m.startswith("_low_")])
    df = seal(df.withColumns(sizes_found), *sizes_found).withColumn("_own", own)
    df = df.withColumns({f"_where_{i}": F.when(F.col("_own"), F.col(f"_place_{i}")).otherwise(F.col(f"_low_{i}")) for i in range(of_places)})
    df = seal(df.withColumn("_city", found_city), "_city").withColumns(places | others)
    unset = F.col("company_size").isin("", "unknown")
    df = seal(df, "_size").withColumns(
        {
            "company_size_source": F.when(unset, F.col("_size.source")).otherwise(F.col("company_size_source")),
            "company_size": F.when(unset, F.col("_size.size")).otherwise(F.col("company_size")),
        }
    )
    return with_size_override(df, sizes).select(*COLUMNS, *extra)
