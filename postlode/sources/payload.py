"""Captured payloads as rows: one row a file, then one row an object inside it.

Nothing is fetched here; sources read what an acquisition step stored. Objects are parsed once,
to maps of their fields' texts, so that missing, null and unexpected fields are empty strings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """``_file, body`` of each file under ``path``; a table of such rows is taken as it is."""
    if isinstance(path, DataFrame):
        return path.select("_file", "body")
    read = spark.read.text(path, wholetext=True)
    return read.select(F.col("_metadata.file_path").alias("_file"), F.col("value").alias("body"))


def objects(payloads: DataFrame, inside: str = "") -> DataFrame:
    """``_file, _at, _o``: objects of the top-level array, or of the array that field ``inside`` holds."""
    parsed = F.from_json("body", f"struct<`{inside}`: array<string>>")[inside] if inside else F.from_json("body", "array<string>")
    kept = [c for c in payloads.columns if c not in ("_file", "body")]
    rows = payloads.select("_file", *kept, F.posexplode(parsed).alias("_at", "_item"))
    return rows.select("_file", *kept, "_at", F.from_json("_item", "map<string,string>").alias("_o")).filter("_o is not null")


def field(name: str, of: Column | None = None) -> Column:
    """A field's text, empty where it is missing, null or false."""
    value = F.try_element_at(F.col("_o") if of is None else of, F.lit(name))
    return F.when(value.isin("false", "0"), "").otherwise(F.coalesce(value, F.lit("")))


def inner(name: str) -> Column:
    """A field's object as a map; null where it is none."""
    return F.from_json(field(name), "map<string,string>")


def first(*values: Column) -> Column:
    """The first that is not empty, else empty."""
    return F.coalesce(*[F.nullif(v, F.lit("")) for v in values], F.lit(""))


def listed(name: str, by: str = ", ") -> Column:
    """A list field joined; a text stays as it is."""
    return F.coalesce(F.array_join(F.from_json(field(name), "array<string>"), by), field(name))


def stem(file: Column) -> Column:
    """A file's name without folder and extension."""
    return F.regexp_extract(file, r"([^/]+?)(?:\.[^./]*)?$", 1)
