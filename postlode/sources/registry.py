"""Sources by name, read one after another into one table of postings."""

from __future__ import annotations

import logging
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.operators.order import numbered
from postlode.schema import POSTING_SCHEMA
from postlode.sources import boards, captures, feeds, literals, structured, threads

Source = Callable[[SparkSession, str], DataFrame]


def _nothing(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame([], POSTING_SCHEMA).withColumns({"_file": F.lit(""), "_at": F.lit(0)})


SOURCES: dict[str, Source] = {
    **{f.__name__: f for f in (boards.remoteok, boards.remotive, boards.arbeitnow, boards.workingnomads)},
    **{f.__name__: f for f in (boards.greenhouse, boards.lever, boards.ashby, boards.workable)},
    **{f.__name__: f for f in (feeds.weworkremotely, feeds.rss, feeds.manual)},
    **{f.__name__: f for f in (boards.ats, structured.join, threads.hackernews, literals.mock)},
    **{name: partial(captures.search_results, engine=name) for name in captures.ENGINES},
    **dict.fromkeys(("yc", "wellfound", "germantechjobs", "berlinstartupjobs"), _nothing),
}


def register_source(name: str, source: Source) -> None:
    SOURCES[name] = source


def parse_bool(value: str | bool) -> bool:
    """A switch as people write it: 1, true, yes, y and on are true."""
    return value if isinstance(value, bool) else value.strip().lower() in ("1", "true", "yes", "y", "on")


def read_sources(spark: SparkSession, paths: dict[str, str], limit: int | None = 50) -> DataFrame:
    """Postings of the named sources with ``_seq``: sources in the given order, files by name, places within.

    ``limit`` rows a source are kept (None: all). Unknown names are skipped with a warning. No source gives an empty table.
    """
    parts = []
    for ordinal, (name, path) in enumerate(paths.items()):
        if name not in SOURCES:
            logging.getLogger(__name__).warning("unknown source %s", name)
            continue
        parts.append(SOURCES[name](spark, path).withColumn("_at", F.col("_at").cast("long")).withColumn("_source", F.lit(ordinal)))
    if not parts:
        return _nothing(spark, "").withColumn("_seq", F.lit(0).cast("long")).drop("_file", "_at")
    rows = reduce(DataFrame.unionByName, parts)
    if limit is not None:
        turn = F.row_number().over(Window.partitionBy("_source").orderBy("_file", "_at"))
        rows = rows.withColumn("_turn", turn).filter(F.col("_turn") <= limit).drop("_turn")
    return numbered(rows, ["_source", "_file", "_at"], "_seq").drop("_source", "_file", "_at")
