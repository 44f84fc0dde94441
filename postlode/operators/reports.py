"""Presenter rows, summaries, comparisons, usage counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode import lexicon as lx
from postlode.functions import pay
from postlode.functions.classify import any_filter
from postlode.functions.match import has_substring
from postlode.functions.text import free_place, known_place, more_specific, shorten
from postlode.operators.barrier import seal
from postlode.schema import SCORES, text_blob

#: Columns of the delimited export, in order.
CSV_COLUMNS = (
    "relevance_score", *SCORES, "priority_level", "job_title", "company_name", "company_fit", "company_size",
    "company_size_source", "location", "city", "country", "region", "remote_type", "seniority", "language",
    "source_platform", "job_url", "reason_for_score", "date_found", "date_posted", "salary", "application_status",
)


def present(df: DataFrame, run_at: str, *extra: str) -> DataFrame:
    """One row a posting as reports show it: 41 columns with display defaults.

    Pay and hours are read from the text, unless the score has left them (``_paid``).
    """
    if "_paid" not in df.columns:
        df = pay.read(df.withColumn("_searched", pay.searched(F.col("salary"), text_blob())), "_paid", "_searched")
    paid = {n: F.col("_paid")[n] for n in df.schema["_paid"].dataType.names}
    df = df.withColumns({"_free": free_place(F.col("location")), "_known": known_place(F.col("city"), F.col("country"))})
    df = seal(df, "_free", "_known")
    shown = lambda c, default: F.when(F.coalesce(F.col(c), F.lit("")) == "", default).otherwise(F.col(c))
    return df.select(
        F.lit(run_at).alias("search_run_at"),
        F.col("relevance_score").alias("score"),
        *SCORES,
        F.col("priority_level").alias("priority"),
        F.col("job_title").alias("title"),
        shown("company_name", "Unknown").alias("company"),
        shown("company_fit", "unknown").alias("company_fit"),
        shown("company_size", "unknown").alias("company_size"),
        "company_size_source",
        more_specific(F.col("_free"), F.col("_known")).alias("location"),
        *[shown(c, "Unknown").alias(c) for c in ("city", "country", "region")],
        "remote_type",
        "seniority",
        shown("salary", "Not listed").alias("salary"),
        *[c.alias(n) for n, c in paid.items()],
        shown("required_skills", "Not extracted").alias("skills"),
        shorten(F.col("job_description"), 1200).alias("description"),
        F.col("source_platform").alias("source"),
        F.col("job_url").alias("url"),
        F.col("reason_for_score").alias("reason"),
        "date_found",
        "date_posted",
        F.col("application_status").alias("status"),
        F.lit("").alias("interesting"),
        F.lit("no").alias("applied"),
        "next_step",
        "review_notes",
        F.lit("no").alias("dismissed"),
        *extra,
    )


def summary(records: DataFrame) -> DataFrame:
    """One row over presenter rows: count, mean score to one place, counts by priority and target."""
    mean = F.bround(F.avg("score"), 1)
    return records.agg(
        F.count("*").alias("exported"),
        F.coalesce(mean, F.lit(0.0)).alias("average_score"),
        F.count_if(F.col("priority") == "urgent").alias("urgent"),
        F.count_if(F.col("priority") == "high").alias("high"),
        F.count_if(F.col("salary_target_met") == "yes").alias("salary_target"),
        F.count_if(F.col("hours_target_met") == "yes").alias("hours_target"),
    )


def run_metrics(kept: DataFrame, side: str = "side") -> DataFrame:
    """Counts of each side's kept postings, as run comparisons list them."""
    good = F.col("relevance_score") >= 50
    where = F.lower(F.concat_ws(" ", F.concat_ws(" ", "job_title", "location"), "country"))
    named = ~F.col("company_name").isin("", "Unknown")
    return kept.groupBy(side).agg(
        F.count("*").alias("kept"),
        F.count_if(good).alias("ge50"),
        F.count_if(F.col("relevance_score") >= 60).alias("ge60"),
        F.count_if(F.col("relevance_score") >= 80).alias("ge80"),
        F.count_if(good & has_substring(F.lower("job_title"), lx.TARGET_HINTS)).alias("target_hits"),
        F.count_if(good & has_substring(where, lx.DACH_HINTS)).alias("dach_hits"),
        F.count_distinct(F.when(good & named, F.col("company_name"))).alias("companies"),
        F.count_if(good & ~named).alias("unknown_company"),
    )


def company_overlap(left: DataFrame, right: DataFrame) -> DataFrame:
    """``company_name, side``: companies of both frames, of the left only, of the right only."""
    names = lambda df: df.filter(~F.col("company_name").isin("", "Unknown")).select("company_name").distinct()
    a, b = names(left), names(right)
    marked = a.withColumn("l", F.lit(1)).join(b.withColumn("r", F.lit(1)), "company_name", "full_outer")
    side = F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), "both").when(F.col("l").isNotNull(), "left").otherwise("right")
    return marked.select("company_name", side.alias("side"))


def dashboard(df: DataFrame, least: int = 0, **choices: list[str]) -> DataFrame:
    """Rows of at least this score whose columns are among the choices, best and latest first."""
    return df.filter((F.col("relevance_score") >= least) & any_filter(choices)).orderBy(F.desc("relevance_score"), F.desc("date_found"))


#: Columns that a dashboard offers choices of.
PICKED = ("region", "country", "remote_type", "seniority", "language", "source_platform", "priority_level")


def pickers(df: DataFrame) -> DataFrame:
    """``picker, value``: the different values of each column of ``PICKED``, nulls left out."""
    pairs = F.array(*[F.struct(F.lit(c).alias("picker"), F.col(c).alias("value")) for c in PICKED])
    return df.select(F.explode(pairs).alias("p")).select("p.picker", "p.value").filter("value is not null").distinct()


def dashboard_metrics(shown: DataFrame) -> DataFrame:
    """``jobs, urgent, average_score`` of the rows shown; the average is 0 where there are none."""
    average = F.coalesce(F.bround(F.avg("relevance_score"), 1), F.lit(0.0))
    return shown.agg(F.count("*").alias("jobs"), F.count_if(F.col("priority_level") == "urgent").alias("urgent"), average.alias("average_score"))


def reviewed(records: DataFrame, include_dismissed: bool = False, limit: int = lx.MOST_EMPLOYEES) -> DataFrame:
    """Reviewed rows that were not dismissed, of companies that are not too large."""
    from postlode.functions.classify import exceeds_employees

    gone = (F.lower(F.trim("dismissed")) == "yes") | (F.lower(F.trim("status")) == "dismissed")
    return records.filter((F.lit(include_dismissed) | ~gone) & ~exceeds_employees(F.col("company_size"), limit))


def monthly_usage(calls: DataFrame, limits: DataFrame, block_ratio: float = 0.95) -> DataFrame:
    """``month, provider, used, limit, remaining, percent, blocked, status`` of calls (``provider, ts``).

    ``limits``: provider and monthly limit; a provider without one is never blocked.
    """
    used = calls.groupBy(F.date_format("ts", "yyyy-MM").alias("month"), "provider").agg(F.count("*").alias("used"))
    limit = F.col("limit")
    joined = used.join(limits, "provider", "left")
    percent = F.when(limit > 0, F.bround(100.0 * F.col("used") / limit, 1))
    blocked = F.coalesce(F.col("used") + 1 > F.floor(limit * block_ratio), F.lit(False))
    return joined.select(
        "month",
        "provider",
        "used",
        limit,
        F.greatest(F.lit(0), limit - F.col("used")).alias("remaining"),
        percent.alias("percent"),
        blocked.alias("blocked"),
        F.when(limit.isNull(), "free").when(blocked, "blocked").when(percent >= 80, "near limit").otherwise("ok").alias("status"),
    )


def allowed_calls(calls: DataFrame, limits: DataFrame, block_ratio: float = 0.95) -> DataFrame:
    """Calls (``provider, ts, event_id``) that the monthly guard lets through, in order of time."""
    month = F.date_format("ts", "yyyy-MM")
    w = Window.partitionBy("provider", month).orderBy("ts", "event_id")
    counted = calls.withColumn("_n", F.row_number().over(w)).join(limits, "provider", "left")
    return counted.filter(F.col("limit").isNull() | (F.col("_n") <= F.floor(F.col("limit") * block_ratio))).drop("_n", "limit")
