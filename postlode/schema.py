"""The posting row: columns, types, defaults and the text that classifiers read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Column, type, default ("" where None is not given). Fixed names and defaults of the row.
FIELDS: tuple[tuple[str, str, object], ...] = (
    ("id", "bigint", None),
    *((c, "string", "") for c in ("job_title", "company_name", "location", "city", "country", "region")),
    *((c, "string", "unknown") for c in ("remote_type", "seniority", "language")),
    ("source_platform", "string", ""),
    ("source_type", "string", "scraper"),
    *((c, "string", "") for c in ("job_url", "date_found", "date_posted", "job_description", "required_skills")),
    *((c, "string", "") for c in ("preferred_skills", "salary", "company_stage")),
    ("company_size", "string", "unknown"),
    ("company_size_source", "string", ""),
    ("is_startup_likely", "boolean", False),
    ("relevance_score", "int", 0),
    *((c, "int", 0) for c in ("title_fit_score", "seniority_fit_score", "remote_fit_score", "skill_fit_score")),
    *((c, "int", 0) for c in ("geography_fit_score", "compensation_fit_score", "company_fit_score", "penalty_score")),
    ("priority_level", "string", "low"),
    ("reason_for_score", "string", ""),
    ("application_status", "string", "new"),
    ("company_fit", "string", "unknown"),
    *((c, "string", "") for c in ("review_notes", "next_step", "normalized_title", "normalized_company")),
    *((c, "string", "") for c in ("deduplication_key", "created_at", "updated_at")),
)
COLUMNS = tuple(f[0] for f in FIELDS)
SCORES = (
    "title_fit_score", "seniority_fit_score", "remote_fit_score", "skill_fit_score",
    "geography_fit_score", "compensation_fit_score", "company_fit_score", "penalty_score",
)
#: Columns that the stored table lacks; they come back as defaults.
NOT_STORED = (*SCORES, "company_fit", "review_notes", "next_step")
STORED = tuple(c for c in COLUMNS if c not in NOT_STORED)
BLOB = (
    "job_title", "company_name", "location", "city", "country", "region", "job_description",
    "required_skills", "preferred_skills", "salary", "company_size",
)
_TYPES = {"bigint": T.LongType(), "string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType()}
POSTING_SCHEMA = T.StructType([T.StructField(n, _TYPES[t]) for n, t, _ in FIELDS])


def conform(df: DataFrame, *extra: str, now: str | None = None) -> DataFrame:
    """``df`` with all columns of the row, missing or null ones at their defaults; ``extra`` columns follow.

    ``now``: an ISO time in UTC for the stamps; the current time if not given.
    """
    stamp = F.lit(now) if now else F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    out = []
    for name, kind, default in FIELDS:
        if name in ("created_at", "updated_at"):
            fallback = stamp
        elif name == "date_found":
            fallback = F.substring(stamp, 1, 10)
        else:
            fallback = F.lit(default)
        value = F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind)
        out.append((value if default is None else F.coalesce(value, fallback.cast(kind))).alias(name))
    return df.select(*out, *extra)


def text_blob() -> Column:
    """The searched columns joined by single spaces, empty ones included."""
    return F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in BLOB])
