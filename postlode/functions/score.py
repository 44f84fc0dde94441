"""The additive relevance score: eight components, their clamped sum, priority and explanation.

``with_facts`` searches title and text once for each term, into masks, and makes every test once;
components and explanation are sums and lists over the tests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions import pay
from postlode.functions.classify import company_fit, is_relevant
from postlode.functions.match import Index, has_substring, has_term, search
from postlode.operators.barrier import seal
from postlode.schema import SCORES, text_blob

EXPERIENCE = r"(?U)\b([5-9]|10)\+?\s*(years|jahre|лет)\b"
HELPERS = ("_blob", "_paid", "_fact", "_fit")


def priority(score: Column) -> Column:
    return F.when(score >= 80, "urgent").when(score >= 70, "high").when(score >= 60, "medium").otherwise("low")


def with_facts(df: DataFrame, profile: lx.TargetingProfile | None = None) -> DataFrame:
    """``df`` with ``_blob``, the structs ``_paid`` and ``_fact`` of all tests, and ``_fit``."""
    profile = profile or lx.TargetingProfile()
    padded = lambda c: F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    df = df.withColumn("_blob", text_blob())
    df = df.withColumns({"_text": padded("_blob"), "_title": padded("job_title")})
    index, titles = Index(), Index()
    text, title = index.on("_text_"), titles.on("_title_")
    aged = has_substring(text, ("years", "jahre", "лет"))
    tests = {
        "target": has_term(title, profile.target_titles),
        "role": has_term(title, lx.ROLE_TITLE_TERMS),
        "junior": has_term(text, lx.JUNIOR_TERMS),
        "away": has_term(text, ("remote", "hybrid", "homeoffice", "удал")),
        "automation": has_term(text, lx.AUTOMATION_TERMS),
        "ai": has_term(text, lx.AI_TERMS),
        "remote_europe": has_substring(text, ("remote europe",)),
        "startup": has_term(text, lx.STARTUP_TERMS),
        "senior": has_term(text, lx.SENIOR_TERMS),
        "senior_title": has_term(title, lx.SENIOR_TERMS),
        "experience": F.when(aged, F.col("_text")).otherwise("").rlike(EXPERIENCE),
        "qa": has_term(text, lx.QA_TERMS),
        "core_automation": has_term(text, lx.AUTOMATION_TERMS[:8]),
        "relevant_title": is_relevant(title),
        "off_target": has_term(title, profile.off_target_title_signals),
        "unrelated": has_term(title, lx.UNRELATED_TITLE_TERMS),
    }
    fit = company_fit(text)
    for words in pay.NEEDED.values():
        has_substring(text, words)  # gives them bits; the text holds the salary too
    df, masks = search(df, (index, "_text_", "_text"), (titles, "_title_", "_title"))
    df = seal(df, *masks).withColumn("_paid_text", F.concat(F.lower(F.coalesce("salary", F.lit(""))), "_text"))  # pay.searched of lower-cased parts
    df = pay.read(df, "_paid", "_paid_text", text)
    paid = {n: F.col("_paid")[n] for n in ("salary_target_met", "hours_target_met")}
    df = df.withColumn("_fact", F.struct(*[c.alias(n) for n, c in (tests | paid).items()]))
    return seal(df.withColumn("_fit", fit), "_fact").drop("_text", "_title", "_paid_text", *masks)


def _points(*cases: tuple[int, Column]) -> Column:
    return sum((F.when(test, value).otherwise(0) for value, test in cases), F.lit(0))


def components() -> dict[str, Column]:
    """Over a frame with facts."""
    fact = lambda n: F.col("_fact")[n]
    near = F.col("region").isin("dach", "europe", "worldwide")
    salary, week = fact("salary_target_met"), fact("hours_target_met")
    return {
        "title_fit_score": _points((25, fact("target")), (5, fact("role"))),
        "seniority_fit_score": _points((20, fact("junior"))),
        "remote_fit_score": _points((15, F.col("remote_type").isin("remote", "hybrid") | fact("away"))),
        "skill_fit_score": _points((15, fact("automation")), (15, fact("ai"))),
        "geography_fit_score": _points((10, near | fact("remote_europe")), (5, F.col("language").isin("de", "en", "ru"))),
        "compensation_fit_score": _points((8, salary == "yes"), (7, week == "yes")),
        "company_fit_score": _points((10, fact("startup") | F.col("is_startup_likely"))),
        "penalty_score": _points(
            (-15, salary == "no"),
            (-5, salary == "unknown"),
            (-15, week == "no"),
            (-5, week == "unknown"),
            (-30, fact("senior")),
            (-20, fact("senior_title")),
            (-20, fact("experience")),
            (-10, (F.col("remote_type") == "onsite") & ~F.col("region").isin("dach", "europe")),
            (-10, fact("qa") & ~(fact("ai") | fact("core_automation"))),
            (-45, ~(fact("target") | fact("relevant_title"))),
            (-20, ~fact("target") & fact("off_target")),
            (-25, ~fact("role")),
            (-100, fact("unrelated")),
        ),
    }


def explanation() -> Column:
    """Over a frame with facts."""
    fact = lambda n: F.col("_fact")[n]
    away = F.col("remote_type")
    salary, week = fact("salary_target_met"), fact("hours_target_met")
    reasons = F.array_compact(
        F.array(
            F.when(fact("target"), "title strongly matches an AI automation or applied AI target role"),
            F.when(fact("junior"), "junior or entry-level signals were found"),
            F.when(away.isin("remote", "hybrid"), F.concat(away, F.lit(" work is available"))),
            F.when(fact("automation"), "automation, no-code, or workflow keywords are present"),
            F.when(fact("ai"), "AI, LLM, or agent keywords are present"),
            F.when(F.col("region").isin("dach", "europe", "worldwide"), "region matches the target geography"),
            F.when(salary == "yes", "compensation target is met"),
            F.when(week == "yes", "weekly hours target is met"),
        )
    )
    cautions = F.array_compact(
        F.array(
            F.when(salary != "yes", F.concat(F.lit("compensation status is "), salary)),
            F.when(week != "yes", F.concat(F.lit("weekly hours status is "), week)),
            F.when(fact("senior"), "senior or lead signals reduce the score"),
            F.when(fact("experience"), "more than 5 years of experience are mentioned"),
        )
    )
    said = F.when(F.size(reasons) == 0, "only weak target-role signals were detected").otherwise(F.array_join(reasons, "; "))
    warned = F.when(F.size(cautions) > 0, F.concat(F.lit(". Caveats: "), F.array_join(cautions, "; "))).otherwise("")
    return F.concat(said, warned, F.lit("."))


def score(df: DataFrame, profile: lx.TargetingProfile | None = None, keep_pay: bool = False) -> DataFrame:
    """Postings with components, relevance, company fit, priority and reason filled in: one narrow projection.

    ``keep_pay``: the struct ``_paid`` of what was read of pay and hours stays, for ``reports.present``.
    """
    scored = with_facts(df, profile).withColumns(components())
    total = sum((F.col(c) for c in SCORES), F.lit(0))
    scored = seal(scored.withColumn("relevance_score", F.greatest(F.lit(0), F.least(F.lit(100), total))), "relevance_score")
    return scored.withColumns(
        {
            "company_fit": F.col("_fit"),
            "priority_level": priority(F.col("relevance_score")),
            "reason_for_score": explanation(),
        }
    ).drop(*[h for h in HELPERS if not (keep_pay and h == "_paid")])
