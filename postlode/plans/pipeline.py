"""The ranking run: sources to ranked, unseen, exportable postings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.classify import exceeds_employees, low_cost_reason
from postlode.functions.score import score
from postlode.operators.barrier import seal
from postlode.operators.dedup import collapse_similar, drop_repeats, prepare
from postlode.operators.enrich import enrich
from postlode.operators.joins import unseen
from postlode.schema import text_blob
from postlode.state import pinned


@dataclass(frozen=True)
class RunConfig:
    """Parameters of a run."""

    min_score: int = 60
    new_only: bool = False
    fuzzy: bool = True
    most_employees: int = lx.MOST_EMPLOYEES
    profile: lx.TargetingProfile = field(default_factory=lx.TargetingProfile)


@dataclass(frozen=True)
class RunResult:
    """Frames of a run, each with ``_seq``; counters come from ``counters``."""

    raw: DataFrame
    unique: DataFrame
    scored: DataFrame
    ranked: DataFrame
    new: DataFrame
    exportable: DataFrame
    seen: DataFrame | None
    config: RunConfig

    def counters(self) -> DataFrame:
        """One row: raw, duplicates, too large, low cost, scored, new and exported postings.

        The scored rows are computed once, for all counts, and kept without their texts.
        """
        scored = pinned(self.scored.select("deduplication_key", "relevance_score", "_large", "_low_cost"))
        _, new, exportable = _chosen(scored, self.seen, self.config)
        flags = scored.agg(
            F.count("*").alias("u"),
            F.count_if("_large").alias("large"),
            F.count_if(~F.col("_large") & (F.col("_low_cost") != "")).alias("low"),
            F.count_if(~F.col("_large") & (F.col("_low_cost") == "")).alias("kept"),
        )
        one = lambda df, name: df.agg(F.count("*").alias(name))
        joined = one(self.raw, "raw").crossJoin(flags).crossJoin(one(new, "new")).crossJoin(one(exportable, "exported"))
        return joined.select(
            "raw",
            (F.col("raw") - F.col("u")).alias("duplicates_removed"),
            F.col("large").alias("large_removed"),
            F.col("low").alias("low_cost_removed"),
            F.col("kept").alias("scored"),
            "new",
            "exported",
        )


def score_and_flag(unique: DataFrame, config: RunConfig | None = None) -> DataFrame:
    """Prepared anew and scored, with ``_large`` and ``_low_cost`` (the reason, or '')."""
    config = config or RunConfig()
    scored = score(prepare(unique).drop("_signature"), config.profile)
    flagged = scored.withColumns(
        {
            "_large": exceeds_employees(F.col("company_size"), config.most_employees),
            "_low_cost": low_cost_reason(F.col("salary"), F.col("location"), text_blob()),
        }
    )
    return seal(flagged, "_large", "_low_cost")


def _chosen(scored: DataFrame, seen: DataFrame | None, config: RunConfig) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of flagged rows those that are ranked, those not seen before and those to export."""
    ranked = scored.filter(~F.col("_large") & (F.col("_low_cost") == "")).drop("_large", "_low_cost")
    new = unseen(ranked, seen) if seen is not None else ranked
    return ranked, new, (new if config.new_only else ranked).filter(F.col("relevance_score") >= config.min_score)


def run(raw: DataFrame, seen: DataFrame | None = None, config: RunConfig | None = None, sizes=None) -> RunResult:
    """``raw``: posting rows of all sources with ``_seq``; ``seen``: keys stored before this run."""
    config = config or RunConfig()
    unique = drop_repeats(prepare(enrich(raw, sizes)))
    if config.fuzzy:
        unique = collapse_similar(unique)
    unique = unique.drop("_signature")
    scored = score_and_flag(unique, config)
    ranked, new, chosen = _chosen(scored, seen, config)
    return RunResult(raw, unique, scored, ranked, new, chosen, seen, config)


def in_rank_order(df: DataFrame) -> DataFrame:
    return df.orderBy(F.desc("relevance_score"), F.asc("_seq"))
