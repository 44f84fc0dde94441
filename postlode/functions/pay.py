"""Pay and weekly hours read from text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.match import Marked, has_substring
from postlode.operators.barrier import seal

#: Fixed patterns: amount a year, amount a month, amount in thousands after the currency, hours a week, hours.
YEARLY = r"(\d{2,3})(?:[.,](\d{3}))?\s?k?\s?(?:eur|euro|brutto)?\s?(year|jahr|jaehrlich|p\.a\.|per year|annum)"
MONTHLY = r"(\d{1,2})(?:[.,](\d{3}))?\s?k?\s?(?:eur|euro|brutto)?\s?(month|monat|monatlich|monthly)"
THOUSANDS = r"(?:eur|euro)\s?(\d{2,3})(?:[.,](\d{3}))?\s?k"
WEEKLY_HOURS = r"(\d{2})\s?(?:h|std\.?|stunden)\s?(?:/|pro|per)?\s?(?:woche|week|weekly)"
HOURS = r"(\d{2})\s?(?:stunden|hours)"
#: What every match of a pattern holds: a text without it is not searched.
NEEDED = {
    YEARLY: ("year", "jahr", "jaehrlich", "p.a.", "annum"),
    MONTHLY: ("month", "monat"),
    THOUSANDS: ("eur",),
    WEEKLY_HOURS: ("woche", "week"),
    HOURS: ("stunden", "hours"),
}


def searched(salary: Column, blob: Column) -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce(salary, F.lit("")), blob))


def _matches(text: Column, pattern: str, marks: Marked | None) -> Column:
    """All matches of a pattern, from one pass over the text."""
    some = F.when(has_substring(marks or text, NEEDED[pattern]), text).otherwise("")
    return F.regexp_extract_all(some, F.lit("(?U)" + pattern), F.lit(0))


def amounts(matches: Column, pattern: str) -> Column:
    """Values of a pattern's matches: both digit groups together, or the one times 1000."""
    group = lambda m, i: F.regexp_extract(m, "(?U)" + pattern, i)
    value = lambda a, b: F.when(b != "", F.concat(a, b).try_cast("int")).otherwise(a.try_cast("int") * 1000)
    return F.transform(matches, lambda m: value(group(m, 1), group(m, 2)))


def hours(matches: dict[str, Column]) -> Column:
    """Values of the matches of both patterns of hours."""
    first = lambda p: F.transform(matches[p], lambda m: F.regexp_extract(m, "(?U)" + p, 1))
    every = [first(p) for p in (WEEKLY_HOURS, HOURS)]
    return F.transform(F.concat(*every), lambda x: x.try_cast("int"))


def _answer(found: Column, met: Column) -> Column:
    return F.when(met, "yes").when(found, "no").otherwise("unknown")


def _analysis(matches: dict[str, Column]) -> dict[str, Column]:
    year, month, short = (amounts(matches[p], p) for p in (YEARLY, MONTHLY, THOUSANDS))
    yearly = F.concat(year, short)
    paid = (F.size(yearly) > 0) | (F.size(month) > 0)
    enough = F.exists(yearly, lambda v: v >= lx.YEARLY_LEAST) | F.exists(month, lambda v: v >= lx.MONTHLY_LEAST)
    weekly = hours(matches)
    timed, short_week = F.size(weekly) > 0, F.exists(weekly, lambda v: v <= lx.HOURS_MOST)
    note = lambda what, found, met: (
        F.when(met, f"{what} target met").when(~found, f"{what} not found").otherwise(f"{what} target not met")
    )
    return {
        "salary_found": F.when(paid, "yes").otherwise("unknown"),
        "salary_target_met": _answer(paid, enough),
        "hours_found": F.when(timed, "yes").otherwise("unknown"),
        "hours_target_met": _answer(timed, short_week),
        "salary_hour_notes": F.concat_ws("; ", note("salary", paid, enough), note("weekly hours", timed, short_week)),
    }


def read(df: DataFrame, name: str, text: str, marks: Marked | None = None) -> DataFrame:
    """``df`` with a struct of salary_found, salary_target_met, hours_found, hours_target_met and salary_hour_notes of a ``searched`` text.

    Every answer asks for the matches, and the functions over arrays would find them anew each time; so they are found
    first, one pass for each pattern, and sealed. ``marks``: the bits of the text, where they are known.
    """
    found = {p: f"{name}_matches_{i}" for i, p in enumerate(NEEDED)}
    df = seal(df.withColumns({c: _matches(F.col(text), p, marks) for p, c in found.items()}), *found.values())
    answers = _analysis({p: F.col(c) for p, c in found.items()})
    return seal(df.withColumn(name, F.struct(*[c.alias(n) for n, c in answers.items()])), name).drop(*found.values())
