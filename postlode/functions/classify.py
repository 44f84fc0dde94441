"""Classifiers of posting text; each takes the text (or its lower-cased form) and gives a column.

Only relevance and skills treat short terms as words of their own; the other classifiers look
for plain substrings, as their results are defined.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.match import Marked, alone, first_of, has_substring, has_term, stands_alone, term_keys
from postlode.functions.text import company_key, strip

JAVA_UNICODE = "(?U)"


def is_relevant(lowered: Column | Marked) -> Column:
    """An AI term or the name of a workflow tool occurs."""
    return has_term(lowered, (*lx.AI_TERMS, *lx.EXTRA_AI_TERMS, *lx.AUTOMATION_TOOL_TERMS))


def is_board_title(lowered: Column) -> Column:
    return has_term(lowered, lx.BOARD_TITLE_TERMS)


def language(text: Column, padded: Marked | None = None) -> Column:
    """``padded``: the bits of the text in lower case with a space at either end, where they are known."""
    padded = padded or F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return first_of(
        [
            (text.rlike(r"[Ѐ-ӿ]"), "ru"),
            (has_substring(padded, (*lx.GERMAN_HINTS, "ä", "ö", "ü", "ß")), "de"),
            (text.rlike(r"(?U)[^\s\x1C-\x1F]"), "en"),
            (F.lit(True), "unknown"),
        ]
    )


def remote_type(lowered: Column | Marked) -> Column:
    return first_of(
        [
            (has_substring(lowered, lx.REMOTE_TERMS), "remote"),
            (has_substring(lowered, lx.HYBRID_TERMS), "hybrid"),
            (has_substring(lowered, lx.ONSITE_TERMS), "onsite"),
            (F.lit(True), "unknown"),
        ]
    )


def seniority(lowered: Column | Marked) -> Column:
    junior = has_substring(lowered, lx.JUNIOR_TERMS)
    senior = has_substring(lowered, lx.SENIOR_TERMS)
    return first_of(
        [
            (senior & junior, "junior"),
            (senior, "senior"),
            *[(has_substring(lowered, terms), level) for level, terms in lx.ENTRY_LEVELS.items()],
            (junior, "junior"),
            (F.lit(True), "unknown"),
        ]
    )


def location_city(lowered: Column | Marked) -> Column:
    return F.coalesce(first_of([(has_substring(lowered, (c.lower(),)), c) for c in lx.CITY_HINTS]), F.lit(""))


def _of_city(city: Column, field: int) -> Column:
    values: dict[str, list[str]] = {}
    for c, facts in lx.CITY_HINTS.items():
        values.setdefault(facts[field], []).append(c)
    return first_of([(city.isin(*cities), v) for v, cities in values.items()])


def location_country(lowered: Column | Marked, city: Column) -> Column:
    named = first_of([(has_substring(lowered, hints), c) for c, hints in lx.COUNTRY_HINTS.items()])
    return F.coalesce(named, _of_city(city, 0), F.lit(""))


def location_region(lowered: Column | Marked, city: Column) -> Column:
    named = first_of([(has_substring(lowered, hints), r) for r, hints in lx.REGION_HINTS.items()])
    return F.coalesce(named, _of_city(city, 1), F.when(has_substring(lowered, ("remote",)), "worldwide"), F.lit("unknown"))


def skills(lowered: Column | Marked, most: int = 18) -> Column:
    """The first skills of the vocabulary that occur, in its order."""
    found = []
    if isinstance(lowered, Marked):
        terms = dict.fromkeys((*lx.AI_TERMS, *lx.AUTOMATION_TERMS, *lx.ENGINEERING_TERMS))
        each = ", ".join(f"if({lowered.sql(term_keys([t]))}, '{t}', null)" for t in terms)
        return F.expr(f"array_join(slice(array_compact(array({each})), 1, {most}), ', ')")
    for term in dict.fromkeys((*lx.AI_TERMS, *lx.AUTOMATION_TERMS, *lx.ENGINEERING_TERMS)):
        test = lowered.rlike(alone([term])) if stands_alone(term) else lowered.contains(term)
        found.append(F.when(test, term))
    return F.array_join(F.slice(F.array_compact(F.array(*found)), 1, most), ", ")


def startup_likely(lowered: Column | Marked) -> Column:
    return has_substring(lowered, lx.STARTUP_SIGNS)


def company_fit(lowered: Column | Marked) -> Column:
    fits = [(has_substring(lowered, terms), fit) for fit, terms in lx.COMPANY_FITS.items()]
    return first_of([*fits, (F.lit(True), "unknown")])


def bucket(value: Column) -> Column:
    """The label of an employee count; a count of no bucket is in the open one."""
    return F.coalesce(first_of([(value.between(a, b), label) for a, b, label in lx.EMPLOYEE_BUCKETS]), F.lit(lx.OPEN_BUCKET))


def _number(x: Column) -> Column:
    return F.replace(x, F.lit(","), F.lit("")).try_cast("int")


def size_matches(low: Column, marks: Marked) -> list[Column]:
    """The first match of each size pattern in a lower-cased text, '' if there is none; tried only where the bits say that its words occur."""
    where = lambda p: F.when(has_substring(marks, lx.SIZE_PATTERNS[p]), low).otherwise("")
    return [F.regexp_extract(where(p), JAVA_UNICODE + p, 0) for p in lx.SIZE_PATTERNS]


def company_size(text: Column, marks: Marked | None = None, matches: list[Column] | None = None) -> Column:
    """struct(size, source) of the first rule that applies to the text.

    ``marks`` and ``matches``: the bits of the lower-cased text and its ``size_matches``, where they are known; each is mentioned often.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    span, number, named = lx.SIZE_PATTERNS
    found = dict(zip(lx.SIZE_PATTERNS, matches or [low] * 3))
    part = lambda p, i: F.regexp_extract(found[p], JAVA_UNICODE + p, i)
    grouped = lambda x: F.format_number(_number(x), 0)
    start, count, team = part(span, 1), part(number, 1), part(named, 2)
    said, size = F.lit("posting text"), lambda label, source: F.struct(label.alias("size"), source.alias("source"))
    return first_of(
        [
            (start != "", size(F.concat(grouped(start), F.lit("-"), grouped(part(span, 2))), said)),
            ((count != "") & (part(number, 2) == "+"), size(F.concat(grouped(count), F.lit("+")), said)),
            (count != "", size(bucket(_number(count)), said)),
            (team != "", size(bucket(_number(team)), said)),
            *[(has_substring(marks or low, terms), size(F.lit(label), F.lit(source))) for terms, label, source in lx.SIZE_WORDING],
            (F.lit(True), size(F.lit("unknown"), F.lit(""))),
        ]
    )


def headcount(text: Column) -> Column:
    """``a-b`` or ``n+`` from a page that names employees."""
    low = F.lower(F.coalesce(text, F.lit("")))
    whole = lambda x: F.regexp_replace(x, ",", "")
    pair = r"(?U)(\d[\d.,]*)\s*[-–]\s*(\d[\d.,]*)\s*(?:employees|mitarbeiter)"
    more = r"(?U)(\d[\d.,]*)\+\s*(?:employees|mitarbeiter)"
    a, b, n = F.regexp_extract(low, pair, 1), F.regexp_extract(low, pair, 2), F.regexp_extract(low, more, 1)
    return (
        F.when(a != "", F.concat(whole(a), F.lit("-"), whole(b))).when(n != "", F.concat(whole(n), F.lit("+"))).otherwise("")
    )


def employee_floor(label: Column) -> Column:
    """The least count that a size label allows; null if it names none."""
    text = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    digits = F.replace(F.regexp_extract(text, r"\d[\d,]*", 0), F.lit(","), F.lit(""))
    return F.when((text != "unknown") & (digits != ""), digits.try_cast("bigint"))


def exceeds_employees(label: Column, limit: int = lx.MOST_EMPLOYEES) -> Column:
    """Whether even the least count is above the limit (an open label: at it); unknown sizes do not exceed."""
    floor = employee_floor(label)
    return F.coalesce(F.when(label.contains("+"), floor >= limit).otherwise(floor > limit), F.lit(False))


def size_key(name: Column) -> Column:
    return company_key(F.coalesce(name, F.lit("")))


def place_names() -> list[str]:
    """Words that are places, so never companies."""
    hints = [h for hs in lx.COUNTRY_HINTS.values() for h in hs]
    return list(dict.fromkeys([*lx.COUNTRY_HINTS, *hints, *(c.lower() for c in lx.CITY_HINTS), *lx.PLACE_WORDS]))


def is_place(value: Column) -> Column:
    """Whether the value, or each of its several comma- or slash-separated parts, is a place."""
    clean = F.lower(strip(F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"(?U)\s+", " ")), " ,-–—|"))
    names = place_names()
    parts = F.filter(F.transform(F.split(clean, "[,/]"), lambda p: F.trim(p)), lambda p: p != "")
    return clean.isin(*names) | ((F.size(parts) > 1) & F.forall(parts, lambda p: p.isin(*names)))


def _stem(pattern: str) -> str:
    """What any match of a currency's pattern holds."""
    return re.match(r"[^?\\]*", pattern.removeprefix(r"\b").replace("s?", ""))[0]


def low_cost_reason(salary: Column, location: Column, blob: Column) -> Column:
    """Why a posting counts as one of a low-wage region: pay in such a currency, else such a place; '' if neither.

    The patterns are tried only where a byte search finds what they are about.
    """
    none = F.lit("")
    text = F.lower(F.concat_ws("\n", F.coalesce(salary, none), F.coalesce(location, none), blob))
    search = lambda words, p: F.trim(F.regexp_extract(F.when(has_substring(text, words), text).otherwise(""), JAVA_UNICODE + p, 0))
    pay = search([_stem(p) for p in lx.LOW_COST_PAY], "(?:" + "|".join(lx.LOW_COST_PAY) + ")")
    place = search(lx.LOW_COST_PLACES, r"\b(?:" + "|".join(lx.LOW_COST_PLACES) + r")\b")
    return (
        F.when(pay != "", F.concat(F.lit("low-wage-region pay ("), pay, F.lit(")")))
        .when(place != "", F.concat(F.lit("low-wage region ("), place, F.lit(")")))
        .otherwise("")
    )


def any_filter(columns: dict[str, list[str]]) -> Column:
    """Conjunction of membership tests; an empty list leaves its column free."""
    tests = [F.col(c).isin(*values) for c, values in columns.items() if values]
    out = F.lit(True)
    for t in tests:
        out = out & t
    return out

