"""Scalar text functions, Column to Column.

Python-flavoured classes are written as Java regular expressions with ``(?U)``, so that
white space, digits and letters are Unicode's.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlode import lexicon as lx
from postlode.functions.match import any_of, java_literal

WHITE = r"(?U)[\s\x1C-\x1F]+"


def collapse(x: Column) -> Column:
    """White-space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(x, WHITE, " "))


def strip(x: Column, chars: str) -> Column:
    """Any of ``chars`` removed from both ends."""
    c = "[" + java_literal(chars) + "]+"
    return F.regexp_replace(x, f"^{c}|{c}$", "")


def strip_white(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^[\s\x1C-\x1F]+|[\s\x1C-\x1F]+$", "")


def title_case(x: Column) -> Column:
    """Every run of letters capitalised (``initcap`` would know only runs between spaces)."""
    runs = F.regexp_extract_all(x, F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


#: Ranges above ASCII that hold all its white space, and some more.
_WIDE_WHITE = (r"[\x80-\xA0]", r"[\u1680-\u200A]", r"[\u2028-\u202F]", r"[\u205F-\u3000]")


def clean_field(x: Column) -> Column:
    """Without replacement and control characters; tab and newline count as white space, a carriage return goes.

    A search for one range takes a fraction of that for several, so most texts, whose only white space is space, tab
    and newline, are told by such searches and cleaned by plain replacements.
    """
    plain = F.replace(F.replace(x, F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" "))
    wide = any_of([*[plain.rlike(r) for r in _WIDE_WHITE], plain.contains("\uFFFD")])
    odd = plain.rlike(r"[\x00-\x1F]") | ((F.octet_length(plain) != F.length(plain)) & wide)
    single = F.when(plain.contains("  "), F.regexp_replace(plain, " {2,}", " ")).otherwise(plain)
    return F.when(odd, collapse(F.regexp_replace(x, "[\\x00-\\x08\\x0B-\\x1F�]", ""))).otherwise(F.trim(single))


@lru_cache(maxsize=1)
def _ascii_images() -> tuple[str, str, dict[str, str]]:
    """Characters whose compatibility decomposition has ASCII in it: those with one ASCII character
    (as two parallel strings) and those with several."""
    one_from, one_to, many = [], [], {}
    for code in range(0x80, min(sys.maxunicode, 0x1FFFF) + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        image = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if c < "\x80")
        if len(image) == 1:
            one_from.append(chr(code))
            one_to.append(image)
        elif image:
            many[chr(code)] = image
    return "".join(one_from), "".join(one_to), many


def to_ascii(x: Column) -> Column:
    """Compatibility decomposition, then only ASCII; characters without an ASCII image vanish."""
    source, target, many = _ascii_images()
    plain = F.translate(x, source, target)
    held = "".join(many)
    pairs = F.from_json(F.lit(json.dumps(many)), "map<string,string>")
    spelled = F.array_join(F.transform(F.split(plain, ""), lambda c: F.coalesce(pairs[c], c)), "")
    wide = F.when(x.rlike("[" + held + "]"), spelled).otherwise(plain)
    return F.when(x.rlike(r"[^\x00-\x7F]"), F.regexp_replace(wide, r"[^\x00-\x7F]", "")).otherwise(x)


def _plain_words(x: Column, suffixes: tuple[str, ...]) -> Column:
    words = F.trim(F.regexp_replace(F.regexp_replace(to_ascii(F.lower(x)), r"[^\w\s]", " "), r"\s+", " "))
    for s in suffixes:  # once each, in this order
        words = F.trim(F.regexp_replace(words, f" {s}$", ""))
    return words


def normalize_text(x: Column) -> Column:
    return _plain_words(x, lx.TITLE_SUFFIXES)


def company_key(x: Column) -> Column:
    return _plain_words(x, lx.COMPANY_SUFFIXES)


def title_core(x: Column) -> Column:
    """A normalised title without words of level, gender or place of work."""
    return collapse(F.regexp_replace(x, r"\b(" + "|".join(lx.TITLE_NOISE) + r")\b", " "))


def signature(title: Column, company: Column, location: Column) -> Column:
    place = F.when(location.contains("remote"), "remote").otherwise(F.substring(location, 1, 30))
    parts = [F.when(p != "", p) for p in (title_core(title), company, place)]
    return F.concat_ws("|", *parts)


_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#[\s\S]*)?$"


def _encode(x: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(x), x)
    return F.replace(F.replace(F.url_encode(decoded), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def normalize_url(x: Column) -> Column:
    """Scheme and host in lower case, no fragment, no trailing slash, no tracking or blank parameters, parameters encoded anew."""
    part = lambda i: F.regexp_extract(x, _URL, i)
    pairs = F.filter(F.split(part(4), "&"), lambda p: p.rlike(r"^[\s\S]*?=[\s\S]+$"))
    name = lambda p: F.substring_index(p, "=", 1)
    value = lambda p: F.substr(p, F.length(name(p)) + 2)
    kept = F.filter(pairs, lambda p: ~F.lower(F.coalesce(F.try_url_decode(name(p)), name(p))).isin(*lx.TRACKING_PARAMETERS))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encode(name(p)), F.lit("="), _encode(value(p)))), "&")
    scheme = F.when(part(1) != "", F.concat(F.lower(part(1)), F.lit(":"))).otherwise("")
    host = F.when(part(2) != "", F.concat(F.lit("//"), F.lower(part(2)))).otherwise("")
    path = F.regexp_replace(part(3), "/+$", "")
    return F.when(x == "", "").otherwise(F.concat(scheme, host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise("")))


def clean_url(x: Column) -> Column:
    """Without brackets, quotes and trailing punctuation around it."""
    inner = strip_white(strip(strip_white(x), "<>\"'"))
    return F.regexp_replace(inner, r"[.,;)\]}>\"' ]+$", "")


def domain(x: Column) -> Column:
    """Host with port, lower-cased, without leading www."""
    return F.regexp_replace(F.lower(F.regexp_extract(x, _URL, 2)), r"^www\.", "")


def root_domain(host: Column) -> Column:
    return F.substring_index(host, ".", -2)


def url_path(x: Column) -> Column:
    return F.regexp_extract(x, _URL, 3)


def clean_title(x: Column) -> Column:
    out = collapse(F.coalesce(x, F.lit("")))
    out = F.regexp_replace(F.regexp_replace(out, lx.TITLE_TAIL, ""), lx.TITLE_CALL, "")
    return F.substring(strip(out, " -–—|"), 1, 160)


def clean_company(x: Column) -> Column:
    out = strip(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", " "), " -–—|")
    out = strip(F.regexp_replace(F.regexp_replace(out, lx.COMPANY_TAIL, ""), lx.COMPANY_LINK, ""), " -–—|")
    return F.when(out == "", "Unknown").otherwise(out)


@lru_cache(maxsize=1)
def _entities() -> str:
    """Character references with their characters, as JSON: all named ones of the HTML standard (some may lack the semicolon),
    and the numeric ones that stand for Windows-1252 characters."""
    named = {f"&{k}": v for k, v in html5.items()}
    old = {f"&#{n};": bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}
    return json.dumps(named | old)


def unescape(x: Column) -> Column:
    """Named, decimal and hexadecimal character references as their characters; unknown ones stay."""
    pieces = F.regexp_extract_all(x, F.lit(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{0,31});?|[^&]+|&"), F.lit(0))
    named = F.from_json(F.lit(_entities()), "map<string,string>")
    digits = lambda p: F.regexp_extract(p, "[#xX]0*([0-9a-fA-F]+);?$", 1)
    number = lambda p: F.when(p.rlike("^&#[xX]"), F.conv(digits(p), 16, 10)).otherwise(digits(p)).cast("bigint")
    code = lambda p: F.when(F.length(digits(p)) > 9, F.lit(0)).otherwise(number(p))
    wrong = lambda n: (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    char = lambda n: F.when(wrong(n), "\uFFFD").otherwise(F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32"))
    decimal = lambda p: F.concat(F.lit("&#"), code(p).cast("string"), F.lit(";"))
    one = lambda p: (
        F.when(p.rlike("^&#[0-9xX]"), F.coalesce(F.try_element_at(named, decimal(p)), char(code(p))))
        .when(p.rlike("^&[A-Za-z]"), F.coalesce(F.try_element_at(named, p), p))
        .otherwise(p)
    )
    return F.when(x.contains("&"), F.array_join(F.transform(pieces, one), "")).otherwise(x)


def html_to_text(x: Column, drop: tuple[str, ...] = (), limit: int | None = None) -> Column:
    """Text of markup: elements in ``drop`` and comments go with their content, tags become spaces, references characters."""
    out = F.regexp_replace(x, r"(?s)<!--.*?-->", " ")
    for tag in drop:
        out = F.regexp_replace(out, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    out = collapse(unescape(F.regexp_replace(out, r"<[/!?]?[A-Za-z][^>]*>", " ")))
    return F.substring(out, 1, limit) if limit else out


def shorten(x: Column, limit: int) -> Column:
    clean = collapse(F.coalesce(x, F.lit("")))
    return F.when(F.length(clean) <= limit, clean).otherwise(F.concat(F.rtrim(F.substring(clean, 1, limit - 1)), F.lit("...")))


def prettify_slug(x: Column) -> Column:
    out = title_case(F.trim(F.translate(x, "-_", "  ")))
    return F.when(out == "", "Unknown").otherwise(out)


def console_safe(x: Column, limit: int = 80) -> Column:
    return F.substring(collapse(F.regexp_replace(F.coalesce(x, F.lit("")), r"[^\x00-\x7F]", "")), 1, limit)


def merge_texts(*texts: Column, limit: int = 7000) -> Column:
    """Different non-blank texts, in order, with a blank line between."""
    kept = F.filter(F.array(*[strip_white(F.coalesce(t, F.lit(""))) for t in texts]), lambda t: t != "")
    return F.substring(F.array_join(F.array_distinct(kept), "\n\n"), 1, limit)


_MODE = r"(?iU)\b(remote|hybrid|on-?site|online|work\s*from\s*home|wfh|home\s*office|anywhere|worldwide|distributed|global)\b"


def known_place(city: Column, country: Column) -> Column:
    """City and country as far as they are known."""
    known = lambda x: F.when(F.lower(F.trim(x)).isin("", "unknown"), "").otherwise(F.trim(x))
    c, k = known(F.coalesce(city, F.lit(""))), known(F.coalesce(country, F.lit("")))
    return F.concat_ws(", ", F.when(c != "", c), F.when(k != "", title_case(k)))


def free_place(location: Column) -> Column:
    """The free text of a place without words of working mode; '' if no letter is left."""
    free = F.regexp_replace(F.regexp_replace(F.coalesce(location, F.lit("")), _MODE, " "), r"[/|()\[\]–—-]+", " ")
    free = strip(F.regexp_replace(F.regexp_replace(free, r"(?U)\s*,\s*", ", "), r"(?U)\s+", " "), " ,")
    return F.regexp_extract(free, r"(?s)^.*\p{L}.*$", 0)


def more_specific(free: Column, structured: Column) -> Column:
    """The one of ``free_place`` and ``known_place`` that says more; both are mentioned often, so best columns."""
    rank = lambda x: F.struct(F.when(x.contains(","), 1).otherwise(0), F.size(F.split(x, " ")), F.length(x))
    return (
        F.when((free == "") & (structured == ""), "Unknown")
        .when(structured == "", free)
        .when(free == "", structured)
        .when(rank(free) >= rank(structured), free)
        .otherwise(structured)
    )


def display_location(city: Column, country: Column, location: Column) -> Column:
    """The more specific of the known city and country and the free text without words of working mode."""
    return more_specific(free_place(location), known_place(city, country))
