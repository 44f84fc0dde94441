"""Term lists compiled to JVM predicates.

A term of up to three letters or digits must stand alone (no ASCII letter or digit beside
it); any other matches anywhere. Long terms become byte searches, which cost far less than
one alternation; a term that holds another of its list is left out, since the other decides.

Where many lists are looked for in one text, an ``Index`` gives each term a bit: one pass
finds them all, into a few long columns, and every list is a test of bits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache, reduce
from operator import or_

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.operators.barrier import bounded_batches


def stands_alone(term: str) -> bool:
    return len(term) <= 3 and term.isalnum()


def needed(terms: Iterable[str]) -> list[str]:
    """The terms without those that contain another one."""
    terms = list(dict.fromkeys(terms))
    return [t for t in terms if not any(o != t and o in t for o in terms)]


def java_literal(text: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+\-?^$|&#])", r"\\\1", text)


@lru_cache(maxsize=16)
def _automaton(terms: tuple[tuple[str, bool], ...]):
    """Aho-Corasick automaton; a term's value holds its length, its bit and whether that stands alone."""
    import ahocorasick

    values: dict[str, list[tuple[int, int, bool]]] = {}
    for n, (term, alone_) in enumerate(terms):
        values.setdefault(term, []).append((len(term), 1 << n, alone_))
    found = ahocorasick.Automaton()
    for term, value in values.items():
        found.add_word(term, value)
    found.make_automaton()
    return found


_BESIDE = frozenset("abcdefghijklmnopqrstuvwxyz0123456789")


def occurring(text: str, terms: tuple[tuple[str, bool], ...]) -> int:
    """Bits of the terms (text, whether it must stand alone) that a lower-cased text holds."""
    bits, last = 0, len(text) - 1
    for end, values in _automaton(terms).iter(text):
        for size, bit, alone_ in values:
            if not bits & bit:
                start = end - size
                if not alone_ or not (start >= 0 and text[start] in _BESIDE or end < last and text[end + 1] in _BESIDE):
                    bits |= bit
    return bits


def any_of(tests: list[Column]) -> Column:
    return reduce(or_, tests) if tests else F.lit(False)


class Index:
    """Bits of terms; filled by the tests that ask for them, and then found by ``search``."""

    #: Bits of a mask: a long without its sign.
    WIDTH = 63

    def __init__(self) -> None:
        self.bits: dict[tuple[str, bool], int] = {}

    def on(self, prefix: str) -> Marked:
        """Tests of a text whose masks are the columns ``prefix`` 0, 1, ..."""
        return Marked(self, prefix)

    @property
    def count(self) -> int:
        return -(-len(self.bits) // self.WIDTH)

    def search(self, df: DataFrame, prefix: str, low: str) -> tuple[DataFrame, list[str]]:
        """``search`` of one text."""
        return search(df, (self, prefix, low))


def search(df: DataFrame, *asked: tuple[Index, str, str]) -> tuple[DataFrame, list[str]]:
    """``df`` with the masks of lower-cased texts (null: no term), whose names follow; asked are an index, the masks' prefix and the text.

    An automaton over Arrow batches finds all terms in one pass, whatever their number; searches by built-in
    functions cost a pass for each term, and one pattern of all terms about as much (README has figures). Texts asked
    together are searched by one worker a task, and batches are short: their size follows that of the texts.
    """
    asked = tuple(a for a in asked if a[0].bits)
    if not asked:
        return df, []
    found = {f"{prefix}found": _finder(tuple(index.bits), index.count)(F.col(low)) for index, prefix, low in asked}
    masks = {f"{prefix}{i}": F.col(f"{prefix}found")[i] for index, prefix, _ in asked for i in range(index.count)}
    return bounded_batches(df).withColumns(found).withColumns(masks).drop(*found), list(masks)


def _finder(terms: tuple[tuple[str, bool], ...], count: int):
    part, width = (1 << Index.WIDTH) - 1, Index.WIDTH

    @F.arrow_udf("array<bigint>")
    def found(texts: pa.Array) -> pa.Array:
        flat = []
        for t in texts:  # one at a time, as all of a batch as Python's texts take more than the batch
            text = t.as_py()
            m = occurring(text, terms) if text else 0
            flat += [m >> i * width & part for i in range(count)]
        return pa.ListArray.from_arrays(pa.array(range(0, len(flat) + 1, count), pa.int32()), pa.array(flat, pa.int64()))

    return found


class Marked:
    """A text known by the bits of an index: stands where a lower-cased text is asked for terms."""

    def __init__(self, index: Index, prefix: str) -> None:
        self.index, self.prefix = index, prefix

    def sql(self, terms: Iterable[tuple[str, bool]]) -> str:
        """Whether any of the terms (text, whether it must stand alone) occurs."""
        masks: dict[int, int] = {}
        for key in terms:
            n = self.index.bits.setdefault(key, len(self.index.bits))
            masks[n // Index.WIDTH] = masks.get(n // Index.WIDTH, 0) | 1 << n % Index.WIDTH
        return "(" + (" or ".join(f"({self.prefix}{i} & {m}L) <> 0" for i, m in masks.items()) or "false") + ")"


def has_substring(lowered: Column | Marked, terms: Iterable[str]) -> Column:
    """Whether the lower-cased text holds any of the terms anywhere."""
    if isinstance(lowered, Marked):
        return F.expr(lowered.sql((t, False) for t in needed(terms)))
    return any_of([lowered.contains(t) for t in needed(terms)])


def alone(terms: Iterable[str]) -> str:
    return "(?<![a-z0-9])(?:" + "|".join(map(java_literal, terms)) + ")(?![a-z0-9])"


def term_keys(terms: Iterable[str]) -> list[tuple[str, bool]]:
    """Each term with whether it must stand alone."""
    terms = [t.lower() for t in terms]
    long = needed(t for t in terms if not stands_alone(t))
    return [*((t, False) for t in long), *((t, True) for t in dict.fromkeys(terms) if stands_alone(t))]


def has_term(lowered: Column | Marked, terms: Iterable[str]) -> Column:
    """Whether the lower-cased text holds any of the terms, short ones standing alone."""
    keys = term_keys(terms)
    if isinstance(lowered, Marked):
        return F.expr(lowered.sql(keys))
    short = [t for t, alone_ in keys if alone_]
    tests = [lowered.contains(t) for t, alone_ in keys if not alone_]
    if short:
        tests.append(lowered.rlike(alone(short)))
    return any_of(tests)


def first_of(cases: list[tuple[Column, Column | str]]) -> Column:
    """The value of the first case that holds, else null."""
    out = None
    for test, value in cases:
        out = F.when(test, value) if out is None else out.when(test, value)
    return F.lit(None).cast("string") if out is None else out
