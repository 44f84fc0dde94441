"""Secret scan: three fixed patterns, and sliding-window Shannon entropy.

Candidate strings are maximal runs of token characters. Over each, a window of fixed
width moves one character at a time. The counts of the window's characters lie in seven
64-bit numbers, five bits a character; a step changes only the counts of the character
that enters and the one that leaves, and adjusts the sum of c*log2(c), kept in whole
units of 2**-40, by those two terms. A candidate is a finding if its highest window entropy
reaches the threshold of its character class and no allow-list rule clears it.

The allow list knows placeholders (parts of a candidate that hold such a word are left out
before the rest is judged), whole UUIDs, and plain identifiers, paths and dates: candidates
in which no letter stands beside a digit and no small letter alone between two capitals.
Its patterns repeat single characters only, so no candidate is too long for them.

Everything is Catalyst expressions on one scan: no shuffle, no Python on executors. The
expensive expressions stand behind ``rlike`` gates, so ordinary documents cost only those.

Null text counts as empty: no findings. Repeated rows give repeated results. Columns other
than ``doc_id`` and ``text`` are not read, so their names cannot clash.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans at one start are listed.
KINDS = ("assign", "access", "hex", "entropy")

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"


@dataclass(frozen=True)
class EntropyRule:
    """Parameters of the entropy scan."""

    #: At most 31: a count takes five bits.
    window: int = 20
    #: Bits a character; a window of 20 has at most log2(20) = 4.32.
    hex_bits: float = 3.0
    mixed_bits: float = 3.6
    #: Words that mark the part of a candidate in which they stand as a placeholder.
    placeholders: tuple[str, ...] = ("example", "placeholder", "changeme", "dummy", "redacted", "xxxx", "0123456789", "abcdefghij")
    #: Regular expressions that clear a whole candidate.
    allow: tuple[str, ...] = (r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",)
    #: Without a match of this a candidate is made of plain words and numbers.
    odd: str = r"[A-Za-z][0-9]|[0-9][A-Za-z]|[A-Z][a-z][A-Z]"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


_SPANS = "array<struct<s:int,k:int,e:int>>"

#: Items of an array that are folded one after another; block results are folded again.
_RUN = 64


def _let(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` stands for ``value`` (computed once)."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _before(numbers: str, fold: str) -> str:
    """SQL: for each of the ints ``numbers`` (none negative) the fold (of ``x`` and ``y``) of those before it, from 0.

    Growing an array copies it, so runs of ``_RUN`` are folded by themselves and shifted by the fold of
    the runs before: n items cost n * _RUN + (n / _RUN)**2 copies of an int.
    """
    grown = lambda items, start: f"""aggregate({items}, named_struct('x', {start}, 'out', cast(array() as array<int>)),
        (acc, y) -> named_struct('x', {fold.replace("x", "acc.x", 1)}, 'out', concat(acc.out, array(acc.x))), acc -> acc.out)"""  # noqa: E731
    runs = f"transform(sequence(0, (size(numbers) - 1) div {_RUN}), r -> slice(numbers, r * {_RUN} + 1, {_RUN}))"
    whole = f"transform(runs, r -> aggregate(r, 0, (x, y) -> {fold}))"
    shifted = f"flatten(zip_with(runs, {grown(whole, '0')}, (r, first) -> {grown('r', 'first')}))"
    return _let("numbers", numbers, f"if(size(numbers) = 0, cast(array() as array<int>), {_let('runs', runs, shifted)})")


def _located(pattern: str, group: int, kind: int, keep: str) -> str:
    """SQL: spans (start, kind, end) of the pattern's matches in ``text`` for which ``keep`` holds.

    Matches and the pieces between them come from the same left-to-right search, so their
    lengths add up to the positions. ``keep`` sees the match as ``z['1']`` and its ``group`` as ``z['2']``.
    """
    p = _quoted(pattern)
    whole = f"regexp_extract_all(text, {p}, 0)"
    part = whole if group == 0 else f"regexp_extract_all(text, {p}, {group})"
    starts = _before("transform(found, z -> length(z['0']) + coalesce(length(z['1']), 0))", "x + y")
    placed = f"zip_with(found, {starts}, (z, at) -> named_struct('at', at + length(z['0']), 'z', z))"
    kept = f"filter({placed}, f -> {_let('z', 'f.z', f"z['1'] is not null and {keep}")})"
    spans = f"transform({kept}, f -> named_struct('s', f.at, 'k', {kind}, 'e', f.at + length(f.z['1'])))"
    return _let("found", f"arrays_zip(split(text, {p}, -1), {whole}, {part})", spans)


#: Characters of candidates are the codes 43 ("+") to 122 ("z"); twelve counts of five bits fill a long.
_FIRST, _PER = 43, 12
_UNIT = 1 << 40


def _entropy_reached(candidate: str, rule: EntropyRule) -> str:
    """SQL: whether the highest window entropy of ``candidate`` (at least a window long) reaches its class's threshold."""
    w = rule.window
    if not 1 < w < 32:
        raise ValueError("a window has 2 to 31 characters")
    terms = "array(" + ", ".join(f"{round(c * math.log2(c) * _UNIT) if c else 0}L" for c in range(w + 1)) + ")"
    least = lambda bits: f"{math.floor(w * (math.log2(w) - bits) * _UNIT + 0.5)}L"
    code = lambda at: f"ascii(cast(substring(b, {at}, 1) as string)) - {_FIRST}"
    shift = lambda c: f"cast(5 * ({c} % {_PER}) as int)"
    held = lambda c: f"cast(shiftright(acc.c[cast({c} div {_PER} as int)], {shift(c)}) & 31 as int)"
    one = lambda c: f"if(f = {c} div {_PER}, shiftleft(1L, {shift(c)}), 0L)"
    changed = f"""named_struct(
        'c', transform(acc.c, (x, f) -> x + {one("p.come")} - if(p.gone < 0, 0L, {one("p.gone")})),
        'sum', acc.sum + t[p.n + 1] - t[p.n] + if(p.gone < 0, 0L, t[greatest(p.o - 1, 0)] - t[p.o]),
        'low', acc.low)"""
    step = f"""transform(transform(
            array(named_struct('come', {code("i")}, 'gone', if(i > {w}, {code(f"i - {w}")}, -1))),
            p -> named_struct('come', p.come, 'gone', p.gone, 'n', {held("p.come")}, 'o', if(p.gone < 0, 0, {held("p.gone")}))),
        p -> if(p.come = p.gone, acc, {changed}))[0]"""
    lowest = f"""aggregate(sequence(1, length(b)),
        named_struct('c', array_repeat(0L, {(122 - _FIRST) // _PER + 1}), 'sum', 0L, 'low', {w * w * _UNIT}L),
        (acc, i) -> transform(array({step}), v -> named_struct('c', v.c, 'sum', v.sum, 'low', if(i < {w}, v.low, least(v.low, v.sum))))[0],
        acc -> acc.low)"""
    most = f"if({candidate} rlike '^[0-9A-Fa-f]+$', {least(rule.hex_bits)}, {least(rule.mixed_bits)})"
    return f"transform(array(cast({candidate} as binary)), b -> transform(array({terms}), t -> {lowest})[0])[0] <= {most}"


def _judged(candidate: str, rule: EntropyRule) -> str:
    """SQL: what is left of ``candidate`` without the parts that placeholders mark."""
    words = "|".join(rule.placeholders)
    part = f"(?i)(?<![A-Za-z0-9])[A-Za-z0-9]*(?:{words})[A-Za-z0-9]*"
    return f"if({candidate} rlike {_quoted(f'(?i){words}')}, regexp_replace({candidate}, {_quoted(part)}, ''), {candidate})" if words else candidate


def _suspicious(candidate: str, rule: EntropyRule) -> str:
    """SQL: whether the candidate is a finding."""
    allowed = "".join(f" and not {candidate} rlike {_quoted(a)}" for a in rule.allow)
    rest = f"length(j) >= {rule.window} and j rlike {_quoted(rule.odd)} and {_entropy_reached('j', rule)}"
    return f"{candidate} rlike {_quoted(rule.odd)}{allowed} and transform(array({_judged(candidate, rule)}), j -> {rest})[0]"


def with_spans(docs: DataFrame, rule: EntropyRule | None = None) -> DataFrame:
    """``doc_id, text`` (null: empty) with ``base`` and ``found``: arrays of structs s, k, e."""
    rule = rule or EntropyRule()
    none = f"cast(array() as {_SPANS})"
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def gated(gate: str, located: str) -> str:
        return f"if(text rlike {_quoted(gate)}, {located}, {none})"

    assign = gated(
        r"(?i:passw|secret|token|api_?key)",
        _located(ASSIGN, 2, 0, "length(z['2']) >= 6"),
    )
    access = gated(ACCESS, _located(ACCESS, 0, 1, "true"))
    hexes = gated(HEX, _located(HEX, 0, 2, "true"))
    run = f"[A-Za-z0-9+/_=-]{{{rule.window},}}"
    entropy = gated(run, _located(run, 0, 3, _suspicious("z['1']", rule)))
    base = texts.withColumns({"_a": F.expr(assign), "_c": F.expr(access), "_h": F.expr(hexes), "_e": F.expr(entropy)})
    return base.select(
        "doc_id",
        "text",
        F.expr("array_sort(concat(_a, _c, _h))").alias("base"),
        F.expr(_uncovered("array_sort(concat(_a, _c, _h, _e))")).alias("found"),
    )


def _uncovered(spans: str) -> str:
    """SQL: sorted ``spans`` without those of entropy that lie in one of a pattern: one that ends as far begins before it."""
    reach = _before("transform(spans, x -> if(x.k < 3, x.e, 0))", "greatest(x, y)")
    kept = f"filter(zip_with(spans, {reach}, (x, far) -> named_struct('x', x, 'far', far)), p -> p.x.k < 3 or p.x.e > p.far)"
    return _let("spans", spans, f"transform({kept}, p -> p.x)")


#: Characters of the pieces that a text is cut into, in two steps, as a place in a text is found from its start.
_LARGE, _PIECE = 1 << 18, 1 << 11


def _masked(mask: str) -> str:
    """SQL: ``text`` with its spans ``found`` masked; those that overlap become one."""
    cut = lambda t, n: f"transform(sequence(0, (length({t}) - 1) div {n}), i -> substr({t}, i * {n} + 1, {n}))"
    pieces = f"flatten(transform({cut('text', _LARGE)}, large -> {cut('large', _PIECE)}))"
    part = lambda a, b: (
        f"if({b} <= {a}, '', substr(array_join(slice(pieces, {a} div {_PIECE} + 1, ({b} - 1) div {_PIECE} - {a} div {_PIECE} + 1), ''), {a} % {_PIECE} + 1, {b} - {a}))"
    )
    reach = _before("transform(found, x -> x.e)", "greatest(x, y)")
    heads = f"filter(zip_with(found, {reach}, (x, far) -> named_struct('s', x.s, 'far', far)), p -> p.s >= p.far)"
    clear = f"array_join(transform({heads}, p -> concat({part('p.far', 'p.s')}, {_quoted(mask)})), '')"
    rest = _let("far", "array_max(transform(found, x -> x.e))", part("far", "length(text)"))
    return _let("pieces", pieces, f"concat({clear}, {rest})")


def _listed(spans_column: str) -> str:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return f"array_join(transform({spans_column}, x -> concat({names}[x.k], ':', x.s, ':', x.e)), ',')"


def scan(docs: DataFrame, rule: EntropyRule | None = None) -> DataFrame:
    """One row per document: counts of the patterns' findings, their digest, and all spans as text."""
    count = lambda k: F.expr(f"cast(size(filter(base, x -> x.k = {k})) as bigint)")
    return with_spans(docs, rule).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.sha2(F.expr(_listed("base")), 256).alias("base_sha256"),
        F.expr(_listed("found")).alias("spans"),
        F.expr("cast(size(filter(found, x -> x.k = 3)) as bigint)").alias("n_entropy"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]", rule: EntropyRule | None = None) -> DataFrame:
    """``docs`` with every finding in ``text`` replaced; overlapping findings become one mask.

    All columns stay; ``n_chars``, where present, is set anew on changed texts. Documents
    without findings pass unchanged, null texts stay null.
    """
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("doc_id"), "text")
    found = with_spans(packed, rule)
    clean = found.select(
        F.col("doc_id").alias("row"),
        F.when(F.size("found") > 0, F.expr(_masked(mask))).alias("masked"),
    )
    out = []
    for c in columns:
        old = F.col("row").getField(c)
        if c == "text":
            out.append(F.coalesce("masked", old).alias(c))
        elif c == "n_chars":
            out.append(F.coalesce(F.length("masked").cast("bigint"), old.cast("bigint")).alias(c))
        else:
            out.append(old.alias(c))
    return clean.select(*out)
