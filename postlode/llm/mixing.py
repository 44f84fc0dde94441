"""Mixing sources to target weights by a low-discrepancy schedule.

The documents of each source are shuffled by hash and strung together; the string is cut
into blocks of equally many words. Golden-ratio points, mapped through the cumulative
shares of the sources, say which source each slot of the mix draws from; the rank of a
slot among its source's slots names the block it takes, round and round up to
``most_repeats`` times. The last slot of a source takes only what its target still needs.

The sources' totals (a row each) come to the driver: sources are named collections, at most
``most_sources``; more are an error. Nothing else is gathered. Prefix sums come from the
totals of range partitions and slot ranks from the totals of chunks of slots, so that a
source with a third of all rows is spread like any other.

Null text has no words; null is a source of its own, last in order; documents without words
are returned by ``mix`` with nothing taken and are not in ``mixed_documents``. Repeated rows
are rows of their own, told apart by number. An empty table gives no rows. Of other columns
``mix`` reads none, and ``mixed_documents`` carries all whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.llm.common import WORD_PATTERN, materialise
from postlode.llm.sharding import in_global_order

#: Fractional parts of the golden ratio and of its multiple by 2**20, in slot numbers' two halves.
GOLDEN = 0.6180339887498949
GOLDEN_20 = math.modf((1 << 20) * 0.6180339887498949)[0]
CHUNK = 1 << 16
WEIGHTS = (1, 2, 3)
WHITE = r"[\x20\x09-\x0D]"


@dataclass(frozen=True)
class Source:
    number: int
    name: str | None
    size: int
    target: float
    blocks: int
    #: Slots that the source fills, and words of the last of them.
    slots: int
    last: int


def targets(sizes: list[int], weights: list[float], most_repeats: int = 3) -> list[float]:
    """Shares of all words by weight, none above ``most_repeats`` times its size; what is over goes to the rest by weight."""
    out = [0.0] * len(sizes)
    left, open_ = float(sum(sizes)), set(range(len(sizes)))
    while open_ and left > 0:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total > most_repeats * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * weights[i] / total
            break
        for i in full:
            out[i] = float(most_repeats * sizes[i])
        left -= sum(out[i] for i in full)
        open_ -= set(full)
    return out


def _sources(rows: DataFrame, block: int, weights: tuple[float, ...], most_repeats: int, most_sources: int) -> list[Source]:
    totals = rows.groupBy("source").agg(F.sum("size").alias("size")).limit(most_sources + 1).collect()
    if len(totals) > most_sources:
        raise ValueError(f"over {most_sources} sources")
    totals.sort(key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    wanted = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most_repeats)
    out = []
    for i, (r, size, target) in enumerate(zip(totals, sizes, wanted, strict=True)):
        blocks = -(-size // block)
        words = min(round(target), most_repeats * size)
        rounds, rest = divmod(words, size) if size else (0, 0)
        slots = rounds * blocks + -(-rest // block)
        last = rest - (-(-rest // block) - 1) * block if rest else block
        out.append(Source(i, r.source, size, target, blocks, slots, last))
    return out


def _point(slot: Column) -> Column:
    """The slot's golden-ratio point in [0, 1); two halves keep it exact for large slot numbers."""
    high, low = F.shiftright(slot, 20), slot.bitwiseAND(F.lit((1 << 20) - 1))
    a, b = high * F.lit(GOLDEN_20), low * F.lit(GOLDEN)
    both = (a - F.floor(a)) + (b - F.floor(b))
    return both - F.floor(both)


def schedule(spark, sources: list[Source], block: int) -> DataFrame:
    """``slot, number, rank, block, words``: what each slot of the mix takes.

    Slots beyond a source's own are dropped; what the points leave short of them (a few slots
    a source) follows at the end.
    """
    total = sum(s.target for s in sources)
    n = math.ceil(total / block)
    bounds, run = [], 0.0
    for s in sources[:-1]:
        run += s.target / total if total else 0
        bounds.append(run)
    steps = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<double>")
    drawn = spark.range(n).select(F.col("id").alias("slot"), F.shiftright("id", 16).alias("chunk"), _point(F.col("id")).alias("u"))
    drawn = drawn.select("slot", "chunk", F.size(F.filter(steps, lambda b: b <= F.col("u"))).alias("number"))
    counts = drawn.groupBy("number", "chunk").agg(F.count("*").alias("n"))
    before = Window.partitionBy("number").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("number", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("number", "chunk").orderBy("slot")
    ranked = drawn.withColumn("r", F.row_number().over(within) - 1).join(first, ["number", "chunk"])
    ranked = ranked.select("slot", "number", (F.col("first") + F.col("r")).cast("long").alias("rank"))
    plan = spark.createDataFrame(
        [(s.number, s.blocks, s.slots, s.last) for s in sources], "number int, blocks long, slots long, last long"
    )
    had = counts.groupBy("number").agg(F.sum("n").alias("had"))
    short = plan.join(had, "number", "left").filter(F.coalesce("had", F.lit(0)) < F.col("slots"))
    tail = short.select("number", F.explode(F.sequence(F.coalesce("had", F.lit(0)).cast("long"), F.col("slots") - 1)).alias("rank"))
    ranks = ranked.unionByName(tail.select((F.lit(n) + F.col("rank")).alias("slot"), "number", "rank"))
    return (
        ranks.join(F.broadcast(plan), "number")
        .filter(F.col("rank") < F.col("slots"))
        .select(
            "slot",
            "number",
            "rank",
            (F.col("rank") % F.col("blocks")).alias("block"),
            F.when(F.col("rank") == F.col("slots") - 1, F.col("last")).otherwise(F.lit(block).cast("long")).alias("words"),
        )
    )


def words_of(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD_PATTERN)).cast("long")


#: Columns that a row to be mixed has besides those that its caller keeps.
_SIZED = ("source", "size", "content")


def _sized(docs: DataFrame, row: Column, *keep: Column) -> DataFrame:
    return docs.select(row.alias("row"), *keep, "source", words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))


def _spans(
    rows: DataFrame, keep: list[str], block: int, weights: tuple[float, ...], most_repeats: int, seed: int, most_sources: int
) -> tuple[DataFrame, DataFrame]:
    """What the schedule takes of the written ``rows``.

    All rows in order (``part, pos``, those kept, ``source_size, target``), and for each block that a
    row has words in: its words ``low`` to ``high`` there, ``shift`` from the block's to the row's
    counting, and ``uses`` (words from the block's start, times).
    """
    spark = rows.sparkSession
    sources = _sources(rows, block, weights, most_repeats, most_sources)
    known = spark.createDataFrame(
        [(s.name, s.number, s.size, s.target) for s in sources], "name string, number int, source_size long, target double"
    )
    told = rows.join(F.broadcast(known), rows.source.eqNullSafe(known.name)).drop("name")
    told = told.withColumn("key", F.xxhash64(F.lit(seed), "doc_id", "content"))
    ordered = in_global_order(told, ["number", "key", "doc_id", "size"], "mix")
    totals = ordered.groupBy("number", "part").agg(F.sum("size").alias("all"))
    before = Window.partitionBy("number").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("number", "part", F.coalesce(F.sum("all").over(before), F.lit(0)).alias("first"))
    run = Window.partitionBy("number", "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = ordered.withColumn("upto", F.sum("size").over(run)).join(starts, ["number", "part"])
    placed = placed.withColumn("a", F.col("first") + F.col("upto") - F.col("size"))
    last = F.floor((F.col("a") + F.col("size") - 1) / block)
    held = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("a") / block), last)))
    shift = F.col("block") * block - F.col("a")
    spans = held.select(
        "part", "pos", *keep, "number", "block", shift.alias("shift"),
        F.greatest(-shift, F.lit(0)).alias("low"), F.least(F.col("size") - shift, F.lit(block)).alias("high"),
    )
    used = schedule(spark, sources, block).groupBy("number", "block", "words").agg(F.count("*").alias("times"))
    used = used.groupBy("number", "block").agg(F.collect_list(F.struct("words", "times")).alias("uses"))
    return ordered, spans.join(used, ["number", "block"], "left")


def mix(
    docs: DataFrame, block: int = 4096, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3, seed: int = 7, most_sources: int = 10_000
) -> DataFrame:
    """``doc_id, source, size, content, source_size, target, taken`` of every row: the words that the mix takes of it."""
    rows = materialise(_sized(docs, F.monotonically_increasing_id(), F.col("doc_id")), "mix-sizes")
    keep = ["doc_id", *_SIZED, "source_size", "target"]
    ordered, spans = _spans(rows, keep, block, weights, most_repeats, seed, most_sources)
    took = F.expr("aggregate(coalesce(uses, array()), 0L, (t, u) -> t + u.times * greatest(least(high, u.words) - low, 0L))")
    out = spans.withColumn("t", took).groupBy("part", "pos", *keep).agg(F.sum("t").alias("taken")).select(*keep, "taken")
    return out.unionByName(ordered.filter("size = 0").select(*keep, F.lit(0).cast("long").alias("taken")))


#: Parts of a block span by how often they are taken, in the row's counting: the cuts are the ends of uses inside it.
_PARTS = """transform(array(array_sort(array_distinct(concat(array(low, high),
        transform(filter(uses, u -> low < u.words and u.words < high), u -> u.words))))),
    p -> transform(sequence(1, size(p) - 1), i -> named_struct('f', p[i - 1] + shift, 't', p[i] + shift,
        'n', aggregate(uses, 0L, (a, u) -> a + if(u.words >= p[i], u.times, 0L)))))[0]"""

#: For each number of takes the runs of words that are taken at least so often, neighbouring parts joined.
_RUNS = """flatten(transform(sequence(1L, greatest(1L, array_max(transform(parts, x -> x.n)))), k -> aggregate(
    filter(parts, x -> x.n >= k),
    cast(array() as array<struct<f:bigint,t:bigint>>),
    (a, x) -> if(size(a) > 0 and try_element_at(a, -1).t = x.f,
        concat(slice(a, 1, size(a) - 1), array(named_struct('f', try_element_at(a, -1).f, 't', x.t))),
        concat(a, array(named_struct('f', x.f, 't', x.t)))))))"""


def mixed_documents(
    docs: DataFrame, block: int = 4096, weights: tuple[float, ...] = WEIGHTS, most_repeats: int = 3, seed: int = 7, most_sources: int = 10_000
) -> DataFrame:
    """The mix as rows like ``docs``: of each document the words that the schedule draws, as often as it draws them.

    A document of which all words are taken n times gives n whole copies; what more is taken of
    some of its words follows as passages, from the first of them to the last, as they stand in the
    text. ``n_chars``, where present, is set anew for passages.
    """
    columns = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("whole")
    held = materialise(docs.select(F.monotonically_increasing_id().alias("row"), whole), "mix-docs")
    fields = held.select("row", "whole.doc_id", "whole.source", "whole.text")
    rows = materialise(_sized(fields, F.col("row"), F.col("doc_id")), "mix-sizes")
    _, spans = _spans(rows, ["row", "size"], block, weights, most_repeats, seed, most_sources)
    parts = spans.filter("uses is not null").select("row", "size", F.expr(_PARTS).alias("p"))
    each = parts.groupBy("row", "size").agg(F.array_sort(F.flatten(F.collect_list("p"))).alias("parts"))
    runs = materialise(each.select(F.col("row").alias("at"), "size", F.expr(_RUNS).alias("runs")).filter("size(runs) > 0"), "mix-runs")
    # texts are dealt by row number at every size, so that small inputs show the shuffle that large ones need
    drawn = held.join(runs.hint("merge"), held.row == runs["at"]).select("whole", "size", F.explode("runs").alias("run"))
    words = F.regexp_extract_all(F.col("whole.text"), F.lit(WORD_PATTERN + WHITE + "*"), F.lit(0))
    some = F.slice(words, (F.col("run.f") + 1).cast("int"), (F.col("run.t") - F.col("run.f")).cast("int"))
    passage = F.regexp_replace(F.array_join(some, ""), WHITE + "+$", "")
    drawn = drawn.select("whole", F.when((F.col("run.f") > 0) | (F.col("run.t") < F.col("size")), passage).alias("passage"))
    final = []
    for c in columns:
        old = F.col("whole").getField(c)
        if c == "text":
            old = F.coalesce("passage", old)
        elif c == "n_chars":
            old = F.coalesce(F.length("passage").cast("long"), old.cast("long"))
        final.append(old.alias(c))
    return drawn.select(*final)
