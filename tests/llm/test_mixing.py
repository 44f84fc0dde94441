import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from postlode.llm import mixing


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def docs_of(spark, rows):
    return spark.createDataFrame([(i, s, t, 1) for i, (s, t) in enumerate(rows)], "doc_id long, source string, text string, taken int")


@given(st.lists(st.integers(0, 1000), min_size=1, max_size=12))
@settings(max_examples=200)
def test_targets_share_everything_below_their_caps(sizes):
    weights = [1 + i % 3 for i in range(len(sizes))]
    got = mixing.targets(sizes, weights)
    assert abs(sum(got) - sum(sizes)) < 1e-6 * max(1, sum(sizes))
    assert all(g <= 3 * s + 1e-6 for g, s in zip(got, sizes, strict=True))
    free = [g / w for g, s, w in zip(got, sizes, weights, strict=True) if g < 3 * s - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


def test_taken_words_meet_targets(spark):
    rows = [(f"s{i % 5}" if i % 3 else "s0", "w " * (i * 31 % 90)) for i in range(700)]
    rows += [(None, "a\tb\nc é") for _ in range(40)] + [("s1", None), ("s9", ""), ("s3", "x y z " * 3000)]
    out = mixing.mix(docs_of(spark, rows), block=64).collect()
    assert len(out) == len(rows)
    sizes, took, target = {}, {}, {}
    for r in out:
        s, t = rows[r.doc_id]
        assert r["size"] == words(t) and r.source == s and 0 <= r.taken <= 3 * r["size"]
        sizes[s] = sizes.get(s, 0) + words(t)
        took[s] = took.get(s, 0) + r.taken
        target[s] = r.target
    names = sorted((s for s in sizes if s), key=str) + [None]
    want = mixing.targets([sizes[s] for s in names], [1 + i % 3 for i in range(len(names))])
    for s, w in zip(names, want, strict=True):
        assert abs(target[s] - w) < 1e-6 and abs(took[s] - w) <= 1, (s, took[s], w)
    assert all(r.source_size == sizes[r.source] for r in out)
    assert sorted(out, key=str) == sorted(mixing.mix(docs_of(spark, rows).repartition(9), block=64).collect(), key=str)


def test_schedule_is_spread_evenly(spark):
    sources = mixing._sources(docs_of(spark, [("a", "w " * 6400), ("b", "w " * 12800)]).selectExpr("source", "size(split(text,' '))-1 as size"), 64, (1, 2), 3, 2)
    slots = mixing.schedule(spark, sources, 64).orderBy("slot").collect()
    assert [sum(s.number == k for s in slots) for k in (0, 1)] == [s.slots for s in sources]
    for n in range(30, len(slots), 30):
        share = sum(s.number == 1 for s in slots[:n]) / n
        assert abs(share - 2 / 3) < 3 / n


def test_mixed_documents(spark):
    rows = [("a", f"one two three {i}") for i in range(10)] + [("b", f"k{i} " * 30) for i in range(10)] + [("b", None)]
    df = docs_of(spark, rows).selectExpr("doc_id", "text", "'en' as lang", "source", "cast(length(text) as bigint) as n_chars")
    out = mixing.mixed_documents(df, block=16)
    assert out.columns == df.columns
    took = {r.doc_id: r.taken for r in mixing.mix(df, block=16).collect()}
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + words(r.text)
        assert r.n_chars == len(r.text)
        assert rows[r.doc_id][1].split()[: words(r.text)] == r.text.split()
    assert got == {k: v for k, v in took.items() if v}


def brute(df, weights=(1, 2, 3)):
    """(doc_id, text) to how often each of its words is taken: round and round a source's words in shuffled order."""
    rows = df.selectExpr("doc_id", "source", "text", "xxhash64(7, doc_id, xxhash64(text)) as key").collect()
    names = sorted({r.source for r in rows}, key=lambda s: (s is None, s or ""))
    strings = [[(r, i) for r in sorted((r for r in rows if r.source == s), key=lambda r: (r.key, r.doc_id is not None, r.doc_id or 0)) for i in range(words(r.text))] for s in names]
    sizes = [len(x) for x in strings]
    count = {}
    for string, target in zip(strings, mixing.targets(sizes, [weights[i % 3] for i in range(len(names))]), strict=True):
        rounds, rest = divmod(min(round(target), 3 * len(string)), len(string)) if string else (0, 0)
        for at, (r, i) in enumerate(string):
            count.setdefault((r.doc_id, r.text), {}).setdefault(i, []).append(rounds + (at < rest))
    return count


def test_mix_equals_brute_force(spark):
    rows = [(f"s{i % 4}" if i % 3 else None, f"a{i}\tb\nc  " + "w é " * (i * 31 % 70) + "end") for i in range(160)]
    rows += [("s1", None), ("s9", ""), ("s3", "x y z\n" * 900)]
    df = docs_of(spark, rows).selectExpr(*[f"{c} as {n}" for c, n in (("doc_id", "doc_id"), ("text", "text"), ("source", "source"))], "'k' as row", "'l' as whole", "'m' as passage", "7 as runs", "8 as size")
    want = brute(df)
    for block in (16, 4096):
        got = {(r.doc_id, rows[r.doc_id][1]): r.taken for r in mixing.mix(df, block=block).collect()}
        assert got == {(i, t): sum(map(sum, want.get((i, t), {}).values())) for i, (_, t) in enumerate(rows)}
        out = mixing.mixed_documents(df, block=block)
        assert out.columns == df.columns
        texts = {}
        for r in out.collect():
            assert (r.row, r.whole, r.passage, r.runs, r["size"], r.source) == ("k", "l", "m", 7, 8, rows[r.doc_id][0])
            assert r.text in rows[r.doc_id][1]
            texts.setdefault(r.doc_id, []).append(r.text)
        for i, (_, t) in enumerate(rows):
            times = [sum(x) for _, x in sorted(want.get((i, t), {}).items())]
            whole = min(times, default=0)
            assert texts.get(i, []).count(t) == whole or not t
            rest = [x for x in texts.get(i, []) if x != t]
            if max(times, default=0) > whole:
                assert len(rest) == 1 and rest[0].split() == t.split()[: sum(times) - whole * len(times)]


def test_repeated_rows_are_mixed_by_themselves(spark):
    rows = [(1, "a", "one two three")] * 5 + [(None, "a", "one two three")] * 4 + [(2, "b", "x y z w v")] * 30
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    took = sorted(r.taken for r in mixing.mix(df, block=4).collect())
    out = mixing.mixed_documents(df, block=4).collect()
    assert sum(words(r.text) for r in out) == sum(took) == 177
    assert sum(r.doc_id is None for r in out) > 4 and len(took) == 39


def test_too_many_sources_are_an_error(spark):
    with pytest.raises(ValueError):
        mixing.mix(docs_of(spark, [(f"s{i}", "a b") for i in range(30)]), most_sources=20)


def test_empty_table(spark):
    assert mixing.mix(docs_of(spark, [])).collect() == []
    assert mixing.mix(docs_of(spark, [("a", None), (None, "")])).selectExpr("sum(taken)").first()[0] == 0
