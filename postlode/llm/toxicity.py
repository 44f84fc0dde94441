"""Toxicity by weak supervision: many voters, a generative model of their votes, a linear classifier.

Voters say "toxic" or nothing. Some are lexicons and patterns that hold for any corpus
(LEXICONS, PATTERNS). Others are lexicons induced from the labels that may be learned from:
words and beginnings of words that toxic texts hold far more often than others, dealt to
``groups`` voters each, once for any occurrence and once for many in proportion to the text.

The label model is generative: a hidden class with a prior, for each voter the rate of its
votes in either class (its accuracy), and for each pair of voters the correlation inside the
classes, by which the evidence of voters that repeat one another is divided. It is fitted by
expectation maximisation over the votes of all documents: Spark counts equal combinations of
votes, and every round sums expected votes and pairs of votes over them. Known labels pin the
class of their rows, softly.

The classifier is a logistic regression on hashed words, votes and densities of hits, trained on
the posterior labels of at most ``sample`` different documents, with or without a label of their own;
lexicons are induced from at most ``sample`` labelled rows of either class. Both samples go by
hash order. All votes, counts and scores cover all documents and whole texts.

Null text counts as empty; every text has a score. Labels that are null or of rows without id
teach nothing; several labels of one id count by their mean, several texts of one id each by
themselves. Without a usable label the fixed voters alone are modelled. An empty table gives no
rows. Of other columns none is read. Scores do not depend on doc_id, language or source.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from math import log, log1p
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postlode.llm.common import bounded_batches, crc_bucket, discard, materialise

LEXICONS = {
    "insult": "idiot idiots moron morons fool fools clown clowns loser losers imbecile dimwit jerk creep liar coward",
    "contempt": "stupid dumb pathetic worthless useless disgusting ridiculous vile filthy despicable shameful",
    "dehumanising": "scum trash garbage vermin parasite parasites filth rat rats pig pigs subhuman",
    "threat": "kill killed die hang burn beat hurt destroy shoot",
    "other languages": "dumm trottel abschaum widerlich depp tonto estupido imbecil basura asqueroso stupide cretin ordure minable",
}
PATTERNS = {
    "address": rb"\b[Yy]ou(?:'re| are)? (?:all )?(?:an?|such|nothing|so)\b",
    "dismissal": rb"\b(?:[Ss]hut up|[Gg]et lost|[Gg]o away|[Ss]hame on)\b",
    "masked": rb"\b[A-Za-z][*@#$%!]{2,}[A-Za-z]*",
    "exclamation": rb"!{3}",
    "drawn out": rb"([A-Za-z])\1{3}",
    "shouting": rb"(?:\b[A-Z]{3,}\b[^A-Za-z]*){4}",
}
_PATTERNS = {name: re.compile(p) for name, p in PATTERNS.items()}
_UPPER, _LETTER, _MARK = (np.isin(np.arange(256), list(x)) for x in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", b"*@#$%!"))
_WORD = {*range(65, 91), *range(97, 123), *range(128, 256)}
#: Letters A-Z in lower case; every byte that no word holds becomes a space.
LOWER = bytes(b + 32 if 65 <= b < 91 else b if b in _WORD else 32 for b in range(256))
#: Lengths in bytes of the beginnings of words that lexicons are induced from.
STARTS = range(3, 11)
PREFIX = b"^"
HASHED = 1 << 13
#: A reader forgets its words beyond so many; a long text is split into words by so many bytes at once.
REMEMBERED, PIECE = 300_000, 1 << 20


def pieces(text: bytes) -> Iterator[list[bytes]]:
    """Lower-cased words of a text, some at a time; no word is cut."""
    text, at = text.translate(LOWER), 0
    while at < len(text):
        cut = text.find(b" ", at + PIECE)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut


def matching(text: bytes) -> list[bool]:
    """Which patterns a text matches; those that need a rare run of bytes are searched for only where there is one."""
    a = np.frombuffer(text, np.uint8)
    up, mark = _UPPER[a], _MARK[a]
    same = a[1:] == a[:-1]
    may = {
        "address": b"ou" in text,
        "masked": bool((mark[1:] & mark[:-1]).any()),
        "exclamation": b"!!!" in text,
        "drawn out": bool((same[2:] & same[1:-1] & same[:-2] & _LETTER[a[3:]]).any()),
        "shouting": bool((up[2:] & up[1:-1] & up[:-2]).any()),
    }
    return [may.get(name, True) and p.search(text) is not None for name, p in _PATTERNS.items()]


def terms(words: set[bytes]) -> set[bytes]:
    """The words and, marked, their proper beginnings."""
    out = set(words)
    for n in STARTS:
        out.update(PREFIX + w[:n] for w in words if len(w) > n)
    return out


@dataclass(frozen=True)
class Voters:
    """All voters; ``of`` names the lexicons that a term belongs to."""

    of: dict[bytes, tuple[int, ...]]
    groups: int

    @property
    def lexicons(self) -> int:
        return len(LEXICONS) + 2 * self.groups

    @property
    def size(self) -> int:
        return 2 * self.lexicons + len(_PATTERNS)

    @classmethod
    def of_terms(cls, induced: list[bytes], groups: int) -> Voters:
        of: dict[bytes, list[int]] = {}
        for k, words in enumerate(LEXICONS.values()):
            for w in words.encode().split():
                of.setdefault(w, []).append(k)
        for first, some in ((0, [t for t in induced if t[:1] != PREFIX]), (groups, [t for t in induced if t[:1] == PREFIX])):
            for i, t in enumerate(some):
                of.setdefault(t, []).append(len(LEXICONS) + first + i % groups)
        return cls({t: tuple(k) for t, k in of.items()}, groups)

    def reader(self) -> Reader:
        return Reader(self)


class Reader:
    """Reads texts for a set of voters, remembering which words hit which lexicons."""

    def __init__(self, voters: Voters):
        self.voters, self.seen, self.hits = voters, set(), {}
        starts = [t[1:] for t in voters.of if t[:1] == PREFIX]
        self.lengths = sorted(set(map(len, starts)))
        self.heads = {t[: STARTS[0]] for t in starts}

    def _learn(self, words: set[bytes]) -> None:
        if len(self.seen) > REMEMBERED:
            self.seen, self.hits = set(), {}
        of = self.voters.of
        heads, head = self.heads, STARTS[0]
        for w in [w for w in words if w[:head] in heads or w in of]:
            found = [*of.get(w, ()), *(k for n in self.lengths if len(w) > n for k in of.get(PREFIX + w[:n], ()))]
            if found:
                self.hits[w] = tuple(dict.fromkeys(found))
        self.seen |= words

    def read(self, text: bytes | None, numbers: bool = True) -> tuple[int, list[float], np.ndarray]:
        """Votes as bits, share of hits of each lexicon, and (if asked for) numbers of the hashed words."""
        text, size = text or b"", 0
        count, hashed = [0] * self.voters.lexicons, np.zeros(HASHED, bool)
        for words in pieces(text):
            size += len(words)
            different = set(words)
            self._learn(different - self.seen)
            if numbers:
                hashed[np.fromiter(map(crc32, {w[:5] for w in different}), np.int64) % HASHED] = True
            hit = different & self.hits.keys()
            if hit:
                for w, n in Counter(w for w in words if w in hit).items():
                    for k in self.hits[w]:
                        count[k] += n
        votes = 0
        for k, n in enumerate(count):
            # one in a hundred words, and more than one, is many
            votes |= (n > 0) << 2 * k | (n > 1 and 100 * n >= size) << 2 * k + 1
        for k, found in enumerate(matching(text)):
            votes |= found << 2 * self.voters.lexicons + k
        return votes, [100 * n / max(1, size) for n in count], np.flatnonzero(hashed).astype(np.uint16)


def induce(texts: DataFrame, most: int = 600, least_texts: int = 3, evidence: float = 20.0, times: float = 5.0) -> list[bytes]:
    """Terms that toxic texts hold far more often: at most ``most``, the most telling first.

    ``texts`` has text (binary) and toxic. A term's evidence is the likelihood ratio of its
    number of toxic texts against the rate in the others.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            every = list(held[0].keys() | held[1].keys())
            columns = [pa.array(every, pa.binary()), *(pa.array([c[t] for t in every], pa.int64()) for c in held)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, names=["term", "clean", "toxic"])

        for b in batches:
            for t, y in zip(b.column(0), b.column(1).to_pylist(), strict=True):
                words = set().union(*map(set, pieces(t.as_py() or b"")))
                held[y].update(terms(words))
                if len(held[0]) + len(held[1]) > 200_000:
                    yield out()
        yield out()

    totals = texts.agg(F.count_if(F.col("toxic") == 0).alias("clean"), F.count_if(F.col("toxic") == 1).alias("toxic")).first()
    if not totals.toxic:
        return []
    summed = texts.select("text", "toxic").mapInArrow(count, "term binary, clean long, toxic long").groupBy("term")
    rate = (F.col("clean") + 0.5) / (totals.clean + 1)
    expected = rate * totals.toxic
    telling = 2 * (F.col("toxic") * F.log(F.col("toxic") / expected) - F.col("toxic") + expected)
    found = summed.agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).filter(F.col("toxic") >= least_texts)
    found = found.withColumns({"telling": telling, "often": F.col("toxic") / expected})
    found = found.filter((F.col("telling") >= evidence) & (F.col("often") >= times))
    return [bytes(r.term) for r in found.orderBy(F.desc("telling"), "term").limit(most).collect()]


@dataclass(frozen=True)
class LabelModel:
    """Prior log odds, log odds of a vote and of silence of each voter, and its share of evidence."""

    prior: float
    vote: np.ndarray
    silence: np.ndarray
    share: np.ndarray

    def posterior(self, bits: np.ndarray, label: np.ndarray, trust: float = 0.98) -> np.ndarray:
        """Probability of the toxic class given votes (a row each) and labels (nan: none)."""
        z = self.prior + bits @ (self.share * (self.vote - self.silence)) + (self.share * self.silence).sum()
        known = ~np.isnan(label)
        z[known] += (2 * label[known] - 1) * log(trust / (1 - trust))
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    @classmethod
    def of_sums(cls, both: np.ndarray, weight: np.ndarray, smooth: float = 1.0) -> LabelModel:
        """From expected pairs of votes (class, voter, voter; a voter's own votes on the diagonal) and class sizes."""
        prior = log((weight[1] + smooth) / (weight[0] + smooth))
        rate = (np.diagonal(both, axis1=1, axis2=2) + smooth / 2) / (weight[:, None] + smooth)
        pairs = both / np.maximum(weight, 1e-9)[:, None, None]
        spread = np.sqrt(np.maximum(rate * (1 - rate), 1e-9))
        tied = (pairs - rate[:, :, None] * rate[:, None, :]) / (spread[:, :, None] * spread[:, None, :])
        tied = np.clip((tied * weight[:, None, None]).sum(axis=0) / max(weight.sum(), 1e-9), 0, 1)
        np.fill_diagonal(tied, 1)
        return cls(prior, np.log(rate[1] / rate[0]), np.log((1 - rate[1]) / (1 - rate[0])), 1 / tied.sum(axis=1))


def _bits(votes: np.ndarray, size: int) -> np.ndarray:
    return (votes[:, None] >> np.arange(size) & 1).astype(np.float64)


def _expected(patterns: DataFrame, size: int, model: LabelModel | None) -> tuple[np.ndarray, np.ndarray]:
    """Expected pairs of votes by class and expected class sizes; without a model by labels alone."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, weight = np.zeros((2, size, size)), np.zeros(2)
        for b in batches:
            bits = _bits(b.column(0).to_numpy(), size)
            label = b.column(1).to_numpy(zero_copy_only=False).astype(np.float64)
            n = b.column(2).to_numpy().astype(np.float64)
            if model is None:
                n, p = np.where(np.isnan(label), 0, n), np.nan_to_num(label)
            else:
                p = model.posterior(bits, label)
            for y, q in enumerate((n * (1 - p), n * p)):
                both[y] += bits.T @ (bits * q[:, None])
                weight[y] += q.sum()
        flat = np.concatenate([both.ravel(), weight])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    out = np.zeros(2 * size * size + 2)
    for r in patterns.mapInArrow(each, "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).collect():
        out[r["at"]] = r.x
    return out[:-2].reshape(2, size, size), out[-2:]


def label_model(patterns: DataFrame, size: int, lexicons: int, rounds: int = 8) -> LabelModel:
    """Expectation maximisation over ``votes, label, n``; the first guess is by labels, or in favour of the lexicons."""
    both, weight = _expected(patterns, size, None)
    if weight.min() >= 1:
        model = LabelModel.of_sums(both, weight)
    else:
        vote = np.where(np.arange(size) < 2 * lexicons, 2.0, 0.0)
        model = LabelModel(-2.0, vote, -0.05 * vote, np.full(size, 0.5))
    for _ in range(rounds):
        model = LabelModel.of_sums(*_expected(patterns, size, model))
    return model


@dataclass(frozen=True)
class Linear:
    """Logistic regression on hashed words (of unit length together) and on dense columns."""

    hashed: np.ndarray
    dense: np.ndarray
    bias: float

    @staticmethod
    def columns(votes: np.ndarray, shares: np.ndarray, size: int) -> np.ndarray:
        return np.concatenate([_bits(votes, size), np.log1p(shares)], axis=1)

    def scores(self, votes: np.ndarray, shares: np.ndarray, hashed: list[np.ndarray], size: int) -> np.ndarray:
        z = self.bias + self.columns(votes, shares, size) @ self.dense
        z += np.array([self.hashed[h].sum() / max(1, len(h)) ** 0.5 for h in hashed])
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    @classmethod
    def fit(cls, dense: np.ndarray, hashed: list[np.ndarray], y: np.ndarray, ridge: float = 3e-4, steps: int = 150, rate: float = 0.1) -> Linear:
        """Soft labels ``y``; full-batch steps of adaptive size (Adam), no randomness."""
        n, width = dense.shape
        w = np.zeros(HASHED + width + 1)
        w[-1] = log((y.sum() + 0.5) / (n - y.sum() + 0.5)) if n else -log1p(20)
        if not n:
            return cls(w[:HASHED], w[HASHED:-1], float(w[-1]))
        size = np.array([len(h) for h in hashed])
        flat, row = np.concatenate(hashed).astype(np.int64), np.repeat(np.arange(n), size)
        unit = (1 / np.sqrt(np.maximum(size, 1)))[row]
        first, second = np.zeros_like(w), np.zeros_like(w)
        for t in range(1, steps + 1):
            z = w[-1] + dense @ w[HASHED:-1] + np.bincount(row, w[flat] * unit, n)
            off = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - y) / n
            g = np.concatenate([np.bincount(flat, off[row] * unit, HASHED), dense.T @ off, [off.sum()]])
            g[:-1] += ridge * w[:-1]
            first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
            w -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-9)
        return cls(w[:HASHED], w[HASHED:-1], float(w[-1]))


@dataclass(frozen=True)
class Model:
    voters: Voters
    labels: LabelModel
    linear: Linear


def learn(docs: DataFrame, labels: DataFrame, usable: Column, sample: int = 10_000, groups: int = 6) -> Model:
    """Voters, label model and classifier; ``usable`` (over ``doc_id``) says whose labels may be learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable)
    known = known.groupBy(F.col("doc_id").alias("l_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    texts = docs.select(F.col("doc_id").alias("l_id"), F.col("text").cast("binary").alias("text"))
    by_hash = [known.filter(F.col("toxic") == y).withColumn("h", F.xxhash64("l_id")).orderBy("h", "l_id").limit(sample) for y in (0, 1)]
    # the limits bound what is broadcast
    chosen = texts.join(F.broadcast(by_hash[0].union(by_hash[1]).select("l_id", "toxic")), "l_id")
    lexicon_texts = materialise(bounded_batches(chosen.select("text", "toxic")), "toxic-texts")
    voters = Voters.of_terms(induce(lexicon_texts), groups)
    discard(lexicon_texts)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = voters.reader()
        for b in batches:
            votes = [reader.read(t.as_py(), numbers=False)[0] for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(votes, pa.int64())], names=["l_id", "votes"])

    # rows without id match nothing; they are spread, or one task would get them all
    spread = F.when(F.col("l_id").isNull(), F.monotonically_increasing_id()).otherwise(0).alias("spread")
    voted = texts.mapInArrow(vote, "l_id long, votes long").select("l_id", "votes", spread)
    voted = voted.join(known.withColumn("spread", F.lit(0).cast("long")), ["l_id", "spread"], "left")
    patterns = materialise(voted.groupBy("votes", F.col("toxic").cast("double").alias("label")).agg(F.count("*").alias("n")), "vote-patterns")
    model = label_model(patterns, voters.size, voters.lexicons)
    discard(patterns)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = voters.reader()
        for b in batches:
            read = [reader.read(t.as_py()) for t in b.column(0)]
            columns = [pa.array([r[0] for r in read], pa.int64()), pa.array([r[1] for r in read], pa.list_(pa.float64()))]
            columns += [pa.array([r[2].tobytes() for r in read], pa.binary()), b.column(1), b.column(2)]
            yield pa.RecordBatch.from_arrays(columns, names=["votes", "shares", "hashed", "h", "label"])

    drawn = texts.select(F.xxhash64("text", "l_id").alias("h"), "l_id").orderBy("h").limit(sample).distinct()
    drawn = drawn.join(known, "l_id", "left").select("h", F.col("toxic").cast("double").alias("label"))
    some = texts.withColumn("h", F.xxhash64("text", "l_id")).join(F.broadcast(drawn.distinct()), "h").select("text", "h", "label")
    read = some.mapInArrow(describe, "votes long, shares array<double>, hashed binary, h long, label double")
    # equal rows have one hash and count once, so at most ``sample`` rows come back
    each = read.groupBy("h").agg(F.min(F.struct("label", "votes", "shares", "hashed")).alias("r"))
    rows = each.orderBy("h").select("r.*").toArrow()
    hashed = [np.frombuffer(h.as_py(), np.uint16) for h in rows["hashed"]]
    votes = rows["votes"].to_numpy().astype(np.int64)
    y = model.posterior(_bits(votes, voters.size), rows["label"].to_numpy().astype(np.float64))
    shares = np.array(rows["shares"].to_pylist(), np.float64).reshape(-1, voters.lexicons)
    return Model(voters, model, Linear.fit(Linear.columns(votes, shares, voters.size), hashed, y))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 3) == 1, F.lit(False))


def score(docs: DataFrame, model: Model, threshold: float = 0.7) -> DataFrame:
    """``doc_id, score, predicted`` (1 at ``threshold`` and above) of every document."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = model.voters.reader()
        for b in batches:
            read = [reader.read(t.as_py()) for t in b.column(1)]
            votes, shares = np.array([r[0] for r in read], np.int64), np.array([r[1] for r in read], np.float64).reshape(len(read), -1)
            s = model.linear.scores(votes, shares, [r[2] for r in read], model.voters.size) if read else np.zeros(0)
            columns = [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "score", "predicted"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return bounded_batches(texts).mapInArrow(each, "doc_id long, score double, predicted int")
