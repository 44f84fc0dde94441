"""Language identification of words by a linear-chain conditional random field.

A text is the chain of its words; what stands unspaced over more than ``WIDEST`` characters is cut
into elements of so many, in fitting as in prediction, so that texts without white space are chains
too and no element is of unbounded size. A word's features are its affixes (prefixes and suffixes of
up to four characters), all its inner two- and three-grams, its length class, and its place in a
lexicon of frequent training words; they are hashed into a weight table. Transitions between
labels are learned with the weights, by gradient ascent on the exact log-likelihood, from
sequences that join spans of documents of different languages, so that switches within a
text are part of what is learned. Forward-backward gives each word's label probabilities; a
document's language is the label with the largest sum.

Long chains are exact too: words are scanned in windows whose transfer matrices are
multiplied first, entry and exit vectors then pass from window to window, and the windows of
all documents of a batch are worked through at once.

The model is fitted on the driver to a bounded sample: ``rows`` passages a language at most,
drawn by hash from all passages of ``span`` characters into which the documents of the language
fall, so that every part of every text is as likely to be drawn. Passages of equal texts are
one. Languages are a closed set of at most ``most_languages``; more are an error. Emissions of
distinct words are remembered by workers up to a bound.

Null text and text without letters give ``und`` with score 0; so does everything where no
language could be learned. Rows without language teach nothing. Repeated rows are predicted
alike. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postlode.llm.common import bounded_batches, crc_bucket

UNKNOWN = "und"
SLOTS = 1 << 15
WINDOW = 32
WORDS_KEPT = 200_000
AT_ONCE = 20_000
#: Characters of a chain's element at most.
WIDEST = 40


def elements(text: str) -> list[str]:
    """The text's words, longer ones in pieces of ``WIDEST`` characters."""
    words = text.split()
    if len(max(words, key=len, default="")) <= WIDEST:
        return words
    return [w[i : i + WIDEST] for w in words for i in range(0, len(w), WIDEST)]


def letters(token: str) -> str:
    """The token's letters, lower-cased."""
    token = token.lower()
    return token if token.isalpha() else "".join(filter(str.isalpha, token))


def _slot(free: int, kind: int, *codes: np.ndarray | int) -> np.ndarray:
    """Slots below ``free`` for features of one kind, each given by up to four numbers (mixed as in splitmix64)."""
    h = np.uint64(kind * 0x9E3779B97F4A7C15 % 2**64)
    with np.errstate(over="ignore"):
        for c in codes:
            h = (h ^ np.asarray(c, np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
        h = h ^ (h >> np.uint64(32))
    return (h % np.uint64(free)).astype(np.int64)


def features(words: list[str], lexicon: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Slots of non-empty words' features, and whose each is; the first ``len(lexicon)`` slots are the lexicon's own."""
    free, held = SLOTS - len(lexicon), len(lexicon)
    text = "".join([f"^{w}$" for w in words])
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(n + 2) - n - 2
    every = np.arange(len(words))
    owner = np.repeat(every, n + 2)
    left = np.arange(len(c)) - start[owner]
    slots, owners = [_slot(free, 1, np.minimum(n, 20) // 3)], [every]
    for size in (2, 3):
        at = np.flatnonzero(left < n[owner] + 3 - size)
        slots.append(_slot(free, size, *(c[at + i] for i in range(size))))
        owners.append(owner[at])
    for size in range(1, 5):
        some = np.flatnonzero(n >= size)
        first, last = start[some] + 1, start[some] + n[some]
        slots.append(_slot(free, 10 + size, *(c[first + i] for i in range(size))))
        slots.append(_slot(free, 20 + size, *(c[last - i] for i in range(size))))
        owners += [some, some]
    listed = [(lexicon[w], i) for i, w in enumerate(words) if w in lexicon]
    own = np.array(listed, np.int64).reshape(-1, 2)
    return np.concatenate([own[:, 0], *(held + s for s in slots)]), np.concatenate([own[:, 1], *owners])


@dataclass(frozen=True)
class Field:
    labels: tuple[str, ...]
    lexicon: dict[str, int]
    #: (SLOTS, labels) and (labels, labels).
    weights: np.ndarray
    transitions: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """exp of each word's summed weights, the largest of a word scaled to 1."""
        if not words or not self.labels:
            return np.zeros((len(words), len(self.labels)))
        parts, i = [], 0
        while i < len(words):
            some = words[i : i + AT_ONCE]
            i += len(some)
            flat, owner = features(some, self.lexicon)
            parts.append(np.stack([np.bincount(owner, column[flat], len(some)) for column in self.weights.T], axis=1))
        total = np.concatenate(parts)
        return np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -50))


def _scaled(x: np.ndarray, axis) -> np.ndarray:
    return x / x.max(axis=axis, keepdims=True)


def marginals(e: np.ndarray, lengths: np.ndarray, a: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Label probabilities of each word of chains laid end to end.

    ``e``: (words, labels) emission factors; ``a``: (labels, labels) transition factors. Before
    the first word every label is alike; every length is at least 1.
    """
    k = e.shape[1]
    per = -(-lengths // window)
    doc = np.repeat(np.arange(len(lengths)), per)
    first_window = np.cumsum(np.append(0, per[:-1]))
    nth = np.arange(per.sum()) - first_window[doc]
    begin = np.cumsum(np.append(0, lengths[:-1]))[doc] + nth * window
    size = np.minimum(window, lengths[doc] - nth * window)
    order = np.argsort(-size, kind="stable")
    begin, size = begin[order], size[order]
    active = np.searchsorted(-size, -np.arange(window), "left")  # windows with over t words come first
    at = np.arange(window)[:, None] + begin[None, :]
    # labels first and windows last, so that every step runs along contiguous memory
    x = np.ascontiguousarray(e.T)[:, np.minimum(at, len(e) - 1)]
    place = np.empty(len(order), int)
    place[order] = np.arange(len(order))

    longest = int(per.max())
    enter, leave = np.full((k, len(order)), 1.0 / k), np.ones((k, len(order)))
    if longest > 1:
        move = np.repeat(np.eye(k)[:, :, None], len(order), axis=2)
        for t in range(window):
            n = active[t]
            move[:, :, :n] = _scaled(np.matmul(a.T, move[:, :, :n]) * x[None, :, t, :n], (0, 1))
        by_length = np.argsort(-per, kind="stable")
        more = np.searchsorted(-per[by_length], -np.arange(longest + 1), "left")
        for w in range(longest - 1):
            some = first_window[by_length[: more[w + 1]]] + w
            here = place[some]
            enter[:, place[some + 1]] = _scaled((enter[:, None, here] * move[:, :, here]).sum(axis=0), 0)
        for w in range(longest - 1, 0, -1):
            some = first_window[by_length[: more[w]]] + w
            here = place[some]
            leave[:, place[some - 1]] = _scaled((move[:, :, here] * leave[None, :, here]).sum(axis=1), 0)
    forward = np.empty_like(x)
    v = enter
    for t in range(window):
        n = active[t]
        v = _scaled((a.T @ v[:, :n]) * x[:, t, :n], 0)
        forward[:, t, :n] = v
    out = np.empty((k, len(e)))
    b = leave
    for t in range(window - 1, -1, -1):
        n = active[t]
        both = forward[:, t, :n] * b[:, :n]
        out[:, at[t, :n]] = both / both.sum(axis=0)
        b[:, :n] = _scaled(a @ (x[:, t, :n] * b[:, :n]), 0)
    return out.T


def _pair_sums(e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For sequences of one length (n, t, labels): word marginals, and expected transition counts."""
    n, t, k = e.shape
    f, b = np.empty_like(e), np.empty_like(e)
    v = np.full((n, k), 1.0 / k)
    for i in range(t):
        f[:, i] = v = _scaled(v @ a * e[:, i], 1)
    v = np.ones((n, k))
    for i in range(t - 1, -1, -1):
        b[:, i] = v
        v = _scaled((e[:, i] * v) @ a.T, 1)
    word = f * b
    word /= word.sum(axis=2, keepdims=True)
    before = np.concatenate([np.full((n, 1, k), 1.0 / k), f[:, :-1]], axis=1)
    pair = before[:, :, :, None] * a[None, None] * (e * b)[:, :, None, :]
    pair /= pair.sum(axis=(2, 3), keepdims=True)
    return word, pair.sum(axis=(0, 1))


def fit(spans: list[tuple[str, list[str]]], steps: int = 300, batch: int = 96, length: int = 24, rate: float = 0.08, lexicon_words: int = 1_000, seed: int = 5) -> Field:
    """A field from (language, words) spans of one language each."""
    spans = [(lang, w) for lang, words in spans if (w := [x for x in map(letters, words) if x])]
    labels = tuple(sorted({lang for lang, _ in spans}))
    if not labels:
        return Field((), {}, np.zeros((SLOTS, 0), np.float32), np.zeros((0, 0)))
    counts = {lang: Counter() for lang in labels}
    for lang, words in spans:
        counts[lang].update(words)
    frequent = sorted({w for c in counts.values() for w, n in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words] if n > 2})
    lexicon = {w: i for i, w in enumerate(frequent)}
    distinct = sorted({w for _, words in spans for w in words})
    number = {w: i for i, w in enumerate(distinct)}
    flat, owner = features(distinct, lexicon)
    flat = flat[np.argsort(owner, kind="stable")]
    sizes = np.bincount(owner, minlength=len(distinct))
    starts = np.cumsum(np.append(0, sizes[:-1]))
    coded = [(labels.index(lang), np.array([number[w] for w in words])) for lang, words in spans]
    by_label = [[w for k, w in coded if k == label] for label in range(len(labels))]
    k, rng = len(labels), np.random.default_rng(seed)
    w, a = np.zeros((SLOTS, k)), np.zeros((k, k))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(a), np.zeros_like(a)]
    for step in range(1, steps + 1):
        ids, gold = np.empty((batch, length), int), np.empty((batch, length), int)
        for i in range(batch):
            at = 0
            while at < length:
                label = int(rng.integers(k))
                words = by_label[label][int(rng.integers(len(by_label[label])))]
                take = min(length - at, len(words), int(rng.integers(4, 2 * length)))
                first = int(rng.integers(len(words) - take + 1))
                ids[i, at : at + take], gold[i, at : at + take] = words[first : first + take], label
                at += take
        used, which = np.unique(ids, return_inverse=True)
        which = which.reshape(ids.shape)
        span = [flat[starts[u] : starts[u] + sizes[u]] for u in used]
        own, owner = np.concatenate(span), np.repeat(np.arange(len(used)), sizes[used])
        total = np.stack([np.bincount(owner, w[own, j], len(used)) for j in range(k)], axis=1)
        e = np.exp(np.maximum(total - total.max(axis=1, keepdims=True), -50))[which]
        word, pairs = _pair_sums(e, np.exp(a))
        error = -word
        error[np.arange(batch)[:, None], np.arange(length)[None, :], gold] += 1
        by_word = np.stack([np.bincount(which.ravel(), error[:, :, j].ravel(), len(used)) for j in range(k)], axis=1)
        gw = np.stack([np.bincount(own, by_word[owner, j], SLOTS) for j in range(k)], axis=1) / batch - 1e-4 * w
        seen = np.zeros((k, k))
        np.add.at(seen, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        seen += np.bincount(gold[:, 0], minlength=k)[None, :] / k  # the label before the first word is any
        ga = (seen - pairs) / batch - 1e-4 * a
        for x, g, m, v in ((w, gw, state[0], state[1]), (a, ga, state[2], state[3])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(labels, lexicon, w.astype(np.float32), a)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(crc_bucket(doc_id, 3) == 1, F.lit(False))


def _whole_words(passage: str, first: bool, last: bool) -> list[str]:
    """A passage's elements without the words that its edges cut; of longer unspaced runs the parts that lie in it stay."""
    words = passage.split()
    if not first and words and not passage[0].isspace() and len(words[0]) <= WIDEST:
        words = words[1:]
    if not last and words and not passage[-1].isspace() and len(words[-1]) <= WIDEST:
        words = words[:-1]
    return elements(" ".join(words))


def learn(docs: DataFrame, usable: Column, rows: int = 600, span: int = 2_000, most_languages: int = 200, **options) -> Field:
    """A field from at most ``rows`` passages a language of usable documents; ``usable`` is over ``doc_id``."""
    spark = docs.sparkSession
    known = docs.filter(usable & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    parts = F.greatest(F.ceil(F.length("text") / span), F.lit(1)).cast("int")
    one, places = F.array(F.xxhash64(F.lit(3), "text")), F.sequence(F.lit(0), parts - 1)  # hashed once a text, not once a passage
    hashes = F.flatten(F.transform(one, lambda t: F.transform(places, lambda p: F.xxhash64(t, p))))
    counts = known.select("lang", F.explode(hashes).alias("h")).groupBy("lang").agg(F.approx_count_distinct("h").alias("n"))
    counts = counts.limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"over {most_languages} languages")
    if not counts:
        return fit([])
    # twice what is wanted of the different passages passes by hash; the exact number follows by rank
    share = spark.createDataFrame([(r.lang, min(1.0, (2 * rows + 20) / max(1, r.n))) for r in counts], "lang string, share double")
    near = lambda t: lambda p: F.pmod(F.xxhash64(t, p), F.lit(1 << 20)) < F.col("share") * (1 << 20)
    drawn = F.flatten(F.transform(one, lambda t: F.transform(F.filter(places, near(t)), lambda p: F.struct(p.alias("part"), F.xxhash64(t, p).alias("h")))))
    each = known.join(F.broadcast(share), "lang").select("lang", "text", parts.alias("parts"), F.explode(drawn).alias("d"))
    passage = F.substr("text", F.col("d.part") * span + 1, F.lit(span))
    got = each.select("lang", "d.h", "d.part", passage.alias("passage"), (F.col("d.part") == F.col("parts") - 1).alias("last"))
    ranked = got.dropDuplicates(["lang", "h"]).withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("h")))
    taken = ranked.filter(F.col("n") <= rows).collect()
    taken.sort(key=lambda r: (r.lang, r.h))
    return fit([(r.lang, _whole_words(r.passage, r.part == 0, r["last"])) for r in taken if r.passage], **options)


def predict(docs: DataFrame, field: Field, at_once: int = 300_000) -> DataFrame:
    """``doc_id, lang_pred, score``: the language of every text and its share of the words' probability."""
    k, a = len(field.labels), np.exp(field.transitions)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        table = np.zeros((0, k))

        def flush(ids: list, texts: list[list[str]]) -> pa.RecordBatch:
            nonlocal table
            if len(number) > WORDS_KEPT:
                number.clear()
                table = np.zeros((0, k))
            new, order = [], {}
            for words in texts:
                for x in set(words).difference(number):
                    clean = letters(x)
                    if not clean:
                        number[x] = -1
                        continue
                    if clean not in order:
                        order[clean] = len(table) + len(new)
                        new.append(clean)
                    number[x] = order[clean]
            if new:
                table = np.concatenate([table, field.emissions(new)])
            rows = [np.fromiter(map(number.__getitem__, words), np.int64, len(words)) for words in texts]
            rows = [r[r >= 0] for r in rows]
            lengths = np.array([len(r) for r in rows])
            some = np.flatnonzero(lengths)
            lang, score = np.full(len(rows), UNKNOWN, dtype=object), np.zeros(len(rows))
            if len(some) and k:
                p = marginals(table[np.concatenate([rows[i] for i in some])], lengths[some], a)
                total = np.add.reduceat(p, np.cumsum(np.append(0, lengths[some][:-1])), axis=0)
                best = total.argmax(axis=1)
                lang[some] = np.array(field.labels, dtype=object)[best]
                score[some] = np.minimum(total[np.arange(len(some)), best] / lengths[some], 1.0)
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

        ids, texts, n = [], [], 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids.append(i)
                texts.append(elements(text.as_py() or ""))
                n += len(texts[-1])
                if n >= at_once:
                    yield flush(ids, texts)
                    ids, texts, n = [], [], 0
        if ids:
            yield flush(ids, texts)

    return bounded_batches(docs.select("doc_id", "text")).mapInArrow(each, "doc_id long, lang_pred string, score double")
