"""Toxicity of texts behind a noisy channel.

Obfuscated spellings (symbols for letters, letters set apart, letters repeated)
are decoded by Viterbi search: a lattice of the letters that each character may
stand for is scored under a character language model, and the best path takes
the place of the span. Then the restored text is scored.

The language model counts character 4-grams of every text given to
``language_model``; over its alphabet of 28 symbols the table has at most 28**4
cells. The classifier is fitted on a bounded sample of labelled texts: a lexicon
of words and word beginnings that are markedly more frequent in toxic texts,
then a logistic regression on how often, how densely and how strongly a text
uses it. Null and empty texts score as a text without words. Rows may repeat.
"""

from __future__ import annotations

import math
import os
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize
from simloom.llm.bytescan import mix, powers, slices, utf8
from simloom.llm.columns import others

#: Symbols of the language model: 0 is the edge of a word, 1-26 are a-z, 27 is any other letter.
SYMBOLS, ORDER = 28, 4
#: Most labelled texts that the classifier is fitted on.
SAMPLE = 8_000
#: Parts that the sample's texts are dealt to.
PIECES = 8

# The letters that a character is written for.
STANDS_FOR = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "*": "aeiou",
}
#: Characters that may stand between letters that were set apart.
BETWEEN = " .-_*|/~"
# Costs of the channel, in nats.
COST_SUBSTITUTE, COST_DROP_SYMBOL, COST_DROP_REPEAT, COST_DROP_BETWEEN, COST_KEEP_REPEAT, COST_PART = 0.7, 6.0, 0.4, 0.2, 0.5, 1.5
#: Longest span whose decoding is remembered, and characters after which what all paths agree on is put out.
REMEMBERED, COMMIT = 64, 32
#: Decodings remembered by a worker; beyond it the memory starts anew.
SPANS = 20_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SYMBOL = np.full(256, 255, np.uint8)  # of the language model
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[128:] = 27
_LETTER = _SYMBOL < 255
_LEET = np.zeros(256, bool)
_LEET[[ord(c) for c in STANDS_FOR]] = True
_APART = np.zeros(256, bool)
_APART[[ord(c) for c in BETWEEN]] = True
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True


def _shift(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by], False beyond the ends."""
    out = np.zeros_like(x)
    if by >= 0:
        out[: max(0, len(x) - by)] = x[by:]
    else:
        out[-by:] = x[:by]
    return out


def suspicious(data: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges of spans that may be obfuscated words, in order, without overlaps.

    A span is a run without white space, or several of them joined where single
    characters are set apart. It counts if in it a symbol stands before a letter,
    a run of symbols ends a word (punctuation may follow), a letter comes twice in
    a row, or at least four single characters are set apart by any number of
    separators. What it reads as is left to the costs of the channel.
    """
    n = len(data)
    if n < 2:
        return []
    low = _LOWER[data]
    letter, leet, apart, space = _LETTER[low], _LEET[low], _APART[low], _SPACE[low]
    mark = leet & _shift(letter, 1)
    mark |= letter & (low < 128) & (low == _shift(low, 1))
    first, last = np.flatnonzero(leet & ~_shift(leet, -1)), np.flatnonzero(leet & ~_shift(leet, 1))
    sure = np.cumsum(leet & (low != 33) & (low != 42))  # exclamation marks and stars alone are punctuation
    ending = _shift(letter, -1)[first] & ~_shift(letter | _DIGIT[low], 1)[last] & (sure[last] > sure[np.maximum(first - 1, 0)])
    mark[first[ending]] = True
    at = np.flatnonzero(space)
    token = np.unique(np.searchsorted(at, np.flatnonzero(mark)))
    edges = np.concatenate([[-1], at, [n]])
    wide = list(zip((edges[token] + 1).tolist(), edges[token + 1].tolist(), strict=True))
    runs = _set_apart(low, letter, leet, apart)
    if not runs:
        return wide
    spans: list[tuple[int, int]] = []
    for a, b in sorted({*wide, *runs}, key=lambda x: (x[0], -x[1])):
        if spans and a < spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans


def _set_apart(low: np.ndarray, letter: np.ndarray, leet: np.ndarray, apart: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of at least four single characters with nothing but separators between them.

    A single character touches no letter, digit, sign that stands for a letter, or
    apostrophe. Signs that are separators too are single beside other separators;
    of several side by side every other one counts.
    """
    solid = letter | _DIGIT[low] | (low == 39) | (leet & ~apart & (low != 33) & (low != 40) & (low != 60))
    single = ((letter & (low < 128)) | leet) & ~_shift(solid, 1) & ~_shift(solid, -1)
    first, last = np.flatnonzero(single & ~_shift(single, -1)), np.flatnonzero(single & ~_shift(single, 1))
    if not len(first):
        return []
    barred = np.cumsum(~(apart | single))
    cuts = np.flatnonzero(barred[first[1:]] != barred[first[:-1]]) + 1
    start, stop = np.insert(cuts, 0, 0), np.append(cuts, len(first))
    many = np.add.reduceat((last - first) // 2 + 1, start) >= 4
    return list(zip(first[start[many]].tolist(), (last[stop[many] - 1] + 1).tolist(), strict=True))


def ngram_counts(data: np.ndarray) -> np.ndarray:
    """Counts of the language model's n-grams over all words of a buffer."""
    s = _SYMBOL[_LOWER[data]]
    s[s == 255] = 0
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] > 0) | (s[:-1] > 0)  # one edge between words
    s = np.concatenate([np.zeros(1, np.uint8), s[keep], np.zeros(1, np.uint8)]).astype(np.int32)
    code = np.zeros(len(s), np.int32)
    for k in range(ORDER):  # the symbols before an edge don't reach over it
        moved = np.zeros_like(s)
        moved[k:] = s[: len(s) - k]
        if k > 1:
            for back in range(1, k):
                moved[k:][s[k - back : len(s) - back] == 0] = 0
        code += moved * SYMBOLS**k
    return np.bincount(code[1:], minlength=SYMBOLS**ORDER)


def language_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Negative log probabilities [28, 28, 28, 28] of a symbol after three others.

    Counts of all texts are added up in each task and then across tasks; at most
    28**4 sums reach the driver.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in slices(offsets, 1 << 20):
                gaps = np.insert(data[offsets[i] : offsets[j]], offsets[i + 1 : j] - offsets[i], 32) if j > i + 1 else data[offsets[i] : offsets[j]]
                total += ngram_counts(gaps)
        at = np.flatnonzero(total)
        for a in range(0, len(at), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(at[a : a + 10_000]), pa.array(total[at[a : a + 10_000]])], names=["gram", "count"])

    sums = docs.select(text).mapInArrow(run, "gram long, count long").groupBy("gram").agg(F.sum("count").alias("count")).toArrow()
    counts = np.zeros(SYMBOLS**ORDER)
    counts[sums["gram"].to_numpy()] = sums["count"].to_numpy()
    return smoothed(counts.reshape((SYMBOLS,) * ORDER))


def smoothed(counts: np.ndarray) -> np.ndarray:
    """Negative log probabilities, each order interpolated with the one below it."""
    lower = np.full(SYMBOLS, 1 / SYMBOLS)
    for order in range(1, ORDER + 1):
        c = counts.sum(axis=tuple(range(ORDER - order)))
        total = c.sum(axis=-1, keepdims=True)
        kinds = (c > 0).sum(axis=-1, keepdims=True)
        lower = (c + np.maximum(kinds, 1) * lower) / (total + np.maximum(kinds, 1))
    return -np.log(lower).astype(np.float32)


class Decoder:
    """Viterbi decoding of spans, with a memory of spans seen."""

    def __init__(self, model: np.ndarray):
        self.cost = array("d", model.reshape(-1).tolist())
        self.memory: dict[str, str] = {}

    def restore(self, span: str) -> str:
        """The likeliest plain spelling of a span."""
        if (known := self.memory.get(span)) is None:
            known = self._viterbi(span.lower())
            if len(self.memory) >= SPANS:
                self.memory.clear()
            if len(span) <= REMEMBERED:
                self.memory[span] = known
        return known

    def _viterbi(self, span: str) -> str:
        head = re.match(r"[^\w@$!|+(<*]*", span).end()
        tail = len(span) - re.match(r"[^\w@$|+]*", span[::-1]).end()
        tail = max(head, tail)
        # state: the last three symbols, on which alone the rest depends; value: cost and letters since the last commitment
        states: dict[int, tuple[float, str]] = {0: (0.0, "")}
        previous, sure = "", []
        for n, c in enumerate(span[head:tail], 1):
            moves: list[tuple[str, float]] = []  # letters put out, cost
            if c.isalpha():
                if c == previous:
                    moves = [("", COST_DROP_REPEAT), (c, COST_KEEP_REPEAT)]
                else:
                    moves = [(c, 0.0)]
            elif c in STANDS_FOR:
                moves = [(x, COST_SUBSTITUTE) for x in STANDS_FOR[c]]
                moves.append(("", COST_DROP_BETWEEN if c in BETWEEN else COST_DROP_REPEAT if c == previous else COST_DROP_SYMBOL))
            elif c in BETWEEN:
                moves = [("", COST_DROP_BETWEEN)]
            else:
                moves = [("", COST_DROP_SYMBOL)]
            reached: dict[int, tuple[float, str]] = {}
            for context, (cost, out) in states.items():
                for x, extra in moves:
                    if x:
                        s = ord(x) - 96 if "a" <= x <= "z" else 27
                        code = context * SYMBOLS + s
                        key, value = code % SYMBOLS**3, (cost + extra + self.cost[code], out + x)
                    else:
                        key, value = context, (cost + extra, out)
                    if key not in reached or value < reached[key]:
                        reached[key] = value
                if c in BETWEEN and context:  # the separator may also part two words
                    key, value = 0, (cost + COST_PART + self.cost[context * SYMBOLS], out + " ")
                    if key not in reached or value < reached[key]:
                        reached[key] = value
            states, previous = reached, c
            if n % COMMIT == 0 and (agreed := os.path.commonprefix([out for _, out in states.values()])):
                sure.append(agreed)
                states = {key: (cost, out[len(agreed) :]) for key, (cost, out) in states.items()}
        done = min((cost + (self.cost[context * SYMBOLS] if context else 0.0), out) for context, (cost, out) in states.items())
        return span[:head] + "".join(sure) + done[1] + span[tail:]


def restored(data: np.ndarray, decoder: Decoder) -> np.ndarray:
    """The bytes of a text with its suspicious spans decoded."""
    spans = suspicious(data)
    if not spans:
        return data
    raw, out, at = data.tobytes(), [], 0
    for a, b in spans:
        out += [raw[at:a], decoder.restore(raw[a:b].decode("utf-8", "replace")).encode()]
        at = b
    out.append(raw[at:])
    return np.frombuffer(b"".join(out), np.uint8)


#: Bytes of the word beginnings that are features, beside the whole word (0).
BEGINNINGS = (4, 5, 6, 7, 8, 10)


def word_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document of each word, and a row of hashes: the whole word, then its beginnings, longest first (0: too short)."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros((1 + len(BEGINNINGS), 0), np.uint64)
    low = _LOWER[data]
    letter = _LETTER[low]
    before, after = _shift(letter, -1), _shift(letter, 1)
    before[offsets[:-1][offsets[:-1] < n]] = False
    last = offsets[1:] - 1
    after[last[last >= 0]] = False
    starts, ends = np.flatnonzero(letter & ~before), np.flatnonzero(letter & ~after) + 1
    up, down = powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    base, size = total[starts], ends - starts
    rows = [mix((total[ends] - base) * down[starts] + np.uint64(1 << 40))]
    for k in sorted(BEGINNINGS, reverse=True):
        h = mix((total[np.minimum(starts + k, n)] - base) * down[starts] + np.uint64(k))
        rows.append(np.where(size >= k, h, np.uint64(0)))
    return np.searchsorted(offsets, starts, "right") - 1, np.stack(rows)


def _restored_slices(batch: pa.RecordBatch, column: int, decoder: Decoder) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, end row, bytes and offsets of slices of a batch with restored texts."""
    data, offsets = utf8(batch.column(column))
    for i, j in slices(offsets):
        base = data[offsets[i] : offsets[j]]
        texts = [base[a:b] for a, b in zip(offsets[i:j] - offsets[i], offsets[i + 1 : j + 1] - offsets[i], strict=True)]
        texts = [restored(t, decoder) for t in texts]
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=at[1:])
        yield i, j, np.concatenate([np.zeros(0, np.uint8), *texts]), at


@dataclass
class Classifier:
    """A lexicon of feature hashes with their log ratios, and the weights of a logistic regression."""

    hashes: np.ndarray
    ratios: np.ndarray
    weights: np.ndarray

    def measures(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """How strongly, how densely and how markedly each text uses the lexicon; and a constant."""
        n = len(offsets) - 1
        doc, rows = word_features(data, offsets)
        weight = np.zeros(len(doc))
        if len(self.hashes):
            table = np.zeros(1 << 16, bool)
            table[(self.hashes >> np.uint64(48)).astype(np.int64)] = True
            for h in rows[::-1]:  # whole words and longer beginnings have the last say
                at = np.flatnonzero(table[(h >> np.uint64(48)).astype(np.int64)])
                k = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
                good = self.hashes[k] == h[at]
                weight[at[good]] = self.ratios[k[good]]
        words = np.bincount(doc, minlength=n)
        total = np.bincount(doc, weight, minlength=n)
        most = np.zeros(n)
        np.maximum.at(most, doc[weight > 0], weight[weight > 0])
        return np.stack([np.log1p(total), np.log((total + 0.2) / (words + 40)), most, np.ones(n)], axis=1)

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Probability that each text is toxic."""
        return 1 / (1 + np.exp(-np.clip(self.measures(data, offsets) @ self.weights, -500, 500)))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Weights of a logistic regression by damped Newton steps; the last column is the constant."""
    mean, scale = x[:, :-1].mean(axis=0), x[:, :-1].std(axis=0) + 1e-9
    z = np.concatenate([(x[:, :-1] - mean) / scale, x[:, -1:]], axis=1)
    w = np.zeros(z.shape[1])
    penalty = np.diag([ridge] * (len(w) - 1) + [1e-6])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    out = w.copy()
    out[:-1] /= scale
    out[-1] -= (out[:-1] * mean).sum()
    return out


def fit(docs: DataFrame, labels: DataFrame, model: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE) -> Classifier:
    """Fit the classifier on at most ``sample`` labelled texts.

    The lexicon takes every word and word beginning of the sample that is marked: in at
    least four toxic texts, and e**1.5 times as frequent as in the others, by four
    standard deviations.

    The sample takes the keys of least hash, a quarter of which is kept for the
    regression and the rest for the lexicon. The keys of the sample, of a bound
    number, are broadcast, so the texts are not shuffled by key: one pass over the
    documents, in as many tasks as they have, writes those of the sample to a table
    of ``PIECES`` parts. A key with several labels counts as toxic if any of them says so.
    """
    spark = docs.sparkSession
    chosen = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    chosen = chosen.withColumn("_order", F.xxhash64("_key")).orderBy("_order", "_key").limit(sample).select("_key", "_label", (F.pmod("_order", F.lit(4)) == 0).alias("_late"))
    rows = spark.createDataFrame(chosen.toArrow(), chosen.schema)
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text")).join(F.broadcast(rows), "_key").select("_text", "_label", "_late")
    texts = materialize(texts.repartition(PIECES), "sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder, found = Decoder(model), {0: [], 1: []}
        words = {0: 0, 1: 0}
        for batch in batches:
            label = batch.column(1).to_numpy()
            for i, j, data, offsets in _restored_slices(batch, 0, decoder):
                doc, feats = word_features(data, offsets)
                for y in (0, 1):
                    at = (label[i:j] > 0)[doc] == bool(y)
                    words[y] += int(at.sum())
                    h = feats[:, at].ravel()
                    d = np.tile(doc[at], len(feats))
                    h, d = h[h != 0], d[h != 0]
                    order = np.lexsort((d, h))
                    h, d = h[order], d[order]
                    new = np.append(True, h[1:] != h[:-1])[: len(h)]
                    once = new | np.append(True, d[1:] != d[:-1])[: len(h)]
                    at = np.flatnonzero(new)
                    if len(at):
                        found[y].append((h[at], np.diff(np.append(at, len(h))), np.add.reduceat(once.astype(np.int64), at)))
        for y in (0, 1):
            out = [(np.zeros(1, np.uint64), np.array([words[y]]), np.zeros(1, np.int64))]
            if found[y]:
                h = np.concatenate([x[0] for x in found[y]])
                keys, where = np.unique(h, return_inverse=True)
                out.append((keys, np.bincount(where, np.concatenate([x[1] for x in found[y]])).astype(np.int64), np.bincount(where, np.concatenate([x[2] for x in found[y]])).astype(np.int64)))
            for h, c, d in out:
                for a in range(0, len(h), 20_000):
                    k = slice(a, a + 20_000)
                    zero = np.zeros(len(h[k]), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(h[k].view(np.int64)), *(pa.array(v) for v in ((zero, c[k], zero, d[k]) if y else (c[k], zero, d[k], zero)))], names=["feature", "c0", "c1", "d0", "d1"])

    early = texts.where(~F.col("_late"))
    sums = early.mapInArrow(count, "feature long, c0 long, c1 long, d0 long, d1 long").groupBy("feature").agg(*(F.sum(c).alias(c) for c in ("c0", "c1", "d0", "d1")))
    sums = materialize(sums, "features")
    n0, n1 = (max(1, x or 0) for x in sums.where("feature = 0").agg(F.sum("c0"), F.sum("c1")).first())
    r0 = (F.col("c0") + 0.5) / F.lit(float(n0))
    ratio = F.log((F.col("c1") + 0.5) / F.lit(float(n1))) - F.log(r0)
    marked = (F.col("d1") >= 4) & (ratio >= 1.5) & ((F.col("c1") - n1 * r0) / F.sqrt(n1 * r0 + 1) >= 4)
    lexicon = sums.where((F.col("feature") != 0) & marked).select("feature", ratio.alias("ratio")).toArrow()
    hashes, ratios = lexicon["feature"].to_numpy().view(np.uint64), lexicon["ratio"].to_numpy()
    order = np.argsort(hashes)
    out = Classifier(hashes[order], ratios[order], np.array([0.0, 0.0, 0.0, -10.0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            for i, j, data, offsets in _restored_slices(batch, 0, decoder):
                m = out.measures(data, offsets)
                yield pa.RecordBatch.from_arrays([*(pa.array(m[:, k]) for k in range(3)), batch.column(1).slice(i, j - i).cast(pa.float64())], names=["a", "b", "c", "y"])

    seen = texts.where("_late").mapInArrow(measure, "a double, b double, c double, y double").toArrow()
    x, y = np.stack([seen[c].to_numpy() for c in "abc"] + [np.ones(len(seen))], axis=1), seen["y"].to_numpy()
    if len(y):
        share = (y.sum() + 0.5) / (len(y) + 1)
        out.weights = _logistic(x, y) if 0 < y.sum() < len(y) else np.array([0.0, 0.0, 0.0, math.log(share / (1 - share))])
    return out


def score(docs: DataFrame, model: np.ndarray, classifier: Classifier, text: str = "text", into: str = "score") -> DataFrame:
    """Replace ``text`` by ``into``: the probability that it is toxic, 0 to 1. A column of that name is replaced."""
    kept = others(docs, text, into)
    docs = docs.select(*(F.col(f"`{c}`") for c in [*kept, text]))
    at = len(kept)
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.lit(0.0).alias(into))
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            got = [classifier.scores(data, offsets) for _, _, data, offsets in _restored_slices(batch, at, decoder)]
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(np.concatenate([*got, np.zeros(0)]))], names=names)

    return docs.mapInArrow(run, frame.schema)


def keep_clean(docs: DataFrame, model: np.ndarray, classifier: Classifier, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below ``threshold``, as they are."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            got = [classifier.scores(data, offsets) for _, _, data, offsets in _restored_slices(batch, at, decoder)]
            yield batch.filter(pa.array(np.concatenate([*got, np.zeros(0)]) < threshold))

    return docs.mapInArrow(run, docs.schema)
