"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent n-grams of a language, or of a
document, most frequent first. A document gets the language whose profile has
the least out-of-place distance: the sum over the document's n-grams of how far
their rank lies from the rank in the language's profile, or ``top`` where the
profile lacks them.

Words are lower-cased runs of letters between two blanks; n-grams cross no word.
Equal counts rank by a fixed hash of the n-gram, equal distances by the name of
the language. A null text, or one without letters, is ``und`` with score 0; so
is every text when nothing was learned. Rows may repeat.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.llm.bytescan import mix, slices, utf8
from simloom.llm.columns import others

#: Length of the longest n-gram and of a profile.
LONGEST, TOP = 3, 400
#: Most languages that a set of profiles may have; profiles are sent to every worker.
MAX_LANGUAGES = 5_000
UNKNOWN = "und"

_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str], longest: int = LONGEST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, 48-bit hash and count of each distinct n-gram, in order of document and hash.

    At most 65,535 texts.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer((" ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(low)), [len(t) + 1 for t in low])
    blank = ~_letters()[codes]
    keep = ~blank
    keep[1:] |= keep[:-1] & blank[1:]  # one blank after each word
    codes, doc, blank = codes[keep].astype(np.uint64), doc[keep].astype(np.uint64), blank[keep]
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes[blank] = 0
    found = []
    first = np.ones(n, bool)
    first[1:] = blank[:-1]
    rolled, valid = codes.copy(), ~blank  # n-grams starting inside a word, ending at its trailing blank at most
    lead = first & ~blank  # the first letter of a word, which has a blank before it
    prior, prior_valid = rolled, valid
    for k in range(1, longest + 1):
        if k > 1:
            ahead = np.zeros(n, np.uint64)
            ahead[: n - k + 1] = codes[k - 1 :]
            inside = np.zeros(n, bool)
            inside[: n - k + 1] = ~blank[k - 2 : n - 1]
            valid = valid & inside
            rolled = rolled * np.uint64(0x100000001B3) + ahead + np.uint64(k)
            # blank + the first k - 1 characters of a word
            at = lead & prior_valid
            found.append((doc[at] << np.uint64(48)) | (mix(prior[at] ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(16)))
        found.append((doc[valid] << np.uint64(48)) | (mix(rolled[valid]) >> np.uint64(16)))
        prior, prior_valid = rolled, valid
    keys = np.concatenate(found)
    keys.sort()
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.flatnonzero(new)
    counts = np.diff(np.append(at, len(keys)))
    keys = keys[at]
    return (keys >> np.uint64(48)).astype(np.int64), keys & np.uint64((1 << 48) - 1), counts


def ranks(doc: np.ndarray, counts: np.ndarray, top: int = TOP) -> tuple[np.ndarray, np.ndarray]:
    """Index and rank (from 0) of the ``top`` most frequent n-grams of each document."""
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    most = np.int64((1 << 20) - 1)
    starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
    sizes = np.diff(np.append(starts, len(doc)))
    begin = np.repeat(starts, sizes)
    rank = np.arange(len(doc)) - begin
    if counts.max() <= most and sizes.max() < 1 << 28 and doc[-1] < 1 << 16:  # document, count and place fit one number, which sorts faster
        key = (doc.astype(np.uint64) << np.uint64(48)) | ((most - counts).astype(np.uint64) << np.uint64(28)) | rank.astype(np.uint64)
        key.sort()
        index = (key & np.uint64((1 << 28) - 1)).astype(np.int64) + begin
    else:
        index = np.lexsort((-counts, doc))
    at = rank < top
    return index[at], rank[at]


def _texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, list]]:
    """First row and texts of pieces of a batch, small enough for ``grams``."""
    _, offsets = utf8(batch.column(column))
    for i, j in slices(offsets):
        for a in range(i, j, 50_000):
            b = min(j, a + 50_000)
            yield a, batch.column(column).slice(a, b - a).to_pylist()


def profiles(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Profiles (lang, gram long, rank int from 0) of the languages of ``docs``.

    Rows with a null text or language are left out. Each task adds up its own
    counts before they are shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gathered: dict[str, list] = {}

        def settle(name: str) -> None:
            keys, counts = (np.concatenate(x) for x in zip(*gathered[name], strict=True))
            keys, where = np.unique(keys, return_inverse=True)
            gathered[name] = [(keys, np.bincount(where, counts).astype(np.int64))]

        for batch in batches:
            for first, texts in _texts(batch, 0):
                names = np.array(batch.column(1).slice(first, len(texts)).to_pylist(), object)
                doc, gram, count = grams(texts, longest)
                for name in sorted(set(names)):
                    at = (names == name)[doc]
                    gathered.setdefault(name, []).append((gram[at], count[at]))
                    if len(gathered[name]) >= 8:
                        settle(name)
        for name in gathered:
            settle(name)
            keys, counts = gathered[name][0]
            for a in range(0, len(keys), 10_000):
                b = min(len(keys), a + 10_000)
                yield pa.RecordBatch.from_arrays([pa.array([name] * (b - a)), pa.array(keys[a:b].astype(np.int64)), pa.array(counts[a:b])], names=["lang", "gram", "count"])

    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    counts = known.mapInArrow(run, "lang string, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    order = Window.partitionBy("lang").orderBy(F.desc("count"), "gram")
    return counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


class Profiles:
    """Profiles as a table of ranks, one column for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.top = top
        self.langs = sorted({lang for lang, _, _ in rows})
        if len(self.langs) > MAX_LANGUAGES:
            raise ValueError(f"{len(self.langs)} languages; at most {MAX_LANGUAGES} profiles can be sent to the workers")
        self.grams = np.unique(np.array([gram for _, gram, _ in rows], np.uint64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        column = {lang: k for k, lang in enumerate(self.langs)}
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.uint64(gram)), column[lang]] = rank

    def nearest(self, texts: list[str | None], longest: int = LONGEST) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is 1 less the share of the greatest distance."""
        names, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
        if not self.langs:
            return names.tolist(), score
        doc, gram, count = grams([t or "" for t in texts], longest)
        index, rank = ranks(doc, count, self.top)
        doc, gram = doc[index], gram[index]
        if not len(doc):
            return names.tolist(), score
        at = np.minimum(np.searchsorted(self.grams, gram), len(self.grams) - 1)
        at = np.where(self.grams[at] == gram, at, len(self.grams))
        there = self.ranks[at]
        off = np.where(there < 0, self.top, np.abs(there - rank[:, None]))
        starts = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        total = np.add.reduceat(off, starts, axis=0)
        best = total.argmin(axis=1)
        sizes = np.diff(np.append(starts, len(doc)))
        score[doc[starts]] = 1 - total[np.arange(len(starts)), best] / (sizes * self.top)
        names[doc[starts]] = np.array(self.langs, object)[best]
        return names.tolist(), score


def identify(docs: DataFrame, learned: DataFrame, text: str = "text", top: int = TOP, longest: int = LONGEST) -> DataFrame:
    """Replace ``text`` by lang_pred and score; ``learned`` are profiles(). Columns that have these names are replaced.

    Profiles are collected: at most MAX_LANGUAGES times ``top`` rows.
    """
    table = Profiles([tuple(r) for r in learned.limit(MAX_LANGUAGES * top + 1).collect()], top)
    kept = others(docs, text, "lang_pred", "score")
    docs = docs.select(*(F.col(f"`{c}`") for c in [*kept, text]))
    at = len(kept)
    frame = docs.select(*(F.col(f"`{c}`") for c in kept), F.lit("").alias("lang_pred"), F.lit(0.0).alias("score"))
    names = frame.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, score = [], []
            for _, texts in _texts(batch, at):
                got = table.nearest(texts, longest)
                lang += got[0]
                score.append(got[1])
            rest = [c for k, c in enumerate(batch.columns) if k != at]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(lang, pa.string()), pa.array(np.concatenate([*score, np.zeros(0)]))], names=names)

    return docs.mapInArrow(run, frame.schema)


def remainder(key: str, divisor: int) -> Column:
    """crc32 of a column as text, modulo ``divisor``; null for null."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % divisor
