"""Near-duplicate documents by ProbMinHash.

Similarity is the probability Jaccard of the counted shingles of five words
(lower-cased A-Z; runs of digits, a-z and characters beyond ASCII):

    J(p, q) = sum over shared x of 1 / sum over y of max(p(y) / p(x), q(y) / q(x)),

which is the plain Jaccard where no shingle repeats. A text of fewer words is
one shingle; a text without words is like no other.

1. A shingle of weight w is a Poisson process of rate w; each arrival falls on a
   random register, which keeps the first shingle to arrive. A process ends once
   its next arrival comes after the last register was filled. Registers of two
   texts agree with probability J.
2. Texts of equal word sequences are one row, so copies are never compared.
3. Registers are cut into bands; rows that agree on a band meet in a bucket.
   Each member is paired with the least member of its bucket, and the pair is
   verified exactly on the texts. Members are never all paired within a bucket; the
   partners of a row are dealt to chunks, which are read as streams.
4. Where that leaves a set of rows that buckets connect in more than one class, rows of
   different classes are compared in blocks, by registers and then exactly, so that no link
   between two different texts that share a bucket is lost.
5. Classes are the connected components of the verified links.

At the similarity sought, 32 bands of 5 registers miss a pair with a probability of 3e-6.
Rows are numbered when they are signed, so rows that share a key but not the text are told
apart. A null text has no words. Repeated rows share a class. Rows without a key are alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize, release
from simloom.llm.bytescan import mix, slices, utf8, words
from simloom.operators.components import connected_components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 32, 5
REGISTERS = BANDS * ROWS
#: Rows compared with each other at once, and the distance below the similarity at
#: which an estimate from the registers rules a pair out: over four standard deviations.
BLOCK, MARGIN = 512, 0.14
#: Words of the rows of a block, and partners of a row that one task compares with it.
BLOCK_WORDS, CHUNK = 1 << 20, 256


def shingles(data: np.ndarray, offsets: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, hash and count of the different shingles, in order of document and hash."""
    hashed, doc, _ = words(data, offsets)
    n = len(hashed)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    first = np.append(True, doc[1:] != doc[:-1])
    starts = np.flatnonzero(first)
    lengths = np.diff(np.append(starts, n))
    rest = np.repeat(lengths, lengths) - (np.arange(n) - np.repeat(starts, lengths))  # words from here to the end
    whole = rest >= size
    whole |= first & (np.repeat(lengths, lengths) < size)
    total = np.zeros(n, np.uint64)
    for k in range(size):
        ahead = np.zeros(n, np.uint64)
        ahead[: n - k] = hashed[k:]
        ahead[rest <= k] = 0
        total += mix(ahead + np.uint64(k + 1)) * np.uint64(2 * k + 3)
    h, d = mix(total[whole]), doc[whole]
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    return d[at], h[at], np.diff(np.append(at, len(h)))


def _uniform(seed: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1] of 64-bit seeds."""
    return ((mix(seed) >> np.uint64(11)) + np.uint64(1)).astype(np.float64) * 2.0**-53


def registers(n: int, doc: np.ndarray, item: np.ndarray, weight: np.ndarray, size: int = REGISTERS) -> np.ndarray:
    """Registers [n, size] of weighted sets: 32-bit marks of the first arrivals; 0 for an empty set.

    All processes advance together, one arrival a round; those that can no
    longer come first anywhere in their set end.
    """
    least = np.full((n, size), np.inf)
    mark = np.zeros((n, size), np.uint64)
    flat_least, flat_mark = least.reshape(-1), mark.reshape(-1)
    live_doc, live_item, live_weight = doc, item, weight.astype(np.float64)
    time = np.zeros(len(doc))
    step = 0
    while len(live_item):
        step += 1
        seed = live_item + np.uint64(step * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        time = time - np.log(_uniform(seed)) / live_weight
        bound = least.max(axis=1)
        go = time < bound[live_doc]
        live_doc, live_item, live_weight, time, seed = live_doc[go], live_item[go], live_weight[go], time[go], seed[go]
        if not len(live_item):
            break
        cell = live_doc * size + (mix(seed ^ np.uint64(0xD6E8FEB86659FD93)) % np.uint64(size)).astype(np.int64)
        order = np.lexsort((live_item, time, cell))
        first = order[np.append(True, cell[order][1:] != cell[order][:-1])]
        first = first[time[first] < flat_least[cell[first]]]
        flat_least[cell[first]] = time[first]
        flat_mark[cell[first]] = live_item[first]
    return (mark >> np.uint64(32)).astype(np.uint32)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two sets (sorted hashes, counts)."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    p, q = a[1] / a[1].sum(), b[1] / b[1].sum()
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    if a[1].max() == 1 and b[1].max() == 1:
        return len(i) / (len(p) + len(q) - len(i))
    # sum over y of max(p(y)/p(x), q(y)/q(x)) depends on x by r = q(x)/p(x) only: p(x) * it = sum of max(p, q / r)
    ps, qs = p[i], q[j]
    ratio = qs / ps
    order = np.argsort(ratio, kind="stable")
    ps, qs, ratio = ps[order], qs[order], ratio[order]
    up_q = np.append(np.cumsum(qs[::-1])[::-1], 0.0)  # y with a ratio of at least this take q / r
    low_p = np.append(0.0, np.cumsum(ps))
    at = np.searchsorted(ratio, ratio, "left")
    only_p, only_q = max(0.0, 1 - ps.sum()), max(0.0, 1 - qs.sum())
    inner = only_p + low_p[at] + (only_q + up_q[at]) / ratio
    return float((ps / inner).sum())


# --- Spark ----------------------------------------------------------------------------------------------------


def _digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Number of words of each text, and two hashes of its word sequence."""
    n = len(offsets) - 1
    hashed, doc, _ = words(data, offsets)
    count = np.bincount(doc, minlength=n)
    place = np.arange(len(hashed)) - np.repeat(np.cumsum(count) - count, count)
    same = [np.zeros(n, np.uint64), np.zeros(n, np.uint64)]
    for k, x in enumerate(same):
        np.add.at(x, doc, mix(hashed + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 + 2 * k)))
    return count, same


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest, text) come in; key, digest, number of words, hashes of the words and registers go out."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        for i, j in slices(offsets):
            for a in range(i, j, 2_000):
                b = min(j, a + 2_000)
                part, at = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                count, same = _digests(part, at)
                marks = registers(b - a, *shingles(part, at))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in (0, 1)), pa.array(count.astype(np.int64)), pa.array(same[0].view(np.int64)), pa.array(same[1].view(np.int64)), pa.array([m.tobytes() for m in marks], pa.binary())],
                    names=["key", "digest", "words", "s1", "s2", "marks"],
                )


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, marks) come in; a row and a bucket for each band go out."""
    for batch in batches:
        for start in range(0, batch.num_rows, 2_000):
            part = batch.slice(start, 2_000)
            marks = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, BANDS, ROWS).astype(np.uint64)
            bucket = np.broadcast_to(np.arange(BANDS, dtype=np.uint64) + np.uint64(77), marks.shape[:2]).copy()
            for k in range(ROWS):
                bucket = mix(bucket * np.uint64(0x100000001B3) + marks[:, :, k])
            row = np.repeat(part.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(bucket.reshape(-1).view(np.int64))], names=["row", "bucket"])


def _sets(array: pa.Array) -> Iterator[tuple[np.ndarray, tuple[np.ndarray, np.ndarray]]]:
    """First hash of the words, and hashes and counts of the shingles, of each text."""
    data, offsets = utf8(array)
    for i, j in slices(offsets):
        part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        s1 = _digests(part, at)[1][0].view(np.int64)
        doc, item, count = shingles(part, at)
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for k in range(j - i):
            yield s1[k], (item[cut[k] : cut[k + 1]], count[cut[k] : cut[k + 1]])


def _verify(similarity: float):
    """Rows (a, chunk, b, text) come in, of each a and chunk first a's own, whose b is a; similar pairs go out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, None
        for batch in batches:
            out: tuple[list[int], list[int]] = ([], [])
            a, chunk, b = (batch.column(k).to_pylist() for k in range(3))
            for x, c, y, (_, found) in zip(a, chunk, b, _sets(batch.column(3)), strict=True):
                if x == y:
                    at, own = (x, c), found
                elif at == (x, c) and probability_jaccard(own, found) >= similarity:
                    out[0].append(x)
                    out[1].append(y)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])

    return run


def _own_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, s1, text, a, chunk) come in; those whose text has the hash s1 go out, without it."""
    for batch in batches:
        data, offsets = utf8(batch.column(2))
        fits = [np.zeros(0, bool)]
        for i, j in slices(offsets):
            s1 = _digests(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1][0].view(np.int64)
            fits.append(s1 == batch.column(1).slice(i, j - i).to_numpy())
        yield batch.select([0, 2, 3, 4]).filter(pa.array(np.concatenate(fits)))


def _compare_blocks(similarity: float, margin: float):
    """A pair of blocks of rows comes in; pairs of classes that a link joins go out."""

    def run(keys: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        row, cls, block = (table[c].to_numpy() for c in ("row", "class", "block"))
        marks = np.frombuffer(b"".join(table["marks"].to_pylist()), np.uint32).reshape(len(row), -1)
        sets = [found for _, found in _sets(table["text"].combine_chunks())]
        root = {c: c for c in set(cls.tolist())}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        out: list[tuple[int, int]] = []
        low, high = keys[2].as_py(), keys[3].as_py()
        left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
        for i in left.tolist():
            agree = (marks[right] == marks[i]).mean(axis=1)
            near = right[(agree >= similarity - margin) & (cls[right] != cls[i])]
            if low == high:
                near = near[near > i]
            for j in near[np.argsort(-agree[np.searchsorted(right, near)], kind="stable")].tolist():
                x, y = find(int(cls[i])), find(int(cls[j]))
                if x != y and probability_jaccard(sets[i], sets[j]) >= similarity:
                    root[max(x, y)] = min(x, y)
                    out.append((int(cls[i]), int(cls[j])))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return run


def _classed(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """Signed rows (key, digest, words, id, row) and the classes (row, class_row) of those that are linked; ``row`` is the least id of the copies."""
    pairs = docs.select(F.col(key).cast("long").alias("key"), _digest(text).alias("digest"), F.col(text).alias("text"))
    signed = pairs.mapInArrow(_sign, "key long, digest binary, words long, s1 long, s2 long, marks binary").withColumn("id", F.monotonically_increasing_id())
    signed = materialize(signed, "signed")
    known = signed.where("key is not null and words > 0")
    # as a table of its own, so that the join with it can split a hot text
    same = materialize(known.groupBy("s1", "s2", "words").agg(F.min("id").alias("row"), F.count("*").alias("n")), "same")
    several = same.where("n > 1").select("s1", "s2", "words", "row")
    copies = known.select("key", "digest", "words", "id", "s1", "s2").join(several, ["s1", "s2", "words"], "left").select("key", "digest", "words", "id", F.coalesce("row", "id").alias("row"))
    copies = copies.unionByName(signed.where("key is null or words = 0").select("key", "digest", "words", "id", F.col("id").alias("row")))
    copies = materialize(copies, "copies")

    met = signed.select("id", "marks").join(same.select(F.col("row").alias("id")), "id", "left_semi").mapInArrow(_bands, "row long, bucket long")
    full = met.groupBy("bucket").agg(F.min("row").alias("a"), F.max("row").alias("last")).where("a < last").select("bucket", "a")
    stars = materialize(met.join(full, "bucket").where("row > a").select("a", F.col("row").alias("b")).distinct(), "stars")

    chunks = materialize(stars.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("chunks")), "chunks")
    dealt = stars.join(chunks, "a").select("a", F.pmod(F.xxhash64("b"), F.col("chunks")).alias("chunk"), F.col("b").alias("id"))
    dealt = dealt.unionByName(chunks.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), F.col("a").alias("id")))
    named = dealt.join(signed.select("id", "key", "s1"), "id").select("id", "s1", "key", "a", "chunk")
    held = named.join(pairs.select("key", "text"), "key").select(F.col("id").alias("row"), "s1", "text", "a", "chunk")
    held = materialize(held.mapInArrow(_own_texts, "row long, text string, a long, chunk long"), "star-texts")
    ordered = held.select("a", "chunk", "row", "text").repartition("a", "chunk").sortWithinPartitions("a", "chunk", "row")  # a is less than each b
    links = materialize(ordered.mapInArrow(_verify(similarity), "a long, b long").distinct(), "links")

    wide = connected_components(stars).select(F.col("node").alias("row"), F.col("component").alias("wide"))
    narrow = materialize(connected_components(links).select(F.col("node").alias("row"), F.col("component").alias("class")), "narrow")
    split = wide.join(narrow, "row", "left").withColumn("class", F.coalesce("class", "row"))
    split = materialize(split.join(copies.where("id = row").select("row", "words"), "row"), "split")
    least = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("words") / BLOCK_WORDS))
    open_sets = split.groupBy("wide").agg(F.min("class").alias("x"), F.max("class").alias("y"), F.count("*").alias("n"), least.alias("blocks")).where("x < y and n > 2").select("wide", "blocks")
    blocked = materialize(split.join(open_sets, "wide").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks"))), "blocked")
    if blocked.isEmpty():
        linked = narrow.withColumnRenamed("class", "class_row")
    else:
        ours = blocked.join(signed.select(F.col("id").alias("row"), "marks"), "row")
        texts = held.join(blocked.select("row"), "row", "left_semi").groupBy("row").agg(F.first("text").alias("text"))
        mine = F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least("block", o).alias("low"), F.greatest("block", o).alias("high"))))
        dealt = ours.join(texts, "row").withColumn("p", mine).select(F.xxhash64("wide", "p.low", "p.high").alias("deal"), "wide", "p.low", "p.high", "row", "class", "block", "marks", "text")
        more = materialize(dealt.groupBy("deal", "wide", "low", "high").applyInArrow(_compare_blocks(similarity, MARGIN), "a long, b long"), "more-links")
        # a class is named by its least row, so only the classes are connected anew, not their rows
        merged = materialize(connected_components(more).select(F.col("node").alias("class"), F.col("component").alias("least")), "merged")
        linked = narrow.join(merged, "class", "left").select("row", F.coalesce("least", "class").alias("class_row"))
        alone = merged.join(narrow.select(F.col("row").alias("class")), "class", "left_anti")  # rows without a link before
        linked = linked.unionByName(alone.select(F.col("class").alias("row"), F.col("least").alias("class_row")))
    release(held, signed, same, chunks, split, blocked)
    return copies, linked


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _placed(docs: DataFrame, key: str, text: str, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(key, digest, words, class_row) of each row, and (class_row, first: the least key and digest) of each class."""
    copies, linked = _classed(docs, key, text, similarity)
    linked = materialize(linked, "linked")  # as a table of its own, so that the join with it can split a hot row
    placed = materialize(copies.join(linked, "row", "left").select("key", "digest", "words", F.coalesce("class_row", "row").alias("class_row")), "placed")
    release(copies)
    return placed, materialize(placed.groupBy("class_row").agg(F.min(F.struct("key", "digest")).alias("first")), "classes")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, words): the least key of the documents that each one is linked with, itself included.

    One row for each row of ``docs``. A row without a key is alone: its class is null.
    """
    placed, firsts = _placed(docs, key, text, similarity)
    return placed.join(firsts, "class_row").select(F.col("key").alias(key), F.col("first.key").alias("class_id"), "words")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` that are the first of their class, and those without a key.

    First is the least key; of rows with one key in one class, the least digest of the
    text. Of equal rows one stays.
    """
    _, firsts = _placed(docs.where(F.col(key).isNotNull()), key, text, similarity)
    kept = firsts.select(F.col("first.key").alias("k"), F.col("first.digest").alias("d"))
    rows = docs.select(F.col(key).cast("long").alias("k"), _digest(text).alias("d"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    chosen = rows.where("k is not null").join(kept, ["k", "d"], "left_semi").groupBy("k", "d").agg(F.first("row").alias("row"))
    return chosen.select("row.*").unionByName(docs.where(F.col(key).isNull()))
