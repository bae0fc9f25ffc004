"""Byte-level BPE encoding and decoding by overlapping chunks.

A text is cut into overlapping chunks, which are rows of their own and are
pre-tokenised in parallel. The split pattern only looks ahead, so once two neighbouring
chunks share a pre-token boundary they agree from there on: chunks are stitched at the
first boundary where they resynchronise, then the pieces between two such
boundaries are encoded by merge rank, again in parallel. A text that has an overlap
without a common boundary (one pre-token longer than the overlap, say) is read
chunk by chunk in order. A text of one chunk has no seam and is encoded where
it is read. Decoding concatenates the bytes of the ids.

Nulls and empty texts have no ids. Rows may repeat. Extra columns are kept; one that has
the name of a result is replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize
from simloom.llm.bytescan import slices
from simloom.llm.columns import others

#: Characters of a chunk, and of the overlap searched for a common boundary.
CHUNK, OVERLAP = 1 << 15, 1 << 9
#: Pieces remembered by a worker; beyond it the memory starts anew.
REMEMBERED = 50_000


class Vocabulary:
    """Merge ranks of a rank file: lines of a base64 token and its rank."""

    _loaded: dict[tuple[str, str], Vocabulary] = {}

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as f:
            pairs = (line.split() for line in f if line.strip())
            ranks = {base64.b64decode(token): int(rank) for token, rank in pairs}
        self.split = regex.compile(pattern)
        self.encoding = tiktoken.Encoding(path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.merges = tiktoken.Encoding(path, pat_str="(?s:.+)", mergeable_ranks=ranks, special_tokens={})  # takes any text as one piece
        self.memory: dict[str, np.ndarray] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> Vocabulary:
        """The vocabulary of a file, read once in each process."""
        if (path, pattern) not in cls._loaded:
            cls._loaded[path, pattern] = cls(path, pattern)
        return cls._loaded[path, pattern]

    def piece(self, piece: str) -> np.ndarray:
        """Ids of one pre-token, merged by rank."""
        if (ids := self.memory.get(piece)) is None:
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            ids = self.memory[piece] = np.array(self.merges.encode_ordinary(piece), np.uint32)
        return ids

    def encode(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> np.ndarray:
        """Ids of a text, whose chunks are read in order."""
        if len(text) <= chunk + overlap:
            return np.asarray(self.encoding.encode_to_numpy(text, disallowed_special=()), np.uint32)
        return self.pieces(pretokenise(text, self.split, chunk, overlap))

    def pieces(self, pieces: list[str]) -> np.ndarray:
        """Ids of pre-tokens."""
        return np.concatenate([np.zeros(0, np.uint32), *(self.piece(p) for p in pieces)])

    def decode(self, ids) -> bytes:
        """The concatenated bytes of ids."""
        return self.encoding.decode_bytes(ids)


def pretokenise(text: str, split: regex.Pattern, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pre-tokens of a text, found chunk by chunk and stitched.

    Each chunk reads ``overlap`` characters into the next one. Of the left
    chunk the boundaries count up to the first one that the right chunk has too,
    leaving out the last piece, which the cut may have shortened. Where the
    overlap holds none, the right chunk is read again from the last sure
    boundary of the left one.
    """
    if len(text) <= chunk + overlap:
        return split.findall(text)
    out: list[str] = []
    start, pieces = 0, split.findall(text[: chunk + overlap])
    while True:
        stop = start + sum(map(len, pieces))
        if stop >= len(text):
            return out + pieces
        nominal = max(start + 1, stop - overlap)
        right = split.findall(text[nominal : nominal + chunk + overlap])
        bounds, at = set(), nominal
        for piece in right:
            if at > stop:
                break
            bounds.add(at)
            at += len(piece)
        at, met = start, None
        sure = pieces[:-2]  # a trailing run of spaces may end differently with more text, so two pieces stay open
        for k, piece in enumerate(sure):
            if at >= nominal and at in bounds:
                met = k
                break
            at += len(piece)
        if met is None:
            out += sure
            start += sum(map(len, sure))
            reach = chunk + overlap if sure else 2 * (stop - start) + chunk
            pieces = split.findall(text[start : start + reach])
            continue
        out += sure[:met]
        here = nominal
        for k, piece in enumerate(right):
            if here == at:
                start, pieces = at, right[k:]
                break
            here += len(piece)


def _text_id(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _cut(chunk: int, overlap: int):
    """(id, text) come in; the chunks go out with their number and whether more follow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                starts = range(0, max(1, len(text) - overlap), chunk)
                for a in range(0, len(starts), 64):
                    part = starts[a : a + 64]
                    yield pa.RecordBatch.from_arrays([pa.array([ident] * len(part), pa.binary()), pa.array(list(range(a, a + len(part))), pa.int32()), pa.array([at + chunk + overlap < len(text) for at in part]), pa.array([text[at : at + chunk + overlap] for at in part], pa.string())], names=["id", "k", "more", "text"])

    return run


def _boundaries(pattern: str, chunk: int, overlap: int):
    """Chunks come in; with the boundaries in either overlap they go out.

    Of the right overlap the last two pieces stay out, which the cut may have changed:
    the last is shortened, and a run of spaces before it may end differently.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = regex.compile(pattern)
        for batch in batches:
            for part in parts(batch, "text"):
                out: tuple[list, list] = ([], [])
                for text, more in zip(part.column(3).to_pylist(), part.column(2).to_pylist(), strict=True):
                    ends = np.cumsum([len(p) for p in split.findall(text)])
                    starts = np.append(0, ends[:-1])
                    out[0].append(starts[starts < overlap].astype(np.int32))
                    sure = starts[:-2] if more else starts[:0]
                    out[1].append((sure[sure >= chunk] - chunk).astype(np.int32))
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(x, pa.list_(pa.int32())) for x in out)], names=[*part.schema.names, "left", "right"])

    return run


def long_texts(texts: DataFrame, ranks: str, pattern: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, ids: array of (k, ids) by k) of the different texts (id, text) of more than one chunk; rows may repeat."""
    chunks = texts.mapInArrow(_cut(chunk, overlap), "id binary, k int, more boolean, text string")
    chunks = chunks.groupBy("id", "k").agg(F.first("more").alias("more"), F.first("text").alias("text"))  # of equal texts one
    chunks = materialize(chunks.mapInArrow(_boundaries(pattern, chunk, overlap), "id binary, k int, more boolean, text string, left array<int>, right array<int>"), "chunks")
    order = Window.partitionBy("id").orderBy("k")
    seams = chunks.select("id", "k", "more", F.array_min(F.array_intersect("right", F.lead("left").over(order))).alias("seam"))
    seams = seams.withColumn("begin", F.lag("seam", 1, 0).over(order))
    seams = materialize(seams, "seams")
    broken = materialize(seams.where("more and seam is null").select("id").distinct(), "broken")
    whole = chunks.select("id", "k", "text").join(seams.join(broken, "id", "left_anti"), ["id", "k"]).select("id", "k", "text", "begin", (F.col("seam") + chunk).alias("end"))

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(ranks, pattern)
        for batch in batches:
            for part in parts(batch, "text"):
                made = []
                for text, begin, end in zip(*(part.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
                    pieces, at = [], begin
                    for m in vocabulary.split.finditer(text, begin):
                        if end is not None and at >= end:
                            break
                        pieces.append(m[0])
                        at = m.end()
                    made.append(vocabulary.pieces(pieces).astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(made, pa.binary())], names=["id", "k", "ids"])

    def in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(ranks, pattern)
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = vocabulary.encode(text, chunk, overlap).astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ident], pa.binary()), pa.array([0], pa.int32()), pa.array([ids], pa.binary())], names=["id", "k", "ids"])

    schema = "id binary, k int, ids binary"
    found = whole.mapInArrow(stitched, schema)
    if not broken.isEmpty():
        read = texts.join(broken, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
        found = found.unionByName(read.mapInArrow(in_order, schema))
    return found.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("ids"))


def _split(docs: DataFrame, ranks: str, pattern: str, text: str, chunk: int, overlap: int, named: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows (the columns ``named``, text) of at most one chunk, and rows (the columns, ids) of more."""
    rows = docs.select(*(F.col(f"`{c}`") for c in named), F.col(f"`{text}`").alias("\0text"))
    body = F.col("`\0text`")
    large = F.length(body) > chunk + overlap
    some = rows.where(large).select(F.struct(*(F.col(f"`{c}`") for c in named), F.lit(0).alias("\0none")).alias("row"), _text_id(body).alias("id"))
    texts = docs.where(F.length(F.col(f"`{text}`")) > chunk + overlap).select(_text_id(F.col(f"`{text}`")).alias("id"), F.col(f"`{text}`").alias("text"))
    made = long_texts(texts, ranks, pattern, chunk, overlap)
    return rows.where(F.coalesce(~large, F.lit(True))), some.join(made, "id").select("row.*", F.expr("transform(ids, x -> x.ids)").alias("\0ids")).drop("\0none")


def _coded(docs: DataFrame, ranks: str, pattern: str, text: str, chunk: int, overlap: int, named: list[str], schema, made) -> DataFrame:
    """The columns ``named`` and those that ``made`` makes of ids (None for a null text); ``schema`` is of both."""
    short, large = _split(docs, ranks, pattern, text, chunk, overlap, named)
    n, names = len(named), [f.name for f in schema.fields]

    def read(of):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            vocabulary = Vocabulary.load(ranks, pattern)
            for batch in batches:
                for part in of(batch):
                    found = made(vocabulary, [_ids(vocabulary, x) for x in part.column(n).to_pylist()])
                    yield pa.RecordBatch.from_arrays([*part.columns[:n], *found], names=names)

        return run

    def one_by_one(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return (batch.slice(k, 1) for k in range(batch.num_rows))

    return short.mapInArrow(read(lambda batch: parts(batch, batch.schema.names[n])), schema).unionByName(large.mapInArrow(read(one_by_one), schema))


def _ids(vocabulary: Vocabulary, x: str | list[bytes] | None) -> np.ndarray | None:
    """The ids of a text, or those that are there already."""
    if x is None:
        return None
    return np.frombuffer(b"".join(x), "<u4") if isinstance(x, list) else np.asarray(vocabulary.encoding.encode_to_numpy(x, disallowed_special=()), np.uint32)


def encode(docs: DataFrame, ranks: str, pattern: str, text: str = "text", into: str = "ids", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Add the column ``into``: the ids of ``text`` as little-endian 32-bit integers in one binary.

    ``ranks`` is the path of a rank file that every executor can read. Texts of one chunk
    are not shuffled.
    """
    named = others(docs, into)
    frame = docs.select(*(F.col(f"`{c}`") for c in named), F.lit(None).cast("binary").alias(into))

    def made(_, found: list) -> list[pa.Array]:
        return [pa.array([None if x is None else x.astype("<u4").tobytes() for x in found], pa.binary())]

    return _coded(docs, ranks, pattern, text, chunk, overlap, named, frame.schema, made)


def decode(encoded: DataFrame, ranks: str, pattern: str, ids: str = "ids", into: str = "decoded") -> DataFrame:
    """Add the column ``into``: the bytes that the ids of ``ids`` stand for."""
    named = others(encoded, into)
    kept = encoded.select(*(F.col(f"`{c}`") for c in named), F.lit(None).cast("binary").alias(into))
    at = named.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.load(ranks, pattern)
        for batch in batches:
            for part in parts(batch, batch.schema.names[at]):
                made = [None if x is None else vocabulary.decode(np.frombuffer(x, "<u4").tolist()) for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(made, pa.binary())], names=part.schema.names)

    return kept.mapInArrow(run, kept.schema)


def digests(docs: DataFrame, ranks: str, pattern: str, text: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Encode and decode; return the rows with n_tokens, ids_sha256 and decoded_sha256 in place of the text.

    A null text counts as empty. Ids and bytes are digested where they are
    made, so neither is sent back to the JVM.
    """
    named = others(docs, text, "n_tokens", "ids_sha256", "decoded_sha256")
    frame = docs.select(*(F.col(f"`{c}`") for c in named), F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256"))

    def made(vocabulary: Vocabulary, found: list) -> list[pa.Array]:
        found = [np.zeros(0, np.uint32) if x is None else x for x in found]
        one = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in found]
        two = [hashlib.sha256(vocabulary.decode(x.tolist())).hexdigest() for x in found]
        return [pa.array([len(x) for x in found], pa.int64()), pa.array(one), pa.array(two)]

    return _coded(docs, ranks, pattern, text, chunk, overlap, named, frame.schema, made)


def parts(batch: pa.RecordBatch, column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``most`` bytes in ``column``, or of one row."""
    array = batch.column(column)
    sizes = pa.compute.fill_null(pa.compute.binary_length(array), 0).to_numpy(zero_copy_only=False)
    offsets = np.zeros(len(array) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    for i, j in slices(offsets, most):
        yield batch.slice(i, j - i)
