"""Approximate nearest neighbours by collision counting.

Vectors are scaled to length 1 and projected on random lines, one sorted array
for each line. A query opens a window around its own projection on every line;
the windows grow with the radius sought (virtual rehashing), and only what they
grow by is read. A vector that lies in the windows of enough lines is verified
with the exact cosine. The radius grows no further than the distance of the
last of the best vectors known so far, and the search ends there. While fewer
are known than wanted it grows up to the greatest distance there is, where every
vector is verified, so a query always gets its neighbours if there are enough vectors.

Vectors are dealt to shards, each indexed in one task. Each query is first searched
in the shard of its own vector; the scores found there go with it to all other
shards, and their windows start near the radius that these scores leave. Queries are
streamed past the index of a shard; neither vectors nor indexes are copied. The lines
are the same everywhere. Vectors that are null, empty, zero or hold null or non-finite
components, and rows without id, take no part. Equal rows count once. Vectors of
different lengths are not compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize

#: Lines, half width of a window at radius 1, and the collisions from which a vector is verified.
LINES, WIDTH = 128, 1.0
#: A vector at the radius collides on 0.683 of the lines on average; 1.5 standard deviations less lets 93 of 100 in.
THRESHOLD = int(0.683 * LINES - 1.5 * (0.683 * 0.317 * LINES) ** 0.5)
#: Distances of vectors of length 1: the first radius, the greatest there is, and the factor by which radii grow.
FIRST, GREATEST, STEP = 0.3, 2.0, 1.2
#: Share of the radius that known scores leave, or at which the search before ended, where a search starts.
START = 0.85
SHARD = 16_384


def lines(dimensions: int, count: int = LINES) -> np.ndarray:
    """The random lines, as columns; the same for each number of dimensions everywhere."""
    return np.random.default_rng(20_240_229 + dimensions).standard_normal((dimensions, count))


class CollisionIndex:
    """One sorted array of projections for each line."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        self.first = FIRST  # where a search without known scores starts: near the radius at which the one before ended
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))
        self.lines = lines(vectors.shape[1])
        at = np.ascontiguousarray(((vectors / self.norms[:, None]) @ self.lines).T)
        self.order = at.argsort(axis=1, kind="stable")
        self.sorted = np.take_along_axis(at, self.order, axis=1)

    def search(self, own: int, query: np.ndarray, k: int, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and cosines of the neighbours found, nearest first, that belong to the k nearest beside the ``known`` cosines; rows with the query's own id are passed over."""
        norm = np.sqrt((query * query).sum())
        centre = (query / norm) @ self.lines
        hits = np.zeros(len(self.ids), np.int64)
        open_ = self.ids != own
        ids, scores = [np.zeros(0, np.int64)], [np.zeros(0)]
        best = np.sort(known)[::-1][:k]
        limit = _radius(best, k)
        radius = START * limit if limit < GREATEST else self.first
        low = high = None
        while True:
            if radius >= GREATEST:
                fresh = np.flatnonzero(open_)
            else:
                edges = np.stack([centre - radius * WIDTH, centre + radius * WIDTH], axis=1)
                a, b = np.array([s.searchsorted(e) for s, e in zip(self.sorted, edges, strict=True)]).T.tolist()
                if low is None:
                    new = [o[x:y] for o, x, y in zip(self.order, a, b, strict=True)]
                else:
                    new = [p for o, x, y, u, v in zip(self.order, a, b, low, high, strict=True) for p in (o[x:u], o[v:y])]
                low, high = a, b
                hits += np.bincount(np.concatenate(new), minlength=len(hits))
                fresh = np.flatnonzero(open_ & (hits >= THRESHOLD))
            if len(fresh):
                open_[fresh] = False
                self.verified += len(fresh)
                cosine = (self.vectors[fresh] * query).sum(axis=1) / (self.norms[fresh] * norm)
                ids.append(self.ids[fresh])
                scores.append(cosine)
                best = np.sort(np.concatenate([best, cosine]))[::-1][:k]
                limit = _radius(best, k)
            if radius >= limit:
                self.first = max(FIRST, START * limit)
                break
            radius = min(radius * STEP, limit)
        every, score = np.concatenate(ids), np.concatenate(scores)
        if len(best) == k:
            every, score = every[score >= best[-1]], score[score >= best[-1]]
        first = np.lexsort((every, -score))[:k]
        return every[first], score[first]


def _radius(best: np.ndarray, k: int) -> float:
    """The distance within which a vector must lie to be among the k best, a little rounded up."""
    return GREATEST if len(best) < k else min(GREATEST, float(np.sqrt(max(0.0, 2 - 2 * best[k - 1]))) + 1e-7)


def usable(vector: Column) -> Column:
    """Whether a vector is neither null, empty nor zero and all its components are finite."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def _searcher(k: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Search the queries of a shard; its rows come by length, and for each length the vectors come before the queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index, length = [], None, None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            at = np.stack([rows["d"].to_numpy(), rows["asks"].to_numpy().astype(np.int64)], axis=1)
            starts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1).tolist(), len(at)]
            for begin, end in zip(starts, starts[1:], strict=False):
                if begin == end:
                    continue
                part, d, asks = rows.slice(begin, end - begin), int(at[begin, 0]), bool(at[begin, 1])
                if d != length:
                    held, index, length = [], None, d
                if not asks:
                    held.append((part["id"].to_numpy(), _matrix(part["v"])))
                elif held or index:
                    if index is None:
                        index = CollisionIndex(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
                        held = []
                    own = part["id"].to_numpy()
                    found = [index.search(o, q, k, np.array(s)) for o, q, s in zip(own.tolist(), _matrix(part["v"]), part["known"].to_pylist(), strict=True)]
                    ids, scores = (pa.array([f[i].tolist() for f in found], kind) for i, kind in ((0, pa.list_(pa.int64())), (1, pa.list_(pa.float64()))))
                    yield pa.RecordBatch.from_arrays([pa.array(own), part["v"].combine_chunks(), part["shard"].combine_chunks(), ids, scores], ["id", "v", "shard", "ids", "scores"])

    return run


def nearest(vectors: DataFrame, queries: Column, k: int, key: str = "vec_id", vector: str = "embedding", shard: int = SHARD) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row that ``queries`` selects.

    Candidates are all rows with another id; the score is the cosine in double
    precision; ties go to the smaller id.
    """
    rows = vectors.where(F.col(key).isNotNull() & usable(F.col(vector))).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("asks")).distinct()
    rows = materialize(rows, "vectors")
    shards = max(1, -(-rows.count() // shard))
    none = F.array().cast("array<double>")
    held = rows.select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("asks"), none.alias("known"), F.size("v").alias("d"))
    asked = rows.where("asks").select("id", "v", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int").alias("shard"), F.lit(True).alias("asks"), none.alias("known"), F.size("v").alias("d"))
    found = "id long, v array<double>, shard int, ids array<long>, scores array<double>"

    def search(asking: DataFrame) -> DataFrame:
        return held.unionByName(asking).repartitionById(shards, F.col("shard")).sortWithinPartitions("d", "asks", "id").mapInArrow(_searcher(k), found)

    home = materialize(search(asked), "home")
    others = F.explode(F.sequence(F.lit(1), F.lit(shards - 1))) if shards > 1 else F.explode(F.array().cast("array<int>"))
    away = home.select("id", "v", "shard", "scores", others.alias("step")).select("id", "v", F.pmod(F.col("shard") + F.col("step"), F.lit(shards)).alias("shard"), F.lit(True).alias("asks"), F.col("scores").alias("known"), F.size("v").alias("d"))
    both = home.select("id", "ids", "scores").unionByName(search(away).select("id", "ids", "scores"))
    pairs = both.select(F.col("id").alias("query_id"), F.explode(F.arrays_zip("ids", "scores")).alias("x")).select("query_id", F.col("x.ids").alias("vec_id"), F.col("x.scores").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
