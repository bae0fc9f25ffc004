"""Boosted trees of two labels, chosen by cross-validation, with the models of all folds and grid points grown in step.

The trees are those of Spark's ``GBTClassifier`` (log loss, variance gain, binned features), which sees
of a row its bins and its label only. So equal binned rows are one cell with a count, without loss: a row in a cell
is dealt to the folds at random, by the cell's multinomial counts. One job over the cells gives the sums of
a level of the trees of all models; there are as many jobs as trees times levels, whatever the folds, and
the cells do not grow with the rows once their bins are full. No row reaches the driver, which gets sums by
model, node, feature and bin.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize, release

#: Cells of a block, which is one row of their table.
BLOCK = 65_536
#: Rows that a task sorts at once, values kept of each chunk and task, and quantiles among which the bounds are.
CHUNK, POINTS, FINE = 131_072, 2_048, 4_096
#: A split must gain more than this for each row of its node; less is rounding.
LEAST = 1e-12


@dataclass
class Tree:
    """A full tree: ``splits`` of each level as (feature, last bin of the left), None where nothing is split; ``values`` of the deepest nodes."""

    splits: list[list[tuple[int, int] | None]] = field(default_factory=list)
    values: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def nodes(self, codes) -> np.ndarray:
        """Place of each row among the deepest nodes; ``codes`` gives the bins of a feature."""
        at = None
        for level in self.splits:
            right = None
            for k, split in enumerate(level):
                if split:
                    side = codes[split[0]] > split[1]
                    side = side if at is None else side & (at == k)
                    right = side if right is None else right | side
            if at is not None:
                at = at * 2 if right is None else at * 2 + right
            elif right is not None:
                at = right.astype(np.uint16)
        return at

    def predict(self, codes) -> np.ndarray | float:
        at = self.nodes(codes)
        return self.values[0] if at is None else self.values[at]


@dataclass
class Boosted:
    """A model of one grid point: fitted on all rows but those of ``fold``, or on all."""

    fold: int | None
    point: int
    depth: int
    size: int
    step: float
    trees: list[Tree] = field(default_factory=list)
    growing: Tree | None = None

    def margin(self, codes) -> np.ndarray | float:
        return sum((1.0 if k == 0 else self.step) * t.predict(codes) for k, t in enumerate(self.trees))

    def targets(self, codes, sign: np.ndarray) -> np.ndarray:
        """What the next tree is fitted to: the signs first, then the gradients of the log loss."""
        return 4 * sign / (1 + np.exp(2 * sign * self.margin(codes))) if self.trees else sign

    def weights(self, counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (total if self.fold is None else total - counts[self.fold]).astype(np.float64)


@dataclass(frozen=True)
class Chosen:
    """The model of the best grid point on all rows, the bounds of its bins and the mean F1 of every point."""

    model: Boosted
    bounds: list[np.ndarray]
    metrics: list[float]

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Probability of label 1 of each row of features."""
        used = {s[0] for t in self.model.trees for level in t.splits for s in level if s}
        codes = {k: np.searchsorted(self.bounds[k], rows[:, k]) for k in used}
        return 1 / (1 + np.exp(-2 * (self.model.margin(codes) + np.zeros(len(rows)))))


def _features(column, width: int) -> np.ndarray:
    """The rows of a column of arrays of ``width`` doubles."""
    if column.null_count or len(flat := column.flatten()) != len(column) * width or flat.null_count:
        raise ValueError(f"a pair has not {width} features")
    return flat.to_numpy(zero_copy_only=False).reshape(-1, width)


def _points(values: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """The values in the middle of n equal parts of the weight."""
    order = np.argsort(values, kind="stable")
    ranks = np.cumsum(weights[order])
    return values[order][np.minimum(np.searchsorted(ranks, (np.arange(n) + 0.5) / n * ranks[-1]), len(values) - 1)]


def bounds(rows: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Upper bounds of all but the last bin of each feature of ``f``: between the values where they are few, else quantiles.

    All rows count: a task sorts them in chunks and keeps POINTS of each, then POINTS of those, so a rank is wrong by two rows in POINTS at most.
    """

    def task(batches):
        chunks, held, n = [], [], 0

        def close():
            x = np.sort(np.concatenate(held).T, axis=1)
            places = ((np.arange(POINTS) + 0.5) * n / POINTS).astype(np.int64)
            chunks.append((x[:, places], x[:, 0].copy(), np.fmax.reduce(x, axis=1), n))  # a view would keep the whole chunk

        for batch in batches:
            held.append(_features(batch["f"], width))
            n += batch.num_rows
            if n >= CHUNK:
                close()
                held, n = [], 0
        if n:
            close()
        if chunks:
            points, low, high, sizes = zip(*chunks, strict=True)
            x, w = np.concatenate(points, axis=1), np.repeat(np.array(sizes) / POINTS, POINTS)
            out = np.stack([np.r_[np.min(low, axis=0)[k], _points(x[k], w, POINTS), np.fmax.reduce(high, axis=0)[k]] for k in range(width)])
            yield pa.RecordBatch.from_pydict({"points": [out.tobytes()], "n": [sum(sizes)]})

    found = rows.select("f").mapInArrow(task, "points binary, n long").collect()
    points = [np.frombuffer(r["points"]).reshape(width, -1) for r in found]
    weights = np.concatenate([np.r_[0.0, np.full(POINTS, r["n"] / POINTS), 0.0] for r in found]) if found else np.zeros(0)
    out = []
    for k in range(width):
        values = np.concatenate([p[k] for p in points]) if points else np.zeros(0)
        different = np.unique(values[~np.isnan(values)])
        if len(different) <= bins:
            out.append((different[:-1] + different[1:]) / 2)
        else:
            fine = _points(values, weights, FINE)
            quantiles = np.unique(fine[[round(q * FINE / bins) for q in range(1, bins)]])
            out.append(quantiles[~np.isnan(quantiles)])
    return out


def cells(rows: DataFrame, edges: list[np.ndarray], bins: int, folds: int, seed: int) -> DataFrame:
    """(codes, label, counts) of blocks of cells, as bytes: bins by feature and cell, labels, and counts by fold and cell."""
    width, bits = len(edges), max(1, (bins - 1).bit_length())
    per = 62 // bits
    words = [f"k{w}" for w in range(-(-width // per))]

    def coded(batches):
        for batch in batches:
            f, label = _features(batch["f"], width), batch["label"]
            if not np.isin(label.to_numpy(zero_copy_only=False), (0.0, 1.0)).all():
                raise ValueError("a label is neither 0 nor 1")
            keys = [np.zeros(len(f), np.int64) for _ in words]
            for k in range(width):
                keys[k // per] |= np.searchsorted(edges[k], f[:, k]) << (bits * (k % per))
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), label], names=[*words, "label"])

    def block(parts: list[pa.RecordBatch], draw: np.random.Generator) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts)
        keys = [t[w].to_numpy() for w in words]
        codes = np.stack([(keys[k // per] >> (bits * (k % per)) & ((1 << bits) - 1)).astype(np.uint16 if bits > 8 else np.uint8) for k in range(width)])
        counts = draw.multinomial(t["n"].to_numpy(), [1 / folds] * folds).T
        values = (codes, t["label"].to_numpy(), np.ascontiguousarray(counts, np.int64))
        return pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in values], names=["codes", "label", "counts"])

    def blocks(batches):
        draw, held, n = np.random.default_rng([seed, TaskContext.get().partitionId()]), [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield block(held, draw)
                held, n = [], 0
        if n:
            yield block(held, draw)

    kinds = ", ".join(f"{w} long" for w in words)
    counted = rows.select("f", F.col("label").cast("double").alias("label")).mapInArrow(coded, f"{kinds}, label double").groupBy(*words, "label").agg(F.count("*").alias("n"))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return counted.repartition(parts, *words).sortWithinPartitions(*words, "label").mapInArrow(blocks, "codes binary, label binary, counts binary")


def _summed(table: DataFrame, width: int, bins: int, folds: int, shape: tuple, add) -> np.ndarray:
    """The sum over all blocks of what ``add`` adds to an array of ``shape``."""

    def task(batches):
        out, some = np.zeros(shape), False
        for batch in batches:
            for row in batch.to_pylist():
                label = np.frombuffer(row["label"])
                codes = np.frombuffer(row["codes"], np.uint16 if bins > 256 else np.uint8).reshape(width, -1)
                add(out, codes, label, np.frombuffer(row["counts"], np.int64).reshape(folds, -1))
                some = True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], names=["sums"])

    total = np.zeros(shape)
    for row in table.mapInArrow(task, "sums binary").collect():
        total += np.frombuffer(row["sums"]).reshape(shape)
    return total


def _split(tree: Tree, sums: np.ndarray, columns: list[int]) -> None:
    """Add a level to a tree from the sums (node, column, bin, weight and target) of its deepest nodes."""
    level, values = [], []
    for node in sums:
        w, s = node[0].sum(axis=0)
        left = np.cumsum(node, axis=1)[:, :-1]
        (wl, sl), (wr, sr) = np.moveaxis(left, 2, 0), np.moveaxis(node.sum(axis=1)[:, None] - left, 2, 0)
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = np.where((wl > 0.5) & (wr > 0.5), sl * sl / wl + sr * sr / wr - s * s / w, -np.inf)
        best = np.unravel_index(np.argmax(gain), gain.shape) if gain.size else None
        if best is not None and gain[best] > LEAST * w:
            level.append((columns[best[0]], int(best[1])))
            values += [sl[best] / wl[best], sr[best] / wr[best]]
        else:
            level.append(None)
            values += [s / w if w > 0.5 else 0.0] * 2
    tree.splits.append(level)
    tree.values = np.array(values)


def _f1(counts: np.ndarray) -> float:
    """Mean F1 of both labels by their rows, of counts by label and prediction; nan where there are none."""
    each = [2 * counts[k, k] / max(counts[k].sum() + counts[:, k].sum(), 1e-300) for k in (0, 1)]
    return float(np.dot(each, counts.sum(axis=1)) / counts.sum()) if counts.sum() else float("nan")


def chosen(plan: CrossValidator, rows: DataFrame, width: int = 10) -> Chosen:
    """The best model of a plan (a ``GBTClassifier``, its grid of depths and trees, folds and seed) on rows (f array of ``width``, label 0 or 1).

    The rows are read twice, for the bounds of the bins and for the cells.
    """
    trees, folds = plan.getEstimator(), plan.getNumFolds()
    bins, points = trees.getMaxBins(), [{p.name: v for p, v in point.items()} for point in plan.getEstimatorParamMaps()]
    if unknown := {name for point in points for name in point} - {"maxDepth", "maxIter"}:
        raise ValueError(f"not chosen by: {sorted(unknown)}")
    edges = bounds(rows, width, bins)
    models = [Boosted(fold, k, p.get("maxDepth", trees.getMaxDepth()), p.get("maxIter", trees.getMaxIter()), trees.getStepSize()) for fold in [*range(folds), None] for k, p in enumerate(points)]
    table = materialize(cells(rows, edges, bins, folds, plan.getSeed()), "cells")

    def total(shape, add):
        return _summed(table, width, bins, folds, shape, add)

    def differ(out, codes, label, counts):
        for a in range(width):
            for b in range(a):
                out[a, b] += (codes[a] != codes[b]).any()

    # of features with the same bins the first would win every split, and a feature of one bin none
    other = total((width, width), differ) > 0
    columns = [k for k in range(width) if len(edges[k]) and other[k, :k].all()]
    for step in range(max(m.size for m in models)):
        for m in models:
            m.growing = Tree() if step < m.size else None
        for level in range(max(m.depth for m in models)):
            now = [m for m in models if m.growing and level < m.depth]
            if not now or not columns:
                continue

            def add(out, codes, label, counts, now=now, level=level):
                sign, all_, wide = 2 * label - 1, counts.sum(axis=0), {k: codes[k].astype(np.int64) for k in columns}
                for sums, m in zip(out, now, strict=True):
                    w, at = m.weights(counts, all_), m.growing.nodes(codes)
                    weighted, base = w * m.targets(codes, sign), 0 if at is None else at.astype(np.int64) * bins
                    for c, k in enumerate(columns):
                        place = wide[k] + base
                        for v, x in enumerate((w, weighted)):
                            sums[:, c, :, v] += np.bincount(place, x, bins << level).reshape(-1, bins)

            sums = total((len(now), 1 << level, len(columns), bins, 2), add)
            for m, own in zip(now, sums, strict=True):
                _split(m.growing, own, columns)
        for m in models:
            if m.growing:
                m.trees.append(m.growing)
                m.growing = None
    held = [m for m in models if m.fold is not None]

    def compare(out, codes, label, counts):
        for sums, m in zip(out, held, strict=True):
            guess = (m.margin(codes) + np.zeros(len(label))) > 0
            sums += np.bincount(2 * label.astype(np.int64) + guess, counts[m.fold], 4).reshape(2, 2)

    f1 = np.array([_f1(c) for c in total((len(held), 2, 2), compare)]).reshape(folds, len(points))
    release(table)
    metrics = [float(np.mean(own[~np.isnan(own)])) if (~np.isnan(own)).any() else 0.0 for own in f1.T]
    return Chosen(models[folds * len(points) + int(np.argmax(metrics))], edges, metrics)


def score(model: Chosen, features: str = "f") -> Column:
    """Probability of label 1 of a column of features."""
    width = len(model.bounds)

    @F.arrow_udf("double")
    def scored(f: pa.Array) -> pa.Array:
        return pa.array(model.scores(_features(f, width)))

    return scored(F.col(features))
