"""Boosted trees of all folds and grid points at once."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from simloom.operators import boosting, classes


def _pair_rows(spark, n, values):
    rng = np.random.default_rng(5)
    x = rng.integers(0, values, (n, 10)) / values
    x[:, 2] = 1.0
    x[:, 6] = x[:, 5] / 3
    y = (x[:, 0] + x[:, 3] * x[:, 5] + rng.normal(0, 0.2, n) > 0.75).astype(float)
    return x, y, spark.createDataFrame([(x.tolist(), float(t)) for x, t in zip(x, y)], "f array<double>, label double").repartition(3)


def test_trees_grown_in_step_are_those_of_spark(spark):
    x, _, rows = _pair_rows(spark, 2000, 25)
    vectors_ = rows.withColumn("features", array_to_vector("f"))
    for depth in (2, 3):
        ours = {tuple(r.f): r.score for r in classes.duplicate_scores(classes.fit_duplicates(rows, 2, (depth,)), rows).collect()}
        spark_model = GBTClassifier(maxDepth=depth, maxIter=10, seed=1).fit(vectors_)
        theirs = {tuple(r.f): r.p for r in spark_model.transform(vectors_).select("f", vector_to_array("probability")[1].alias("p")).collect()}
        assert ours == pytest.approx(theirs, abs=1e-9)


def test_grid_is_chosen_in_one_job_for_each_level(spark):
    x, y, rows = _pair_rows(spark, 1500, 1000)
    spark.sparkContext.setJobGroup("boosted", "")
    try:
        model = classes.fit_duplicates(rows)
    finally:
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("boosted"))
        spark.sparkContext._jsc.clearJobGroup()
    assert jobs < 60  # 20 models one by one take hundreds
    assert len(model.metrics) == 2 and 0.7 < min(model.metrics) and model.model.depth == (2, 3)[int(np.argmax(model.metrics))]
    assert model.model.fold is None and len(model.model.trees) == 10


def test_bounds_are_quantiles_of_all_rows(spark, monkeypatch):
    monkeypatch.setattr(boosting, "CHUNK", 20_000)
    rows = spark.range(200_000).select(F.array(F.exp(F.col("id") / 20_000), -F.col("id").cast("double"), (F.col("id") % 2).cast("double")).alias("f"))
    a, b, c = boosting.bounds(rows, 3, 32)
    ranks = np.arange(1, 32) * 200_000 / 32
    assert np.abs(np.log(a) * 20_000 - ranks).max() < 300 and np.abs(b + 200_000 - ranks).max() < 300 and c.tolist() == [0.5]


def test_each_row_is_in_one_fold_and_one_cell(spark):
    x, y, rows = _pair_rows(spark, 1500, 4)
    edges = boosting.bounds(rows, 10, 32)
    assert [len(e) for e in edges] == [3, 3, 0, 3, 3, 3, 3, 3, 3, 3]
    seen = [0.0, 0.0]
    for r in boosting.cells(rows.union(rows), edges, 32, 5, 1).collect():
        counts, label = np.frombuffer(r.counts, np.int64).reshape(5, -1), np.frombuffer(r.label)
        assert np.frombuffer(r.codes, np.uint8).reshape(10, -1)[0].max() <= 3
        for k in (0, 1):
            seen[k] += counts[:, label == k].sum()
    assert seen == [2 * (y == 0).sum(), 2 * (y == 1).sum()]


def test_pairs_of_no_kind_and_of_one_kind(spark):
    rows = spark.createDataFrame([([float(i)] * 10, 1.0) for i in range(40)], "f array<double>, label double")
    assert {round(r.score, 6) for r in classes.duplicate_scores(classes.fit_duplicates(rows), rows).collect()} == {round(1 / (1 + np.exp(-2 * classes.fit_duplicates(rows).model.margin({}))), 6)}
    none = rows.where("false")
    assert classes.duplicate_scores(classes.fit_duplicates(none), none).collect() == []
    with pytest.raises(Exception, match="neither 0 nor 1"):
        classes.fit_duplicates(rows.withColumn("label", F.lit(2.0)))
