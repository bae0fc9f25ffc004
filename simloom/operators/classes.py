"""Classes, subsets of classes, attention over classes, and models on pair features."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import vectors as V
from simloom.operators import boosting
from simloom.operators.featuremaps import softmax



def counts(items: DataFrame) -> DataFrame:
    """(class_id, count)."""
    return items.groupBy("class_id").agg(F.count("*").alias("count"))


def weights(items: DataFrame) -> DataFrame:
    """(class_id, weight): mean size of the classes over the size of each."""
    sizes = counts(items)
    mean = sizes.agg(F.avg("count").alias("mean"))
    return sizes.join(F.broadcast(mean), F.lit(True)).select("class_id", (F.col("mean") / F.col("count")).alias("weight"))


def dense(items: DataFrame) -> bool:
    """Whether the class ids are 0 to one less than their number."""
    x = items.agg(F.countDistinct("class_id").alias("n"), F.max("class_id").alias("m"), F.min("class_id").alias("l")).first()
    return x["n"] == 0 or (x["n"] == x["m"] + 1 and x["l"] == 0)


def in_all_splits(items: DataFrame, least: int, without: list[int] | None = None) -> DataFrame:
    """(class_id): classes with at least ``least`` rows in each value of ``split``."""
    sizes = items.groupBy("class_id", "split").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    splits = items.select("split").distinct().agg(F.count("*").alias("splits"))
    good = sizes.groupBy("class_id").agg(F.count("*").alias("m")).join(F.broadcast(splits), F.lit(True)).where("m = splits").select("class_id")
    return good.where(~F.col("class_id").isin(without)) if without else good


def top_classes(items: DataFrame, k: int, without: list[int] | None = None) -> DataFrame:
    """(class_id, new_id): the k largest classes, numbered by their old ids from 0; ties in size go to the higher id."""
    sizes = counts(items)
    if without:
        sizes = sizes.where(~F.col("class_id").isin(without))
    best = sizes.orderBy(F.desc("count"), F.desc("class_id")).limit(k)
    return best.select("class_id", (F.row_number().over(Window.orderBy("class_id")) - 1).alias("new_id"))


def reindexed(items: DataFrame, kept: DataFrame, unknown: int | None = None) -> DataFrame:
    """Rows with the new ids of ``kept``; others get ``unknown``, or go."""
    out = items.join(_few(kept, MOST_CLASSES), "class_id", "left" if unknown is not None else "inner")
    return out.withColumn("new_id", F.coalesce("new_id", F.lit(unknown)) if unknown is not None else F.col("new_id"))


def class_attention(index: DataFrame, query: Column) -> DataFrame:
    """(class_id, value array): sum of a class's vectors weighted by the softmax of their scalar products with a query."""
    weight = softmax(V.dot(F.col("features"), query), Window.partitionBy("class_id"))
    each = index.withColumn("weight", weight).select("class_id", "weight", F.posexplode(V.doubles(F.col("features"))).alias("k", "x"))
    summed = each.groupBy("class_id", "k").agg(F.sum(F.col("weight") * F.col("x")).alias("v"))
    return summed.groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda s: s["v"]).alias("value"))


def class_logits(index: DataFrame, weights: DataFrame) -> DataFrame:
    """(uid, class_id, score): scalar product of each row with the ``weight`` of each class (class_id, weight, bias), and its bias. At most MOST_CLASSES classes."""
    return index.join(_few(weights, MOST_CLASSES), F.lit(True)).select("uid", "class_id", (V.dot(F.col("features"), F.col("weight")) + F.col("bias")).alias("score"))


def word_lists(words: DataFrame) -> DataFrame:
    """(uid, words array): the words (uid, kp, word) of an image's keypoints in their order; a keypoint without word counts as -1."""
    each = words.select("uid", F.struct("kp", F.coalesce("word", F.lit(-1)).alias("word")).alias("x"))
    return each.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["word"]).alias("words"))


#: Most classes or centroids that are sent to every task.
MOST_CLASSES = 100_000


def _few(rows: DataFrame, most: int) -> DataFrame:
    """The rows, to be sent to every task; more than ``most`` are an error."""
    if rows.limit(most + 1).count() > most:
        raise ValueError(f"at most {most} rows can be sent to every task")
    return F.broadcast(rows)


def nearest_centroid(index: DataFrame, centroids: DataFrame) -> DataFrame:
    """(uid, word): the centroid (word, centre) of least Euclidean distance; ties to the lower word. Centroids are few and sent to all tasks."""
    d = V.squared_distance(F.col("features"), F.col("centre"))
    return index.join(_few(centroids, MOST_CLASSES), F.lit(True)).groupBy("uid").agg(F.min_by("word", F.struct(F.round(d, 9), "word")).alias("word"))


def visual_words(rows: DataFrame, k: int, seed: int = 1, column: str = "features"):
    """k-means model of vectors; its centres are the words."""
    return KMeans(k=k, seed=seed, featuresCol="_v", predictionCol="word").fit(rows.select(array_to_vector(V.doubles(F.col(column))).alias("_v")))


def assign_words(rows: DataFrame, model, column: str = "features") -> DataFrame:
    """Rows with the word of a k-means model."""
    return model.transform(rows.withColumn("_v", array_to_vector(V.doubles(F.col(column))))).drop("_v")


def duplicate_features(pair: str = "f") -> Column:
    """The ten pair features with the first three by logarithm, the next two by root."""
    f = F.col(pair)
    return F.when(f.isNotNull(), F.array(*(F.log(f[k]) for k in range(3)), *(F.sqrt(f[k]) for k in range(3, 5)), *(f[k] for k in range(5, 10))))


def fit_duplicates(pairs: DataFrame, folds: int = 10, depths: tuple[int, ...] = (2, 3), trees: tuple[int, ...] = (10,), seed: int = 1) -> boosting.Chosen:
    """Boosted trees on (f array of ten, label double), chosen by cross-validated F1. Trees ask for the order of a feature only, so none is scaled."""
    trees_ = GBTClassifier(seed=seed)
    grid = ParamGridBuilder().addGrid(trees_.maxDepth, list(depths)).addGrid(trees_.maxIter, list(trees)).build()
    plan = CrossValidator(estimator=trees_, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed)
    return boosting.chosen(plan, pairs)


def duplicate_scores(model: boosting.Chosen, pairs: DataFrame) -> DataFrame:
    """Rows with ``score``: the probability of label 1."""
    return pairs.withColumn("score", boosting.score(model))
