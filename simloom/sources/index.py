"""Feature indexes: Parquet tables (uid, features), one folder for each named variant."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Normalizer, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASE, HALF = "base_index", "half_dim_pca"


def folder(path: str, key: str = BASE) -> str:
    """Where a variant lies."""
    return f"{path}/index_key={key}"


def open_index(spark: SparkSession, path: str, key: str = BASE) -> DataFrame:
    """(uid, features) of a variant."""
    return spark.read.parquet(folder(path, key))


def build(features: DataFrame, path: str, maps: DataFrame | None = None) -> None:
    """Write an index, and its feature maps; an index that exists is an error."""
    features.select("uid", "features").write.mode("errorifexists").parquet(folder(path))
    if maps is not None:
        maps.write.mode("errorifexists").parquet(f"{path}/feature_maps")


def append(features: DataFrame, path: str, skip_known: bool = False) -> None:
    """Add rows to an index; rows of known ids are added too unless they are to be skipped."""
    rows = features.select("uid", "features")
    if skip_known:
        rows = missing(rows, open_index(features.sparkSession, path))
    rows.write.mode("append").parquet(folder(path))


def missing(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows whose uid is not known."""
    return rows.join(known.select("uid").distinct(), "uid", "left_anti")


def describe(index: DataFrame, maps: DataFrame | None = None) -> DataFrame:
    """(n, d, with_maps)."""
    return index.agg(F.count("*").alias("n"), F.max(F.size("features")).alias("d")).withColumn("with_maps", F.lit(maps is not None))


def fit_reduction(index: DataFrame, dimensions: int) -> PipelineModel:
    """Scale to length 1, centre, project on the principal components, scale to length 1."""
    rows = index.select(array_to_vector(F.col("features").cast("array<double>")).alias("v"))
    return Pipeline(
        stages=[
            Normalizer(inputCol="v", outputCol="v1"),
            StandardScaler(inputCol="v1", outputCol="v2", withMean=True, withStd=False),
            PCA(k=dimensions, inputCol="v2", outputCol="v3"),
            Normalizer(inputCol="v3", outputCol="v4"),
        ]
    ).fit(rows)


def reduce(index: DataFrame, model: PipelineModel) -> DataFrame:
    """(uid, features) in the reduced space."""
    rows = index.select("uid", array_to_vector(F.col("features").cast("array<double>")).alias("v"))
    return model.transform(rows).select("uid", vector_to_array("v4").alias("features"))


def add_half_dimensions(spark: SparkSession, path: str) -> None:
    """Write the variant of half the dimensions, with its model beside it."""
    index = open_index(spark, path)
    d = index.select(F.size("features").alias("d")).first()["d"]
    model = fit_reduction(index, d // 2)
    model.write().overwrite().save(f"{path}/models/{HALF}")
    reduce(index, model).write.mode("overwrite").parquet(folder(path, HALF))


def load_reduction(path: str) -> PipelineModel:
    """The model of the variant of half the dimensions."""
    return PipelineModel.load(f"{path}/models/{HALF}")
