"""Where images come from: tables (uid, resolver_key, iiif_server_id), and the registry of resolvers (ord, key, base_url, root_folder)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions import text as X


def upsert(known: DataFrame, news: DataFrame, order: str = "added") -> DataFrame:
    """One row for each uid: the news replace what is known, the one of greatest ``order`` first."""
    both = known.withColumn("_new", F.lit(0)).withColumn("_o", F.lit(None).cast(dict(news.dtypes)[order])).unionByName(news.withColumn("_new", F.lit(1)).withColumnRenamed(order, "_o"))
    columns = known.columns
    last = Window.partitionBy("uid").orderBy(F.desc("_new"), F.desc("_o"), *(F.desc(c) for c in columns if c != "uid"))
    return both.withColumn("_r", F.row_number().over(last)).where("_r = 1").select(*columns)


def resolve(urls: DataFrame, registry: DataFrame) -> DataFrame:
    """(uid, url, resolver_key, iiif_server_id): the first resolver in the registry's order whose address begins the URL, schemes aside; the rest of the URL without slashes around it is the id. Null where none does."""
    each = urls.withColumn("_u", X.without_scheme(F.col("url")))
    base = X.without_scheme(F.col("base_url"))
    hit = each.join(F.broadcast(registry), F.startswith(F.col("_u"), base), "left")
    first = hit.groupBy("uid", "url").agg(F.min_by(F.struct("key", base.alias("base"), "_u"), "ord").alias("x"))
    rest = F.trim(F.substr(F.col("x._u"), F.length("x.base") + 1), F.lit("/"))
    return first.select("uid", "url", F.col("x.key").alias("resolver_key"), F.when(F.col("x.key").isNotNull(), rest).alias("iiif_server_id"))


def local_path(located: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows with ``path``: root folder of the resolver and the decoded id."""
    return located.join(F.broadcast(registry.select(F.col("key").alias("resolver_key"), "root_folder")), "resolver_key").withColumn("path", F.concat(F.col("root_folder"), F.lit("/"), X.unquoted(F.col("iiif_server_id")))).drop("root_folder")


def statistics(located: DataFrame, registry: DataFrame) -> DataFrame:
    """(key, n): rows of each resolver of the registry; 0 for those without any, other keys are not told."""
    n = located.groupBy(F.col("resolver_key").alias("key")).agg(F.count("*").alias("n"))
    return registry.select("key").join(n, "key", "left").select("key", F.coalesce("n", F.lit(0)).alias("n"))


def usable(rows: DataFrame, blacklist: list[str]) -> DataFrame:
    """Rows (uid, path) with a path that is not on the blacklist."""
    return rows.where(F.col("path").isNotNull() & ~F.col("path").isin(blacklist))


def with_metadata(rows: DataFrame, metadata: DataFrame, order: str) -> DataFrame:
    """Rows (key, ...) with the metadata of their key; of repeated keys the row of greatest ``order`` counts, unknown keys go."""
    last = Window.partitionBy("key").orderBy(F.desc(order))
    return rows.join(metadata.withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", order), "key")


def corrected(metadata: DataFrame, corrections: dict[str, str], author: str = "author") -> DataFrame:
    """Rows with the author ids that ``corrections`` names replaced."""
    out = F.col(author)
    for wrong, right in sorted(corrections.items()):
        out = F.when(F.col(author) == wrong, right).otherwise(out)
    return metadata.withColumn(author, out)


def without_source(rows: DataFrame, source: str, kept: DataFrame) -> DataFrame:
    """Rows (uid, source) of other sources, and those whose uid is in ``kept`` whatever their source."""
    other = rows.where(F.col("source") != source)
    return other.unionByName(rows.where(F.col("source") == source).join(kept.select("uid").distinct(), "uid", "left_semi"))


def attributed(metadata: DataFrame, author: str = "author", modifier: str = "modifier") -> DataFrame:
    """Rows whose author is a catalogue id and whose modifier leaves the attribution standing."""
    return metadata.where(F.col(author).contains("ulan") & (F.col(modifier).isNull() | F.col(modifier).isin("?", "attr")))
