"""Searches as one call, as a service offers them.

Results are rows (rank, result, total): ``result`` is a struct of uid, score and, after
reranking, box; ``total`` is the length of the allow-list as given, else the size of the index.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simloom.operators import matching, search

#: Rows that are reranked, or as many as are wanted if that is more.
SHORTLIST = 1_000


def _results(rows: DataFrame, total: int) -> DataFrame:
    if "y" in rows.columns:
        found = F.struct("uid", "score", F.struct("y", "x", "h", "w").alias("box"))
    else:
        found = F.struct("uid", "score")
    return rows.select("rank", found.alias("result"), F.lit(total).cast("long").alias("total"))


def search_service(
    index: DataFrame, positives: list, negatives: list | None = None, k: int = 100, allow: list | None = None, rerank: bool = False, maps: DataFrame | None = None,
    positive_vectors: list | None = None, negative_vectors: list | None = None,
) -> DataFrame:
    """Search by ids and by given vectors (of images that are not in the index; already reduced if the index is).

    Reranking by matching maps takes place for exactly one positive given by id and no
    negative ids. Without positives there are no results.
    """
    good, bad = [np.array(v, np.float64) for v in positive_vectors or []], [np.array(v, np.float64) for v in negative_vectors or []]
    total = search.total(index, allow)
    if not positives and not good:
        return _results(search.search_from_features(index, np.zeros((0, 1)), None, k), total)
    good = [*(search.features_of(index, positives) if positives else []), *good]
    bad = [*(search.features_of(index, negatives) if negatives else []), *bad]
    again = rerank and maps is not None and len(positives) == 1 and not positive_vectors and not negatives
    found = search.search_from_features(index, np.array(good), np.array(bad) if bad else None, max(SHORTLIST, k) if again else k, allow)
    if again:
        found = matching.rerank(maps, positives[0], found, k)
    return _results(found, total)


def search_external(index: DataFrame, vector: list, k: int = 100, allow: list | None = None, transform=None) -> DataFrame:
    """Search by the vector of one image that is not in the index; ``transform`` maps a table (uid, features) to the index's space (its stored reduction)."""
    if transform is not None:
        own = index.sparkSession.createDataFrame([(0, [float(x) for x in vector])], "uid long, features array<double>")
        vector = transform(own).first()["features"]
    return search_service(index, [], k=k, allow=allow, positive_vectors=[vector])


def composed_search(index: DataFrame, maps: DataFrame, shortlist: int = SHORTLIST):
    """A function (uid, k) -> (rank, uid, score): the nearest rows by vectors, reranked by their maps."""

    def run(uid, k: int) -> DataFrame:
        first = search.search_one(index, uid, max(k, shortlist))
        return matching.rerank(maps, uid, first, k).select("rank", "uid", "score")

    return run
