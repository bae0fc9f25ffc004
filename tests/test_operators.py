"""Small hand-made cases of the operators."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from simloom.functions import text as X
from simloom.functions import vectors as V
from simloom.operators import classes, evaluation, featuremaps, graph, keypoints, matching, mining, pairs, region, search, svm
from simloom.operators.components import connected_components
from simloom.plans import catalog
from simloom.plans import fixtures as T
from simloom.sources import index, locations, tables
from simloom.streaming.append import append_stream


def vectors(spark, n=40, d=4, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return spark.createDataFrame([(i, [float(t) for t in v]) for i, v in enumerate(x)], "uid long, features array<float>"), x


def test_components_on_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 200)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert {got[i] for i in range(61)} == {0} and {got[i] for i in range(100, 140)} == {100} and got[200] == 200
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_two_class_machine_meets_its_conditions():
    rng = np.random.default_rng(1)
    p, n = rng.standard_normal((4, 3)) * 0.4, rng.standard_normal((5, 3)) * 0.4
    m = svm.two_class(p, n)
    x, y = np.concatenate([p, n]), np.array([1.0] * 4 + [-1.0] * 5)
    a = m.coefficients * y
    f = svm.kernel(x, x, 2.0) @ m.coefficients - m.offset
    assert abs(m.coefficients.sum()) < 1e-8 and (a > -1e-9).all() and (a < 1 + 1e-9).all()
    assert (y * f)[a < 1e-9].min(initial=1) > 1 - 1e-5 and (y * f)[a > 1 - 1e-9].max(initial=1) < 1 + 1e-5


def test_closed_forms_of_machines():
    p, n = np.array([[1.0, 0.0]]), np.array([[0.0, 1.0]])
    m = svm.two_class(p, n)
    assert np.allclose(m.coefficients, [1, -1]) and abs(m.offset) < 1e-9
    two = np.array([[1.0, 0.0], [0.0, 1.0]])
    one = svm.one_class(two)
    assert np.allclose(one.coefficients, [0.5, 0.5]) and abs(one.offset - (1 + math.exp(-2)) / 2) < 1e-9
    same = svm.one_class(np.array([[1.0, 0.0]] * 3))
    assert abs(same.coefficients.sum() - 1.5) < 1e-9 and abs(same.offset - 1.5) < 1e-9


def test_search_cases(spark):
    rows, x = vectors(spark)
    assert search.search(rows, []).count() == 0
    assert search.search(rows, [1], allow=[-1]).count() == 0
    assert search.search(rows, [1], allow=[]).count() == 40
    assert {r.uid for r in search.search(rows, [1], allow=[2, 2, 3, -9]).collect()} == {2, 3} and search.total(rows, [2, 2, -9]) == 3
    with pytest.raises(KeyError):
        search.search(rows, [999])
    assert search.search(rows, [5], k=1).first().uid == 5


def test_pairs_against_numpy(spark):
    rows, x = vectors(spark, 50)
    d = 1 - x @ x.T
    want = {(i, j) for i in range(50) for j in range(i + 1, 50) if d[i, j] < 0.3}
    for block in (7, 4096):
        assert {(r.i, r.j) for r in pairs.within(rows, 0.3, block).collect()} == want
        near = pairs.knn_join(rows, 5, block).collect()
        assert {(r.i, r.j) for r in near} == {(i, j) for i in range(50) for j in np.argsort(d[i], kind="stable")[:5]}


def test_distance_matrix_of_known_and_unknown(spark):
    rows, x = vectors(spark, 5)
    got = {(r.i, r.j): r.dist for r in pairs.distance_matrix(rows, [1, -1, -2, 2]).collect()}
    assert got[0, 0] == 0 and got[0, 1] == 10 and got[1, 2] == 0.01 and got[1, 1] == 0.01
    assert got[0, 3] == round(float(np.linalg.norm(x[1].astype(np.float32) - x[2].astype(np.float32))), 3)
    assert pairs.distance_matrix(rows, [-1]).first().dist == 0.01


def test_dbscan_border_and_noise(spark):
    near = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (6, 7), (7, 8), (4, 7)], "i long, j long")
    rows = spark.createDataFrame([(i,) for i in range(1, 12)], "uid long")
    got = dict(graph.dbscan(near, rows).collect())
    assert got == {1: 0, 2: 0, 3: 0, 4: 0, 6: 0, 7: 0, 8: 0}
    assert graph.dbscan(near.limit(0), rows).count() == 0


def test_closures(spark):
    links = spark.createDataFrame([(1, 2, "DUPLICATE"), (2, 3, "DUPLICATE"), (3, 4, "POSITIVE")], "img1 long, img2 long, type string")
    assert dict(graph.physical_closure(links).collect()) == {1: 1, 2: 1, 3: 1, 4: 4}
    ignored = {}
    for r in graph.ignore_closure(links).collect():
        ignored.setdefault(r.uid, set()).add(r.member)
    assert ignored == {3: {1, 2, 3, 4}, 4: {1, 2, 3, 4}}
    assert {(r.query_id, r.uid) for r in graph.benchmark_ignored(links).collect()} == {(3, 1), (3, 2), (3, 3), (4, 1), (4, 2), (4, 4)}


def drawn_links(seed: int, n: int, count: int) -> list[tuple]:
    rng = np.random.default_rng(seed)
    ends = rng.integers(0, n, (count, 2))
    return [(int(a), int(b), str(rng.choice(["DUPLICATE", "POSITIVE", "NEGATIVE"], p=[0.5, 0.4, 0.1]))) for a, b in ends]


def ignored_by_definition(rows: list[tuple]) -> dict[int, set[int]]:
    near = {}
    for a, b, kind in rows:
        near.setdefault((a, kind), set()).add(b)
        near.setdefault((b, kind), set()).add(a)

    def closure(u):
        seen, todo = {u}, [u]
        while todo:
            new = near.get((todo.pop(), "DUPLICATE"), set()) - seen
            seen |= new
            todo += new
        return seen

    own = {u: set().union(*(closure(x) for x in {u} | near[u, "POSITIVE"])) for u, kind in near if kind == "POSITIVE"}
    return {u: own[u].union(*(own[t] for t in closure(u) if t in own)) for u in own}


@pytest.mark.parametrize("members, share", [(graph.MEMBERS, graph.SHARE), (7, 3)])
def test_ignored_rows_by_definition(spark, monkeypatch, members, share):
    monkeypatch.setattr(graph, "MEMBERS", members)
    monkeypatch.setattr(graph, "SHARE", share)
    rows = drawn_links(3, 90, 70)
    links = spark.createDataFrame(rows, "img1 long, img2 long, type string")
    want = ignored_by_definition(rows)
    got = [tuple(r) for r in graph.ignore_closure(links).collect()]
    assert len(got) == len(set(got)) and set(got) == {(u, m) for u in want for m in want[u]}
    assert dict(graph.ignored_counts(links).collect()) == {u: len(want[u]) for u in want}


def test_ignored_rows_of_a_large_component_are_made_once(spark):
    n = 1_500  # by way of each member's own rows they would be made n times each
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("img1"), F.col("id").alias("img2"), F.lit("DUPLICATE").alias("type"))
    links = links.unionByName(spark.range(0, n, 2).select(F.col("id").alias("img1"), (F.col("id") + 1).alias("img2"), F.lit("POSITIVE").alias("type")))
    assert graph.ignored_groups(links)[1].count() == 1
    assert graph.ignore_closure(links).count() == n * n


def test_benchmark_ignores_no_target(spark, monkeypatch):
    monkeypatch.setattr(graph, "MEMBERS", 5)
    monkeypatch.setattr(graph, "SHARE", 4)
    rows = drawn_links(5, 80, 70)
    links = spark.createDataFrame(rows, "img1 long, img2 long, type string")
    want = {(u, m) for u, x in ignored_by_definition(rows).items() for m in x}
    want -= {(x, y) for a, b, kind in rows if kind == "POSITIVE" for x, y in ((a, b), (b, a))}
    got = [tuple(r) for r in graph.benchmark_ignored(links).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_ignored_rows_of_a_benchmark_are_made_once(spark):
    n = 1_500
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("img1"), F.col("id").alias("img2"), F.lit("DUPLICATE").alias("type"))
    links = links.unionByName(spark.range(0, n, 2).select(F.col("id").alias("img1"), (F.col("id") + 1).alias("img2"), F.lit("POSITIVE").alias("type")))
    assert graph.benchmark_ignored(links).count() == n * n - n


def test_ignored_rows_are_packed_when_written(spark, tmp_path):
    n = 2_500  # the rows grow with the square of a component: at 1 GB over 10 GB were written
    links = spark.range(1, n).select(F.lit(0).cast("long").alias("img1"), F.col("id").alias("img2"), F.lit("DUPLICATE").alias("type"))
    links = links.unionByName(spark.range(0, n, 2).select(F.col("id").alias("img1"), (F.col("id") + 1).alias("img2"), F.lit("POSITIVE").alias("type")))
    graph.benchmark_ignored(links).write.parquet(f"{tmp_path}/ignored")
    assert spark.read.parquet(f"{tmp_path}/ignored").distinct().count() == n * n - n
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < 0.5 * n * n


def test_ignored_pairs_are_found_without_all_ignored_rows(spark):
    rows = drawn_links(7, 80, 70)
    links = spark.createDataFrame(rows, "img1 long, img2 long, type string")
    want = {(u, m) for u, x in ignored_by_definition(rows).items() for m in x}
    asked = [(u, m) for u in range(80) for m in range(0, 80, 3)]
    got = graph.ignored_among(links, spark.createDataFrame(asked, "query_id long, uid long"))
    assert {tuple(r) for r in got.collect()} == want & set(asked)


@pytest.fixture
def crowded(spark, tmp_path):
    """A folder of vectors of which a third are linked into one large component."""
    rng = np.random.default_rng(8)
    x = rng.standard_normal((150, 64))
    x[:50] = x[0] + 0.95 * x[:50]
    rows = [(i, [float(t) for t in v / np.linalg.norm(v)], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    return str(tmp_path)


def plain_truth(spark, sf):
    links = T.links(spark, sf)
    return T.results(spark, sf, links), graph.benchmark_targets(links), graph.benchmark_ignored(links)


def refused(*_):
    raise AssertionError("all ignored rows were asked for")


@pytest.mark.parametrize("name", ["eval_ap", "eval_mean_ap", "eval_final_pr", "eval_pr_thresholds", "eval_recall_at_n", "target_positions"])
def test_evaluation_without_all_ignored_rows(spark, crowded, monkeypatch, name):
    with monkeypatch.context() as m:
        m.setattr(graph, "_expanded", refused)
        got = sorted(map(str, catalog.QUERIES[name](spark, crowded).collect()))
    monkeypatch.setattr(catalog, "_truth", plain_truth)
    assert got and got == sorted(map(str, catalog.QUERIES[name](spark, crowded).collect()))


@pytest.mark.parametrize("shard", [1_000, 40])
def test_blocked_search_marks_and_keeps(spark, monkeypatch, shard):
    monkeypatch.setattr(search, "SHARD", shard)
    rng = np.random.default_rng(12)
    x = rng.integers(-2, 3, (120, 4)).astype(float)  # whole numbers: many ties, exact scores
    index = spark.createDataFrame([(i, [float(t) for t in v], i % 5) for i, v in enumerate(x)], "uid long, features array<double>, component long")
    queries = spark.createDataFrame([(i, [float(t) for t in x[i]], i % 5, 7 + i) for i in range(0, 120, 7)], "query_id long, features array<double>, component long, depth int")
    skip = spark.createDataFrame([(0, 0), (0, 3), (1, 2), (4, 4)], "component long, other long")
    keep = spark.createDataFrame([(q, u) for q in range(0, 120, 7) for u in range(0, 120, 2)], "query_id long, uid long")
    pairs_ = {(0, 0), (0, 3), (1, 2), (4, 4)}
    want = []
    for q in range(0, 120, 7):
        best = sorted(range(120), key=lambda u: (-(x[u] @ x[q]), u))[: 7 + q]
        want += [(q, r + 1, u, float(x[u] @ x[q]), (q % 5, u % 5) in pairs_) for r, u in enumerate(best)]
    assert sorted(map(tuple, search.search_many(index, queries, None, skip).collect())) == want
    assert sorted(map(tuple, search.search_many(index, queries, None, skip, keep).collect())) == [w for w in want if not w[4] or w[2] % 2 == 0]


def test_only_nodes_with_a_quota_are_searched(spark, crowded):
    links = T.links(spark, crowded)
    some = mining.negative_quotas(links, 9)
    assert some.count() == 9 and graph.nodes(links).count() > 9
    found = catalog._all_results(spark, crowded, links, 9)
    assert {r.query_id for r in found.select("query_id").distinct().collect()} == {r.uid for r in some.collect()}
    every = mining.hard_negatives(links, catalog._all_results(spark, crowded, links), 9, "h").collect()
    assert every and sorted(every) == sorted(mining.hard_negatives(links, found, 9, "h").collect())


def test_triplets_without_all_ignored_rows(spark, crowded, monkeypatch):
    links = T.links(spark, crowded)
    every = T.triplet_results(spark, crowded, links, 5)
    want = sorted(mining.triplets(links, every, 5, 0.1, "t").collect())
    monkeypatch.setattr(graph, "_expanded", refused)
    fair = T.fair_results(spark, crowded, links, 5)
    assert 0 < fair.count() < every.count()
    assert want and want == sorted(catalog.QUERIES["triplet_candidates"](spark, crowded).collect())


def test_lsh_pairs_are_not_listed_by_bucket(spark, monkeypatch):
    rows, x = vectors(spark, 300)
    points = rows.select("uid", pairs.array_to_vector(V.unit(F.col("features"))).alias("v"))
    model = pairs.BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=0.2, numHashTables=2, seed=7).fit(points)
    near = model.approxSimilarityJoin(points, points, 1.0, "d").where("datasetA.uid < datasetB.uid")
    want = {(r.i, r.j): r.d**2 / 2 for r in near.select(F.col("datasetA.uid").alias("i"), F.col("datasetB.uid").alias("j"), "d").collect()}
    listed = []
    monkeypatch.setattr(type(model), "approxSimilarityJoin", lambda self, *a, join=type(model).approxSimilarityJoin: listed.append(1) or join(self, *a))
    got = {(r.i, r.j): r.dist for r in pairs.lsh_pairs(rows, 0.5, 2, 0.2).collect()}
    assert got and got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in got)
    assert len(got) < pairs.within(rows, 0.5).count() and not listed


def ap(ranked, targets, ignored):
    hits, j, before, total = 0, 0, 1.0, 0.0
    for u in ranked:
        if u in ignored:
            continue
        j += 1
        hits += u in targets
        if u in targets:
            total += (before + hits / j) / 2
        before = hits / j
    return total / len(targets)


def test_average_precision_by_hand(spark):
    lists = {1: [9, 4, 8, 5, 6], 2: [9, 9], 3: []}
    truth = {1: {4, 6, 77}, 2: {5}, 3: {1}}
    ignored = {1: {9, 8}, 2: set(), 3: set()}
    results = spark.createDataFrame([(q, r + 1, u, 1.0 / (r + 1)) for q, us in lists.items() for r, u in enumerate(us)], "query_id long, rank int, uid long, score double")
    t = spark.createDataFrame([(q, u) for q, us in truth.items() for u in us], "query_id long, uid long")
    i = spark.createDataFrame([(q, u) for q, us in ignored.items() for u in us], "query_id long, uid long")
    got = {r.query_id: r.ap for r in evaluation.average_precision(results, t, i).collect()}
    for q in lists:
        assert got[q] == pytest.approx(ap(lists[q], truth[q], ignored[q]))
    end = {r.query_id: (r.precision, r.recall) for r in evaluation.final_precision_recall(results, t, i).collect()}
    assert end[3] == (1.0, 0.0) and end[1] == pytest.approx((2 / 3, 2 / 3))
    assert evaluation.recall_at(results, t, i, 2).first().recall == pytest.approx((1 / 3) / 3)
    where = {(r.query_id, r.uid): r.position for r in evaluation.target_positions(results, t, i).collect()}
    assert where[1, 4] == 1 and where[1, 6] == 3 and where[1, 77] is None


def test_quotas(spark):
    keys = spark.createDataFrame([(i,) for i in (5, 1, 3)], "uid long")
    assert dict(mining.quotas(keys, "uid", 7).collect()) == {1: 3, 3: 2, 5: 2}


def test_mining_searches_as_deep_as_the_exclusions_ask_for(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((900, 64))
    x[:450] = x[0]  # copies fill the first 450 results of each other
    x[450] = 0.4 * x[0] + 0.9 * x[450]
    rows = [(i, [float(t) for t in v / np.linalg.norm(v)], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    links = spark.createDataFrame([(0, i, "DUPLICATE") for i in range(1, 450)] + [(0, 450, "POSITIVE")], "img1 long, img2 long, type string")
    hard = mining.hard_negatives(links, catalog._all_results(spark, str(tmp_path), links), 451, "h").collect()
    assert {r.a for r in hard if r.a < 2} == {0, 1} and min(r.b for r in hard if r.a == 0) > 450
    depths = dict(mining.triplet_depth(links, 5, 400).collect())
    assert depths == {0: 461, 450: 461}
    found = T.triplet_results(spark, str(tmp_path), links, 5)
    assert dict(found.groupBy("query_id").count().collect()) == depths
    assert {r.query_id for r in mining.triplets(links, found, 5, 0.5, "t").collect()} >= {0}


def test_codec_cases(spark):
    rows = [(1, 1, 1, 4, [0.0, 2.0, 0.0, 3.0]), (2, 1, 1, 4, [5.0] * 4), (3, 1, 1, 4, [0.0] * 4)]
    maps = spark.createDataFrame(rows, "uid long, h int, w int, c int, data array<double>")
    codes = {r.uid: r for r in featuremaps.encoded(maps).collect()}
    assert codes[1].gaps == [1, 2] and codes[1].width == 8 and codes[3].gaps == [] and codes[3].width is None
    back = {r.uid: r.data for r in featuremaps.decoded(featuremaps.encoded(maps)).collect()}
    assert np.allclose(back[1], rows[0][4], atol=1 / 510) and back[2] == [5.0] * 4 and back[3] == [0.0] * 4
    gap = lambda n: spark.range(1).select(V.delta_width(F.array(F.lit(n)))).first()[0]
    assert [gap(n) for n in (255, 256, 65534, 65535, 65536)] == [8, 16, 16, 16, 32]


def test_window_search_matches_plain_loops():
    data = np.random.default_rng(3).random((5, 6, 2))
    sums = region.integral_image(data)
    query = region.describe(sums, 1, 1, 3, 4)[0]
    best = (-np.inf, None)
    for y2 in range(6):
        for x2 in range(7):
            for y1 in range(y2):
                for x1 in range(x2):
                    if y2 - y1 < 2 or x2 - x1 < 2 or not 0.8 < (y2 - y1) / (x2 - x1) / (2 / 3) < 1.2:
                        continue
                    ym, xm = y1 + region.half_even((y2 - y1) / 2), x1 + region.half_even((x2 - x1) / 2)
                    q = np.concatenate([data[a:b, c:d].sum(axis=(0, 1)) for a, b, c, d in ((y1, ym, x1, xm), (ym, y2, x1, xm), (ym, y2, xm, x2), (y1, ym, xm, x2))])
                    s = q / np.sqrt((q**2).sum() + 0.01) @ query
                    if s > best[0] + 1e-12:
                        best = (s, (y1 / 5, x1 / 6, (y2 - y1) / 5, (x2 - x1) / 6))
    got = region.best_window(data, query, 2 / 3)
    assert got[0] == pytest.approx(best[0]) and got[1] == pytest.approx(best[1])
    assert region.best_window(data, query, float("nan"))[0] == -np.inf
    assert [region.half_even(s / 2) for s in (2, 3, 5, 7)] == [1, 2, 2, 4]


def test_matching_finds_identity_and_flip():
    m = np.random.default_rng(5).standard_normal((9, 9, 16))
    n, _, box = matching.match(m, m)
    assert n >= 49 and box == pytest.approx((1 / 9, 1 / 9, 7 / 9, 7 / 9))
    assert matching.match(m, m[:, ::-1])[0] >= 40
    assert matching.match(np.zeros((2, 2, 3)), m) == (0, (0.0, 0.0, 1.0, 1.0), (0.0, 0.0, 1.0, 1.0))


def _embeddings(spark, path, n, seed=8):
    x = np.random.default_rng(seed).standard_normal((n, 64))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    spark.createDataFrame([(i, [float(t) for t in v], 0) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return x.astype(float)


def test_map_0_is_matched_with_every_map(spark, tmp_path):
    maps = _embeddings(spark, tmp_path, 130).reshape(-1, 4, 4, 4)
    points = {b: matching.candidates(maps[0], m) for b, m in enumerate(maps)}
    got = [tuple(r) for r in catalog.QUERIES["mutual_matches"](spark, str(tmp_path)).select("a", "b", "y1", "x1", "y2", "x2").collect()]
    assert sorted(got) == sorted((0, b, *p) for b, ps in points.items() for p in ps.tolist())
    counted = {r.b: r.n_matches for r in catalog.QUERIES["match_inliers"](spark, str(tmp_path)).collect()}
    assert counted == {b: int(matching.inliers(ps).sum()) for b, ps in points.items()} and len(counted) == 130
    votes = {r.b for r in catalog.QUERIES["hough_votes"](spark, str(tmp_path)).collect()}
    assert votes == {b for b, ps in points.items() if len(ps)} and max(votes) > 99


def test_rows_past_a_short_list_can_win(spark, tmp_path):
    x = _embeddings(spark, tmp_path, 400)
    first = sorted(range(400), key=lambda i: (-round(float(x[i] @ x[0]), 12), i))
    maps = x.reshape(-1, 4, 4, 4)
    counted = {i: matching.match(maps[0], maps[i])[0] for i in range(400)}
    want = sorted(first, key=lambda i: -counted[i])[:20]
    assert [r.uid for r in catalog.QUERIES["rerank"](spark, str(tmp_path)).orderBy("rank").collect()] == want
    assert not set(want) <= set(first[:60])
    maps = np.maximum(maps, 0)
    query = region.describe(region.integral_image(maps[0]), 0, 0, 2, 2)[0]
    score = {i: region.best_window(maps[i], query, 1.0)[0] for i in range(400)}
    want = sorted(range(400), key=lambda i: (-score[i], i))[:50]
    assert [r.uid for r in catalog.QUERIES["search_region"](spark, str(tmp_path)).orderBy("rank").collect()] == want
    assert not set(want) <= set(first[:200])


def test_candidates_come_of_reranked_searches(spark):
    m = np.random.default_rng(9).standard_normal((120, 64))
    maps = spark.createDataFrame([(i, 4, 4, 4, [float(t) for t in v]) for i, v in enumerate(m)], "uid long, h int, w int, c int, data array<double>")
    results = spark.createDataFrame([(q, r + 1, (q + r) % 120) for q in (3, 50) for r in range(120)], "query_id long, rank int, uid long")
    found = matching.rerank_many(maps, results, 21)
    got = {q: [r.uid for r in found.where(F.col("query_id") == q).orderBy("rank").collect()] for q in (3, 50)}
    for q in got:
        counted = {i: matching.match(m[q].reshape(4, 4, 4), m[i].reshape(4, 4, 4))[0] for i in range(120)}
        assert got[q] == sorted(((q + r) % 120 for r in range(120)), key=lambda i: -counted[i])[:21]
    links = spark.createDataFrame([(3, 50, "POSITIVE")], "img1 long, img2 long, type string")
    pairs_ = {(r.a, r.b) for r in mining.candidate_pairs(links, found).collect()}
    assert pairs_ == {(min(q, u), max(q, u)) for q in got for u in got[q] if u != q}
    assert pairs_ != {(r.a, r.b) for r in mining.candidate_pairs(links, results).collect()}


@pytest.mark.parametrize("shape", [(4, 4, 4), (6, 6, 3), (4, 7, 2), (2, 2, 3)])
def test_many_maps_are_matched_as_one_by_one(shape):
    rng = np.random.default_rng(4)
    maps = rng.standard_normal((400, *shape))
    maps[50:150] = np.round(maps[50:150])  # equal distances and cells without a length
    maps[150:160] = 0.0
    maps[160:170] = maps[0]
    maps[170, -2, -2] = np.nan
    for a in (0, 60, 151, 170):
        assert matching.inlier_counts(maps[a], maps, {}).tolist() == [matching.match(maps[a], m)[0] for m in maps]


@pytest.mark.parametrize("shard", [1_000, 40])
def test_candidates_are_not_matched_one_by_one(spark, tmp_path, monkeypatch, shard):
    x = _embeddings(spark, tmp_path, 150)
    links = T.links(spark, str(tmp_path)).unionByName(spark.createDataFrame([(3, 50, "POSITIVE", 0.6), (7, 3, "POSITIVE", 0.6)], "img1 long, img2 long, type string, dist double"))
    maps, asked = x.reshape(-1, 4, 4, 4), {i for r in links.where("type = 'POSITIVE'").collect() for i in (r.img1, r.img2)}
    want = set()
    for q in asked:
        first = sorted(range(150), key=lambda i: (-float(x[i] @ x[q]), i))
        counted = [matching.match(maps[q], m)[0] for m in maps]
        want |= {(min(q, u), max(q, u)) for u in sorted(first, key=lambda i: -counted[i])[:21] if u != q}
    for module in (matching, search):  # the larger shard takes no table of shortlists
        monkeypatch.setattr(module, "SHARD", shard)
    monkeypatch.setattr(matching, "matched", refused)
    monkeypatch.setattr(T, "links", lambda *_: links)
    got = [tuple(r) for r in catalog.QUERIES["candidate_pairs"](spark, str(tmp_path)).select("a", "b").collect()]
    assert len(asked) >= 3 and sorted(got) == sorted(want)


def test_keypoint_features(spark):
    rng = np.random.default_rng(2)
    pts = rng.random((30, 2)) * 100
    desc = rng.standard_normal((30, 8))
    rows = [(1, i, float(x), float(y), [float(t) for t in d]) for i, ((x, y), d) in enumerate(zip(pts, desc))]
    rows += [(2, i, float(x) * 2 + 5, float(y) * 2 - 3, [float(t) for t in d]) for i, ((x, y), d) in enumerate(zip(pts, desc))]
    rows += [(3, 0, 1.0, 1.0, [1.0] * 8)]
    points = spark.createDataFrame(rows, "uid long, kp int, x double, y double, desc array<double>")
    got = {(r.a, r.b): r for r in keypoints.pair_features(points, spark.createDataFrame([(1, 2), (1, 3)], "a long, b long")).collect()}
    assert got[1, 2].f[:3] == [30.0, 30.0, 30.0] and got[1, 2].f[5:] == [1.0] * 5 and got[1, 3].f is None


def test_features_of_pairs_of_different_images(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((64, 64))
    x[16:32] = x[:16].reshape(4, 4, 64)[:, ::-1].reshape(16, 64)  # image 1 is image 0 mirrored; 2 and 3 are others
    rows = [(i, [float(t) for t in v], 0) for i, v in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r for r in catalog.QUERIES["duplicate_pair_features"](spark, str(tmp_path)).collect()}
    assert set(got) == {(0, 1), (1, 2), (2, 3), (0, 0), (1, 1), (2, 2), (3, 3)}
    assert got[0, 1].f == pytest.approx([16.0, 16.0, 16.0, 1.0, 1.0] + [1.0] * 5) and got[1, 2].f is None


def test_trees_are_chosen_over_the_whole_grid(spark, monkeypatch):
    class Asked(Exception):
        pass

    def validator(**given):
        raise Asked(given["numFolds"], [{p.name: v for p, v in point.items()} for point in given["estimatorParamMaps"]])

    rows = spark.createDataFrame([([1.0] * 10, 1.0)], "f array<double>, label double")
    monkeypatch.setattr(catalog, "_duplicate_rows", lambda spark, sf: rows)
    monkeypatch.setattr(classes, "CrossValidator", validator)
    with pytest.raises(Asked) as asked:
        catalog.QUERIES["gbt_duplicates"](spark, "")
    assert asked.value.args == (10, [{"maxDepth": 2, "maxIter": 10}, {"maxDepth": 3, "maxIter": 10}])


def test_text_functions(spark):
    row = spark.range(1).select(
        X.image_path(F.lit("abcdef")), X.unquoted(F.lit("a%20b+c")), X.file_stem(F.lit("/x/y.z/pic.tar.jpg")), X.url_safe_base64(F.lit("_-8=")),
        X.fitted_size(F.lit(100), F.lit(100), 10)["width"], X.stepped_size(F.lit(200), F.lit(100), 320, 32)["width"], X.grid_side(F.lit(50), F.lit(100), F.lit(7)),
    ).first()
    assert list(row) == ["a/b/cdef.jpg", "a b+c", "pic.tar", bytearray(b"\xff\xef"), 10, 160, 4]


def test_index_lifecycle_and_stream(spark, tmp_path):
    rows, _ = vectors(spark, 20)
    path = f"{tmp_path}/index"
    index.build(rows.where("uid < 10"), path)
    with pytest.raises(Exception, match="exists|PATH_ALREADY_EXISTS"):
        index.build(rows, path)
    rows.where("uid >= 5").write.parquet(f"{tmp_path}/incoming")
    append_stream(spark, f"{tmp_path}/incoming", path, f"{tmp_path}/state").awaitTermination()
    assert index.open_index(spark, path).count() == 20
    index.append(rows.limit(1), path)
    assert index.open_index(spark, path).count() == 21
    index.add_half_dimensions(spark, path)
    assert len(index.open_index(spark, path, index.HALF).first().features) == 2


def test_files_and_locations(spark, tmp_path):
    paths = spark.createDataFrame([("a", "/p/a.jpg"), ("b", None)], tables.PATHS)
    tables.write_csv(paths.where("path is not null"), f"{tmp_path}/c")
    assert tables.read_csv(spark, f"{tmp_path}/c", tables.PATHS).collect()[0].path == "/p/a.jpg"
    tables.write_json(paths, f"{tmp_path}/j")
    assert tables.read_json(spark, f"{tmp_path}/j", tables.PATHS).count() == 2
    assert locations.usable(paths, ["/q"]).count() == 1 and locations.usable(paths, ["/p/a.jpg"]).count() == 0
    split = tables.from_split_codes(spark.createDataFrame([("/a/x.png", 3, 2)], "path string, author int, code int")).first()
    assert (split.uid, split.class_id, split.split) == ("x", 2, "validation")
    items = spark.createDataFrame([(1, 0), (2, 1)], "uid long, class_id int")
    assert classes.dense(items) and not classes.dense(items.where("class_id = 1"))
