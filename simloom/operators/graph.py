"""Typed link graphs: tables (img1, img2, type), type POSITIVE, NEGATIVE or DUPLICATE."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.numbering import numbered
from simloom.functions.workspace import materialize
from simloom.operators.components import connected_components

POSITIVE, NEGATIVE, DUPLICATE = "POSITIVE", "NEGATIVE", "DUPLICATE"


def build_graph(links: DataFrame, order: str) -> DataFrame:
    """One link for each unordered pair: the one of greatest ``order``. Loops stay."""
    pair = links.withColumn("u", F.least("img1", "img2")).withColumn("v", F.greatest("img1", "img2"))
    last = Window.partitionBy("u", "v").orderBy(F.desc(order), F.desc("type"))
    return pair.withColumn("r", F.row_number().over(last)).where("r = 1").select(F.col("u").alias("img1"), F.col("v").alias("img2"), "type")


def of_types(links: DataFrame, types: list[str], known: DataFrame | None = None) -> DataFrame:
    """Links of some types, without those of unknown nodes."""
    out = links.where(F.col("type").isin(types))
    if known is not None:
        out = out.join(known.select(F.col("uid").alias("img1")), "img1", "left_semi").join(known.select(F.col("uid").alias("img2")), "img2", "left_semi")
    return out


def nodes(links: DataFrame) -> DataFrame:
    """(uid) of all ends of links."""
    return links.select(F.col("img1").alias("uid")).unionByName(links.select(F.col("img2").alias("uid"))).distinct()


def neighbours(links: DataFrame, kind: str | None = None) -> DataFrame:
    """(uid, other) in both directions."""
    some = links.where(F.col("type") == kind) if kind else links
    return some.select(F.col("img1").alias("uid"), F.col("img2").alias("other")).unionByName(some.select(F.col("img2").alias("uid"), F.col("img1").alias("other"))).distinct()


def degrees(links: DataFrame) -> DataFrame:
    """(uid, degree): how many different nodes each node is linked with; a loop counts as one."""
    return neighbours(links).groupBy("uid").agg(F.count("*").alias("degree"))


def has_edge(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs (a, b) with ``linked``: whether a link joins them, in either direction."""
    known = neighbours(links).select(F.col("uid").alias("a"), F.col("other").alias("b"), F.lit(True).alias("linked"))
    return pairs.join(known, ["a", "b"], "left").withColumn("linked", F.coalesce("linked", F.lit(False)))


def physical_closure(links: DataFrame) -> DataFrame:
    """(uid, component): the least node that each node is joined with by DUPLICATE links, itself if none."""
    joined = connected_components(links.where(F.col("type") == DUPLICATE), "img1", "img2").withColumnRenamed("node", "uid")
    return nodes(links).join(joined, "uid", "left").select("uid", F.coalesce("component", "uid").alias("component"))


def ignored_groups(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What searches ignore, by components: (uid, component, asked) of the physical closure, and (component, other).

    A node is ``asked`` if it has a POSITIVE link. It ignores the members of its own
    component and of those that a POSITIVE link joins with it, whichever member has the
    link, so all asked nodes of a component ignore the same. There are at most as many
    pairs of components as links and components.
    """
    positive = neighbours(links, POSITIVE)
    asked = positive.select("uid", F.lit(True).alias("asked")).distinct()
    placed = materialize(physical_closure(links).join(asked, "uid", "left").select("uid", "component", F.coalesce("asked", F.lit(False)).alias("asked")), "closure")
    ends = placed.select("uid", "component"), placed.select(F.col("uid").alias("other"), F.col("component").alias("far"))
    linked = positive.join(ends[0], "uid").join(ends[1], "other").select("component", F.col("far").alias("other"))
    own = placed.where("asked").select("component", F.col("component").alias("other"))
    return placed, materialize(linked.unionByName(own).distinct(), "groups")


def ignored_counts(links: DataFrame) -> DataFrame:
    """(uid, n): how many rows ``ignore_closure`` has for each node."""
    placed, groups = ignored_groups(links)
    sizes = placed.groupBy(F.col("component").alias("other")).agg(F.count("*").alias("n"))
    each = groups.join(sizes, "other").groupBy("component").agg(F.sum("n").alias("n"))
    return placed.where("asked").join(each, "component").select("uid", "n")


#: Members of an array (64 steps at most), asked nodes that meet arrays at once and from which on a component is large, members of a
#: part, and of the steps in which arrays lose members (Parquet packs 8 values to whole bytes).
MEMBERS, SHARE, PART, STEP = 256, 256, 1_024, 8
#: Arrays and shares that meet in a task, about.
MEETINGS = 1_024


def _products(placed: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(key, uid) of members, the same of asked nodes, and the pairs of components left.

    Each asked node of a key ignores all members of it. A key is a large component with its asked nodes
    and whatever they ignore, or with its members and the asked nodes of small components that ignore it.
    A row stands for ``SHARE`` rows of the result at least, so there are few.
    """
    sizes = placed.groupBy("component").agg(F.count("*").alias("n"), F.count_if("asked").alias("m")).where(F.col("n") >= SHARE)
    large = materialize(sizes.select("component", (F.col("m") >= SHARE).alias("asks")), "large")  # at most one in SHARE nodes
    asks = F.broadcast(large.where("asks").select("component", F.lit(True).alias("asks")))
    holds = F.broadcast(large.select(F.col("component").alias("other"), F.lit(True).alias("holds")))
    marked = groups.join(asks, "component", "left").join(holds, "other", "left")
    whole, turned = marked.where("asks"), marked.where("asks is null and holds")
    everyone = placed.select("uid", F.col("component").alias("other"))
    asked = placed.where("asked").select("uid", "component")
    key = [F.struct(F.lit(side).alias("turned"), F.col(c).alias("root")).alias("key") for side, c in ((False, "component"), (True, "other"))]
    members = whole.join(everyone, "other").select(key[0], "uid").unionByName(turned.select("other").distinct().join(everyone, "other").select(key[1], "uid"))
    queries = asked.join(asks, "component").select(key[0], "uid").unionByName(turned.join(asked, "component").select(key[1], "uid"))
    return members, queries, marked.where("asks is null and holds is null").select("component", "other")


def _dealt(rows: DataFrame, size: int, to: str) -> DataFrame:
    """(key, ``to``, uids): arrays of about ``size`` ids, in order."""
    sizes = F.broadcast(rows.groupBy("key").agg(F.ceil(F.count("*") / size).alias("of")))
    return rows.join(sizes, "key").groupBy("key", F.pmod(F.xxhash64("uid"), F.col("of")).alias(to)).agg(F.sort_array(F.collect_list("uid")).alias("uids"))


def _cut(uids: Column) -> Column:
    """Arrays of ``MEMBERS`` ids; all lengths but the last are multiples of ``STEP``."""
    even = F.size(uids) - F.size(uids) % STEP
    starts = F.when(even > 0, F.sequence(F.lit(1), even, F.lit(MEMBERS))).otherwise(F.array().cast("array<int>"))
    full = F.transform(starts, lambda s: F.slice(uids, s, F.least(F.lit(MEMBERS), even + 1 - s)))
    return F.filter(F.concat(full, F.array(F.slice(uids, even + 1, STEP))), lambda a: F.size(a) > 0)


def _expanded(links: DataFrame, without: DataFrame | None = None) -> DataFrame:
    """(uid, member) of ``ignored_groups``, less the rows (uid, other) of ``without``. Each row is made once.

    The rows grow with the square of a component and are written in an order that Parquet packs well.
    Arrays of members meet shares of the asked nodes: a node stays for a whole array, the next one repeats
    it, and a task holds few arrays with all their shares. Of an array that holds rows of ``without``, steps of ``STEP``
    members are left out, so that the others still repeat; what is left of those steps comes by itself.
    """
    placed, groups = ignored_groups(links)
    members, queries, rest = _products(placed, groups)
    parts = _dealt(members, PART, "part").select("key", "part", F.posexplode(_cut(F.col("uids"))).alias("piece", "members"))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.size("members") / STEP).cast("int") - 1), lambda i: F.slice("members", i * STEP + 1, STEP))
    pieces = materialize(parts.select("key", F.struct("part", "piece").alias("piece"), "members", steps.alias("steps")), "pieces")
    shares = materialize(_dealt(queries, SHARE, "share").withColumnRenamed("uids", "queries"), "shares")
    grid = pieces.select("key", "piece").join(shares.select("key", "share"), "key")
    tasks = max(int(links.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-grid.count() // MEETINGS))
    small = _of_small(placed, rest, without)
    if without is not None:
        asked = shares.select("key", "share", F.explode("queries").alias("uid"))
        each = pieces.select("key", "piece", F.posexplode("steps").alias("step", "members"))
        at = each.select("key", "piece", "step", F.explode("members").alias("other"))
        met = without.join(asked, "uid").join(at, ["key", "other"]).groupBy("key", "piece", "share", "uid", "step").agg(F.collect_list("other").alias("without"))
        met = materialize(met, "met")
        small = small.unionByName(each.join(met, ["key", "piece", "step"]).select("uid", F.explode(F.array_except("members", "without")).alias("member")))
        gaps = met.groupBy("key", "piece", "share", "uid").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("gap"))
        gaps = gaps.groupBy("key", "piece", "share").agg(F.map_from_entries(F.collect_list(F.struct("uid", "gap"))).alias("gaps"))
        grid = grid.join(gaps, ["key", "piece", "share"], "left")
    meets = grid.join(shares, ["key", "share"]).repartition(tasks, "key", "piece").join(pieces.repartition(tasks, "key", "piece"), ["key", "piece"])
    gap = [] if without is None else [F.coalesce(F.try_element_at("gaps", F.col("uid")), F.lit(0).cast("long")).alias("gap")]
    rows = meets.select("*", F.explode("queries").alias("uid")).select("uid", "members", *gap)
    rows = rows.select("uid", *["gap"] * len(gap), F.posexplode("members").alias("at", "member"))
    if without is not None:
        rows = rows.where(F.expr(f"shiftright(gap, int(at / {STEP})) & 1 = 0"))
    return rows.select("uid", "member").unionByName(small)


def _of_small(placed: DataFrame, groups: DataFrame, without: DataFrame | None) -> DataFrame:
    """The rows of ``_expanded`` of pairs of components none of which is large."""
    arrays = placed.groupBy(F.col("component").alias("other")).agg(F.collect_list("uid").alias("members"))
    lists = groups.join(arrays, "other").select("component", "members")
    asked, members = placed.where("asked").select("uid", "component"), F.col("members")
    if without is not None:
        asked = asked.join(without.groupBy("uid").agg(F.collect_list("other").alias("without")), "uid", "left")
        members = F.when(F.col("without").isNull(), members).otherwise(F.array_except("members", "without"))
    return asked.join(lists, "component").select("uid", F.explode(members).alias("member"))


def ignore_closure(links: DataFrame) -> DataFrame:
    """(uid, member): what a search for a node must neither count for nor against.

    For nodes with a POSITIVE link: the closures of the node and of its positive
    neighbours; then the same sets of the other members of the node's closure.
    Other nodes have none. The rows grow with the square of a component's size;
    ``ignored_groups`` says the same in rows that grow with the links.
    """
    return _expanded(links)


def benchmark_targets(links: DataFrame) -> DataFrame:
    """(query_id, uid): each node with POSITIVE links is a query, the neighbours are its targets."""
    return neighbours(links, POSITIVE).select(F.col("uid").alias("query_id"), F.col("other").alias("uid"))


def benchmark_ignored(links: DataFrame) -> DataFrame:
    """(query_id, uid): what a query ignores, its targets aside."""
    return _expanded(links, neighbours(links, POSITIVE)).select(F.col("uid").alias("query_id"), F.col("member").alias("uid"))


def ignored_among(links: DataFrame, pairs: DataFrame) -> DataFrame:
    """(query_id, uid): those of the different ``pairs`` (query_id, uid) that ``ignore_closure`` has."""
    placed, groups = ignored_groups(links)
    asked = placed.where("asked").select(F.col("uid").alias("query_id"), "component")
    there = placed.select("uid", F.col("component").alias("other"))
    each = pairs.select("query_id", "uid").distinct().join(asked, "query_id").join(there, "uid")
    return each.join(groups, ["component", "other"], "left_semi").select("query_id", "uid")


def uniform(seed: str, *columns: str) -> Column:
    """A number in [0, 1) that only depends on the columns and a seed."""
    digest = F.md5(F.concat_ws("_", *(F.col(c).cast("string") for c in columns), F.lit(seed)))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / 4294967296.0


def split_components(links: DataFrame, share: float, seed: str = "split") -> DataFrame:
    """(uid, component, side): whole components go to side A with the probability ``share``, else to B."""
    parts = connected_components(links, "img1", "img2").withColumnRenamed("node", "uid")
    return parts.withColumn("side", F.when(uniform(seed, "component") < share, "A").otherwise("B"))


def with_positive(links: DataFrame) -> DataFrame:
    """Links of the components that hold a POSITIVE link."""
    parts = connected_components(links, "img1", "img2")
    placed = links.join(parts.withColumnRenamed("node", "img1"), "img1")
    good = placed.where(F.col("type") == POSITIVE).select("component").distinct()
    return placed.join(good, "component", "left_semi").select("img1", "img2", "type")


def component_statistics(links: DataFrame) -> DataFrame:
    """(component, members): sizes of the components."""
    return connected_components(links, "img1", "img2").groupBy("component").agg(F.count("*").alias("members"))


def duplicate_totals(scored: DataFrame, above: float = 0.9) -> DataFrame:
    """(links, share, images, objects) of candidate pairs (a, b, score): those above a score, their share of all, their images and components."""
    links = scored.where(F.col("score") > above).select("a", "b")
    parts = connected_components(links).agg(F.count("*").alias("images"), F.countDistinct("component").alias("objects"))
    counted = scored.agg(F.count_if(F.col("score") > above).alias("links"), F.avg((F.col("score") > above).cast("double")).alias("share"))
    return counted.join(parts, F.lit(True))  # one row each


def most_conflicts(conflicts: DataFrame, n: int = 10) -> DataFrame:
    """The n pairs of authors of ``attribution_conflicts`` that meet most often."""
    return conflicts.orderBy(F.desc("count"), "id1", "id2").limit(n)


def attribution_conflicts(members: DataFrame) -> DataFrame:
    """(id1, id2, count): in how many components two different authors id1 < id2 meet; ``members`` is (component, author).

    Authors of a component are made distinct first.
    """
    authors = members.where("author is not null").select("component", "author").distinct()
    other = authors.select("component", F.col("author").alias("id2"))
    return authors.withColumnRenamed("author", "id1").join(other, "component").where("id1 < id2").groupBy("id1", "id2").agg(F.count("*").alias("count"))


def dbscan(near: DataFrame, rows: DataFrame, least: int = 3) -> DataFrame:
    """(uid, cluster): density clusters. ``near`` is (i, j), the pairs i < j within reach; ``rows`` is (uid).

    A row with at least ``least`` rows within reach, itself included, is a core.
    Connected cores are a cluster; another row within reach of cores joins the one
    of lowest number. Clusters are numbered from 0 by their lowest core; noise is left out.
    """
    both = near.select(F.col("i").alias("uid"), F.col("j").alias("other")).unionByName(near.select(F.col("j").alias("uid"), F.col("i").alias("other")))
    degree = both.groupBy("uid").agg((F.count("*") + 1).alias("n"))
    cores = rows.select("uid").join(degree, "uid", "left").where(F.coalesce("n", F.lit(1)) >= least).select("uid")
    inner = near.join(cores.withColumnRenamed("uid", "i"), "i", "left_semi").join(cores.withColumnRenamed("uid", "j"), "j", "left_semi")
    joined = connected_components(inner, "i", "j").withColumnRenamed("node", "uid")
    placed = cores.join(joined, "uid", "left").select("uid", F.coalesce("component", "uid").alias("root"))
    numbers = numbered(placed.select("root").distinct(), "cluster", "root")
    core_cluster = placed.join(numbers, "root").select("uid", "cluster")
    border = both.join(cores, "uid", "left_anti").join(core_cluster.select(F.col("uid").alias("other"), "cluster"), "other").groupBy("uid").agg(F.min("cluster").alias("cluster"))
    return core_cluster.unionByName(border)
