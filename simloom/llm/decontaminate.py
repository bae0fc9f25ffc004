"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Words are lower-cased (A-Z) runs of digits, a-z and characters beyond ASCII.
A window is ``size`` consecutive words of an item; an item of fewer words, but
not none, is one window.

1. The frequency of each item word in the documents is counted.
2. The rarest word of each window is its probe. The postings of the probes, with
   text, place and the words beside, are stored. A posting and a probe give an
   alignment: item word k would stand at place shift + k of the text. It is kept
   where the neighbours that lie in the window agree.
3. In the texts that have alignments, the postings of all item words are
   intersected with the aligned places. Runs of at least a window of matched words
   are exact phrase matches.

A text is known by a digest, so copies of a text are looked at once, and
missing or repeated document ids do not matter. Null texts have no words; null
item ids count as the empty string; items are known by id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize

SIZE = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters between words, after lower-casing.
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: str) -> Column:
    """The words of a text column, in order; none for null."""
    return F.array_remove(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER), _GAP), "")


def text_id(text: str) -> Column:
    """Digest by which a text is known."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def item_words(items: DataFrame, key: str = "item_id", text: str = "text", size: int = SIZE) -> DataFrame:
    """(item, name, k, term, len): the words of each item by place, and the length of its windows."""
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    each = items.select(name.alias("name"), F.unhex(F.md5(F.concat_ws("\x00", name, F.col(text)).cast("binary"))).alias("item"), words(text).alias("w")).where(F.size("w") > 0).dropDuplicates(["item"])
    return each.select("item", "name", F.least(F.size("w"), F.lit(size)).alias("len"), F.size("w").alias("n"), F.posexplode("w").alias("k", "term"))


def frequencies(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, f): how often each of ``terms`` occurs in the documents; 0 if never."""
    seen = docs.select(F.explode(words(text)).alias("term")).join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("f"))
    return terms.join(seen, "term", "left").select("term", F.coalesce("f", F.lit(0)).alias("f"))


def probes(placed: DataFrame, counted: DataFrame) -> DataFrame:
    """(item, k, term, before, after): the rarest word of each window, with the neighbours that lie in the window (null: outside).

    Windows without a word that occurs need no probe.
    """
    by_place = Window.partitionBy("item").orderBy("k")
    known = placed.join(counted, "term").withColumn("before", F.lag("term").over(by_place)).withColumn("after", F.lead("term").over(by_place))
    starts = F.sequence(F.greatest(F.lit(0), F.col("k") - F.col("len") + 1), F.least(F.col("k"), F.col("n") - F.col("len")))
    inside = known.withColumn("s", F.explode(starts))
    rarest = Window.partitionBy("item", "s").orderBy("f", "k")
    least = inside.withColumn("r", F.row_number().over(rarest)).where((F.col("r") == 1) & (F.col("f") > 0))
    return least.select(
        "item", "k", "term",
        F.when(F.col("k") > F.col("s"), F.col("before")).alias("before"),
        F.when(F.col("k") < F.col("s") + F.col("len") - 1, F.col("after")).alias("after"),
    ).distinct()


def postings(docs: DataFrame, terms: DataFrame, text: str = "text") -> DataFrame:
    """(term, text_id, place, before, after): each place of ``terms`` in the texts, with the words beside it."""
    split = docs.select(text_id(text).alias("text_id"), words(text).alias("w"))
    beside = F.arrays_zip("w", F.concat(F.array(F.lit("")), F.col("w")).alias("b"), F.concat(F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))), F.array(F.lit(""))).alias("a"))
    each = split.where(F.size("w") > 0).select("text_id", F.posexplode(beside).alias("place", "x"))
    return each.select(F.col("x.w").alias("term"), "text_id", "place", F.col("x.b").alias("before"), F.col("x.a").alias("after")).join(terms, "term", "left_semi")


def matches(docs: DataFrame, items: DataFrame, text: str = "text", key: str = "item_id", size: int = SIZE) -> DataFrame:
    """(text_id, name, begin, end): maximal runs of words of a text that equal at least a window of an item."""
    placed = materialize(item_words(items, key, text, size), "item-words")
    terms = placed.select("term").distinct()
    counted = materialize(frequencies(docs, terms, text), "frequencies")
    probed = materialize(probes(placed, counted), "probes")
    index = materialize(postings(docs, probed.select("term").distinct(), text), "postings")
    found = index.alias("d").join(probed.alias("p"), "term")
    agree = (F.col("p.before").isNull() | (F.col("p.before") == F.col("d.before"))) & (F.col("p.after").isNull() | (F.col("p.after") == F.col("d.after")))
    aligned = materialize(found.where(agree).select("text_id", "item", (F.col("place") - F.col("k")).alias("shift")).distinct(), "alignments")

    sought = aligned.select("text_id").distinct()
    copies = docs.select(text_id(text).alias("text_id"), F.col(text).alias("text")).groupBy("text_id").agg(F.first("text").alias("text"))
    within = copies.join(sought, "text_id").select("text_id", F.posexplode(words("text")).alias("place", "term")).join(terms, "term", "left_semi")
    due = aligned.join(placed, "item").select("text_id", "item", "name", "len", "shift", "k", "term", (F.col("shift") + F.col("k")).alias("place"))
    met = due.join(within, ["text_id", "place", "term"])
    run = F.col("k") - F.row_number().over(Window.partitionBy("text_id", "item", "shift").orderBy("k"))
    runs = met.withColumn("run", run).groupBy("text_id", "item", "name", "len", "shift", "run").agg(F.min("place").alias("begin"), F.count("*").alias("n"))
    return runs.where(F.col("n") >= F.col("len")).select("text_id", "name", "begin", (F.col("begin") + F.col("n")).cast("long").alias("end"))


def proximity_matches(docs: DataFrame, items: DataFrame, within: int, text: str = "text", key: str = "item_id", rarest: int = 3) -> DataFrame:
    """(text_id, name, begin, end): places where the ``rarest`` rarest words of an item stand within ``within`` words.

    Order does not count. Each place of the item's rarest word is looked at:
    the other words' postings are intersected with the places around it. Of each
    other word the nearest place counts, the earlier one on ties.
    """
    placed = item_words(items, key, text)
    counted = frequencies(docs, placed.select("term").distinct(), text)
    order = Window.partitionBy("item").orderBy("f", "term")
    chosen = placed.select("item", "name", "term").distinct().join(counted, "term").withColumn("r", F.row_number().over(order)).where(F.col("r") <= rarest)
    index = postings(docs, chosen.select("term").distinct(), text).select("term", "text_id", F.col("place").cast("long")).distinct()
    size = chosen.groupBy("item").agg(F.count("*").alias("terms"))
    cell = F.floor(F.col("place") / within)
    hubs = index.join(chosen.where("r = 1"), "term").select("text_id", "item", "name", F.col("place").alias("hub"), F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    others = index.join(chosen.where("r > 1"), "term").select("text_id", "item", "term", "place", cell.alias("cell"))
    apart = F.abs(F.col("place") - F.col("hub"))
    near = hubs.join(others, ["text_id", "item", "cell"]).where(apart < within).groupBy("text_id", "item", "name", "hub", "term").agg(F.min(F.struct(apart.alias("apart"), "place")).alias("x"))
    whole = near.groupBy("text_id", "item", "name", "hub").agg(F.count("*").alias("met"), F.least(F.min("x.place"), F.col("hub")).alias("begin"), (F.greatest(F.max("x.place"), F.col("hub")) + 1).alias("end"))
    alone = hubs.join(size.where("terms = 1"), "item", "left_semi").select("text_id", "name", F.col("hub").alias("begin"), (F.col("hub") + 1).alias("end")).distinct()
    met = whole.join(size, "item").where((F.col("met") == F.col("terms") - 1) & (F.col("end") - F.col("begin") <= within))
    return met.select("text_id", "name", "begin", "end").distinct().unionByName(alone)


def hits(found: DataFrame) -> DataFrame:
    """(text_id, n_hit, n_items, items_sha256) of the texts of ``matches``: words covered by any match, and the items."""
    order = Window.partitionBy("text_id").orderBy("begin", "end")
    so_far = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    fresh = found.select("text_id", "begin", "end").distinct().withColumn("fresh", F.greatest(F.lit(0), F.col("end") - F.greatest(F.col("begin"), so_far)))
    covered = fresh.groupBy("text_id").agg(F.sum("fresh").cast("long").alias("n_hit"))
    names = found.groupBy("text_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return covered.join(names, "text_id").select("text_id", "n_hit", F.size("names").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "names").cast("binary"), 256).alias("items_sha256"))


def report(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", size: int = SIZE) -> DataFrame:
    """One row for each row of ``docs``: key, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = materialize(hits(matches(docs, items, text, item_key, size)), "hits")  # as a table of its own, so that the join below can split a hot text
    rows = docs.select(F.col(key), text_id(text).alias("text_id"), F.size(words(text)).cast("long").alias("n_words"))
    none = F.lit(0).cast("long")
    out = rows.join(found, "text_id", "left").select(key, "n_words", F.coalesce("n_hit", none).alias("n_hit"), F.coalesce("n_items", none).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def keep_clean(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id", size: int = SIZE) -> DataFrame:
    """The rows of ``docs`` whose text has no match."""
    found = materialize(matches(docs, items, text, item_key, size).select("text_id").distinct(), "contaminated")
    rows = docs.select(text_id(text).alias("text_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.join(found, "text_id", "left_anti").select("row.*")
