"""The queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simloom.functions.workspace import new_path
from simloom.llm import bpe, decontaminate, htmltext, langid, nearcopies, neighbours, repeats, tokenfiles, toxicity, warc

#: Rank file of the production tokenizer.
RANKS = "byte_bpe_multi_50k.tiktoken"
#: An id that the rank file leaves free.
SEPARATOR = 50256


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors by cosine of each vector whose id is divisible by 50."""
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from four fifths of the labels.

    A label without doc_id is not learned from; a document without one is not held out.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _read(spark, sf_dir, "labels").where(langid.remainder("doc_id", 5) != 0)
    model = toxicity.language_model(docs)
    classifier = toxicity.fit(docs, labels, model)
    held = docs.select("doc_id", F.coalesce(langid.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "text")
    return toxicity.score(held, model, classifier).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_suffix_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that lie in repeated 400-byte strings, removed from every document."""
    return repeats.digests(_read(spark, sf_dir, "documents"))


def op4_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from two thirds of them.

    A document without doc_id is neither learned from nor held out.
    """
    docs = _read(spark, sf_dir, "documents")
    part = langid.remainder("doc_id", 3)
    learned = langid.profiles(docs.where(part != 1))
    held = docs.select("doc_id", F.coalesce(part == 1, F.lit(False)).alias("held_out"), "text")
    return langid.identify(held, learned)


def op5_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of near copies of every document: five-word shingles, similarity 0.8."""
    return nearcopies.classes(_read(spark, sf_dir, "documents"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE: ids and decoded bytes of every document, as digests."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that lie in windows of ten words of the benchmark."""
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written to WARC archives, equal payloads as revisits, and read back."""
    return warc.archive_report(_read(spark, sf_dir, "pages"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written to flat token files, and their tokens counted by separator scan.

    Chunks are twice as long as for ``op6_bpe``, as the token files take most of the disk.
    """
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, chunk=2 * bpe.CHUNK).select("doc_id", "ids")
    path = new_path(spark, "tokens")
    written = tokenfiles.write_token_files(encoded, path, SEPARATOR)
    lengths = tokenfiles.document_lengths(tokenfiles.block_summaries(spark, path, SEPARATOR, files=written.select("file").distinct()))
    return lengths.join(written.hint("merge"), ["file", "ordinal"]).select("doc_id", "n_tokens")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The visible text of every page."""
    pages = _read(spark, sf_dir, "pages").select("page_id", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_neighbours": op1_neighbours,
    "op2_toxicity": op2_toxicity,
    "op3_suffix_repeats": op3_suffix_repeats,
    "op4_langid": op4_langid,
    "op5_near_copies": op5_near_copies,
    "op6_bpe": op6_bpe,
    "op7_decontaminate": op7_decontaminate,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_html": op10_html,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
        t AS (SELECT d, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY d)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
               CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN t USING (d)
    """,
    "op7_decontaminate": """
        WITH d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                              '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        i AS (
            SELECT CAST(item_id AS VARCHAR) AS item,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
            FROM benchmark),
        iw AS (
            SELECT DISTINCT item, n, array_to_string(w[s : s + n - 1], ' ') AS g
            FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM i WHERE len(w) > 0)),
        dw AS (
            SELECT doc_id, n, s, array_to_string(w[s : s + n - 1], ' ') AS g
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
        m AS (SELECT DISTINCT doc_id, item, n, s FROM dw JOIN iw USING (n, g)),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM m) GROUP BY doc_id),
        c AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN c USING (doc_id)
    """,
}
