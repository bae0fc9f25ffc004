"""Token counts of flat token files.

A flat file holds ids one after the other, with an end-of-document id after each
document and no index. Files are cut into blocks at fixed places; a block is
searched for the separator in one vectorised comparison, and a prefix scan over
the blocks' separators and tails gives each document its number in the file and
joins the pieces of documents that cross blocks.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from simloom.functions.workspace import materialize
from simloom.llm.files import open_system, qualified

#: Bytes of a block, and documents in a row of a block's lengths.
BLOCK = 8 << 20
#: Bytes after which a task starts another file.
ROLL = 512 << 20


def write_token_files(encoded: DataFrame, path: str, separator: int, key: str = "doc_id", ids: str = "ids", dtype: str = "<u2") -> DataFrame:
    """Write each document's ids and a separator to flat files below ``path``; return (file, ordinal, key).

    ``ids`` holds little-endian 32-bit integers; null counts as none. A second
    attempt of a task writes a file of its own, and only the files that the result
    names count. Ids that do not fit ``dtype`` or equal the separator raise an error.
    """
    top = np.iinfo(np.dtype(dtype)).max
    path = qualified(encoded.sparkSession, path)
    rows = encoded.select(F.col(key).alias("key"), F.col(ids).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_system(path)
        system.create_dir(root, recursive=True)
        out, name, ordinal, size = None, "", 0, 0
        try:
            for batch in batches:
                for part in (batch.slice(a, 500) for a in range(0, batch.num_rows, 500)):
                    if out is None or size > ROLL:
                        if out is not None:
                            out.close()
                        name, ordinal, size = f"{uuid.uuid4().hex}.bin", 0, 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    pieces = []
                    for x in part.column(1).to_pylist():
                        values = np.frombuffer(x or b"", "<u4")
                        if len(values) and (values.max() > top or (values == separator).any()):
                            raise ValueError(f"an id is the separator or does not fit {dtype}")
                        pieces += [values.astype(dtype).tobytes(), np.array([separator], dtype).tobytes()]
                    data = b"".join(pieces)
                    out.write(data)
                    size += len(data)
                    n = part.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(ordinal, ordinal + n)), part.column(0)], names=["file", "ordinal", "key"])
                    ordinal += n
        finally:
            if out is not None:
                out.close()

    kind = dict(rows.dtypes)["key"]
    return materialize(rows.mapInArrow(run, f"file string, ordinal long, key {kind}"), "token-files").withColumnRenamed("key", key)


def block_summaries(spark: SparkSession, path: str, separator: int, dtype: str = "<u2", block: int = BLOCK, files: DataFrame | None = None) -> DataFrame:
    """(file, block, separators, head, tail, inner): of each block, tokens before the first and after the last separator, and the lengths between.

    A block without separators has its tokens as tail. ``files`` (file) keeps some files only.
    """
    width = np.dtype(dtype).itemsize
    path = qualified(spark, path)
    block -= block % width
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size"))
    if files is not None:
        listed = listed.join(files, "file", "left_semi")
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block)))
    plan = listed.where("size > 0").select("file", "size", F.explode(blocks).alias("block")).repartition("file", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_system(path)
        for batch in batches:
            for file, size, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with system.open_input_file(f"{root}/{file}") as f:
                    f.seek(number * block)
                    tokens = np.frombuffer(f.read(min(block, size - number * block)), dtype)
                at = np.flatnonzero(tokens == separator)
                head, tail = (int(at[0]), len(tokens) - 1 - int(at[-1])) if len(at) else (0, len(tokens))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([number], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([head], pa.int64()), pa.array([tail], pa.int64()), pa.array([np.diff(at) - 1], pa.list_(pa.int64()))],
                    names=["file", "block", "separators", "head", "tail", "inner"],
                )

    return plan.mapInArrow(run, "file string, block long, separators long, head long, tail long, inner array<long>")


def document_lengths(summaries: DataFrame) -> DataFrame:
    """(file, ordinal, n_tokens, closed): the documents of ``block_summaries``, by a prefix scan.

    Blocks without separators belong to the last block with one before them. A
    document without separator at the end of a file counts if it has tokens.
    """
    along = Window.partitionBy("file").orderBy("block")
    upto: Column = F.sum((F.col("separators") > 0).cast("int")).over(along)
    light = summaries.withColumn("run", upto).withColumn("base", F.sum("separators").over(along) - F.col("separators"))
    tails = light.groupBy("file", "run").agg(F.sum("tail").alias("tails"), F.max(F.col("base") + F.col("separators")).alias("after"))
    carried = tails.withColumn("carry", F.coalesce(F.lag("tails").over(Window.partitionBy("file").orderBy("run")), F.lit(0)))
    # the run before the first separator may be missing: then nothing is carried
    before = F.lag("run").over(Window.partitionBy("file").orderBy("run"))
    carried = carried.withColumn("carry", F.when(before == F.col("run") - 1, F.col("carry")).otherwise(0))
    closed = light.where("separators > 0").join(carried.select("file", "run", "carry"), ["file", "run"])
    lengths = F.concat(F.array(F.col("carry") + F.col("head")), "inner")
    done = closed.select("file", "base", F.posexplode(lengths).alias("k", "n_tokens")).select("file", (F.col("base") + F.col("k")).alias("ordinal"), "n_tokens", F.lit(True).alias("closed"))
    last = Window.partitionBy("file").orderBy(F.desc("run"))
    open_ = tails.withColumn("r", F.row_number().over(last)).where("r = 1 and tails > 0").select("file", F.col("after").alias("ordinal"), F.col("tails").alias("n_tokens"), F.lit(False).alias("closed"))
    return done.unionByName(open_)
