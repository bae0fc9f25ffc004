"""Index append as a stream: new files of features are added once, known ids skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from simloom.sources import index


def append_stream(spark: SparkSession, incoming: str, path: str, checkpoint: str, id_type: str = "bigint") -> StreamingQuery:
    """Add the rows (uid, features) of Parquet files as they arrive in ``incoming``; ends when all there are is read.

    A batch that is run again after a failure adds nothing twice, as its ids are known then.
    """
    rows = spark.readStream.schema(f"uid {id_type}, features array<float>").parquet(incoming)

    def add(batch: DataFrame, _: int) -> None:
        index.append(batch.dropDuplicates(["uid"]), path, skip_known=True)

    return rows.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
