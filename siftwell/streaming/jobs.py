"""Structured Streaming jobs that process what has arrived, then stop.

Each job restarts from its checkpoint. Folders are given by the caller and must
be reachable from every executor.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.functions.vectors import with_unit
from siftwell.operators.search import filter_rows
from siftwell.streaming.merging import merge_batches, read_index


def arriving(
    spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1000
) -> DataFrame:
    """Parquet files below ``path``, a bounded number per micro-batch."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def stream_filter(stream: DataFrame, query: str, out: str, checkpoint: str) -> DataFrame:
    """Apply a search string to arriving rows; returns the table written so far."""
    run = (
        filter_rows(stream, query)
        .writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    # With the stream's schema, as there is no file to take it from before rows have arrived.
    return stream.sparkSession.read.schema(stream.schema).parquet(out)


def stream_upsert(
    stream: DataFrame,
    id_column: str,
    vector: str,
    version: str,
    out: str,
    checkpoint: str,
    fan: int | None = None,
) -> DataFrame:
    """Add arriving vectors to an index; returns its latest version per id.

    Each micro-batch owns one folder and overwrites it, so a batch that runs
    twice after a failure leaves the same rows. With ``fan``, finished batches are
    merged afterwards as :func:`merge_batches` does, so readers open few folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = batch.filter(F.col(id_column).isNotNull() & F.col(vector).isNotNull()).select(
            F.col(id_column).cast("string").alias("id"),
            F.col(vector).alias("embedding"),
            F.col(version).cast("long").alias("version"),
        )
        newest = rows.groupBy("id").agg(
            # Of equal versions the hash decides, so that a repeated batch chooses alike.
            F.max_by("embedding", F.struct("version", F.xxhash64("embedding"))).alias("embedding"),
            F.max("version").alias("version"),
        )
        with_unit(newest, "embedding").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    run = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    if fan:
        merge_batches(stream.sparkSession, out, fan)
    return read_index(stream.sparkSession, out)
