"""Streaming load cleaning.

The row-local cleaning stages (F1, F2, P2, F3, P3, P5, P6) are stateless, so
the batch functions apply unchanged to a streaming DataFrame. Per-session
counts (A1) run as a stateful aggregation whose state lives in the
checkpointed state store; every micro-batch rewrites the (distributed)
result table, so nothing passes through the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import clean
from ..session import scratch_path, table_path
from ..sources import fixtures as fx


def events_stream(spark: SparkSession, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """Events as a file stream (a file source watches a directory): the table's
    own folder, or, where the table is a single file, its parent filtered to
    that file's name."""
    path = table_path(sf_dir, "events")
    table = spark.read.parquet(path)
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if all(f.rstrip("/").endswith("/events.parquet") for f in table.inputFiles()):
        return stream.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.parquet(path)


def cleaned_loads_stream(events: DataFrame) -> DataFrame:
    """Stateless cleaning of a stream of events into item-page loads."""
    return clean.pre_dedup_loads(fx.loads_raw_from(events))


def run_clean_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run the cleaning stream to completion (availableNow) into Parquet and
    return the written table."""
    out, ckpt = scratch_path(spark, "stream_loads"), scratch_path(spark, "stream_loads_ckpt")
    q = (
        cleaned_loads_stream(events_stream(spark, sf_dir))
        .writeStream.format("parquet").option("path", out).option("checkpointLocation", ckpt)
        .outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(out)


def run_session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 as a stateful stream: loads per (user, session) over the cleaned
    stream; each micro-batch overwrites the result table."""
    out, ckpt = scratch_path(spark, "stream_sessions"), scratch_path(spark, "stream_sessions_ckpt")
    counts = cleaned_loads_stream(events_stream(spark, sf_dir)).groupBy("uuid_ind", "session_id").agg(
        F.count(F.lit(1)).alias("n_loads")
    )

    def write(batch: DataFrame, _epoch: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    q = counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out)
