"""Event streams: overlapping reads, late rows, folds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.functions.scores import status_rank, terminal


def file_stream(spark: SparkSession, glob: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files that match a pattern."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(glob)


def without_repeats(stream: DataFrame, key: str, time: str, lookback: str = "26 hours") -> DataFrame:
    """First row of each key within the lookback; state older than that is dropped."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, lookback).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: str, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """Counts by tumbling window and column; rows later than ``late`` are left out."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    return rows.groupBy(F.window(time, every), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")


def status_stream(events: DataFrame) -> DataFrame:
    """Running status of each application; order of arrival doesn't matter (update or complete mode)."""
    at = F.struct("occurred_at", "id")
    ended = F.max_by("status", F.when(terminal(F.col("status")), at))
    far = F.max_by("status", F.struct(status_rank(F.col("status")).alias("r"), "occurred_at", "id"))
    return events.groupBy("application_id").agg(F.coalesce(ended, far).alias("status"))


def upsert_stream(stream: DataFrame, upsert: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies each batch to a table; ``availableNow`` drains what has landed and stops."""
    return stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drained(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """Runs a stream over what has landed and returns what it wrote below ``folder``.

    Each batch owns a subfolder and overwrites it, so a batch that is run again
    after a failure leaves no row twice.  In complete mode the last batch is the
    result; in update mode rows carry their ``batch``, the latest for a key counts.
    """
    spark = stream.sparkSession

    def write(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/out/batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in stream.schema)}, batch long").parquet(f"{folder}/out")
    if mode == "update":
        return rows
    if mode == "complete":
        last = rows.agg(F.max("batch").alias("_last"))
        rows = rows.join(F.broadcast(last), F.col("batch") == F.col("_last")).drop("_last")
    return rows.drop("batch")
