"""Incremental runs: the same transforms over a stream of files, each input seen once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def stream_files(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes what there is and stops; a later call goes on from the checkpoint."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def transform_available(spark: SparkSession, path: str, schema: T.StructType, f: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> DataFrame:
    """A stateless transform over the new files of a folder; returns all results so far."""
    run_available(f(stream_files(spark, path, schema)), out, checkpoint)
    return spark.read.parquet(out)


def dedupe_stream(stream: DataFrame, keys: list[str], ts: str, within: str) -> DataFrame:
    """First row of each key, keys forgotten after the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, ts: str, by: list[str], size: str, late: str, value: str | None = None) -> DataFrame:
    """Counts (and a sum) of tumbling windows, late rows taken until the watermark."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    aggs = [F.count("*").alias("n"), *([F.sum(value).alias("total")] if value else [])]
    return timed.groupBy(F.window(ts, size), *by).agg(*aggs).select(F.col("window.start").alias("start"), *by, "n", *(["total"] if value else []))


def session_counts(df: DataFrame, ts: str, by: list[str], gap: str) -> DataFrame:
    """Rows per session: a session ends when the key rests for ``gap``."""
    timed = df.withColumn(ts, F.col(ts).cast("timestamp"))
    return timed.groupBy(F.session_window(ts, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), *by, "n")
