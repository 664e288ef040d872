"""Structured Streaming over an event stream: event-time windows, sessions, dedup, expiry, incremental upsert."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read(spark: SparkSession, folder: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(folder)


def windowed(events: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; what comes later than ``late`` after the newest event is dropped."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return events.withWatermark(time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n", "total")


def sessions(events: DataFrame, time: str, user: str, gap: str, late: str = "1 hour") -> DataFrame:
    """A session of a user ends after ``gap`` without an event."""
    s = events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("s"), user).agg(F.count("*").alias("n"))
    return s.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), user, "n")


def deduplicated(events: DataFrame, time: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """A key once within the watermark, however often it is delivered."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def replay(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, writing below ``folder``, and reads its result back.

    Appended rows go to a Parquet sink; a complete result is written batch by
    batch, and the newest batch is read.
    """
    spark, out = stream.sparkSession, f"{folder}/out"
    spark.createDataFrame([], stream.schema).write.mode("append").parquet(f"{out}/batch=-1")
    if mode == "append":
        writer = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/batch=0")
    else:
        writer = stream.writeStream.outputMode(mode).foreachBatch(lambda rows, n: rows.write.mode("overwrite").parquet(f"{out}/batch={n}"))
    writer.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.schema(T.StructType([*stream.schema, T.StructField("batch", T.LongType())])).parquet(out)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == (-1 if newest is None else newest)).drop("batch")


def incremental(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hands each micro-batch to ``apply`` (an upsert by key, safe to repeat), over what is there now."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
