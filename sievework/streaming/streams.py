"""The stateless operators on streams, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash


def table_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).parquet(path)


def _watermarked(stream: DataFrame, time: str, delay: str) -> DataFrame:
    """Watermarks need an instant, so a local time is taken in the session's zone."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)


def first_within(stream: DataFrame, time: str, delay: str, key: str, text: str) -> DataFrame:
    """The first row of each normal form in a key; the state is dropped as the watermark passes."""
    hashed = _watermarked(stream.withColumn("text_hash", content_hash(text)), time, delay)
    return hashed.dropDuplicatesWithinWatermark([key, "text_hash"])


def windowed_counts(stream: DataFrame, time: str, delay: str, window: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Rows and summed values of each event-time window; late rows beyond the delay are dropped."""
    span = F.window(time, window, slide) if slide else F.window(time, window)
    return _watermarked(stream, time, delay).groupBy(span, *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n", "total")


def sessions(stream: DataFrame, time: str, delay: str, gap: str, by: list[str]) -> DataFrame:
    """Runs of rows no more than ``gap`` apart."""
    return _watermarked(stream, time, delay).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there and returns the rows of its memory sink; for tests and small inputs."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return stream.sparkSession.table(name)
