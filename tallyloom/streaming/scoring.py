"""Scoring of result files as they arrive. An extension: the reference has no streams.

Row scores are stateless and work on a stream as they are; means per window need a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def result_stream(spark: SparkSession, path: str, schema: str, fmt: str = "json", files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """Files of a folder as they arrive, of those whose name matches `glob` if given."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt)
    return (reader.option("pathGlobFilter", glob) if glob else reader).load(path)


def once_per_row(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Repeated deliveries within the delay are dropped; state is bounded by it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_means(stream: DataFrame, score: Column, task: str, time: str, delay: str, window: str) -> DataFrame:
    """(start, task, n, value) per window of event time; rows later than the delay are dropped."""
    out = stream.withColumn("_s", score).withWatermark(time, delay).groupBy(F.window(time, window), task).agg(F.count("_s").alias("n"), F.avg("_s").alias("value"))
    return out.select(F.col("window.start").alias("start"), task, "n", "value")
