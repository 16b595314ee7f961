"""Streams of pages: glyph files that arrive in a folder, counted, made distinct and windowed as they come.

The batch engine has no streams; these are extensions with the same relations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def arrivals(spark: SparkSession, path: str, schema: str | T.StructType, per_trigger: int = 50) -> DataFrame:
    """Parquet files as they appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(path)


def distinct_pages(pages: DataFrame, time: str = "ts", late: str = "1 hour", *keys: str) -> DataFrame:
    """The first of each page content within the watermark; state is dropped behind it."""
    return pages.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def tumbling(events: DataFrame, time: str = "ts", every: str = "1 hour", late: str = "10 minutes", *keys: str) -> DataFrame:
    events = events.withColumn(time, F.col(time).cast("timestamp"))  # watermarks need an instant, not a local time
    return events.withWatermark(time, late).groupBy(F.window(time, every), *keys).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("most"))


def sessions(events: DataFrame, time: str = "ts", gap: str = "30 minutes", late: str = "10 minutes", *keys: str) -> DataFrame:
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("n"))
