"""The stateless validators on a stream of bars: the same expressions, and duplicates within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import ohlc_validity
from ..schema import BAR, KEY


def bar_stream(spark, path: str) -> DataFrame:
    return spark.readStream.schema(BAR).parquet(path)


def invalid_bars(stream: DataFrame) -> DataFrame:
    return ohlc_validity(stream)


def first_bars(stream: DataFrame, delay: str = "30 days") -> DataFrame:
    """Each bar once: repeats within the watermark are dropped, and the state behind it is let go."""
    timed = stream.withColumn("event_time", F.col("trading_date").cast("timestamp")).withWatermark("event_time", delay)
    return timed.dropDuplicatesWithinWatermark(KEY).drop("event_time")
