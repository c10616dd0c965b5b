"""Streams of placed pixels and of measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.pixels import composite


def streamed_composite(placed: DataFrame) -> DataFrame:
    """Depth-buffer composite of a stream (key, y, x, v, dist): ``min_by`` keeps one state row per place, updated as tiles arrive."""
    return composite(placed)


def windowed_stats(events: DataFrame, time: str, value: str, by: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Count, mean and extrema per key and window of event time; rows later than the watermark no longer change a window."""
    w = events.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), by)
    return w.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max")).select(by, F.col("w.start").alias("start"), "n", "mean", "min", "max")
