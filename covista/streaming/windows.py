"""An extension: event counts and sums in sliding windows, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str = "ts", kind: str = "event_type", value: str = "value", size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, kind, n, total) for a batch or a stream; a stream drops rows later than late."""
    rows = events.withWatermark(ts, late) if events.isStreaming else events
    return rows.groupBy(F.window(ts, size), kind).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("window.start").alias("start"), kind, "n", "total")
