"""An extension: counts of terms over event time and duplicates dropped, on unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, item: str, time: str = "ts", width: str = "1 day", late: str = "2 days") -> DataFrame:
    """(start, item, n) for each window; on a stream, rows later than ``late`` are dropped and state is let go."""
    rows = events.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    counted = rows.groupBy(F.window("_ts", width).alias("_w"), F.col(item).alias("item")).agg(F.count("*").alias("n"))
    return counted.select(F.col("_w.start").alias("start"), "item", "n")


def first_seen(events: DataFrame, keys: list[str], time: str = "ts", late: str = "2 days") -> DataFrame:
    """Each key once; on a stream within ``late`` of event time."""
    rows = events.withColumn(time, F.col(time).cast("timestamp"))
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else rows.dropDuplicates(keys)


def sessions(events: DataFrame, key: str, gap: str = "30 minutes", time: str = "ts", late: str = "2 days") -> DataFrame:
    """(key, start, n): runs of events of a key without a pause of ``gap``."""
    rows = events.withColumn("_ts", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("_ts", late) if events.isStreaming else rows
    return rows.groupBy(F.session_window("_ts", gap).alias("_w"), key).agg(F.count("*").alias("n")).select(key, F.col("_w.start").alias("start"), "n")
