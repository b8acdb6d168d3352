"""An extension beyond the batch directory: the latest visit of each user and place over a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """(user_id, place_id, ts, event_id) of the latest event of each pair; for update mode. Keys and one row each are the state."""
    best = F.max(F.struct("ts", "event_id")).alias("b")
    return stream.withWatermark("ts", late).groupBy("user_id", "place_id").agg(best).select("user_id", "place_id", "b.ts", "b.event_id")


def hourly(stream: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events of each type in each hour; for append mode, an hour is given out when no more can come."""
    return stream.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("hour"), "event_type", "n")
