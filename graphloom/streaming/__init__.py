"""Streaming extensions: access counters and confidence feedback from event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def access_counts(events: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(window start, user_id, accesses) of views and clicks; later events than the watermark are left out."""
    seen = events.where(F.col("event_type").isin("view", "click")).withWatermark("ts", lateness)
    return seen.groupBy(F.window("ts", window), "user_id").agg(F.count("*").alias("accesses")).select(F.col("window.start").alias("start"), "user_id", "accesses")


def feedback_totals(events: DataFrame) -> DataFrame:
    """(user_id, feedback): the clamped running sum of error (-0.01) and purchase (+0.01) events."""
    delta = F.when(F.col("event_type") == "error", -0.01).otherwise(0.01)
    some = events.where(F.col("event_type").isin("error", "purchase"))
    return some.groupBy("user_id").agg(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sum(delta))).alias("feedback"))
