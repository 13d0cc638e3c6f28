"""Streaming faces: routes as verdicts arrive, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.rules import first_match
from citeloom.functions.tri import count_false, count_true


def running_routes(verdicts: DataFrame) -> DataFrame:
    """Route of every pair so far, from a stream (pair, established); update mode."""
    n, f, t = F.count(F.lit(1)), count_false(F.col("established")), count_true(F.col("established"))
    counted = verdicts.groupBy("pair").agg(n.alias("n"), f.alias("f"), t.alias("t"))
    return counted.select("pair", first_match([(F.col("f") > 0, "F6_FLAGGED"), (F.col("t") == F.col("n"), "FULL_COVERAGE")], "HELD_LOW_CONFIDENCE").alias("route"))


def windowed_tally(events: DataFrame, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and sums by event type in tumbling windows; rows later than ``late`` are dropped by the watermark."""
    at = F.window("ts", size)
    return events.withWatermark("ts", late).groupBy(at.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select("w.start", "event_type", "n", "total")
