"""Trips of a stream of pings: a vessel's trip ends when it has been silent, or seen in harbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trip_sessions(pings: DataFrame, gap: str = "2 hours", delay: str = "1 hour", vessel: str = "vid", time: str = "time", in_harbour: str = "in_harbour") -> DataFrame:
    """Sessions at sea by vessel with their bounds and number of pings, for streams and tables alike; late pings are waited for `delay`."""
    at_sea = pings.where(~F.coalesce(F.col(in_harbour), F.lit(False)))
    marked = at_sea.withWatermark(time, delay) if pings.isStreaming else at_sea
    return marked.groupBy(F.session_window(time, gap).alias("w"), vessel).agg(F.count(F.lit(1)).alias("pings")).select(vessel, F.col("w.start").alias("t1"), F.col("w.end").alias("t2"), "pings")
