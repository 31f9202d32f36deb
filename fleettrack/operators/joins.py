"""Points in intervals."""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in `order`."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def add_trip_id(pings: DataFrame, trips: DataFrame, vessel: str = "vid", trip: str = "tid", time: str = "time", start: str = "T1", end: str = "T2", bucket_seconds: int | None = None, check: bool = False) -> DataFrame:
    """Left join of pings with the trips of their vessel that they fall in, both ends included.

    Of rows with the same vessel and trip the first (by start) counts; start and end are dropped, other columns of `trips` stay.
    Trips that overlap repeat a ping. With `bucket_seconds`, intervals are also dealt out to time buckets of that length, so that a
    vessel with very many trips is joined by (vessel, bucket) instead of by vessel alone. check=True warns if nothing matched.
    """
    for df, names in ((pings, [vessel, time]), (trips, [vessel, trip, start, end])):
        if missing := [c for c in names if c not in df.columns]:
            raise ValueError(f"missing columns: {', '.join(missing)}")
    le = first_rows(trips, [vessel, trip], [start, end]).withColumnRenamed(vessel, "_v")
    inside = F.col(vessel).eqNullSafe(F.col("_v")) & F.col(time).between(F.col(start), F.col(end))
    if bucket_seconds:
        slot = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_seconds)
        le = le.withColumn("_b", F.explode(F.when(F.col(start) <= F.col(end), F.sequence(slot(start), slot(end)))))
        inside = inside & (slot(time) == F.col("_b"))
    out = pings.join(le, inside, "left").drop("_v", "_b", start, end)
    if check and not out.where(F.col(trip).isNotNull()).limit(1).count():
        warnings.warn("no ping falls in a trip", stacklevel=2)
    return out


def interval_id(points: DataFrame, intervals: DataFrame, vessel: str = "vid", time: str = "time", start: str = "t1", end: str = "t2", id: str = "id") -> DataFrame:
    """(vessel, time, id) for every point: the intervals that hold it, null for none."""
    le = intervals.select(F.col(vessel).alias("_v"), F.col(start).alias("_1"), F.col(end).alias("_2"), id)
    return points.join(le, (F.col(vessel) == F.col("_v")) & F.col(time).between(F.col("_1"), F.col("_2")), "left").select(vessel, time, id)


def validity_join(trails: DataFrame, periods: DataFrame, key: str = "mid", time: str = "time", start: str = "t1", end: str = "t2") -> DataFrame:
    """Trails with the periods that hold them (inner); the bounds are dropped."""
    return trails.join(periods.withColumnRenamed(key, "_k"), (F.col(key) == F.col("_k")) & F.col(time).between(F.col(start), F.col(end))).drop("_k", start, end)
