"""Trips from harbour visits, with a least and a greatest duration."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import elapsed

SHORT_GAP_MIN = 3.0


def _split(name: str, time: np.ndarray, gap: np.ndarray, most_hours: float, compat_cut: bool) -> list[tuple[str, np.datetime64, np.datetime64]]:
    """Cut one trip's pings (their times and minutes since the ping before, in order) at its longest gaps until no part is longer than `most_hours`, or a cut would be at a short gap."""
    todo, done = deque([(name, time[0], time[-1])]), []
    while todo:
        name, a, b = todo.popleft()
        first, end = int(np.searchsorted(time, a, "right")), int(np.searchsorted(time, b, "left"))  # pings inside
        if (b - a) / np.timedelta64(1, "s") / 3600 <= most_hours or end - first < 2:
            done.append((name, a, b))
            continue
        k = int(np.nanargmax(gap[first + 1 : end])) + (0 if compat_cut else 1)
        if not gap[first + k] >= SHORT_GAP_MIN or (k == 0 and not compat_cut):
            done.append((name, a, b))
            continue
        before = time[first + k - 1] if k else a
        todo += [(f"{name}_1", a, before), (f"{name}_2", time[first + k], b)]
    return done


def harbour_trips(df: DataFrame, vessel: str, time: str, in_harbour: str, rid: str, least_hours: float = 0.5, most_hours: float = 72, split: bool = True, compat_cut: bool = True, check: bool = False) -> DataFrame:
    """Adds trip_id (vessel_n) to pings: from the first ping at sea to the first one in harbour after it, both included.

    Trips are numbered before those of `least_hours` or less are dropped; longer ones than `most_hours` are cut at their longest gap
    (`compat_cut` cuts one ping early, as the established method does). Vessels that never change state have no trips. A null in
    `in_harbour` makes the vessel's pings there count as at sea; check=True raises instead. `rid` breaks ties in time.
    """
    if check and df.where(F.col(in_harbour).isNull()).limit(1).count():
        raise ValueError(f"{in_harbour} holds nulls")
    w = Window.partitionBy("v").orderBy("time", "_rid")
    whole = Window.partitionBy("v")
    base = df.select(F.col(vessel).alias("v"), F.col(time).alias("time"), F.col(rid).alias("_rid"), F.coalesce(F.col(in_harbour), F.lit(False)).alias("h"))
    marked = base.withColumns({
        "ph": F.lag("h").over(w), "next": F.lead("time").over(w),
        "gap_min": elapsed(F.lag("time").over(w), F.col("time"), "mins"),
        "mixed": F.min("h").over(whole) != F.max("h").over(whole),
    }).where("mixed")
    depart = ~F.col("h") & (F.col("ph").isNull() | F.col("ph"))
    arrive = F.col("h") & ~F.col("ph")
    numbered = marked.withColumns({"depart": depart, "arrive": F.coalesce(arrive, F.lit(False))}).withColumn("n", F.sum(F.col("depart").cast("long")).over(w))
    member = numbered.where(~F.col("h") | F.col("arrive"))
    named = member.withColumn("trip", F.concat_ws("_", F.col("v").cast("string"), F.col("n").cast("string")))
    spans = named.groupBy("v", "trip", "n").agg(F.min("time").alias("a"), F.max("time").alias("b"), F.count(F.lit(1)).alias("pings"))
    hours = elapsed(F.col("a"), F.col("b"), "hours")
    spans = spans.where(hours > least_hours)
    if split:
        cuttable = (hours > most_hours) & (F.col("pings") >= 4)  # a cut needs two pings inside
        long_ones = named.join(spans.where(cuttable).select("v", "trip"), ["v", "trip"], "left_semi")
        kind, vkind = dict(named.dtypes)["time"], dict(named.dtypes)["v"]
        buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            """Many trips at once: a group for each trip would cost more than its cuts."""
            pdf = pdf.sort_values(["trip", "time", "_rid"], kind="stable")
            name, v, gap = pdf["trip"].to_numpy(), pdf["v"].to_numpy(), pdf["gap_min"].to_numpy(float)
            time = pdf["time"].astype("datetime64[us]").to_numpy()
            first = np.append(np.flatnonzero(name[1:] != name[:-1]) + 1, len(name)) if len(name) else []
            rows = [(v[i], *x) for i, j in zip([0, *first], first, strict=False) for x in _split(str(name[i]), time[i:j], gap[i:j], most_hours, compat_cut)]
            return pd.DataFrame(rows, columns=["v", "trip", "a", "b"])

        cut = long_ones.groupBy(F.pmod(F.xxhash64("trip"), F.lit(buckets))).applyInPandas(run, f"v {vkind}, trip string, a {kind}, b {kind}")
        cut = cut.where(hours > 0).where(hours >= least_hours)
        spans = spans.where(~cuttable).select("v", "trip", "a", "b").unionByName(cut)
    le = spans.select(F.col("v").alias("_v"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("trip").alias("trip_id"))
    le = le.withColumn("_day", F.explode(F.sequence(F.to_date("_a"), F.to_date("_b"))))  # a vessel's trips are joined by day
    return df.join(le, (F.col(vessel) == F.col("_v")) & (F.to_date(time) == F.col("_day")) & F.col(time).between(F.col("_a"), F.col("_b")), "left").drop("_v", "_a", "_b", "_day")


def state_envelopes(df: DataFrame, state: str, time: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Gaps and islands: each run of one state with its first and last time; the next run's start closes it."""
    from .track import run_id, track_window

    w = track_window(by, order)
    runs = df.withColumn("run", run_id(F.col(state), w)).groupBy(*by, "run").agg(F.first(state).alias(state), F.min(time).alias("t1"), F.max(time).alias("t2"), F.count(F.lit(1)).alias("pings"))
    return runs.withColumn("t2", F.coalesce(F.lead("t1").over(Window.partitionBy(*by).orderBy("run")), F.col("t2")))
