"""Functions along a track. Each takes `by` (the columns of a track) and `order` (its order, a tie-break last) or a window made of them.

All functions of one track share one window specification, so Spark sorts and exchanges once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.scalars import KNOTS_PER_MS
from ..functions.semantics import divide, elapsed

EARTH_M = 6371008.8
#: WGS 84. Fixed values.
AXIS_M, FLATTENING = 6378137.0, 1 / 298.257223563


def track_window(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*by).orderBy(*order)


def _prev(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return F.lag(x, k).over(w)


def _next(x: Column, w: WindowSpec, k: int = 1) -> Column:
    return F.lead(x, k).over(w)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), F.lit(2.0))
    h = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def ellipsoidal(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on the ellipsoid, by Lambert's formula on reduced latitudes (metres off over thousands of kilometres)."""
    beta = lambda lat: F.atan(F.lit(1 - FLATTENING) * F.tan(F.radians(lat)))
    b1, b2 = beta(lat1), beta(lat2)
    h = F.pow(F.sin((b2 - b1) / 2), F.lit(2.0)) + F.cos(b1) * F.cos(b2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    s = F.lit(2.0) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))
    p, q = (b1 + b2) / 2, (b2 - b1) / 2
    sq = lambda f, x: F.pow(f(x), F.lit(2.0))
    x = (s - F.sin(s)) * sq(F.sin, p) * sq(F.cos, q) / sq(F.cos, s / 2)
    y = (s + F.sin(s)) * sq(F.cos, p) * sq(F.sin, q) / sq(F.sin, s / 2)
    return F.when(s == 0, F.lit(0.0)).otherwise(F.lit(AXIS_M) * (s - F.lit(FLATTENING / 2) * (x + y)))


METHODS = {"haversine": haversine, "ellipsoid": ellipsoidal}


def distance(lon: Column, lat: Column, w: WindowSpec, method: str = "haversine") -> Column:
    """Metres from the previous ping; null for the first."""
    return METHODS[method](_prev(lon, w), _prev(lat, w), lon, lat)


def run_id(x: Column, w: WindowSpec) -> Column:
    """1, 2, ...: rises when x differs from the one before; a null always starts a run."""
    return F.sum(F.when(x == _prev(x, w), 0).otherwise(1)).over(w)


def trip_ids(df: DataFrame, in_harbour: str, by: Sequence[str], order: Sequence[str], out: str = "tid") -> DataFrame:
    """Trips at sea 1, 2, ... and stays in harbour -1, -2, ... of each track; null where `in_harbour` is null."""
    w = track_window(by, order)
    x = F.col(in_harbour)
    change = F.when(x == _prev(x, w), 0).otherwise(1)
    flagged = df.withColumn("_step", F.when(x, -change).when(~x, change))
    return flagged.withColumn(out, F.sum("_step").over(Window.partitionBy(*by, in_harbour).orderBy(*order))).drop("_step")


def step_time(time: Column, w: WindowSpec, units: str = "secs") -> Column:
    """Time since the previous ping; null for the first."""
    return elapsed(_prev(time, w), time, units)


def metres_per_second(lon: Column, lat: Column, time: Column, w: WindowSpec, method: str = "haversine") -> Column:
    return divide(distance(lon, lat, w, method), step_time(time, w))


def acceleration(lon: Column, lat: Column, time: Column, w: WindowSpec, dt: str = "back", method: str = "haversine") -> Column:
    """Speed over a time step: that from the previous ping, or with dt="next" that to the next one."""
    step = step_time(time, w) if dt == "back" else elapsed(time, _next(time, w))
    return divide(metres_per_second(lon, lat, time, w, method), step)


def speed_knots(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], out: str = "speed", method: str = "haversine") -> DataFrame:
    """Speed from the previous ping; the first ping has that of the second; null for a track of one ping."""
    w = track_window(by, order)
    raw = df.withColumn(out, metres_per_second(F.col(lon), F.col(lat), F.col(time), w, method) * F.lit(KNOTS_PER_MS))
    return raw.withColumn(out, F.when(F.row_number().over(w) == 1, _next(F.col(out), w)).otherwise(F.col(out)))


def track_time(df: DataFrame, time: str, by: Sequence[str], order: Sequence[str], weight: tuple[float, float] = (0, 1), fill: bool = True, out: str = "dt") -> DataFrame:
    """Seconds that a ping stands for. First weight 0: time since the previous ping; second weight 0: time to the next; else both, weighted.

    With `fill`, an end of a track without a value takes its neighbour's; a track of one ping has null.
    """
    total = float(sum(weight))
    if total <= 0:
        raise ValueError("weights must add up to more than 0")
    w1, w2 = (x / total for x in weight)
    w = track_window(by, order)
    back, ahead = step_time(F.col(time), w), elapsed(F.col(time), _next(F.col(time), w))
    value = back if w1 == 0 else ahead if w2 == 0 else back * F.lit(w1) + ahead * F.lit(w2)
    df = df.withColumn(out, value)
    if not fill:
        return df
    first, last = _prev(F.col(time), w).isNull(), _next(F.col(time), w).isNull()
    v = F.col(out)
    filled = F.when(first & v.isNull(), _next(v, w)).when(last & v.isNull(), _prev(v, w)).otherwise(v)
    return df.withColumn(out, filled)


def interpolate(df: DataFrame, x: str, y: str, by: Sequence[str], out: str = "y_filled") -> DataFrame:
    """y at every x by straight lines between known points: tied x share the mean of their y; nothing is known beyond the ends.

    With fewer than two known x, only those x have a value.
    """
    keys = [*by, x]
    mean = df.withColumn("_m", F.avg(y).over(Window.partitionBy(*keys)))
    known = F.when(F.col("_m").isNotNull(), F.struct(F.col(x).cast("double").alias("x"), F.col("_m").alias("y")))
    so_far = lambda order: Window.partitionBy(*by).orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    a = F.last(known, ignorenulls=True).over(so_far(F.asc(x)))
    b = F.last(known, ignorenulls=True).over(so_far(F.desc(x)))  # frames that run on to the end take Spark quadratic time
    at = F.col(x).cast("double")
    both = mean.withColumns({"_a": a, "_b": b})
    line = F.col("_a.y") + (F.col("_b.y") - F.col("_a.y")) * F.try_divide(at - F.col("_a.x"), F.col("_b.x") - F.col("_a.x"))
    return both.withColumn(out, F.when(F.col("_m").isNotNull(), F.col("_m")).otherwise(line)).drop("_m", "_a", "_b")


def pad_harbour(tid: Column, hid: Column, w: WindowSpec) -> Column:
    """Harbour id carried to the first ping of a trip from the ping before, and to its last from the ping after."""
    first = (tid != _prev(tid, w)) & (tid > 0)
    last = (tid != _next(tid, w)) & (tid > 0)
    return F.when(first, _prev(hid, w)).when(last, _next(hid, w)).otherwise(hid)


def rms_table(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Root mean squares over the two pings before and after: distance (.vd, m), time (.vt, s) and speed (.vs)."""
    w = track_window(by, order)
    x, y, t = F.col(lon), F.col(lat), F.col(time)
    d, dt = [], []
    for k in (2, 1, -1, -2):
        d.append(haversine(_prev(x, w, k), _prev(y, w, k), x, y))
        dt.append(elapsed(_prev(t, w, k), t) + F.lit(0.01))
    rms = lambda parts: F.sqrt(sum((p * p for p in parts), F.lit(0.0)) / 4)
    return df.withColumns({".vd": rms(d), ".vt": rms(dt), ".vs": rms([divide(a, b) for a, b in zip(d, dt, strict=True)])})


def densify(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], seconds: int) -> DataFrame:
    """Great-circle positions every `seconds` from each ping to the next: rows (by..., time, lon, lat)."""
    w = track_window(by, order)
    legs = df.select(*by, F.col(time).alias("t0"), F.col(lon).cast("double").alias("x0"), F.col(lat).cast("double").alias("y0"), _next(F.col(time), w).alias("t1"), _next(F.col(lon), w).cast("double").alias("x1"), _next(F.col(lat), w).cast("double").alias("y1"))
    span = F.greatest(F.lit(0), F.floor((elapsed(F.col("t0"), F.col("t1")) - F.lit(1e-6)) / seconds)).cast("int")
    steps = legs.withColumn("k", F.explode(F.sequence(F.lit(0), F.coalesce(span, F.lit(0)))))
    f = F.coalesce(F.try_divide(F.col("k") * F.lit(float(seconds)), elapsed(F.col("t0"), F.col("t1"))), F.lit(0.0))
    arc = haversine(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) / F.lit(EARTH_M)
    a, b = F.try_divide(F.sin((1 - f) * arc), F.sin(arc)), F.try_divide(F.sin(f * arc), F.sin(arc))
    cos, sin, rad = F.cos, F.sin, F.radians
    x = a * cos(rad("y0")) * cos(rad("x0")) + b * cos(rad("y1")) * cos(rad("x1"))
    y = a * cos(rad("y0")) * sin(rad("x0")) + b * cos(rad("y1")) * sin(rad("x1"))
    z = a * sin(rad("y0")) + b * sin(rad("y1"))
    lon_at = F.when(f == 0, F.col("x0")).otherwise(F.coalesce(F.degrees(F.atan2(y, x)), F.col("x0")))
    lat_at = F.when(f == 0, F.col("y0")).otherwise(F.coalesce(F.degrees(F.atan2(z, F.sqrt(x * x + y * y))), F.col("y0")))
    at = F.timestamp_add("SECOND", F.col("k") * F.lit(seconds), F.col("t0"))
    return steps.select(*by, at.alias("time"), lon_at.alias("lon"), lat_at.alias("lat"))


def resample(df: DataFrame, time: str, values: Sequence[str], by: Sequence[str], unit: str = "minute") -> DataFrame:
    """Values of each track on a regular grid of `unit`, by straight lines between its pings."""
    t = F.date_trunc(unit, F.col(time)).cast("timestamp")
    at = df.select(*by, t.alias("time"), *values)
    grid = at.groupBy(*by).agg(F.min("time").alias("a"), F.max("time").alias("b")).select(*by, F.explode(F.sequence("a", "b", F.expr(f"interval 1 {unit}"))).alias("time"))
    both = at.groupBy(*by, "time").agg(*[F.avg(v).alias(v) for v in values]).unionByName(grid, allowMissingColumns=True)
    both = both.groupBy(*by, "time").agg(*[F.max(v).alias(v) for v in values]).withColumn("_x", F.unix_seconds("time"))
    for v in values:
        both = interpolate(both, "_x", v, by, out=f"_{v}").drop(v).withColumnRenamed(f"_{v}", v)
    return both.drop("_x")


def two_pass_speed_filter(df: DataFrame, lon: str, lat: str, time: str, by: Sequence[str], order: Sequence[str], most_knots: float) -> DataFrame:
    """Flag `too_fast`: the ping's speed from the one before is above the limit, or there is none after it."""
    w = track_window(by, order)
    v = metres_per_second(F.col(lon), F.col(lat), F.col(time), w) * F.lit(KNOTS_PER_MS)
    return df.withColumn("too_fast", F.coalesce(v > most_knots, F.lit(False)) | _next(F.col(time), w).isNull())


def track_length(df: DataFrame, lon: str, lat: str, by: Sequence[str], order: Sequence[str], out: str = "length_m") -> DataFrame:
    """Length of each track's line in metres."""
    w = track_window(by, order)
    return df.withColumn("_d", distance(F.col(lon), F.col(lat), w)).groupBy(*by).agg(F.coalesce(F.sum("_d"), F.lit(0.0)).alias(out))
