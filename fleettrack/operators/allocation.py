"""Landed weight and value of logbook events spread over the pings of their trips."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import INTEGER, NUMERIC, require, sum0

TRIP = ["VE_COU", "VE_REF", "FT_REF"]
#: Fixed values.
HOW = {1: "1 trip_rectangle_day", 2: "2 trip_rectangle", 3: "3 trip"}


def _joined(a: DataFrame, b: DataFrame, same: dict[str, str], equal: dict[str, str], how: str = "left") -> DataFrame:
    """Join by columns of `a` and `b` among which nulls match (`same`) or don't (`equal`); b's go."""
    keys = {**same, **equal}
    other = b.select(*[F.col(c).alias(f"_r_{c}") if c in keys.values() else F.col(c) for c in b.columns])
    cond = F.lit(True)
    for left, right in same.items():
        cond &= F.col(left).eqNullSafe(F.col(f"_r_{right}"))
    for left, right in equal.items():
        cond &= F.col(left) == F.col(f"_r_{right}")
    return a.join(other, cond, how).drop(*[f"_r_{k}" for k in keys.values()])


BY_TRIP = {c: c for c in TRIP}


def _fished(trails: DataFrame) -> DataFrame:
    """The days and rectangles of each trip's fishing, with the number of pings (_c)."""
    return trails.where("state = 1").groupBy(*TRIP, "ir", F.to_date("time").alias("_d")).agg(F.count(F.lit(1)).alias("_c"))


def event_steps(trails: DataFrame, events: DataFrame) -> DataFrame:
    """Events with `step`: 1 if a fishing ping of the trip has its day and rectangle; 2 if it has no date and one has its rectangle; 3 if the trip has fishing pings; else 9999."""
    days = _fished(trails)
    then = days.select(*TRIP, "ir", "_d", F.lit(True).alias("_then"))
    there = days.groupBy(*TRIP, "ir").agg(F.lit(True).alias("_there"))
    ever = days.groupBy(*TRIP).agg(F.lit(True).alias("_ever"))
    known = _joined(events, then, BY_TRIP, {"LE_RECT": "ir", "date": "_d"})
    known = _joined(_joined(known, there, BY_TRIP, {"LE_RECT": "ir"}), ever, BY_TRIP, {})
    step = F.when(F.col("_then"), 1).when(F.col("date").isNull() & F.col("_there"), 2).when(F.col("_ever"), 3).otherwise(9999)
    return known.withColumn("step", step).drop("_then", "_there", "_ever")


def _shares(days: DataFrame, events: DataFrame) -> DataFrame:
    """For each trip, rectangle and day of fishing what one ping gets: _how, _wt, _kg, _eu.

    Pings and events are counted and summed by trip, rectangle and day first; what follows is windows over those sums, all within the trip.
    """
    sums = events.groupBy(*TRIP, F.col("LE_RECT").alias("ir"), F.col("date").alias("_d")).agg(sum0(F.col("LE_KG")).alias("_kg"), sum0(F.col("LE_EURO")).alias("_eu"))
    t = days.unionByName(sums, allowMissingColumns=True)
    within = lambda *by: Window.partitionBy(*TRIP, *by)
    rect, day = F.col("ir").isNotNull(), F.col("ir").isNotNull() & F.col("_d").isNotNull()
    for name, by in (("_ever", ()), ("_there", ("ir",)), ("_then", ("ir", "_d"))):  # the widest key first: its exchange serves all
        t = t.withColumn(name, F.max("_c").over(within(*by)).isNotNull())
    t = t.withColumn("_step", F.when(F.col("_c").isNull(), F.when(day & F.col("_then"), 1).when(F.col("_d").isNull() & rect & F.col("_there"), 2).when(F.col("_ever"), 3)))
    for step, by in ((3, ()), (2, ("ir",)), (1, ("ir", "_d"))):
        of_step = lambda c, step=step: F.when(F.col("_step") == step, F.col(c))
        t = t.withColumns({f"{c}{step}": F.sum(of_step(c)).over(within(*by)) for c in ("_kg", "_eu")})
    t = t.where(F.col("_c").isNotNull()).withColumn("_step", F.when(day & F.col("_kg1").isNotNull(), 1).when(rect & F.col("_kg2").isNotNull(), 2).otherwise(3))
    pings = lambda step, *by: F.sum(F.when(F.col("_step") == step, F.col("_c"))).over(within(*by))
    t = t.withColumn("_n3", pings(3)).withColumn("_n2", pings(2, "ir"))
    n = F.when(F.col("_step") == 1, F.col("_c")).when(F.col("_step") == 2, F.col("_n2")).otherwise(F.col("_n3"))
    of = lambda c: F.when(F.col("_step") == 1, F.col(f"{c}1")).when(F.col("_step") == 2, F.col(f"{c}2")).otherwise(F.col(f"{c}3")) / n
    named = F.when(F.col("_step") == 1, HOW[1]).when(F.col("_step") == 2, HOW[2]).otherwise(HOW[3])
    return t.select(*TRIP, "ir", "_d", named.alias("_how"), (1 / n).alias("_wt"), of("_kg").alias("_kg"), of("_eu").alias("_eu"))


def spread_catch(trails: DataFrame, events: DataFrame, remove_diagnostic: bool = True, check: bool = False) -> DataFrame:
    """Trails with LE_KG, LE_EURO and .how. Events go to the fishing pings of their trip, rectangle and day, in equal parts; those
    without a date to the pings of trip and rectangle that are left; the rest to what is left of the trip.

    check=True raises when .pid repeats, and warns when weight was lost (no ping was left to take it).
    """
    require(trails, {".pid": INTEGER, "VE_COU": "string", "VE_REF": "string", "FT_REF": "string", "time": "timestamp", "ir": "string", "state": INTEGER})
    require(events, {".eid": INTEGER, "VE_COU": "string", "VE_REF": "string", "FT_REF": "string", "date": "date", "LE_RECT": "string", "LE_KG": NUMERIC, "LE_EURO": NUMERIC})
    if check and trails.count() != trails.select("`.pid`").distinct().count():
        raise ValueError(".pid is not unique")
    shares = _shares(_fished(trails), events)
    t = trails.drop("date").withColumns({"_day": F.to_date("time"), "_fishing": F.when(F.col("state") == 1, 1)})
    t = _joined(t, shares.withColumn("_one", F.lit(1)), {**BY_TRIP, "ir": "ir", "_day": "_d"}, {"_fishing": "_one"})
    kept = [F.col(f"`{c}`") for c in trails.columns if c != "date"]
    day = F.when(F.col("_how").eqNullSafe(HOW[2]), None).otherwise(F.col("_day")).alias("date")
    out = t.select(*kept, day, F.col("_wt").alias(".wt"), F.col("_kg").alias("LE_KG"), F.col("_eu").alias("LE_EURO"), F.col("_how").alias(".how"))
    if check:
        given, spread = events.agg(sum0(F.col("LE_KG"))).first()[0], out.agg(sum0(F.col("LE_KG"))).first()[0]
        if abs(given - spread) > 1e-6 * max(1.0, abs(given)):
            warnings.warn(f"weight of events {given}, of pings {spread}", stacklevel=2)
    return out.drop("date", ".wt") if remove_diagnostic else out
