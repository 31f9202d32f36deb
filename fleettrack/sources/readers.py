"""Sources: files with stated schemas, database tables, code lists. Schemas are never inferred."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import ms_to_knots

HARBOURS = "SI_HARB int, ring array<struct<x: double, y: double>>"
SURVEY_TRACKS = "vid int, cruise_id int, time timestamp, lon double, lat double, speed double, heading double"
SURVEY_STATIONS = "cruise_id int, station_id int, station_nr int, date date, vid int, sclass int, lon1 double, lat1 double, t1 timestamp, lon2 double, lat2 double, t2 timestamp"


def read_table(spark: SparkSession, path: str | None = None, fmt: str = "parquet", jdbc: dict | None = None, schema: str | None = None) -> DataFrame:
    """A Parquet, ORC, JSON or CSV path, or a JDBC table (filters and columns are pushed down to either)."""
    if jdbc:
        return spark.read.format("jdbc").options(**jdbc).load()
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    return (reader.schema(schema) if schema else reader).load(path)


def read_harbours(spark: SparkSession, path: str, fmt: str = "json") -> DataFrame:
    return read_table(spark, path, fmt, schema=HARBOURS)


def read_survey_tracks(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "csv", schema=SURVEY_TRACKS)


def read_survey_stations(spark: SparkSession, path: str) -> DataFrame:
    return read_table(spark, path, "csv", schema=SURVEY_STATIONS)


def mobile_periods(df: DataFrame) -> DataFrame:
    """Device periods: t1 and t2 texts like 2020:01:31 as dates."""
    return df.withColumns({t: F.try_to_timestamp(F.col(t), F.lit("yyyy:MM:dd")).cast("date") for t in ("t1", "t2")})


#: Names of the trail table and what they are here. Fixed values.
TRAIL_NAMES = {"mobileid": "mid", "posdate": "time", "poslon": "lon", "poslat": "lat", "harborid": "hid", "in_out_of_harbor": "io", "recdate": "rectime"}


def database_trail(df: DataFrame) -> DataFrame:
    """Positions from radians to degrees and speed from m/s to knots: mid, time, lon, lat, speed, heading, hid, io, rectime, and the rest of the columns. The trail table's own names are replaced (TRAIL_NAMES)."""
    df = df.withColumnsRenamed({a: b for a, b in TRAIL_NAMES.items() if a in df.columns and b not in df.columns})
    return df.withColumns({"lon": F.col("lon") * (180 / 3.141592653589793), "lat": F.col("lat") * (180 / 3.141592653589793), "heading": F.col("heading") * (180 / 3.141592653589793), "speed": F.col("speed") * 3600 / 1852})


def vessel_trail(trails: DataFrame, periods: DataFrame, vids: Sequence[int] | DataFrame | None = None) -> DataFrame:
    """Trails of vessels (a list, or a frame with vid), by the devices that they had at the time; all trails, without vessel, when `vids` is None."""
    if vids is None:
        return trails
    mine = periods.join(vids.select("vid").distinct(), "vid", "left_semi") if isinstance(vids, DataFrame) else periods.where(F.col("vid").isin(list(vids)))
    known = mine.where((F.col("pings").isNotNull() | (F.col("link") == "manual"))).select(F.col("mid").alias("_mid"), "vid", "t1", "t2")
    return trails.join(known, (F.col("mid") == F.col("_mid")) & F.col("time").between(F.col("t1"), F.col("t2"))).drop("_mid", "t1", "t2")


def combined_trails(sources: dict[str, DataFrame], years: Sequence[int], box: tuple[float, float, float, float] = (-60, 60, 50, 80), distinct_time: Sequence[str] = ("stk", "lbs"), speeds_in_ms: Sequence[str] = ()) -> DataFrame:
    """Trails of several sources between the first of the first year and 31 December (at 0:00) of the last, in the box, numbered by vessel and time as .rid over all rows.

    Of rows of `distinct_time` sources with the same vessel and time one is kept; the speeds of `speeds_in_ms` sources become knots. Rows without a position go.
    A row's number is its place within the vessel behind the rows of all vessels before, so that no task orders all rows.
    """
    parts = []
    for name, df in sources.items():
        df = df.where(F.col("time").between(F.lit(f"{min(years)}-01-01").cast("timestamp"), F.lit(f"{max(years)}-12-31").cast("timestamp")))
        if name in distinct_time:
            w = Window.partitionBy("vid", "time").orderBy("lon", "lat", "speed")
            df = df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
        if name in speeds_in_ms:
            df = df.withColumn("speed", ms_to_knots(F.col("speed")))
        parts.append(df.withColumn("source", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    out = out.where(F.col("lon").between(box[0], box[1]) & F.col("lat").between(box[2], box[3]))
    before = Window.orderBy(F.asc_nulls_last("vid")).rowsBetween(Window.unboundedPreceding, -1)  # one row for each vessel
    bases = out.groupBy("vid").agg(F.count(F.lit(1)).alias("n")).select(F.col("vid").alias("_vid"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"))
    ties = [c for c in ("lon", "lat", "speed") if c in out.columns]
    numbered = out.withColumn("_k", F.row_number().over(Window.partitionBy("vid").orderBy("time", "source", *ties)))
    joined = numbered.join(bases, F.col("vid").eqNullSafe(F.col("_vid")), "left")
    return joined.withColumn(".rid", F.col("_base") + F.col("_k")).drop("_vid", "_base", "_k")


def code_list(df: DataFrame, key: str, trim: bool = True, valid: bool = True, remove: str | None = None, description: str = "description") -> DataFrame:
    """A published code list (Key, Description, Deprecated): with `trim` the key as `key` and its description; with `valid` current codes only."""
    if not trim:
        return df
    if valid:
        df = df.where(~F.coalesce(F.col("Deprecated").cast("boolean"), F.lit(False)))
    text: Column = F.regexp_replace("Description", remove, "") if remove else F.col("Description")
    return df.select(F.col("Key").alias(key), text.alias(description))


def metier5_codes(df: DataFrame, trim: bool = True, valid: bool = True) -> DataFrame:
    return code_list(df, "metier5", trim, valid)


def metier6_codes(df: DataFrame, trim: bool = True, valid: bool = True) -> DataFrame:
    return code_list(df, "metier6", trim, valid, remove=", see.*device")


def gear_codes(df: DataFrame, trim: bool = True, valid: bool = True) -> DataFrame:
    """The key is called target here too, as users of the list expect."""
    return code_list(df, "target", trim, valid)


def target_codes(df: DataFrame, trim: bool = True, valid: bool = True) -> DataFrame:
    return code_list(df, "target", trim, valid)


def metier5_benthis_lookup(df: DataFrame, metier6: str = "Metier_level6", benthis: str = "Benthis_metiers", trim: bool = True) -> DataFrame:
    """Level-5 métier to benthis métier, distinct, from a table by level 6."""
    from ..functions.codes import level5_of_level6

    if not trim:
        return df
    out = df.select(level5_of_level6(F.col(metier6)).alias("metier5"), F.col(benthis).alias("benthis_metier"))
    return out.where(F.col("benthis_metier").isNotNull() & (F.col("benthis_metier") != "")).distinct()


def sample_outlier_track(spark: SparkSession) -> DataFrame:
    """46 pings a minute apart on a straight course, with known outliers (whacks). Fixed values."""
    odd = F.col("id").isin(5, 10, 11, 15, 16, 17, *range(27, 32))
    t = F.timestamp_add("SECOND", (F.col("id") - 1) * 60, F.lit("2022-10-15 00:00:00").cast("timestamp"))
    lat = 62 + (F.col("id") - 1) * (0.2 / 45)
    return spark.range(1, 47).select(
        F.col("id").cast("int").alias(".rid"), F.lit(1.0).alias("vid"), F.lit(1.0).alias("tid"),
        F.when(odd, -24.5).when(F.col("id") == 40, -25.04).otherwise(-25.0).alias("lon"),
        F.when(F.col("id") == 40, 62.04).otherwise(lat).alias("lat"), t.alias("time"), (odd | (F.col("id") == 40)).alias("whacks"),
    )
