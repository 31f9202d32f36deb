"""Sinks: track lines and map layers as tables and GeoJSON, files by vessel."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of JSON that a coordinate pair takes.
PAIR = "concat('[', cast(p.lon as string), ',', cast(p.lat as string), ']')"


def track_lines(df: DataFrame, by: Sequence[str], time: str = "time", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One line for each group: its points in order of time."""
    points = F.sort_array(F.collect_list(F.struct(F.col(time).alias("time"), F.col(lon).cast("double").alias("lon"), F.col(lat).cast("double").alias("lat"))))
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), points.alias("line"))


def line_features(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Track lines as GeoJSON features, one text for each."""
    pairs = F.array_join(F.expr(f"transform(line, p -> {PAIR})"), ",")
    properties = F.to_json(F.struct(*by))
    return lines.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"LineString","coordinates":['), pairs, F.lit("]}}")).alias("value"))


def point_features(df: DataFrame, lon: str = "lon", lat: str = "lat", colour: str = "speed", tooltip: Sequence[str] = ()) -> DataFrame:
    """Points as GeoJSON features with their colour value and tooltip."""
    properties = F.to_json(F.struct(F.col(colour).alias("colour"), *tooltip))
    where = F.concat(F.lit("["), F.col(lon).cast("double").cast("string"), F.lit(","), F.col(lat).cast("double").cast("string"), F.lit("]"))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), properties, F.lit(',"geometry":{"type":"Point","coordinates":'), where, F.lit("}}")).alias("value"))


def map_layer(df: DataFrame, colour: str = "speed", tooltip: Sequence[str] = (), no_lines: bool = True, radius: int = 400, by: Sequence[str] = ()) -> dict[str, DataFrame | dict]:
    """A map's layers: styled points, and with no_lines=False one line of all points (or one by group)."""
    out: dict[str, DataFrame | dict] = {"style": {"radius": radius, "colour": colour}, "points": point_features(df, colour=colour, tooltip=tooltip)}
    if not no_lines:
        rows = df if by else df.withColumn("_all", F.lit(1))
        out["lines"] = line_features(track_lines(rows, by or ["_all"]), by or ["_all"])
    return out


def trip_layer(df: DataFrame, trip: str = "tid", radius: int = 10, lines: bool = True) -> dict[str, DataFrame | dict]:
    """Points coloured by speed and one line for each trip."""
    return map_layer(df, "speed", [trip], not lines, radius, [trip])


def write_by_vessel(df: DataFrame, path: str, vessel: str = "vid", fmt: str = "parquet") -> None:
    df.repartition(vessel).write.mode("overwrite").partitionBy(vessel).format(fmt).save(path)


def write_lines(features: DataFrame, path: str) -> None:
    """GeoJSON features as text, one in a line."""
    features.write.mode("overwrite").text(path)
