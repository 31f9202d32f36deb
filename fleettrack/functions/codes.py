"""Codes of gears, métiers and radio stations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _part(x: Column, k: int) -> Column:
    return F.get(F.split(x, "_"), k)


def gear_of_metier(x: Column) -> Column:
    return _part(x, 0)


def target_of_metier(x: Column, strict: bool = False) -> Column:
    """Second part; where there is none null, or an error with strict=True."""
    part = _part(x, 1)
    return F.when(part.isNotNull() | x.isNull(), part).otherwise(F.raise_error(F.concat(F.lit("no target in "), x))) if strict else part


def level5_of_level6(x: Column, strict: bool = False) -> Column:
    """First two parts; a missing one is written NA, or makes the result null with strict=True."""
    if strict:
        return F.concat(_part(x, 0), F.lit("_"), _part(x, 1))
    return F.concat_ws("_", F.coalesce(_part(x, 0), F.lit("NA")), F.coalesce(_part(x, 1), F.lit("NA")))


#: Leading digits of a nine-digit station number and what it is, first match first. Fixed values.
STATIONS = [
    ("0", "coast station"), ("1", "SAR aircraft"), ("[2-7]", "vessel"), ("8", "Handheld VHF transceiver"),
    ("970", "Search and Rescue Transponders"), ("972", "Man overboard"), ("974", "406 MHz EPIRBs fitted with an AIS transmitter"),
    ("98", "Child vessel"), ("99", "Navigational aid"), ("9", "Starts with 9"),
]


def mmsi_category(mmsi: Column) -> Column:
    x = mmsi.cast("string")
    out = F.lit(None).cast("string")
    for prefix, name in reversed(STATIONS):
        out = F.when(x.rlike(f"^{prefix}"), name).otherwise(out)
    return F.when(x.rlike("^[0-9]{9}$"), out)


def mmsi_flag(df: DataFrame, lookup: DataFrame, mmsi: str = "mmsi", mid: str = "MID", flag: str = "flag") -> DataFrame:
    """Adds `flag` by the country digits: the first three of vessels, the third to fifth of child vessels, of numbers with nine digits. One row of `lookup` per MID counts."""
    x = F.col(mmsi).cast("string")
    key = F.when(x.rlike(r"^[2-7][0-9]{8}\z"), F.substring(x, 1, 3)).when(x.rlike(r"^98[0-9]{7}\z"), F.substring(x, 3, 3)).try_cast("int")
    known = lookup.groupBy(F.col(mid).cast("int").alias("_mid")).agg(F.min(flag).alias(flag))
    return df.join(known, key == F.col("_mid"), "left").drop("_mid")
