"""Scalar functions: units, grids, statistical rectangles, dates, text tests, prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .semantics import NUMERIC, add_all, require

#: Fixed values.
KNOTS_PER_MS = 1.94384449
RECT_LETTERS = "ABCDEFGHJKLM"
RECT_LETTERS_WITH_I = "ABCDEFGHIJKL"


def ms_to_knots(x: Column) -> Column:
    return x * F.lit(KNOTS_PER_MS)


def knots_to_ms(x: Column) -> Column:
    return x / F.lit(KNOTS_PER_MS)


def grade(x: Column, dx: float) -> Column:
    """Midpoint of the bin of width `dx` that holds x."""
    if not isinstance(dx, (int, float)) or dx <= 0:
        raise ValueError("dx must be one number above 0")
    return F.floor(x / F.lit(float(dx))) * F.lit(float(dx)) + F.lit(dx / 2)


def statistical_rectangle(lon: Column, lat: Column, safe: bool = True, use_i: bool = False) -> Column:
    """Code of the statistical rectangle (0.5 degree by 1 degree) of a position: two digits, a letter, a digit. Null outside the area."""
    outside = (lat < 36) | (lat >= 85) | (lon <= -44) | (lon > 69)
    x, y = (grade(lon, 1), grade(lat, 0.5)) if safe else (lon, lat)
    row = F.lpad((F.floor(y * 2) - 71).cast("string"), 2, "0")
    letters = F.lit(RECT_LETTERS_WITH_I if use_i else RECT_LETTERS)
    band = F.floor((x + 60) / 10).cast("int")
    letter = F.substring(letters, band, 1)
    digit = F.when(letter == "A", F.floor(F.pmod(x, F.lit(4.0)))).otherwise(F.floor(F.pmod(x, F.lit(10.0))))
    return F.when(~outside, F.concat(row, letter, digit.cast("string")))


def statistical_rectangle_alt(lon: Column, lat: Column) -> Column:
    """The other convention: truncated row, right-closed letter bands west of 0, J beyond 30 degrees east and 50 degrees west."""
    row = F.lpad(F.when(2 * (lat - 35.5) >= 0, F.floor(2 * (lat - 35.5))).otherwise(F.ceil(2 * (lat - 35.5))).cast("string"), 2, "0")
    letter = (
        F.when((lon >= 0) & (lon < 10), "F").when((lon >= 10) & (lon < 20), "G").when((lon >= 20) & (lon < 30), "H")
        .when((lon > -10) & (lon < 0), "E").when((lon > -20) & (lon <= -10), "D").when((lon > -30) & (lon <= -20), "C")
        .when((lon > -40) & (lon <= -30), "B").when((lon > -50) & (lon <= -40), "A").when(lon.isNotNull(), "J")
    )
    west = F.pmod(F.ceil(F.pmod(lon, F.lit(10.0)) - 1 + 10), F.lit(10))
    digit = F.when(lon < 0, west).otherwise(F.floor(F.pmod(lon, F.lit(10.0))))
    return F.concat(row, letter, digit.cast("string"))


def crosses_year(start: Column, end: Column) -> Column:
    return F.year(start) != F.year(end)


def crosses_year_checked(df: DataFrame, start: str, end: str, out: str = "crosses_year") -> DataFrame:
    """`crosses_year` after a check that both columns have the same date or timestamp type."""
    kinds = dict(df.dtypes)
    require(df, {start: ("date", "timestamp"), end: ("date", "timestamp")})
    if kinds[start] != kinds[end]:
        raise ValueError(f"{start} is {kinds[start]}, {end} is {kinds[end]}")
    return df.withColumn(out, crosses_year(F.col(start), F.col(end)))


#: strptime codes and their patterns here. Fixed values; one-digit fields parse too.
STRPTIME = {"%d": "d", "%m": "M", "%Y": "yyyy", "%y": "yy", "%H": "H", "%M": "m", "%S": "s", "%b": "MMM", "%B": "MMMM", "%j": "D"}


def make_timestamp(date: Column, time: Column, tz: str = "GMT", fmt: str = "%d/%m/%Y %H:%M:%S") -> Column:
    """Timestamp from a date text and a time text in `tz`; null where they don't parse (29/02 of a common year among them)."""
    for code, pattern in STRPTIME.items():
        fmt = fmt.replace(code, pattern)
    at = F.try_to_timestamp(F.concat_ws(" ", F.when(date.isNotNull() & time.isNotNull(), date), time), F.lit(fmt))
    return at if tz in ("GMT", "UTC") else F.to_utc_timestamp(at, tz)


def logbook_crosses_year(df: DataFrame, check: bool = False) -> DataFrame:
    """Adds departure and landing timestamps where missing, and crosses_year; check=True raises a warning if any trip crosses."""
    require(df, {"FT_DDAT": "", "FT_DTIME": "", "FT_LDAT": "", "FT_LTIME": ""})
    if "FT_DDATIM" not in df.columns:
        df = df.withColumn("FT_DDATIM", make_timestamp(F.col("FT_DDAT"), F.col("FT_DTIME")))
    if "FT_LDATIM" not in df.columns:
        df = df.withColumn("FT_LDATIM", make_timestamp(F.col("FT_LDAT"), F.col("FT_LTIME")))
    df = df.withColumn("crosses_year", crosses_year(F.col("FT_DDATIM"), F.col("FT_LDATIM")))
    if check and df.where("crosses_year").limit(1).count():
        import warnings

        warnings.warn("some trips cross the turn of a year", stacklevel=2)
    return df


def sum_across(df: DataFrame, prefix: str = "LE_KG", remove: bool = True) -> DataFrame:
    """Row sum of the numeric columns whose names start with `prefix`, as a column of that name; null if any is null."""
    if not isinstance(prefix, str) or not prefix:
        raise ValueError("prefix must be one text")
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        raise ValueError(f"no column starts with {prefix}")
    kinds = dict(df.dtypes)
    if wrong := [c for c in names if not kinds[c].startswith(NUMERIC)]:
        raise ValueError(f"not numeric: {', '.join(wrong)}")
    out = df.withColumn("_sum", add_all(F.col(f"`{c}`") for c in names))
    out = out.drop(*[c for c in names if remove or c == prefix])
    return out.withColumnRenamed("_sum", prefix)


def letters_only(x: Column) -> Column:
    return F.coalesce(~x.rlike("[^A-Za-z]"), F.lit(True))


def numbers_only(x: Column) -> Column:
    return F.coalesce(~x.rlike("[^0-9]"), F.lit(True))


def _extract(x: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, group), F.lit(""))


def between_parentheses(x: Column) -> Column:
    return _extract(x, r"(?<=\()(.+?)(?=\))", 1)


def dmy_period(x: Column) -> Column:
    """The first run like 1.2.2020: three numbers with signs between."""
    return _extract(x, r"\d+\D+\d+\D+\d+", 0)
