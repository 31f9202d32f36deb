"""Summaries and the small table verbs that go with them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import strict


def summary(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """By group: n, first and last time; least, median and largest speed (null if any is), dist and dura; distinct trips and harbours."""
    three = lambda c, f: [f(a, F.col(c)).alias(f"{c}_{n}") for n, a in (("min", F.min), ("median", F.median), ("max", F.max))]
    plain = lambda a, c: a(c)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("time").alias("t_min"), F.max("time").alias("t_max"),
        *three("speed", strict), *three("dist", plain), *three("dura", plain),
        F.countDistinct("tid").alias("n_tid"), F.countDistinct("hid").alias("n_hid"),
    )


def duplicates(df: DataFrame, keys: Sequence[str], out: str = "n") -> DataFrame:
    """Rows with the number of rows of their key."""
    return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def at_least(df: DataFrame, keys: Sequence[str], n: int) -> DataFrame:
    """Rows of keys that have `n` rows or more."""
    return duplicates(df, keys, "_n").where(F.col("_n") >= n).drop("_n")


def near_next(x: Column, w, tolerance: float = 1.5e-8) -> Column:
    """Whether the next value is the same within a tolerance."""
    return F.abs(x - F.lead(x).over(w)) < tolerance


def bin_median(df: DataFrame, x: str, y: str, width: float) -> DataFrame:
    """Median of y by x rounded (half to even) to multiples of `width`."""
    return df.groupBy((F.bround(F.col(x) / width) * width).alias(x)).agg(F.median(y).alias(f"{y}_median"))


def round_to_second(t: Column) -> Column:
    return F.date_trunc("second", t + F.expr("interval 500 milliseconds"))


def split_id(x: Column, sep: str = "_") -> tuple[Column, Column]:
    """Two parts of an id, as numbers where they are."""
    parts = F.split(x, sep)
    return F.get(parts, 0), F.get(parts, 1).try_cast("int")


def counts_where(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """By group the number of rows for which each condition holds."""
    return df.groupBy(*by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def between_port_calls(df: DataFrame, in_port: str, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows from the first to the last ping in port of each group."""
    w = Window.partitionBy(*by).orderBy(*order)
    whole = Window.partitionBy(*by)
    n = df.withColumn("_k", F.row_number().over(w))
    at = F.when(F.col(in_port), F.col("_k"))
    return n.withColumns({"_a": F.min(at).over(whole), "_b": F.max(at).over(whole)}).where(F.col("_k").between(F.col("_a"), F.col("_b"))).drop("_k", "_a", "_b")


def buffered(df: DataFrame, start: str, end: str, before_days: int = 2, after_days: int = 3) -> DataFrame:
    return df.withColumns({start: F.col(start) - F.expr(f"interval {before_days} days"), end: F.col(end) + F.expr(f"interval {after_days} days")})


def grouped_folds(key: Column, k: int = 5) -> Column:
    """Fold 0 to k-1 of a row by its group: groups are never split."""
    return F.pmod(F.xxhash64(key), F.lit(k))


def confusion(df: DataFrame, truth: str, predicted: str, values: Sequence[str] | None = None) -> DataFrame:
    return df.groupBy(truth).pivot(predicted, list(values) if values else None).count().na.fill(0)


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def melt_ends(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Stations with lon1, lat1, t1, lon2, lat2, t2 as two rows each: end, lon, lat, t."""
    return df.select(*keys, F.expr("stack(2, 1, lon1, lat1, t1, 2, lon2, lat2, t2) as (end, lon, lat, t)"))
