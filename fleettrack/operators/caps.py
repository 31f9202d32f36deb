"""Upper caps of a column, over the whole frame or by group: by interquartile range, by quantile, or by gaps between magnitudes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import log_inf


def _attach(df: DataFrame, caps: DataFrame, by: Sequence[str]) -> DataFrame:
    """`df` with the column _cap of its group."""
    if not by:
        return df.crossJoin(caps)  # one row
    cond = None
    for k in by:
        part = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        cond = part if cond is None else cond & part
    return df.join(caps.select(*[F.col(k).alias(f"_r_{k}") for k in by], "_cap"), cond, "left").drop(*[f"_r_{k}" for k in by])


def _capped(df: DataFrame, x: str, caps: DataFrame, by: Sequence[str], out: str | None) -> DataFrame:
    value = F.when(F.col(x) > F.col("_cap"), F.col("_cap")).otherwise(F.col(x).cast("double"))
    return _attach(df, caps, by).withColumn(out or x, value).drop("_cap")


def quartile_caps(df: DataFrame, x: str, by: Sequence[str] = (), multiplier: float = 1.5) -> DataFrame:
    """(by..., _cap): exp of the lesser of the largest log and the third quartile plus `multiplier` interquartile ranges of the logs."""
    logs = df.where(F.col(x) >= 0).withColumn("_l", log_inf(F.col(x).cast("double")))
    q = logs.groupBy(*by).agg(F.percentile("_l", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), F.max("_l").alias("_most"))
    fence = F.col("_q")[1] + (F.col("_q")[1] - F.col("_q")[0]) * multiplier
    return q.select(*by, F.exp(F.when(F.isnan(fence), F.col("_most")).otherwise(F.least(F.col("_most"), fence))).alias("_cap"))


def cap_quartile(df: DataFrame, x: str, by: Sequence[str] = (), multiplier: float = 1.5, out: str | None = None) -> DataFrame:
    return _capped(df, x, quartile_caps(df, x, by, multiplier), by, out)


def quantile_caps(df: DataFrame, x: str, by: Sequence[str] = (), prob: float = 0.99, na_rm: bool = False) -> DataFrame:
    """(by..., _cap): the exact quantile with linear interpolation. A null is an error when the job runs, unless `na_rm`."""
    v = F.col(x).cast("double")
    v = v if na_rm else F.when(v.isNotNull(), v).otherwise(F.raise_error(F.lit(f"{x} holds nulls")).cast("double"))
    return df.groupBy(*by).agg(F.percentile(v, F.lit(prob)).alias("_cap"))


def cap_quantile(df: DataFrame, x: str, by: Sequence[str] = (), prob: float = 0.99, na_rm: bool = False, out: str | None = None) -> DataFrame:
    return _capped(df, x, quantile_caps(df, x, by, prob, na_rm), by, out)


def gap_caps(df: DataFrame, x: str, by: Sequence[str] = (), step_limit: float = 1.5) -> DataFrame:
    """(by..., _cap): of the sorted distinct positive values, the one behind the last gap of at most `step_limit` decimal magnitudes.

    Without a larger gap, or with larger gaps only, it is the largest value; without positive values 0.
    """
    v = F.col(x).cast("double")
    distinct = df.where(v > 0).select(*by, v.alias("_v")).distinct()
    w = Window.partitionBy(*by).orderBy("_v")
    gaps = distinct.withColumn("_gap", F.log10("_v") - F.log10(F.lag("_v").over(w)))
    good = F.max(F.when(F.col("_gap") <= step_limit, F.col("_v")))
    caps = gaps.groupBy(*by).agg(F.max("_v").alias("_most"), good.alias("_good"), F.max("_gap").alias("_widest"))
    caps = caps.select(*by, F.when((F.col("_widest") > step_limit) & F.col("_good").isNotNull(), F.col("_good")).otherwise(F.col("_most")).alias("_cap"))
    every = df.groupBy(*by).agg(F.lit(0.0).alias("_zero")) if by else df.sparkSession.range(1).select(F.lit(0.0).alias("_zero"))
    filled = _attach(every, caps, by) if by else every.join(caps, F.lit(True), "left")
    return filled.select(*by, F.coalesce("_cap", "_zero").alias("_cap"))


def cap_gaps(df: DataFrame, x: str, by: Sequence[str] = (), step_limit: float = 1.5, out: str | None = None) -> DataFrame:
    return _capped(df, x, gap_caps(df, x, by, step_limit), by, out)


def cap_at(x: Column, cap: Column) -> Column:
    return F.when(x > cap, cap).otherwise(x)
