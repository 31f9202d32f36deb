"""Column helpers for a three-valued, null-aware data-frame semantics on ANSI Spark."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def if_else(cond: Column, yes, no, missing=None) -> Column:
    """`yes` or `no`; where the condition is null, `missing` (null by default)."""
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    out = F.when(cond, as_col(yes)).when(~cond, as_col(no))
    return out if missing is None else out.otherwise(as_col(missing))


def is_in(x: Column, values) -> Column:
    """Membership that is false, not null, for null."""
    return F.coalesce(x.isin(*values), F.lit(False))


def divide(a: Column, b: Column) -> Column:
    """a / b as doubles: plus or minus infinity over 0, null for 0 / 0."""
    a, b = a.cast("double"), b.cast("double")
    return F.when(b != 0, a / b).when((b == 0) & (a > 0), F.lit(INF)).when((b == 0) & (a < 0), F.lit(-INF))


def no_nan(x: Column) -> Column:
    return F.when(~F.isnan(x), x)


def sum0(x: Column) -> Column:
    """Sum without nulls; 0 for none."""
    return F.coalesce(F.sum(x), F.lit(0.0))


def strict(agg, x: Column) -> Column:
    """`agg(x)`, but null when any x is null."""
    return F.when(F.count(x) == F.count(F.lit(1)), agg(x))


def log_inf(x: Column) -> Column:
    """Natural logarithm with minus infinity at 0 and null below."""
    return F.when(x == 0, F.lit(-INF)).when(x > 0, F.ln(x))


def micros_between(start: Column, end: Column) -> Column:
    """Microseconds from `start` to `end`, for timestamps with or without zone."""
    return F.timestamp_diff("MICROSECOND", start, end)


#: Seconds in each unit.
UNITS = {"secs": 1, "mins": 60, "hours": 3600, "days": 86400, "weeks": 604800}


def elapsed(start: Column, end: Column, units: str = "secs") -> Column:
    return micros_between(start, end) / F.lit(1e6 * UNITS[units])


def add_all(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def require(df: DataFrame, columns: dict[str, str | tuple[str, ...]]) -> None:
    """Raise ValueError unless `df` has the columns with one of the given type prefixes; no job runs."""
    types = dict(df.dtypes)
    for name, kinds in columns.items():
        kinds = (kinds,) if isinstance(kinds, str) else kinds
        if name not in types:
            raise ValueError(f"column {name} is missing")
        if not any(types[name].startswith(k) for k in kinds):
            raise ValueError(f"column {name} is {types[name]}, not {' or '.join(kinds)}")


NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
INTEGER = ("tinyint", "smallint", "int", "bigint")
TIME = ("timestamp",)
