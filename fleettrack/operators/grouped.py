"""applyInPandas for frames whose column names may hold dots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T


def grouped(df: DataFrame, by: Sequence[str], extra: Sequence[tuple[str, T.DataType]], fn: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    """`fn` on each group, which gives the columns of `df` and the `extra` ones."""
    names = df.columns
    plain = [f"c{k}" for k in range(len(names) + len(extra))]
    fields = [*[f.dataType for f in df.schema.fields], *[t for _, t in extra]]
    every = [*names, *[n for n, _ in extra]]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf.columns = names
        out = fn(pdf)[every]
        out.columns = plain
        return out

    keys = [plain[names.index(b)] for b in by]
    schema = T.StructType([T.StructField(p, t) for p, t in zip(plain, fields, strict=True)])
    return df.toDF(*plain[: len(names)]).groupBy(*keys).applyInPandas(run, schema).toDF(*every)
