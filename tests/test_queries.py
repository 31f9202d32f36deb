"""Every query with SQL against DuckDB on the smallest tables; the others run and give rows."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from fleettrack.plans import registry
from fleettrack.plans.views import view

SF = "/root/testdata/sf0.001"


def normal(df: pd.DataFrame) -> pd.DataFrame:
    cols = sorted(df.columns)
    out = pd.DataFrame({c: [None if v is None or pd.isna(v) else repr(float(v) + 0.0) if isinstance(v, (int, float, np.integer, np.floating)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in df[c].tolist()] for c in cols}, dtype=object)
    return out.fillna("").sort_values(cols).reset_index(drop=True)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_against_sql(spark, duck, name):
    got = normal(registry.QUERIES[name](spark, SF).toPandas())
    want = normal(duck.execute(registry.SQL[name]).df())
    pd.testing.assert_frame_equal(got, want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL) - {"forest_by_trip"}))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


@pytest.mark.parametrize("name, limit, timed", [("whacky_speed", 0.4 / 1.94384449, True), ("whacky_distance", 0.02 * 1852, False)])
def test_scans_flag_every_vessel(spark, name, limit, timed):
    got = {r["pid"]: r["whacky"] for r in registry.QUERIES[name](spark, SF).collect()}
    want = {}
    for _, g in view(spark, SF, "smooth").toPandas().sort_values(["vid", "time", "pid"]).groupby("vid"):
        lon, lat, sec = np.radians(g["lon"].to_numpy()), np.radians(g["lat"].to_numpy()), g["time"].astype("datetime64[us]").astype("int64").to_numpy() / 1e6

        def bad(a, b):
            h = np.sin((lat[b] - lat[a]) / 2) ** 2 + np.cos(lat[a]) * np.cos(lat[b]) * np.sin((lon[b] - lon[a]) / 2) ** 2
            metres = 2 * 6371008.8 * np.arcsin(np.sqrt(h))
            dt = sec[b] - sec[a]
            return bool((metres / dt if dt else np.inf if metres else 0) > limit) if timed else bool(metres > limit)

        flags, last = [False] * len(g), 0
        for k in range(1, len(g)):
            if not bad(last, k):
                last = k
            elif timed and k == 1:
                flags[0], last = True, 1
            else:
                flags[k] = True
        want |= dict(zip(g["pid"].tolist(), flags, strict=True))
    assert len(want) == spark.read.parquet(f"{SF}/events.parquet").count() and got == want


def test_minute_grid_of_every_vessel(spark):
    got = {r["vid"]: r["minutes"] for r in registry.QUERIES["resample_minutes"](spark, SF).collect()}
    ends = view(spark, SF, "pings").toPandas().assign(t=lambda d: d["time"].dt.floor("min")).groupby("vid")["t"].agg(["min", "max"])
    assert got == {v: int((b - a).total_seconds()) // 60 + 1 for v, a, b in ends.itertuples()}


@pytest.mark.parametrize("name", ["gaussian_thresholds", "binary_clusters", "hidden_states"])
def test_behaviour_of_every_vessel(spark, name):
    assert registry.QUERIES[name](spark, SF).count() == spark.read.parquet(f"{SF}/events.parquet").count()


def test_forest_query_uses_the_operator_s_defaults(spark, monkeypatch):
    seen = {}

    def forest(df, *args, **options):
        seen.update(options, vessels=df.select("vid").distinct().count())
        return df.selectExpr("pid", "1 AS fold", "kind", "kind AS predicted")

    monkeypatch.setattr(registry.behaviour, "forest_by_trip", forest)
    registry.QUERIES["forest_by_trip"](spark, SF)
    vessels = view(spark, SF, "pings").where("kind IN ('click', 'view')").select("vid").distinct().count()
    assert seen == {"vessels": vessels}
