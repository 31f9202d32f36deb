"""Operators against small fixtures, plain Python versions and properties."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fleettrack.operators import allocation, behaviour, caps, joins, logbook, outliers, raster, spatial, summary, track, trips
from fleettrack.sources import readers, sinks
from fleettrack.streaming.trips import trip_sessions

T0 = dt.datetime(2022, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


@pytest.fixture
def interval_fixture(spark):
    ve = spark.createDataFrame([("A", at(10)), ("A", at(15)), ("A", at(32)), ("B", at(12))], "vid string, time timestamp")
    le = spark.createDataFrame([("A", 101.0, at(9), at(16)), ("A", 102.0, at(31), at(33)), ("B", 201.0, at(11), at(13))], "vid string, tid double, T1 timestamp, T2 timestamp")
    return ve, le


@pytest.mark.parametrize("bucket", [None, 3600, 86400])
def test_add_trip_id(interval_fixture, bucket):
    ve, le = interval_fixture
    out = joins.add_trip_id(ve, le, bucket_seconds=bucket)
    assert out.columns == ["vid", "time", "tid"]
    assert [r["tid"] for r in out.orderBy("vid", "time").collect()] == [101, 101, 102, 201]
    with pytest.raises(ValueError):
        joins.add_trip_id(ve.drop("time"), le)


def test_add_trip_id_without_match(spark, interval_fixture):
    _, le = interval_fixture
    ve = spark.createDataFrame([("C", at(10))], "vid string, time timestamp")
    with pytest.warns(UserWarning):
        assert joins.add_trip_id(ve, le, check=True).first()["tid"] is None


def test_trip_ids(spark):
    rows = [(1, k, h) for k, h in enumerate([True, True, False, False, True, False])]
    d = spark.createDataFrame(rows, "vid int, time int, h boolean")
    assert [r["tid"] for r in track.trip_ids(d, "h", ["vid"], ["time"]).orderBy("time").collect()] == [-1, -1, 1, 1, -2, 2]


def test_runs_with_nulls(spark):
    d = spark.createDataFrame([(1, k, x) for k, x in enumerate(["a", "a", None, None, "b"])], "vid int, time int, x string")
    w = track.track_window(["vid"], ["time"])
    assert [r[0] for r in d.select(track.run_id(F.col("x"), w), "time").orderBy("time").collect()] == [1, 1, 2, 3, 4]


def test_track_time_of_one_ping(spark):
    d = spark.createDataFrame([(1, T0)], "vid int, time timestamp")
    for weight in ((0, 1), (1, 0), (1, 1)):
        assert track.track_time(d, "time", ["vid"], ["time"], weight).first()["dt"] is None


def test_interpolate(spark):
    d = spark.createDataFrame([(1, 0, None), (1, 1, 10.0), (1, 2, None), (1, 3, 30.0), (1, 3, 50.0), (1, 4, None)], "vid int, x int, y double")
    assert [r["y_filled"] for r in track.interpolate(d, "x", "y", ["vid"]).orderBy("x").collect()] == [None, 10, 25, 40, 40, None]


def removal_rounds(lon, lat, sec, limit):
    """The first offender goes, all is computed again: the definition of the speed filter."""
    keep = list(range(len(lon)))
    while True:
        for i in range(1, len(keep)):
            a, b = keep[i - 1], keep[i]
            d = outliers._metres(*np.radians([lon[a], lat[a], lon[b], lat[b]]))
            if d / (sec[b] - sec[a]) > limit:
                keep.remove(keep[i] if keep[i] != 1 else 0)
                break
        else:
            return [k not in keep for k in range(len(lon))]


def test_scan_is_repeated_removal():
    rnd = random.Random(3)
    for _ in range(200):
        n = rnd.randint(1, 12)
        lon, lat = np.cumsum([rnd.choice([0, 0.001, 0.05]) for _ in range(n)]), np.full(n, 60.0)
        sec = np.arange(n) * 60.0
        assert outliers.scan(lon, lat, sec, 12.0, True).tolist() == removal_rounds(lon, lat, sec, 12.0)


def test_known_outliers(spark):
    d = readers.sample_outlier_track(spark)
    got = outliers.implausible_speed(d, "lon", "lat", "time", ["vid", "tid"], ["time"], 25)
    assert got.where("whacky <> whacks and `.rid` <> 40").count() == 0


def test_planar_filter_leaves_no_fast_ping(spark):
    rnd = random.Random(1)
    rows = [(float(rnd.choice([0, 1, 5000]) + k), 0.0, T0 + dt.timedelta(seconds=60 * k), k % 2, k) for k in range(60)]
    out = outliers.planar_speed_filter(spark.createDataFrame(rows, "x double, y double, time timestamp, device_id int, seq int")).toPandas()
    assert (out["speed"].dropna() <= 25).all() and out["seq"].is_unique


def test_rms_filter_and_peek(spark):
    d = readers.sample_outlier_track(spark)
    flags = outliers.implausible_trip_speed(d, "lon", "lat", "time", ["vid"], ["time"], filter=False)
    assert flags.where("whacky").count() > 0
    near = outliers.peek(d, "lon", -24.9, reach=2)
    assert near.where("whacky = 'whacky'").count() == 11 and outliers.peek(d, "lon", 0).count() == 0


def plain_trips(rows, least, most_n=None):
    """Trips of one vessel by a loop: (time, in harbour) in order."""
    out, n, start = {}, 0, None
    for k, (_t, h) in enumerate(rows):
        if not h and start is None:
            n, start = n + 1, k
        if start is not None and (h or k == len(rows) - 1):
            if (rows[k][0] - rows[start][0]).total_seconds() / 3600 > least:
                out.update({i: n for i in range(start, k + 1)})
            start = None
    return out


def test_harbour_trips(spark):
    rnd = random.Random(9)
    rows = [[at(0.4 * k) for k in range(80)], [rnd.random() < 0.4 for _ in range(80)]]
    rows = list(zip(*rows, strict=True))
    d = spark.createDataFrame([("v", t, h, k) for k, (t, h) in enumerate(rows)] + [("w", at(k), False, k) for k in range(5)], "vid string, time timestamp, h boolean, rid int")
    got = trips.harbour_trips(d, "vid", "time", "h", "rid", split=False).where("vid = 'v'").orderBy("rid", "trip_id").collect()
    want = plain_trips(rows, 0.5)
    assert {r["rid"] for r in got if r["trip_id"]} == set(want)
    assert all(r["trip_id"] == f"v_{want[r['rid']]}" for r in got if r["trip_id"])
    assert trips.harbour_trips(d, "vid", "time", "h", "rid").where("vid = 'w' and trip_id is not null").count() == 0


def test_long_trips_are_cut(spark):
    hours = [0, 1, 2, 3, 50, 51, 52, 90]
    d = spark.createDataFrame([("v", at(h), h in (0, 90), k) for k, h in enumerate(hours)], "vid string, time timestamp, h boolean, rid int")
    got = trips.harbour_trips(d, "vid", "time", "h", "rid", most_hours=60, compat_cut=False).where("trip_id is not null").collect()
    assert {r["rid"] for r in got if r["trip_id"] == "v_1_1"} == {1, 2, 3}
    early = trips.harbour_trips(d, "vid", "time", "h", "rid", most_hours=60).where("trip_id = 'v_1_1'").count()
    assert early <= 2  # the established cut is one ping before the gap
    with pytest.raises(ValueError):
        trips.harbour_trips(d.withColumn("h", F.lit(None).cast("boolean")), "vid", "time", "h", "rid", check=True)


def test_allocation_conserves(spark):
    trails = [(k, "XX", "v", at(24 * (k % 3)), "t", ["A", "B"][k % 2], int(k != 5)) for k in range(6)]
    events = [(1, "XX", "v", "t", at(0).date(), "A", 10.0, 1.0), (2, "XX", "v", "t", None, "B", 6.0, 1.0), (3, "XX", "v", "t", at(2400).date(), "A", 4.0, 1.0), (4, "XX", "v", "none", None, "A", 99.0, 1.0)]
    t = spark.createDataFrame(trails, "`.pid` int, VE_COU string, VE_REF string, time timestamp, FT_REF string, ir string, state int")
    e = spark.createDataFrame(events, "`.eid` int, VE_COU string, VE_REF string, FT_REF string, date date, LE_RECT string, LE_KG double, LE_EURO double")
    assert [r["step"] for r in allocation.event_steps(t, e).orderBy("`.eid`").collect()] == [1, 2, 3, 9999]
    with pytest.warns(UserWarning):
        out = allocation.spread_catch(t, e, check=True)
    assert out.columns[-3:] == ["LE_KG", "LE_EURO", ".how"]
    assert out.agg(F.sum("LE_KG")).first()[0] == pytest.approx(20)
    assert out.where("state = 0 and LE_KG is not null").count() == 0
    assert ".wt" in allocation.spread_catch(t, e, remove_diagnostic=False).columns
    with pytest.raises(ValueError):
        allocation.spread_catch(t.unionAll(t), e, check=True)
    with pytest.raises(ValueError):
        allocation.spread_catch(t.drop("ir"), e)


def test_null_trip_keys_match(spark):
    t = spark.createDataFrame([(1, None, "v", at(0), "t", "A", 1)], "`.pid` int, VE_COU string, VE_REF string, time timestamp, FT_REF string, ir string, state int")
    e = spark.createDataFrame([(1, None, "v", "t", at(0).date(), "A", 10.0, 1.0)], "`.eid` int, VE_COU string, VE_REF string, FT_REF string, date date, LE_RECT string, LE_KG double, LE_EURO double")
    assert allocation.spread_catch(t, e).first()["LE_KG"] == 10


@pytest.mark.parametrize(("values", "cap"), [([1, 2, 3, 1000], 3), ([1, 2, 3, 1000, 1100], 1100), ([0, 0], 0), ([5], 5), ([1, 1000], 1000)])
def test_gap_caps(spark, values, cap):
    d = spark.createDataFrame([(float(v),) for v in values], "x double")
    assert caps.gap_caps(d, "x").first()["_cap"] == cap


def test_quantile_cap_and_nulls(spark):
    d = spark.createDataFrame([(float(k),) for k in range(101)] + [(None,)], "x double")
    assert caps.cap_quantile(d, "x", prob=0.9, na_rm=True).agg(F.max("x")).first()[0] == pytest.approx(90)
    with pytest.raises(Exception, match="holds nulls"):
        caps.cap_quantile(d, "x").collect()


def in_polygon(x, y, ring):
    odd = False
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
        if (bx - ax) * (y - ay) == (by - ay) * (x - ax) and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return True
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            odd = not odd
    return odd


def test_points_in_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (2.0, 1.0), (0.0, 3.0)]
    points = [(k, x / 2, y / 2) for k, (x, y) in enumerate((x, y) for x in range(-1, 10) for y in range(-1, 8))]
    p = spark.createDataFrame(points, "id int, lon double, lat double")
    q = spark.createDataFrame([("a", ring), ("none", [(9.0, 9.0)])], "hid string, ring array<struct<x: double, y: double>>")
    for small in (0, 10):
        got = spatial.points_in_polygons(p, q, small=small).collect()
        assert {r["id"]: r["inside"] for r in got} == {k: in_polygon(x, y, ring) for k, x, y in points}
    assert spatial.keep_inside(p, q).count() + spatial.drop_inside(p, q).count() == len(points)
    with pytest.raises(ValueError):
        spatial.keep_inside(p.withColumn("lon", F.lit("a")), q)


def test_raster_edges(spark):
    g = raster.Grid(0, 16, 0, 16, 8)
    d = spark.createDataFrame([(0.0, 16.0, 1.0), (16.0, 0.0, 3.0), (16.0, 0.0, 5.0), (17.0, 0.0, 9.0)], "x double, y double, z double")
    assert sorted(map(tuple, raster.rasterize(d, g).collect())) == [(0, 0, 1.0), (1, 1, 4.0)]
    assert raster.BASE_GRID.n_cols == 150784 and raster.BASE_GRID.n_rows == 135936


def test_tiles_are_written(spark, tmp_path):
    g = raster.Grid(0, 16, 0, 16, 1)
    d = spark.createDataFrame([(x + 0.5, y + 0.5, float(x)) for x in range(16) for y in range(16)], "x double, y double, z double")
    out = raster.shade_tiles(raster.rasterize(d, g), 1, tile=8)
    raster.write_tiles(out, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).select("tile_x", "tile_y").distinct().count() == 4


def test_sources_and_sinks(spark, tmp_path):
    d = spark.createDataFrame([(1, 7, T0, -20.0, 64.0, 5.0, 90.0)], readers.SURVEY_TRACKS)
    d.write.option("header", True).csv(str(tmp_path / "tracks"))
    assert readers.read_survey_tracks(spark, str(tmp_path / "tracks")).collect() == d.collect()
    sinks.write_by_vessel(d, str(tmp_path / "by"))
    assert readers.read_table(spark, str(tmp_path / "by")).count() == 1
    layers = sinks.trip_layer(d.withColumnRenamed("cruise_id", "tid"))
    assert '"LineString"' in layers["lines"].first()[0] and '"Point"' in layers["points"].first()[0]
    lists = spark.createDataFrame([("OTB_DEF_1", "Otter, see device", False), ("X", "old", True)], "Key string, Description string, Deprecated boolean")
    assert readers.metier6_codes(lists).collect() == [("OTB_DEF_1", "Otter")]
    assert readers.gear_codes(lists, valid=False).columns[0] == "target" and readers.target_codes(lists, trim=False).count() == 2
    look = spark.createDataFrame([("OTB_DEF_1", "OT_DMF"), ("OTB_DEF_2", "OT_DMF"), ("PS_X_1", "")], "Metier_level6 string, Benthis_metiers string")
    assert readers.metier5_benthis_lookup(look).collect() == [("OTB_DEF", "OT_DMF")]


def test_stream_of_trips(spark, tmp_path):
    rows = [(1, T0 + dt.timedelta(minutes=10 * k), False) for k in range(5)] + [(1, at(20), False), (1, at(40), True)]
    d = spark.createDataFrame(rows, "vid int, time timestamp, in_harbour boolean")
    d.write.parquet(str(tmp_path / "in"))
    q = trip_sessions(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))).writeStream.outputMode("append").format("memory").queryName("trips_out").start()
    try:
        q.processAllAvailable()
        assert spark.table("trips_out").select("pings").collect() == [(5,)]
    finally:
        q.stop()
    assert trip_sessions(d).count() == 2


def test_behaviour(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(3, 0.3, 60), rng.normal(10, 0.5, 60)] * 2)
    move, mean, _, path = behaviour.baum_welch(x[:, None], 2)
    assert abs(mean[0, 0] - 3) < 0.3 and abs(mean[1, 0] - 10) < 0.5 and (path == np.repeat([0, 1, 0, 1], 60)).mean() > 0.98
    d = spark.createDataFrame(pd.DataFrame({"tid": 1, "k": range(len(x)), "speed": x, "turn": np.abs(x - 5)}))
    out = behaviour.gaussian_thresholds(d, "speed", ["tid"], ["k"], k=2).first()
    assert out["threshold_lower"] < 10 < out["threshold_upper"]
    assert behaviour.hidden_states(d, ["speed"], ["tid"], ["k"]).select("vit").distinct().count() == 2
    assert behaviour.binary_clusters(d, "speed", "turn", ["tid"], ["k"]).where("A between 1 and 4").count() == len(x)


def test_forest_by_trip(spark):
    d = spark.createDataFrame([(k % 6, float(k % 2), float(k), "ab"[k % 2]) for k in range(60)], "tid int, x double, y double, label string")
    out = behaviour.forest_by_trip(d, ["x", "y"], "label", "tid", folds=2, trees=5)
    assert out.count() == 60 and summary.accuracy(out, "label", "predicted").first()["accuracy"] > 0.9
    assert out.groupBy("tid").agg(F.countDistinct("fold").alias("n")).where("n > 1").count() == 0


def test_planar_filter_columns(spark):
    rows = [(0.0, 0.0, dt.datetime(2024, 1, 1, 0, 0, 0), 1, 1), (-3.0, 4.0, dt.datetime(2024, 1, 1, 0, 0, 10), 1, 2), (900.0, 0.0, dt.datetime(2024, 1, 1, 0, 0, 11), 1, 3), (0.0, 0.0, dt.datetime(2024, 1, 1, 0, 0, 20), 1, 4), (0.0, 0.0, dt.datetime(2024, 1, 1, 0, 0, 30), 1, 5)]
    got = outliers.planar_speed_filter(spark.createDataFrame(rows, "x double, y double, time timestamp, device_id int, seq int")).orderBy("seq").collect()
    assert [(r["seq"], r["dx"], r["dy"], r["dt"], r["dd"]) for r in got] == [(1, 0, 0, None, 0), (2, 3, 4, 10, 5), (5, 3, 4, 20, 5)]  # 3 and 4 are too fast at once
    assert got[0]["speed"] is None and got[1]["speed"] == pytest.approx(0.5 * 1.9438)


def test_scan_jumps_as_it_would_step():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 40, 200):
        for timed in (True, False):
            for _ in range(10):
                lon, lat = np.cumsum(rng.normal(0, 0.001, n)) + (rng.random(n) < 0.3) * rng.normal(0, 1, n), np.full(n, 60.0)
                if n > 5:
                    lon[rng.integers(n)] = np.nan
                seconds = np.cumsum(rng.integers(0, 3, n)) * 60.0
                limit = 4.0 if timed else 200.0
                want, last = np.zeros(n, bool), 0
                for k in range(1, n):
                    x, y = np.radians(lon), np.radians(lat)
                    h = np.cos(y[last]) * np.cos(y[k]) * np.sin((x[k] - x[last]) / 2) ** 2
                    d = 2 * outliers.EARTH_M * np.arcsin(np.sqrt(h))
                    dt = seconds[k] - seconds[last]
                    d = d if not timed else d / dt if dt else (np.inf if d > 0 else np.nan)
                    if d > limit and k == 1 and timed:
                        want[0], last = True, 1
                    elif d > limit:
                        want[k] = True
                    else:
                        last = k
                assert outliers.scan(lon, lat, seconds if timed else None, limit, timed).tolist() == want.tolist()


def test_trip_speed_filter_drops(spark):
    d = readers.sample_outlier_track(spark)
    flagged = outliers.implausible_speed(d, "lon", "lat", "time", ["vid"], ["time"])
    left = outliers.implausible_trip_speed(d, "lon", "lat", "time", ["vid"], ["time"])
    assert left.columns == d.columns and left.count() == flagged.where("NOT whacky").count() < d.count()


def test_peek_within_groups(spark):
    d = spark.createDataFrame([(v, k, 9.0 if (v, k) == (1, 5) else 0.0) for v in (1, 2) for k in range(1, 10)], "vid int, rid int, x double")
    assert sorted((r["vid"], r["rid"]) for r in outliers.peek(d, "x", 5, rid="rid", by=["vid"]).collect()) == [(1, k) for k in range(3, 8)]
    assert outliers.peek(d, "x", 5, rid="rid").count() == 10


def test_effort_of_unknown_gears_is_not_filled(spark):
    rows = [(1, None, 5.0), (2, None, None), (3, 6, 4.0), (4, 6, None)]
    lb = spark.createDataFrame(rows, "visir int, gid int, effort double").selectExpr("*", "1 AS vid", "timestamp'2024-01-01 00:00:00' + visir * interval '1' day AS t1", "timestamp'2024-01-01 01:00:00' + visir * interval '1' day AS t2")
    assert {r["visir"]: r["effort"] for r in logbook.cap_effort(lb).collect()} == {1: 5.0, 2: None, 3: 4.0, 4: 4.0}


def test_trail_names_and_speeds(spark):
    d = spark.createDataFrame([(7, "t", 3.141592653589793, 0.0, 0.0, 1.0, "H", "I")], "mobileid int, posdate string, poslon double, poslat double, heading double, speed double, harborid string, in_out_of_harbor string")
    assert readers.database_trail(d).columns == ["mid", "time", "lon", "lat", "heading", "speed", "hid", "io"] and readers.database_trail(d).first()["lon"] == 180
    p = spark.createDataFrame([(2, "2024-02-01 00:00:00", 1.0), (1, "2024-03-01 00:00:00", 1.0), (1, "2024-02-01 00:00:00", 1.0)], "vid int, time string, speed double").selectExpr("vid", "timestamp(time) AS time", "1.0D AS lon", "60.0D AS lat", "speed")
    got = readers.combined_trails({"stk": p, "pam": p.limit(1)}, [2024], speeds_in_ms=("pam",)).orderBy("`.rid`").collect()
    assert [(r[".rid"], r["vid"]) for r in got] == [(1, 1), (2, 1), (3, 2), (4, 2)] and sorted(round(r["speed"], 3) for r in got) == [1, 1, 1, 1.944]


def test_flags_need_nine_digits(spark):
    from fleettrack.functions import codes

    d = spark.createDataFrame([(x,) for x in ("219000001", "219", "219abc", "2190000001", "219abc000", "982191234", "98219", "219000001\n", None)], "mmsi string")
    flags = spark.createDataFrame([(219, "DK")], "MID int, flag string")
    assert {r["mmsi"]: r["flag"] for r in codes.mmsi_flag(d, flags).collect() if r["flag"]} == {"219000001": "DK", "982191234": "DK"}
