"""Golden values of the scalar functions and contracts of edge cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from fleettrack.functions import codes, scalars
from fleettrack.functions.semantics import divide, if_else


def column(spark, values, kind, fn):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(fn(F.col("x"))).collect()]


def test_grade(spark):
    assert column(spark, [62.3, 62.6, 63.2, 64.9], "double", lambda x: scalars.grade(x, 1)) == [62.5, 62.5, 63.5, 64.5]
    assert column(spark, [-1.4, -0.9, 0.1, 1.6], "double", lambda x: scalars.grade(x, 1)) == [-1.5, -0.5, 0.5, 1.5]
    assert column(spark, [0.13, 0.22, 0.38, 0.49], "double", lambda x: scalars.grade(x, 0.2)) == pytest.approx([0.1, 0.3, 0.3, 0.5])
    with pytest.raises(ValueError):
        scalars.grade(F.lit(1), 0)


def test_rectangles(spark):
    rows = [(-10.5, 62.5), (15.2, 54.9), (-43.5, 36.0), (69.0, 84.9), (100.0, 10.0), (None, 60.0)]
    got = spark.createDataFrame(rows, "lon double, lat double").select(scalars.statistical_rectangle(F.col("lon"), F.col("lat"))).collect()
    assert [r[0] for r in got] == ["54D9", "38G5", "01A0", "98M9", None, None]


def test_timestamps(spark):
    rows = [("29/02/2023", "12:00:00"), ("1/2/2022", "3:04:05"), (None, "12:00:00"), ("x", "y")]
    got = [r[0] for r in spark.createDataFrame(rows, "d string, t string").select(scalars.make_timestamp(F.col("d"), F.col("t"))).collect()]
    assert got == [None, dt.datetime(2022, 2, 1, 3, 4, 5), None, None]


def test_crosses_year(spark):
    d = spark.createDataFrame([("31/12/2022", "23:50:00", "01/01/2023", "00:30:00")], "FT_DDAT string, FT_DTIME string, FT_LDAT string, FT_LTIME string")
    assert scalars.logbook_crosses_year(d).first()["crosses_year"] is True
    with pytest.warns(UserWarning):
        scalars.logbook_crosses_year(d, check=True)
    with pytest.raises(ValueError):
        scalars.logbook_crosses_year(d.drop("FT_LTIME"))
    with pytest.raises(ValueError):
        scalars.crosses_year_checked(d.withColumn("a", F.current_date()).withColumn("b", F.current_timestamp()), "a", "b")


def test_sum_across(spark):
    d = spark.createDataFrame([(1, 1.0, 0.0, 2.0), (2, 2.0, 1.0, 1.0), (3, 3.0, 0.0, 2.0), (4, None, 0.0, 1.0)], "id int, catch_cod double, catch_had double, catch_her double")
    out = scalars.sum_across(d, "catch_")
    assert out.columns == ["id", "catch_"] and [r[1] for r in out.orderBy("id").collect()] == [3.0, 4.0, 5.0, None]
    assert "catch_cod" in scalars.sum_across(d, "catch_", remove=False).columns
    for bad in ("none", "", None):
        with pytest.raises(ValueError):
            scalars.sum_across(d, bad)
    with pytest.raises(ValueError):
        scalars.sum_across(d.withColumn("catch_x", F.lit("a")), "catch_")


def test_codes(spark):
    assert column(spark, ["OTB_DEF_>=120", "OTB", None], "string", codes.level5_of_level6) == ["OTB_DEF", "OTB_NA", "NA_NA"]
    assert column(spark, ["OTB_DEF", "OTB", None], "string", codes.target_of_metier) == ["DEF", None, None]
    assert column(spark, ["251234567", "970123456", "999999999", "12", None, "98123456x"], "string", codes.mmsi_category) == ["vessel", "Search and Rescue Transponders", "Navigational aid", None, None, None]
    mids = spark.createDataFrame([(251, "IS"), (251, "IS"), (219, "DK")], "MID int, flag string")
    got = codes.mmsi_flag(spark.createDataFrame([("251234567",), ("982190000",), ("x",), (None,)], "mmsi string"), mids)
    assert sorted(got.collect(), key=str) == sorted([("251234567", "IS"), ("982190000", "DK"), ("x", None), (None, None)], key=str)


def test_text(spark):
    assert column(spark, ["a (b c) (d)", "none", None], "string", scalars.between_parentheses) == ["b c", None, None]
    assert column(spark, ["x 1.2.2020 y", "1"], "string", scalars.dmy_period) == ["1.2.2020", None]
    assert column(spark, ["ab", "a1", None], "string", scalars.letters_only) == [True, False, True]


def test_null_semantics(spark):
    assert column(spark, [True, False, None], "boolean", lambda x: if_else(x, 1, 2)) == [1, 2, None]
    assert column(spark, [True, None], "boolean", lambda x: if_else(x, 1, 2, 3)) == [1, 3]
    got = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (3.0, 2.0)], "a double, b double").select(divide(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [float("inf"), float("-inf"), None, 1.5]
