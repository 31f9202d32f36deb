"""Every query of the library with its DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codes, scalars
from ..operators import allocation, behaviour, caps, joins, logbook, outliers, raster, spatial, summary, track, trips
from ..sources import readers, sinks
from ..streaming.trips import trip_sessions
from .views import sql_views, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, uses: str = ""):
    """Registers a function of a view getter under its name, with its SQL over the views that it uses."""

    def put(fn):
        QUERIES[fn.__name__] = lambda spark, sf_dir: fn(lambda name: view(spark, sf_dir, name))
        if sql:
            head = sql_views(*uses.split()) if uses else ""
            text = sql.strip()
            SQL[fn.__name__] = f"{head},\n{text[5:]}" if head and text.startswith("WITH ") else f"{head}\n{text}"
        return fn

    return put


BY, ORDER = ["vid"], ["time", "pid"]
OVER = "OVER (PARTITION BY vid ORDER BY time, pid)"


def r(x, digits: int = 6):
    return F.round(x, digits)


def untied(x, digits: int = 4):
    """Rounded a hair off, so that values halfway between two results fall to one side in any order of summation."""
    return F.round(x + F.lit(3e-8), digits)


def long(x):
    return x.cast("long")


# ---- scalar functions


@query("SELECT pid, round(speed * 1.94384449e0, 6) AS kn, round(speed / 1.94384449e0, 6) AS ms FROM pings", "pings")
def unit_conv(v):
    return v("pings").select("pid", r(scalars.ms_to_knots(F.col("speed"))).alias("kn"), r(scalars.knots_to_ms(F.col("speed"))).alias("ms"))


@query("SELECT pid, floor(lon) + 0.5e0 AS lon_1, floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS lat_half, floor(speed / 0.25e0) * 0.25e0 + 0.125e0 AS speed_q FROM pings", "pings")
def grade(v):
    return v("pings").select("pid", scalars.grade(F.col("lon"), 1).alias("lon_1"), scalars.grade(F.col("lat"), 0.5).alias("lat_half"), scalars.grade(F.col("speed"), 0.25).alias("speed_q"))


RECT = """, a AS (SELECT pid, floor(lon) + 0.5e0 AS x, floor(lat / 0.5e0) * 0.5e0 + 0.25e0 AS y, lon, lat FROM pings),
b AS (SELECT *, substr('ABCDEFGHJKLM', cast(floor((x + 60) / 10) AS int), 1) AS l, substr('ABCDEFGHIJKL', cast(floor((x + 60) / 10) AS int), 1) AS li FROM a)
SELECT pid,
 CASE WHEN NOT (lat < 36 OR lat >= 85 OR lon <= -44 OR lon > 69) THEN lpad(cast(cast(floor(y * 2) - 71 AS bigint) AS varchar), 2, '0') || l || cast(cast(CASE WHEN l = 'A' THEN x - 4 * floor(x / 4) ELSE x - 10 * floor(x / 10) END - 0.5e0 AS bigint) AS varchar) END AS rect,
 CASE WHEN NOT (lat < 36 OR lat >= 85 OR lon <= -44 OR lon > 69) THEN lpad(cast(cast(floor(y * 2) - 71 AS bigint) AS varchar), 2, '0') || li || cast(cast(CASE WHEN li = 'A' THEN x - 4 * floor(x / 4) ELSE x - 10 * floor(x / 10) END - 0.5e0 AS bigint) AS varchar) END AS rect_i
FROM b"""


@query("WITH " + RECT[2:], "pings")
def ices_rect(v):
    rect = scalars.statistical_rectangle
    return v("pings").select("pid", rect(F.col("lon"), F.col("lat")).alias("rect"), rect(F.col("lon"), F.col("lat"), use_i=True).alias("rect_i"))


@query("""SELECT pid, lpad(cast(cast(trunc(2 * (lat - 35.5e0)) AS bigint) AS varchar), 2, '0') ||
 CASE WHEN lon > -50 AND lon <= -40 THEN 'A' WHEN lon > -40 AND lon <= -30 THEN 'B' WHEN lon > -30 AND lon <= -20 THEN 'C' WHEN lon > -20 AND lon <= -10 THEN 'D'
 WHEN lon > -10 AND lon < 0 THEN 'E' WHEN lon >= 0 AND lon < 10 THEN 'F' WHEN lon >= 10 AND lon < 20 THEN 'G' WHEN lon >= 20 AND lon < 30 THEN 'H' ELSE 'J' END ||
 cast(CASE WHEN lon < 0 THEN cast(ceil(lon - 10 * floor(lon / 10) - 1 + 10) AS bigint) % 10 ELSE cast(floor(lon - 10 * floor(lon / 10)) AS bigint) END AS varchar) AS rect FROM pings""", "pings")
def ices_rect_alt(v):
    return v("pings").select("pid", scalars.statistical_rectangle_alt(F.col("lon"), F.col("lat")).alias("rect"))


@query("SELECT n_nationkey, string_split(metier, '_')[1] || '_' || string_split(metier, '_')[2] AS gear, string_split(metier, '_')[3] AS target, string_split(metier, '_')[1] || '_' || string_split(metier, '_')[2] AS met5 FROM metiers", "metiers")
def metier_parts(v):
    m = F.regexp_replace("metier", "NATION_", "NATION")
    fix = lambda c: F.regexp_replace(c, "^NATION", "NATION_")
    return v("metiers").select("n_nationkey", fix(codes.gear_of_metier(m)).alias("gear"), codes.target_of_metier(m).alias("target"), codes.level5_of_level6(F.col("metier")).alias("met5"))


@query("""SELECT mmsi, CASE WHEN NOT regexp_matches(mmsi, '^[0-9]{9}$') THEN NULL WHEN mmsi[1] = '0' THEN 'coast station' WHEN mmsi[1] = '1' THEN 'SAR aircraft' WHEN mmsi[1] BETWEEN '2' AND '7' THEN 'vessel'
 WHEN mmsi[1] = '8' THEN 'Handheld VHF transceiver' WHEN mmsi[1:3] = '970' THEN 'Search and Rescue Transponders' WHEN mmsi[1:3] = '972' THEN 'Man overboard' WHEN mmsi[1:3] = '974' THEN '406 MHz EPIRBs fitted with an AIS transmitter'
 WHEN mmsi[1:2] = '98' THEN 'Child vessel' WHEN mmsi[1:2] = '99' THEN 'Navigational aid' WHEN mmsi[1] = '9' THEN 'Starts with 9' END AS category
FROM (SELECT mmsi FROM stations UNION ALL SELECT lpad(cast(c_custkey * 999983 % 1000000007 AS varchar), 9, '0') FROM customer UNION ALL SELECT '97' || lpad(cast(c_custkey % 10 AS varchar), 1, '0') || '123456' FROM customer UNION ALL SELECT '12a' FROM customer)""", "stations")
def mmsi_category(v):
    c = v("customer")
    alls = v("stations").select("mmsi").unionByName(c.selectExpr("lpad(cast(c_custkey * 999983 % 1000000007 AS string), 9, '0') AS mmsi"))
    alls = alls.unionByName(c.selectExpr("concat('97', cast(c_custkey % 10 AS string), '123456') AS mmsi")).unionByName(c.selectExpr("'12a' AS mmsi"))
    return alls.select("mmsi", codes.mmsi_category(F.col("mmsi")).alias("category"))


@query("""SELECT c_custkey, mmsi, flag FROM stations LEFT JOIN flags ON MID = CASE WHEN length(mmsi) <> 9 OR length(translate(mmsi, '0123456789', '')) > 0 THEN NULL WHEN mmsi[1] BETWEEN '2' AND '7' THEN cast(mmsi[1:3] AS int) WHEN mmsi[1:2] = '98' THEN cast(mmsi[3:5] AS int) END""", "stations flags")
def mmsi_flag(v):
    return codes.mmsi_flag(v("stations"), v("flags")).select("c_custkey", "mmsi", "flag")


@query("SELECT visir, year(t1) <> year(t2) AS crosses FROM logbook", "logbook")
def crosses_year(v):
    return scalars.crosses_year_checked(v("logbook"), "t1", "t2", "crosses").select("visir", "crosses")


DATES = "SELECT o_orderkey, CASE WHEN o_orderkey % 50 = 0 THEN '29/02/2023' WHEN o_orderkey % 51 = 0 THEN 'x' ELSE cast(day(o_orderdate) AS varchar) || '/' || cast(month(o_orderdate) AS varchar) || '/' || cast(year(o_orderdate) AS varchar) END AS d, lpad(cast(o_orderkey % 24 AS varchar), 2, '0') || ':' || lpad(cast(o_orderkey % 60 AS varchar), 2, '0') || ':00' AS t"


@query(f"SELECT o_orderkey, epoch(try_strptime(d || ' ' || t, '%d/%m/%Y %H:%M:%S'))::BIGINT AS at FROM ({DATES} FROM orders)")
def make_timestamp(v):
    d = v("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN '29/02/2023' WHEN o_orderkey % 51 = 0 THEN 'x' ELSE concat_ws('/', day(o_orderdate), month(o_orderdate), year(o_orderdate)) END AS d", "concat_ws(':', lpad(cast(o_orderkey % 24 AS string), 2, '0'), lpad(cast(o_orderkey % 60 AS string), 2, '0'), '00') AS t")
    return d.select("o_orderkey", F.unix_seconds(scalars.make_timestamp(F.col("d"), F.col("t"))).alias("at"))


@query(f"""SELECT o_orderkey, coalesce(year(try_strptime(d || ' ' || t, '%d/%m/%Y %H:%M:%S')) <> year(try_strptime('01/01/2000 ' || t, '%d/%m/%Y %H:%M:%S')), false) AS crosses_year FROM ({DATES} FROM orders)""")
def logbook_crosses_year(v):
    d = v("orders").selectExpr("o_orderkey", "CASE WHEN o_orderkey % 50 = 0 THEN '29/02/2023' WHEN o_orderkey % 51 = 0 THEN 'x' ELSE concat_ws('/', day(o_orderdate), month(o_orderdate), year(o_orderdate)) END AS FT_DDAT", "concat_ws(':', lpad(cast(o_orderkey % 24 AS string), 2, '0'), lpad(cast(o_orderkey % 60 AS string), 2, '0'), '00') AS FT_DTIME", "'01/01/2000' AS FT_LDAT")
    return scalars.logbook_crosses_year(d.withColumn("FT_LTIME", F.col("FT_DTIME"))).select("o_orderkey", F.coalesce("crosses_year", F.lit(False)).alias("crosses_year"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, round(l_discount + l_tax + l_quantity, 4) AS amount FROM (SELECT * FROM lineitem)")
def sum_across(v):
    d = v("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", F.col("l_discount").alias("amount_a"), F.col("l_tax").alias("amount_b"), F.col("l_quantity").alias("amount_c"))
    return scalars.sum_across(d, "amount").withColumn("amount", r(F.col("amount"), 4))


@query("""SELECT p_partkey, NOT regexp_matches(p_name, '[^A-Za-z]') AS letters, NOT regexp_matches(cast(p_size AS varchar), '[^0-9]') AS numbers, p_name AS inside, '1.2.2020' AS period FROM part""")
def text_tests(v):
    wrapped, dated = F.concat(F.lit("a ("), "p_name", F.lit(") b")), F.concat(F.lit("from 1.2.2020 "), "p_name")
    return v("part").select("p_partkey", scalars.letters_only(F.col("p_name")).alias("letters"), scalars.numbers_only(F.col("p_size").cast("string")).alias("numbers"), scalars.between_parentheses(wrapped).alias("inside"), scalars.dmy_period(dated).alias("period"))


# ---- along tracks


def on(fn, *columns):
    """Window functions over the pings' tracks."""
    return fn(*map(F.col, columns), track.track_window(BY, ORDER))


@query(f"""WITH a AS (SELECT pid, vid, time, in_harbour, CASE WHEN in_harbour = lag(in_harbour) {OVER} THEN 0 ELSE 1 END AS s FROM pings)
SELECT pid, cast(sum(s) {OVER} AS bigint) AS run FROM a""", "pings")
def event_runs(v):
    return v("pings").select("pid", long(on(track.run_id, "in_harbour")).alias("run"))


TRIPS = f"""a AS (SELECT *, CASE WHEN in_harbour = lag(in_harbour) {OVER} THEN 0 ELSE 1 END AS s FROM pings),
t AS (SELECT *, cast(sum(CASE WHEN in_harbour THEN -s ELSE s END) OVER (PARTITION BY vid, in_harbour ORDER BY time, pid) AS bigint) AS tid FROM a)"""


@query(f"WITH {TRIPS} SELECT pid, tid FROM t", "pings")
def trip_ids(v):
    return track.trip_ids(v("pings"), "in_harbour", BY, ORDER).select("pid", long(F.col("tid")).alias("tid"))


@query(f"""WITH {TRIPS} SELECT pid, CASE WHEN tid <> lag(tid) {OVER} AND tid > 0 THEN lag(hid) {OVER} WHEN tid <> lead(tid) {OVER} AND tid > 0 THEN lead(hid) {OVER} ELSE hid END AS hid FROM t""", "pings")
def pad_harbour(v):
    return track.trip_ids(v("pings"), "in_harbour", BY, ORDER).select("pid", on(track.pad_harbour, "tid", "hid").alias("hid"))


SECS = f"(date_diff('microsecond', lag(time) {OVER}, time) / 1e6)"
AHEAD = f"(date_diff('microsecond', time, lead(time) {OVER}) / 1e6)"
HAV = "2 * 6371008.8e0 * asin(least(1e0, sqrt(pow(sin(radians({y2} - {y1}) / 2), 2) + cos(radians({y1})) * cos(radians({y2})) * pow(sin(radians({x2} - {x1}) / 2), 2))))"
DIST = HAV.format(x1=f"lag(lon) {OVER}", y1=f"lag(lat) {OVER}", x2="lon", y2="lat")


@query(f"SELECT pid, round({SECS}, 6) AS secs, round({SECS} / 3600, 6) AS hours FROM pings", "pings")
def step_time(v):
    w = track.track_window(BY, ORDER)
    return v("pings").select("pid", r(track.step_time(F.col("time"), w)).alias("secs"), r(track.step_time(F.col("time"), w, "hours")).alias("hours"))


@query(f"SELECT pid, round({DIST}, 3) AS metres FROM smooth", "smooth")
def track_distance(v):
    return v("smooth").select("pid", r(on(track.distance, "lon", "lat"), 3).alias("metres"))


@query(f"WITH a AS (SELECT *, {DIST} AS d, {SECS} AS s FROM smooth) SELECT pid, round(CASE WHEN s <> 0 THEN d / s / s END, 9) AS acc FROM a", "smooth")
def step_accel(v):
    return v("smooth").select("pid", r(on(track.acceleration, "lon", "lat", "time"), 9).alias("acc"))


@query(f"""WITH a AS (SELECT *, {DIST} / nullif({SECS}, 0) * 1.94384449e0 AS k, row_number() {OVER} AS n FROM smooth)
SELECT pid, round(CASE WHEN n = 1 THEN lead(k) {OVER} ELSE k END, 6) AS speed FROM a""", "smooth")
def track_speed(v):
    return track.speed_knots(v("smooth"), "lon", "lat", "time", BY, ORDER).select("pid", r(F.col("speed")).alias("speed"))


def _track_time(name: str, weight: tuple[float, float], formula: str) -> None:
    sql = f"""WITH a AS (SELECT pid, vid, time, {formula} AS d FROM pings)
SELECT pid, round(CASE WHEN d IS NULL AND lag(time) {OVER} IS NULL THEN lead(d) {OVER} WHEN d IS NULL AND lead(time) {OVER} IS NULL THEN lag(d) {OVER} ELSE d END, 7) AS dt FROM a"""

    def run(v):
        return track.track_time(v("pings"), "time", BY, ORDER, weight).select("pid", r(F.col("dt"), 7).alias("dt"))

    run.__name__ = name
    query(sql, "pings")(run)


_track_time("track_time_back", (0, 1), SECS)
_track_time("track_time_fwd", (1, 0), AHEAD)
_track_time("track_time_mixed", (1, 1), f"{SECS} * 0.5e0 + {AHEAD} * 0.5e0")


@query("""WITH a AS (SELECT pid, vid, pid // 3 AS x, CASE WHEN pid % 4 <> 0 THEN value END AS y FROM pings),
m AS (SELECT *, avg(y) OVER (PARTITION BY vid, x) AS m FROM a),
d AS (SELECT DISTINCT vid, x, m FROM m),
b AS (SELECT *, last_value(CASE WHEN m IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(m IGNORE NULLS) OVER p AS y0,
 first_value(CASE WHEN m IS NOT NULL THEN x END IGNORE NULLS) OVER n AS x1, first_value(m IGNORE NULLS) OVER n AS y1 FROM d
 WINDOW p AS (PARTITION BY vid ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY vid ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT pid, round(CASE WHEN m.m IS NOT NULL THEN m.m ELSE y0 + (y1 - y0) * (m.x - x0) / nullif(x1 - x0, 0) END, 6) AS y FROM m JOIN b USING (vid, x)""", "pings")
def interpolate(v):
    d = v("pings").selectExpr("pid", "vid", "pid div 3 AS x", "CASE WHEN pid % 4 <> 0 THEN value END AS y")
    return track.interpolate(d, "x", "y", BY).select("pid", r(F.col("y_filled")).alias("y"))


def _rms_sql() -> str:
    d, t = [], []
    for fn, k in (("lag", 2), ("lag", 1), ("lead", 1), ("lead", 2)):
        d.append("(" + HAV.format(x1=f"{fn}(lon, {k}) {OVER}", y1=f"{fn}(lat, {k}) {OVER}", x2="lon", y2="lat") + ")")
        t.append(f"(date_diff('microsecond', {fn}(time, {k}) {OVER}, time) / 1e6 + 0.01e0)")
    mean = lambda x: "sqrt((" + " + ".join(f"pow({p}, 2)" for p in x) + ") / 4)"
    return f"SELECT pid, round({mean(d)}, 3) AS vd, round({mean(t)}, 4) AS vt, round({mean([f'({a} / nullif({b}, 0))' for a, b in zip(d, t, strict=True)])}, 4) AS vs FROM smooth"


@query(_rms_sql(), "smooth")
def rms(v):
    return track.rms_table(v("smooth"), "lon", "lat", "time", BY, ORDER).select("pid", r(F.col("`.vd`"), 3).alias("vd"), r(F.col("`.vt`"), 4).alias("vt"), r(F.col("`.vs`"), 4).alias("vs"))


@query("""WITH a AS (SELECT vid, date_trunc('minute', time) AS t, avg(value) AS value FROM pings GROUP BY 1, 2),
e AS (SELECT vid, min(t) AS a, max(t) AS b FROM a GROUP BY 1),
g AS (SELECT vid, unnest(generate_series(a, b, interval 1 minute)) AS t FROM e),
j AS (SELECT g.vid, g.t, value, epoch(g.t) AS x FROM g LEFT JOIN a USING (vid, t)),
b AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) OVER p AS x0, last_value(value IGNORE NULLS) OVER p AS y0,
 first_value(CASE WHEN value IS NOT NULL THEN x END IGNORE NULLS) OVER n AS x1, first_value(value IGNORE NULLS) OVER n AS y1 FROM j
 WINDOW p AS (PARTITION BY vid ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), n AS (PARTITION BY vid ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT vid, count(*) AS minutes, round(sum(coalesce(value, y0 + (y1 - y0) * (x - x0) / nullif(x1 - x0, 0))) + 1e-5, 3) AS total FROM b GROUP BY 1""", "pings")
def resample_minutes(v):
    out = track.resample(v("pings").select("vid", "time", "value"), "time", ["value"], BY)
    return out.groupBy("vid").agg(F.count(F.lit(1)).alias("minutes"), F.round(F.sum("value") + F.lit(1e-5), 3).alias("total"))


@query()
def densified(v):
    return track.densify(v("smooth"), "lon", "lat", "time", BY, ORDER, 3600)


@query(f"SELECT pid, coalesce({DIST} / nullif({SECS}, 0) * 1.94384449e0 > 0.5e0, false) OR lead(time) {OVER} IS NULL AS too_fast FROM smooth", "smooth")
def two_pass_speed(v):
    return track.two_pass_speed_filter(v("smooth"), "lon", "lat", "time", BY, ORDER, 0.5).select("pid", "too_fast")


@query(f"WITH a AS (SELECT vid, {DIST} AS d FROM smooth) SELECT vid, round(coalesce(sum(d), 0) / 1852, 4) AS nm FROM a GROUP BY 1", "smooth")
def line_length(v):
    return track.track_length(v("smooth"), "lon", "lat", BY, ORDER).select("vid", r(F.col("length_m") / 1852, 4).alias("nm"))


# ---- outliers


def _scan_sql(measure: str, limit: str, first_rule: bool) -> str:
    """A left-to-right scan as a recursive query, one step a ping."""
    drop = "CASE WHEN n.n = 2 THEN n.lon ELSE s.lon END", "CASE WHEN n.n = 2 THEN n.lat ELSE s.lat END", "CASE WHEN n.n = 2 THEN n.time ELSE s.time END"
    keep = drop if first_rule else ("s.lon", "s.lat", "s.time")
    bad = f"coalesce({measure} > {limit}, false)"
    dist = HAV.format(x1="s.lon", y1="s.lat", x2="n.lon", y2="n.lat")
    bad = bad.replace("DIST", dist).replace("SECS", "nullif(date_diff('microsecond', s.time, n.time) / 1e6, 0)")
    step = f"""SELECT n.vid, n.n, n.pid, {bad} AS bad, CASE WHEN {bad} THEN {keep[0]} ELSE n.lon END, CASE WHEN {bad} THEN {keep[1]} ELSE n.lat END, CASE WHEN {bad} THEN {keep[2]} ELSE n.time END
 FROM s JOIN n ON n.vid = s.vid AND n.n = s.n + 1"""
    final = "SELECT pid, CASE WHEN n = 1 THEN coalesce(lead(bad) OVER (PARTITION BY vid ORDER BY n), false) WHEN n = 2 THEN false ELSE bad END AS whacky FROM s" if first_rule else "SELECT pid, bad AS whacky FROM s"
    return f"""RECURSIVE n AS (SELECT *, row_number() {OVER} AS n FROM smooth),
s AS (SELECT vid, n, pid, false AS bad, lon, lat, time FROM n WHERE n = 1 UNION ALL {step})
{final}"""


def _recursive(text: str) -> str:
    return sql_views("smooth").replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + text.removeprefix("RECURSIVE ")


@query()
def whacky_speed(v):
    d = outliers.implausible_speed(v("smooth"), "lon", "lat", "time", BY, ORDER, 0.4)
    return d.select("pid", "whacky")


@query()
def whacky_distance(v):
    return outliers.implausible_distance(v("smooth"), "lon", "lat", BY, ORDER, 0.02).select("pid", "whacky")


SQL["whacky_speed"] = _recursive(_scan_sql("DIST / SECS", "0.4e0 / 1.94384449e0", True))
SQL["whacky_distance"] = _recursive(_scan_sql("DIST", "0.02e0 * 1852", False))


@query()
def whacky_speed_trip(v):
    return outliers.implausible_trip_speed(v("smooth"), "lon", "lat", "time", BY, ORDER, filter=False, most_knots=0.4).select("pid", "whacky")


@query()
def whacky_speed_trip_filtered(v):
    return outliers.implausible_trip_speed(v("smooth"), "lon", "lat", "time", BY, ORDER).select("pid")


SQL["whacky_speed_trip_filtered"] = "SELECT pid FROM (" + _recursive(_scan_sql("DIST / SECS", "25e0 / 1.94384449e0", True)) + ") WHERE NOT whacky"


@query()
def whacky_mendo(v):
    d = v("smooth").selectExpr("lon * 100000 AS x", "lat * 100000 AS y", "time", "vid AS device_id", "pid AS seq")
    return outliers.planar_speed_filter(d, most_knots=1).select("seq", "device_id", r(F.col("speed"), 4).alias("speed"))


@query("""WITH h AS (SELECT DISTINCT unnest([pid - 2, pid - 1, pid, pid + 1, pid + 2]) AS pid FROM pings WHERE value > 49)
SELECT pid, CASE WHEN value > 49 THEN 'whacky' ELSE '' END AS whacky FROM pings JOIN h USING (pid)""", "pings")
def peek(v):
    return outliers.peek(v("pings"), "value", 49, rid="pid").select("pid", "whacky")


# ---- trips and joins

INTERVALS = "intervals AS (SELECT vid, pid AS tid, time AS t1, time + interval '2' hour AS t2 FROM pings)"


def _intervals(v):
    return v("pings").selectExpr("vid", "pid AS tid", "time AS T1", "time + interval '2' hour AS T2")


@query(f"WITH {INTERVALS} SELECT p.pid, p.vid, i.tid FROM pings p LEFT JOIN intervals i ON p.vid = i.vid AND p.time BETWEEN i.t1 AND i.t2", "pings")
def add_tripid(v):
    return joins.add_trip_id(v("pings").select("pid", "vid", "time"), _intervals(v)).select("pid", "vid", "tid")


SQL["add_tripid_bucketed"] = SQL["add_tripid"]


@query()
def add_tripid_bucketed(v):
    return joins.add_trip_id(v("pings").select("pid", "vid", "time"), _intervals(v), bucket_seconds=6 * 3600).select("pid", "vid", "tid")


@query(f"WITH {INTERVALS} SELECT p.vid, epoch_us(p.time) AS us, i.tid FROM pings p LEFT JOIN intervals i ON p.vid = i.vid AND p.time BETWEEN i.t1 AND i.t2", "pings")
def interval_id(v):
    out = joins.interval_id(v("pings"), _intervals(v), start="T1", end="T2", id="tid")
    return out.select("vid", F.unix_micros(F.col("time").cast("timestamp")).alias("us"), "tid")


@query(f"WITH {INTERVALS} SELECT p.pid, i.tid FROM pings p JOIN intervals i ON p.vid = i.vid AND p.time BETWEEN i.t1 AND i.t2", "pings")
def validity_join(v):
    return joins.validity_join(v("pings"), _intervals(v), key="vid", start="T1", end="T2").select("pid", "tid")


JEPOL = f"""m AS (SELECT vid, pid, time, in_harbour AS h, lag(in_harbour) {OVER} AS ph, min(in_harbour::int) OVER (PARTITION BY vid) <> max(in_harbour::int) OVER (PARTITION BY vid) AS mixed FROM pings),
k AS (SELECT *, sum(CASE WHEN NOT h AND (ph IS NULL OR ph) THEN 1 ELSE 0 END) {OVER} AS n, coalesce(h AND NOT ph, false) AS arrive FROM m WHERE mixed),
s AS (SELECT vid, n, min(time) AS a, max(time) AS b FROM k WHERE NOT h OR arrive GROUP BY 1, 2)"""


@query(f"""WITH {JEPOL} SELECT pid, cast(s.vid AS varchar) || '_' || cast(s.n AS varchar) AS trip_id FROM pings p LEFT JOIN (SELECT * FROM s WHERE date_diff('microsecond', a, b) / 3.6e9 > 0.5e0) s ON p.vid = s.vid AND p.time BETWEEN a AND b""", "pings")
def trip_jepol_nosplit(v):
    return trips.harbour_trips(v("pings"), "vid", "time", "in_harbour", "pid", split=False).select("pid", "trip_id")


@query()
def trip_jepol_split(v):
    return trips.harbour_trips(v("pings"), "vid", "time", "in_harbour", "pid", most_hours=24).select("pid", "trip_id")


@query(f"""WITH a AS (SELECT vid, pid, time, kind, CASE WHEN kind = lag(kind) {OVER} THEN 0 ELSE 1 END AS s FROM pings),
b AS (SELECT *, sum(s) {OVER} AS run FROM a), c AS (SELECT vid, run, min(kind) AS kind, min(time) AS t1, max(time) AS t2, count(*) AS pings FROM b GROUP BY 1, 2)
SELECT vid, cast(run AS bigint) AS run, kind, epoch_us(t1) AS t1, epoch_us(coalesce(lead(t1) OVER (PARTITION BY vid ORDER BY run), t2)) AS t2, pings FROM c""", "pings")
def envelopes(v):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    return trips.state_envelopes(v("pings"), "kind", "time", BY, ORDER).select("vid", long(F.col("run")).alias("run"), "kind", us("t1"), us("t2"), "pings")


@query("""WITH a AS (SELECT vid, pid, time, CASE WHEN date_diff('microsecond', lag(time) OVER (PARTITION BY vid ORDER BY time, pid), time) < 7200000000 THEN 0 ELSE 1 END AS s FROM pings WHERE NOT in_harbour),
b AS (SELECT *, sum(s) OVER (PARTITION BY vid ORDER BY time, pid) AS k FROM a)
SELECT vid, epoch_us(min(time)) AS t1, epoch_us(max(time)) + 7200000000 AS t2, count(*) AS pings FROM b GROUP BY vid, k""", "pings")
def sea_sessions(v):
    d = v("pings").select("vid", F.col("time").cast("timestamp").alias("time"), "in_harbour")
    return trip_sessions(d).select("vid", F.unix_micros("t1").alias("t1"), F.unix_micros("t2").alias("t2"), "pings")


@query("SELECT coalesce(a.vid, b.vid) AS vid, a.n AS n_signup, b.n AS n_error FROM (SELECT vid, count(*) AS n FROM pings WHERE kind = 'signup' GROUP BY 1) a FULL JOIN (SELECT vid, count(*) AS n FROM pings WHERE kind = 'error' AND value > 20 GROUP BY 1) b ON a.vid = b.vid", "pings")
def full_comparison(v):
    p = v("pings")
    a = p.where("kind = 'signup'").groupBy("vid").agg(F.count(F.lit(1)).alias("n_signup"))
    return a.join(p.where("kind = 'error' AND value > 20").groupBy("vid").agg(F.count(F.lit(1)).alias("n_error")), "vid", "full")


# ---- aggregates and caps


@query(f"""WITH {TRIPS}, u AS (SELECT *, CASE WHEN pid % 3 <> 0 THEN value END AS dist FROM t)
SELECT vid, count(*) AS n, epoch_us(min(time)) AS t_min, epoch_us(max(time)) AS t_max, min(speed) AS speed_min, round(median(speed), 6) AS speed_median, max(speed) AS speed_max,
 min(dist) AS dist_min, round(median(dist), 6) AS dist_median, max(dist) AS dist_max, count(DISTINCT tid) AS n_tid, count(DISTINCT hid) AS n_hid FROM u GROUP BY 1""", "pings")
def track_summary(v):
    d = track.trip_ids(v("pings"), "in_harbour", BY, ORDER).withColumns({"dist": F.when(F.col("pid") % 3 != 0, F.col("value")), "dura": F.lit(None).cast("double")})
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp")).alias(c)
    out = summary.summary(d, BY)
    return out.select("vid", "n", us("t_min"), us("t_max"), "speed_min", r(F.col("speed_median")).alias("speed_median"), "speed_max", "dist_min", r(F.col("dist_median")).alias("dist_median"), "dist_max", "n_tid", "n_hid")


@query("""WITH q AS (SELECT l_returnflag AS g, exp(least(max(ln(l_extendedprice)), quantile_cont(ln(l_extendedprice), 0.75) + 1.5e0 * (quantile_cont(ln(l_extendedprice), 0.75) - quantile_cont(ln(l_extendedprice), 0.25)))) AS cap FROM lineitem GROUP BY 1)
SELECT g, round(cap, 3) AS cap FROM q""")
def cap_iqr(v):
    d = v("lineitem").withColumnRenamed("l_returnflag", "g")
    return caps.quartile_caps(d, "l_extendedprice", ["g"]).select("g", r(F.col("_cap"), 3).alias("cap"))


@query("""WITH q AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.99) AS cap FROM lineitem GROUP BY 1)
SELECT g, round(cap, 3) AS cap, count(*) AS n, round(sum(least(l_extendedprice, cap)), 3) AS total FROM lineitem JOIN q ON g = l_returnflag GROUP BY 1, 2""")
def cap_winsor(v):
    d = v("lineitem").select(F.col("l_returnflag").alias("g"), "l_extendedprice")
    capped = caps.cap_quantile(d, "l_extendedprice", ["g"], out="x").groupBy("g").agg(F.count(F.lit(1)).alias("n"), r(F.sum("x"), 3).alias("total"))
    return capped.join(caps.quantile_caps(d, "l_extendedprice", ["g"]), "g").select("g", r(F.col("_cap"), 3).alias("cap"), "n", "total")


@query("""WITH d AS (SELECT DISTINCT l_returnflag AS g, CASE WHEN l_orderkey % 1000 = 1 THEN l_quantity * 100000 ELSE l_quantity END AS v FROM lineitem),
w AS (SELECT *, log10(v) - log10(lag(v) OVER (PARTITION BY g ORDER BY v)) AS gap FROM d WHERE v > 0)
SELECT g, CASE WHEN max(gap) > 1.5e0 THEN coalesce(max(CASE WHEN gap <= 1.5e0 THEN v END), max(v)) ELSE max(v) END AS cap FROM w GROUP BY 1""")
def cap_miller(v):
    d = v("lineitem").selectExpr("l_returnflag AS g", "CASE WHEN l_orderkey % 1000 = 1 THEN l_quantity * 100000 ELSE l_quantity END AS v")
    return caps.gap_caps(d, "v", ["g"]).select("g", F.col("_cap").alias("cap"))


@query("SELECT kind, count(*) AS n, count(DISTINCT vid) AS vessels, min(value) AS lo, max(value) AS hi FROM pings GROUP BY 1", "pings")
def group_counts(v):
    return v("pings").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vid").alias("vessels"), F.min("value").alias("lo"), F.max("value").alias("hi"))


@query("""SELECT kind, count(*) FILTER (in_harbour) AS "true", count(*) FILTER (NOT in_harbour) AS "false" FROM pings GROUP BY 1""", "pings")
def confusion(v):
    return summary.confusion(v("pings").withColumn("p", F.col("in_harbour").cast("string")), "kind", "p", ["true", "false"])


@query("""SELECT o_orderkey AS station_id, 1 AS "end", o_totalprice AS lon, cast(o_custkey AS double) AS lat, epoch_us(o_orderdate) AS t FROM orders
UNION ALL SELECT o_orderkey, 2, o_totalprice + 1, cast(o_custkey + 1 AS double), epoch_us(o_orderdate) FROM orders""")
def melted_ends(v):
    d = v("orders").selectExpr("o_orderkey AS station_id", "o_totalprice AS lon1", "cast(o_custkey AS double) AS lat1", "unix_micros(cast(o_orderdate AS timestamp)) AS t1", "o_totalprice + 1 AS lon2", "cast(o_custkey + 1 AS double) AS lat2", "unix_micros(cast(o_orderdate AS timestamp)) AS t2")
    return summary.melt_ends(d, ["station_id"])


# ---- allocation

SPREAD = """
 fishing AS (SELECT VE_COU, VE_REF, FT_REF, cast(time AS date) AS d, ir FROM trails WHERE state = 1),
 days AS (SELECT DISTINCT * FROM fishing), rects AS (SELECT DISTINCT VE_COU, VE_REF, FT_REF, ir FROM fishing), tripsf AS (SELECT DISTINCT VE_COU, VE_REF, FT_REF FROM fishing),
 steps AS (SELECT e.*, CASE WHEN d.d IS NOT NULL THEN 1 WHEN e.date IS NULL AND r.ir IS NOT NULL THEN 2 WHEN t.FT_REF IS NOT NULL THEN 3 ELSE 9999 END AS step FROM catches e
  LEFT JOIN days d ON d.VE_COU = e.VE_COU AND d.VE_REF = e.VE_REF AND d.FT_REF = e.FT_REF AND d.d = e.date AND d.ir = e.LE_RECT
  LEFT JOIN rects r ON r.VE_COU = e.VE_COU AND r.VE_REF = e.VE_REF AND r.FT_REF = e.FT_REF AND r.ir = e.LE_RECT
  LEFT JOIN tripsf t ON t.VE_COU = e.VE_COU AND t.VE_REF = e.VE_REF AND t.FT_REF = e.FT_REF),
 one AS (SELECT VE_COU, VE_REF, FT_REF, date, LE_RECT, sum(LE_KG) AS kg, sum(LE_EURO) AS eu FROM steps WHERE step = 1 GROUP BY ALL),
 two AS (SELECT VE_COU, VE_REF, FT_REF, LE_RECT, sum(LE_KG) AS kg, sum(LE_EURO) AS eu FROM steps WHERE step = 2 GROUP BY ALL),
 three AS (SELECT VE_COU, VE_REF, FT_REF, sum(LE_KG) AS kg, sum(LE_EURO) AS eu FROM steps WHERE step = 3 GROUP BY ALL),
 a AS (SELECT t.*, o.kg AS kg1, o.eu AS eu1, w.kg AS kg2, w.eu AS eu2, h.kg AS kg3, h.eu AS eu3,
  CASE WHEN state <> 1 THEN 0 WHEN o.kg IS NOT NULL THEN 1 WHEN w.kg IS NOT NULL THEN 2 ELSE 3 END AS s FROM trails t
  LEFT JOIN one o ON o.VE_COU = t.VE_COU AND o.VE_REF = t.VE_REF AND o.FT_REF = t.FT_REF AND o.date = cast(t.time AS date) AND o.LE_RECT = t.ir
  LEFT JOIN two w ON w.VE_COU = t.VE_COU AND w.VE_REF = t.VE_REF AND w.FT_REF = t.FT_REF AND w.LE_RECT = t.ir
  LEFT JOIN three h ON h.VE_COU = t.VE_COU AND h.VE_REF = t.VE_REF AND h.FT_REF = t.FT_REF),
 n AS (SELECT *, count(*) OVER (PARTITION BY VE_COU, VE_REF, FT_REF, ir, cast(time AS date), s) AS n1, count(*) OVER (PARTITION BY VE_COU, VE_REF, FT_REF, ir, s) AS n2, count(*) OVER (PARTITION BY VE_COU, VE_REF, FT_REF, s) AS n3 FROM a)
SELECT pid, state, round(CASE s WHEN 1 THEN kg1 / n1 WHEN 2 THEN kg2 / n2 WHEN 3 THEN kg3 / n3 END + 3e-8, 4) AS kg, round(CASE s WHEN 1 THEN eu1 / n1 WHEN 2 THEN eu2 / n2 WHEN 3 THEN eu3 / n3 END + 3e-8, 4) AS euro,
 CASE s WHEN 1 THEN '1 trip_rectangle_day' WHEN 2 THEN '2 trip_rectangle' WHEN 3 THEN '3 trip' END AS how FROM n"""


@query("WITH " + SPREAD.strip(), "trails catches")
def spread_catch(v):
    out = allocation.spread_catch(v("trails").withColumnRenamed("pid", ".pid"), v("catches").withColumnRenamed("eid", ".eid"))
    return out.select(F.col("`.pid`").alias("pid"), "state", untied(F.col("LE_KG")).alias("kg"), untied(F.col("LE_EURO")).alias("euro"), F.col("`.how`").alias("how"))


@query("WITH " + SPREAD[: SPREAD.index(" one AS")].strip().rstrip(",") + " SELECT eid, step FROM steps", "trails catches")
def event_steps(v):
    return allocation.event_steps(v("trails"), v("catches")).select("eid", "step")


# ---- logbook


@query("""WITH a AS (SELECT *, CASE WHEN gid = 7 THEN mesh_min ELSE mesh END AS m FROM logbook),
b AS (SELECT *, round_even(m / 2.54e0, 0) AS i FROM a), c AS (SELECT *, CASE WHEN i <= 66 THEN 60 WHEN i <= 76 THEN 70 WHEN i <= 87 THEN 80 WHEN i IS NOT NULL THEN 90 END AS inch FROM b)
SELECT visir, gid, m AS mesh, cast(CASE WHEN gid = 9 THEN 80 WHEN gid IN (7, 10, 12, 14) THEN 40 WHEN gid IN (5, 6) AND (m <= 147 OR m IS NULL) THEN 135 WHEN gid IN (5, 6) THEN 155 WHEN gid IN (15, 38, 40) THEN 100
 WHEN gid = 2 THEN coalesce(round_even(inch * 2.54e0, 0), 203) END AS double) AS mesh_std FROM c""", "logbook")
def mesh_std(v):
    return logbook.standard_mesh(v("logbook")).select("visir", "gid", "mesh", "mesh_std")


@query("SELECT visir, CASE WHEN gid IN (10, 12) THEN -666 WHEN gid IN (18, 39) THEN 18 WHEN gid IN (4, 42) THEN -666 WHEN gid IN (15, 37, 38, 40) THEN 15 ELSE coalesce(gid, -666) END AS gid FROM logbook", "logbook")
def lump_gears(v):
    return logbook.lump_gears(v("logbook")).select("visir", "gid")


@query("""WITH m AS (SELECT gid, median(effort) AS med FROM logbook GROUP BY 1),
a AS (SELECT l.*, coalesce(effort, med) AS e FROM logbook l LEFT JOIN m ON l.gid = m.gid), b AS (SELECT *, lead(t1) OVER (PARTITION BY vid ORDER BY t1, visir) AS nx FROM a)
SELECT visir, round(CASE WHEN gid = 6 THEN least(e, 12) WHEN gid = 7 THEN least(e, 24) WHEN gid = 14 THEN least(e, 15) ELSE e END, 9) AS effort, t2 > nx AS overlap,
 epoch(CASE WHEN t2 > nx THEN date_trunc('second', nx - interval '1' minute) ELSE t2 END)::BIGINT AS t2 FROM b""", "logbook")
def cap_effort(v):
    return logbook.cap_effort(v("logbook")).select("visir", r(F.col("effort"), 9).alias("effort"), "overlap", F.unix_seconds(F.col("t2").cast("timestamp")).alias("t2"))


@query("""WITH a AS (SELECT *, CASE WHEN gid IN (6, 7, 9, 14) THEN sweeps WHEN gid IN (15, 38, 40) THEN plow_width END AS w FROM logbook),
b AS (SELECT *, CASE WHEN gid IN (6, 7) AND w > 250 THEN 250 WHEN gid = 9 AND w > 75 THEN 75 WHEN gid = 14 AND w > 55 THEN 55 ELSE w END AS c FROM a),
m AS (SELECT gid, median(c) AS med FROM b WHERE gid IN (6, 7, 9, 14, 15, 37, 38, 40) GROUP BY 1)
SELECT visir, CASE WHEN b.gid = 5 THEN 500 ELSE cast(coalesce(c, med) AS double) END AS gear_width FROM b LEFT JOIN m ON b.gid = m.gid""", "logbook")
def gear_width_proxy(v):
    return logbook.gear_width_proxy(v("logbook")).select("visir", "gear_width")


BENTHIS = [("OT_DMF", 9.6054, 0.4337, "power", "avg_kw"), ("OT_MIX", 10.6608, 0.2921, "power", "avg_oal"), ("TBB_DMF", 0.3, 4.0, "linear", "avg_oal"), ("SDN", 2.0, 1.0, "linear", "avg_kw")]


@query("""WITH p AS (SELECT * FROM (VALUES ('OT_DMF', 9.6054e0, 0.4337e0, 'power', 'avg_kw'), ('OT_MIX', 10.6608e0, 0.2921e0, 'power', 'avg_oal'), ('TBB_DMF', 0.3e0, 4.0e0, 'linear', 'avg_oal'), ('SDN', 2e0, 1e0, 'linear', 'avg_kw')) t(m, a, b, model, variable)),
d AS (SELECT p_partkey, cast(p_size AS double) AS len, p_retailprice AS kw, CASE p_partkey % 5 WHEN 0 THEN 'OT_DMF' WHEN 1 THEN 'OT_MIX' WHEN 2 THEN 'TBB_DMF' WHEN 3 THEN 'SDN' END AS m FROM part)
SELECT p_partkey, round(CASE WHEN model = 'power' AND variable = 'avg_kw' THEN a * pow(kw, b) WHEN model = 'power' THEN a * pow(len, b) WHEN model = 'linear' AND variable = 'avg_oal' THEN a * len + b END, 6) AS width FROM d LEFT JOIN p USING (m)""")
def gear_width(v):
    parts = v("part")
    spark = parts.sparkSession
    params = spark.createDataFrame(BENTHIS, "benthis_metier string, a double, b double, model string, variable string")
    lookup = spark.createDataFrame([(f"M{k}", b[0]) for k, b in enumerate(BENTHIS)], "metier5 string, benthis_metier string")
    d = parts.selectExpr("p_partkey", "cast(p_size AS double) AS length", "p_retailprice AS kw", "concat('M', cast(p_partkey % 5 AS string)) AS metier5")
    return logbook.benthis_width(d, lookup, params).select("p_partkey", r(F.col("gear_width")).alias("width"))


@query("""WITH c AS (SELECT visir % 2000 AS visir, sum(effort) AS catch FROM logbook GROUP BY 1)
SELECT l.visir, CASE WHEN gid < 10 THEN 'mobile' ELSE 'static' END AS source, round(coalesce(catch, CASE WHEN c.visir IS NOT NULL THEN 0 END) + 3e-8, 4) AS catch FROM logbook l LEFT JOIN c ON l.visir = c.visir WHERE year(date) IN (1995, 1996, 1997)""", "logbook")
def logbook_records(v):
    lb = v("logbook")
    catch = lb.selectExpr("visir % 2000 AS visir", "effort AS catch")
    return logbook.logbook(lb.where("gid < 10"), lb.where("gid >= 10"), catch, years=(1995, 1996, 1997)).select("visir", "source", untied(F.col("catch")).alias("catch"))


# ---- space

SQUARES = [(f"S{k}", -40.0 + 11 * k, 38.0 + 5 * k, 8.0) for k in range(9)]
TRIANGLE = [(-20.0, 40.0), (20.0, 40.0), (0.0, 80.0)]
INSIDE = "(lon BETWEEN x0 AND x0 + 8 AND lat BETWEEN y0 AND y0 + 8)"
SQ = "sq AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {x}e0, {y}e0)" for n, x, y, _ in SQUARES) + ") t(hid, x0, y0))"
IN_TRI = "(lat >= 40 AND 40 * (lon + 20) - 20 * (lat - 40) >= 0 AND -40 * (lon - 20) - 20 * (lat - 40) >= 0)"


def _polygons(v, triangle: bool = True):
    rings = [(n, [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]) for n, x, y, s in SQUARES] + ([("T", TRIANGLE)] if triangle else [])
    return v("pings").sparkSession.createDataFrame(rings, "poly string, ring array<struct<x: double, y: double>>")


@query(f"WITH {SQ} SELECT pid, EXISTS (SELECT 1 FROM sq WHERE {INSIDE}) OR {IN_TRI} AS inside FROM pings", "pings")
def points_in_polygons(v):
    return spatial.points_in_polygons(v("pings"), _polygons(v)).select("pid", "inside")


@query(f"WITH {SQ} SELECT pid FROM pings WHERE EXISTS (SELECT 1 FROM sq WHERE {INSIDE}) OR {IN_TRI}", "pings")
def st_keep(v):
    return spatial.keep_inside(v("pings"), _polygons(v)).select("pid")


@query(f"WITH {SQ} SELECT pid FROM pings WHERE NOT (EXISTS (SELECT 1 FROM sq WHERE {INSIDE}) OR {IN_TRI})", "pings")
def st_drop(v):
    return spatial.drop_inside(v("pings"), _polygons(v)).select("pid")


@query(f"WITH {SQ} SELECT pid, sq.hid AS poly FROM pings LEFT JOIN sq ON {INSIDE}", "pings")
def harbour_join(v):
    return spatial.polygon_join(v("pings"), _polygons(v, False)).select("pid", "poly")


SQL["harbour_join_by_cell"] = SQL["harbour_join"]


@query()
def harbour_join_by_cell(v):
    """The join without broadcast, as for many polygons."""
    return spatial.polygon_join(v("pings"), _polygons(v, False), small=0).select("pid", "poly")


@query("SELECT pid FROM pings WHERE lon BETWEEN -10 AND 10 AND lat BETWEEN 50 AND 60", "pings")
def within_box(v):
    return spatial.within_box(v("pings"), "lon", "lat", -10, 10, 50, 60).select("pid")


@query("SELECT min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM pings", "pings")
def bbox(v):
    return spatial.bounding_box(v("pings"), "lon", "lat")


@query("SELECT cast(floor(min(lon)) AS bigint) AS xmin, cast(ceil(max(lon)) AS bigint) AS xmax, cast(floor(min(lat)) AS bigint) AS ymin, cast(ceil(max(lat)) AS bigint) AS ymax FROM pings", "pings")
def extent(v):
    return spatial.whole_extent(v("pings"), "lon", "lat")


# ---- rasters

GRID = raster.Grid(0, 20480, 0, 2048, 8)
CELL = "cast(least(floor(x / {r}), {c}) AS bigint) AS col, cast(least(floor((2048 - y) / {r}), {w}) AS bigint) AS row"


@query(f"SELECT {CELL.format(r='32e0', c=639, w=63)}, round(avg(z) + 3e-8, 4) AS value FROM xyz WHERE x BETWEEN 0 AND 20480 AND y BETWEEN 0 AND 2048 GROUP BY 1, 2", "xyz")
def rasterize_mean(v):
    return raster.rasterize(v("xyz"), GRID, agg=4).select("col", "row", untied(F.col("value")).alias("value"))


@query(f"WITH c AS (SELECT {CELL.format(r='32e0', c=639, w=63)}, count(z) AS value FROM xyz WHERE x BETWEEN 0 AND 20480 AND y BETWEEN 0 AND 2048 GROUP BY 1, 2) SELECT col - (SELECT min(col) FROM c) AS col, row - (SELECT min(row) FROM c) AS row, value FROM c", "xyz")
def rasterize_count(v):
    return raster.rasterize(v("xyz"), GRID, agg=4, fun="count", no_trim=False)


def _pyramid_sql(levels: int) -> str:
    out = [f"l0 AS (SELECT {CELL.format(r='8e0', c=2559, w=255)}, count(z) AS n, sum(z) AS s FROM xyz WHERE x BETWEEN 0 AND 20480 AND y BETWEEN 0 AND 2048 GROUP BY 1, 2)"]
    for k in range(1, levels):
        out.append(f"l{k} AS (SELECT col // 2 AS col, row // 2 AS row, sum(n) AS n, sum(s) AS s FROM l{k - 1} GROUP BY 1, 2)")
    value = ", ".join(f"CASE WHEN l{k}.n >= 10 THEN l{k}.s / l{k}.n END" for k in range(levels))
    res = " ".join(f"WHEN l{k}.n >= 10 THEN {8 << k}" for k in range(levels))
    joins_ = " ".join(f"LEFT JOIN l{k} ON l{k}.col = l0.col // {1 << k} AND l{k}.row = l0.row // {1 << k}" for k in range(1, levels))
    return f"WITH {', '.join(out)} SELECT l0.col, l0.row, round(coalesce({value}) + 3e-8, 4) AS value, cast(CASE {res} END AS double) AS res FROM l0 {joins_}"


@query(_pyramid_sql(5), "xyz")
def pyramid(v):
    return raster.resolution_pyramid(v("xyz"), GRID, 10, 128).select("col", "row", untied(F.col("value")).alias("value"), "res")


SHADE = f"""c AS (SELECT {CELL.format(r='64e0', c=319, w=31)}, avg(z) AS v FROM xyz WHERE x BETWEEN 0 AND 20480 AND y BETWEEN 0 AND 2048 GROUP BY 1, 2),
j AS (SELECT c.col, c.row, c.v, (e.v - w.v) / 128e0 AS dx, (n.v - s.v) / 128e0 AS dy FROM c LEFT JOIN c e ON e.col = c.col + 1 AND e.row = c.row LEFT JOIN c w ON w.col = c.col - 1 AND w.row = c.row
 LEFT JOIN c n ON n.col = c.col AND n.row = c.row - 1 LEFT JOIN c s ON s.col = c.col AND s.row = c.row + 1)"""


@query(f"""WITH {SHADE} SELECT col, row, round(CASE WHEN dx IS NOT NULL AND dy IS NOT NULL THEN greatest(0, (sin(radians(45)) - dx * sin(radians(315)) * cos(radians(45)) - dy * cos(radians(315)) * cos(radians(45))) / sqrt(1 + dx * dx + dy * dy)) END * 255, 4) AS r,
 col // 100 AS tile_x, row // 100 AS tile_y FROM j""", "xyz")
def shade_tiles(v):
    out = raster.shade_tiles(raster.rasterize(v("xyz"), GRID, agg=8), 64, tile=100)
    return out.select("col", "row", r(F.when(F.col("shade").isNotNull(), F.col("r")), 4).alias("r"), "tile_x", "tile_y")


# ---- sources, sinks, verbs


@query("""SELECT pid, round(lon * (180 / 3.141592653589793e0), 6) AS lon, round(speed * 3600 / 1852, 6) AS speed FROM pings""", "pings")
def database_trail(v):
    return readers.database_trail(v("pings").withColumn("heading", F.lit(1.0))).select("pid", r(F.col("lon")).alias("lon"), r(F.col("speed")).alias("speed"))


@query("""WITH m AS (SELECT DISTINCT vid AS mid, vid + 1000 AS vid FROM pings)
SELECT p.pid, m.vid FROM pings p JOIN m ON p.vid = m.mid WHERE p.time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' AND (m.vid % 3 = 0 OR m.vid % 5 = 0)""", "pings")
def vessel_trail(v):
    p = v("pings").withColumnRenamed("vid", "mid")
    m = p.select("mid", (F.col("mid") + 1000).alias("vid")).distinct()
    m = m.selectExpr("mid", "vid", "CASE WHEN vid % 3 = 0 THEN 1 END AS pings", "CASE WHEN vid % 5 = 0 THEN 'manual' ELSE 'auto' END AS link", "'2024:01:05' AS t1", "'2024:01:20' AS t2")
    periods = readers.mobile_periods(m).withColumns({t: F.col(t).cast("timestamp_ntz") for t in ("t1", "t2")})
    return readers.vessel_trail(p, periods, m.select("vid")).select("pid", "vid")


@query("""WITH u AS (SELECT pid, vid, time, 'a' AS source, lon, lat FROM pings WHERE pid % 2 = 0 UNION ALL SELECT pid, vid, time, 'b', lon, lat FROM pings WHERE pid % 2 = 1)
SELECT pid, row_number() OVER (ORDER BY vid, time, source, lon, lat) AS rid FROM u WHERE time BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-12-31' AND lon BETWEEN -60 AND 60 AND lat BETWEEN 50 AND 80""", "pings")
def combined_trails(v):
    p = v("pings").withColumn("time", F.col("time").cast("timestamp"))
    out = readers.combined_trails({"a": p.where("pid % 2 = 0"), "b": p.where("pid % 2 = 1")}, [2024], distinct_time=("a",))
    return out.select("pid", long(F.col("`.rid`")).alias("rid"))


@query("SELECT p_partkey AS metier6, replace(p_name, ' ', ', see ') AS raw, CASE WHEN contains(p_name, ' ') THEN split_part(p_name, ' ', 1) ELSE p_name END AS description FROM part WHERE p_partkey % 4 <> 0")
def code_list(v):
    d = v("part").selectExpr("p_partkey AS Key", "concat(replace(p_name, ' ', ', see '), ' device') AS Description", "p_partkey % 4 = 0 AS Deprecated")
    out = readers.metier6_codes(d)
    raw = readers.code_list(d, "metier6", description="raw").withColumn("raw", F.regexp_replace("raw", " device$", ""))
    return out.join(raw, "metier6").select("metier6", "raw", F.regexp_replace("description", " device$", "").alias("description"))


@query("SELECT vid, count(*) AS n, md5(string_agg(cast(pid AS varchar), ',' ORDER BY time, pid)) AS line_md5 FROM pings GROUP BY 1", "pings")
def track_lines(v):
    lines = sinks.track_lines(v("pings").selectExpr("vid", "time", "cast(pid AS double) AS lon", "lat"), BY)
    return lines.select("vid", "n", F.md5(F.array_join(F.transform("line", lambda p: p.lon.cast("long").cast("string")), ",").cast("binary")).alias("line_md5"))


@query()
def map_points(v):
    return sinks.point_features(v("pings"), tooltip=["vid", "hid"])


@query("SELECT pid, count(*) OVER (PARTITION BY vid, kind) AS n FROM pings", "pings")
def duplicates(v):
    return summary.duplicates(v("pings"), ["vid", "kind"]).select("pid", "n")


@query("SELECT pid FROM pings WHERE vid IN (SELECT vid FROM pings GROUP BY 1 HAVING count(*) >= 70)", "pings")
def at_least(v):
    return summary.at_least(v("pings"), BY, 70).select("pid")


@query("SELECT round_even(l_extendedprice / 1000, 0) * 1000 AS bin, round(median(l_quantity), 4) AS q FROM lineitem GROUP BY 1")
def bin_median(v):
    return summary.bin_median(v("lineitem"), "l_extendedprice", "l_quantity", 1000).select(F.col("l_extendedprice").alias("bin"), r(F.col("l_quantity_median"), 4).alias("q"))


@query("SELECT pid, epoch(date_trunc('second', time + interval '500' millisecond))::BIGINT AS s FROM pings", "pings")
def round_second(v):
    return v("pings").select("pid", F.unix_seconds(summary.round_to_second(F.col("time")).cast("timestamp")).alias("s"))


@query(f"SELECT pid, abs(value - lead(value) {OVER}) < 1.5e-8 AS same FROM pings", "pings")
def near_next(v):
    return v("pings").select("pid", on(summary.near_next, "value").alias("same"))


@query("SELECT vid, count(*) FILTER (kind = 'signup') AS n_in, count(*) FILTER (value > 20) AS n_fast FROM pings GROUP BY 1", "pings")
def counts_where(v):
    return summary.counts_where(v("pings"), BY, n_in=F.col("kind") == "signup", n_fast=F.col("value") > 20)


@query(f"WITH a AS (SELECT *, row_number() {OVER} AS k FROM pings), b AS (SELECT *, min(CASE WHEN in_harbour THEN k END) OVER (PARTITION BY vid) AS lo, max(CASE WHEN in_harbour THEN k END) OVER (PARTITION BY vid) AS hi FROM a) SELECT pid FROM b WHERE k BETWEEN lo AND hi", "pings")
def between_port_calls(v):
    return summary.between_port_calls(v("pings"), "in_harbour", BY, ORDER).select("pid")


@query("SELECT visir, epoch(t1 - interval '2' day)::BIGINT AS t1, epoch(t2 + interval '3' day)::BIGINT AS t2 FROM logbook", "logbook")
def buffered(v):
    return summary.buffered(v("logbook"), "t1", "t2").select("visir", *[F.unix_seconds(F.col(c).cast("timestamp")).alias(c) for c in ("t1", "t2")])


@query("SELECT n_nationkey, split_part(n_name, '_', 1) AS vessel, try_cast(split_part(n_name, '_', 2) AS int) AS number FROM nation")
def split_id(v):
    a, b = summary.split_id(F.col("n_name"))
    return v("nation").select("n_nationkey", a.alias("vessel"), b.alias("number"))


# ---- behaviour


def _steps(v):
    w = track.track_window(BY, ORDER)
    return v("smooth").withColumns({"step": track.distance(F.col("lon"), F.col("lat"), w), "turn": F.abs(F.col("value") - F.lag("value").over(w))})


@query()
def gaussian_thresholds(v):
    return behaviour.gaussian_thresholds(_steps(v), "step", BY, ORDER).select("pid", r(F.col("threshold_lower"), 4).alias("threshold_lower"), r(F.col("threshold_upper"), 4).alias("threshold_upper"))


@query()
def binary_clusters(v):
    return behaviour.binary_clusters(_steps(v), "step", "turn", BY, ORDER).select("pid", "A")


@query()
def hidden_states(v):
    return behaviour.hidden_states(_steps(v), ["step"], BY, ORDER).select("pid", "vit")


@query()
def forest_by_trip(v):
    d = _steps(v).join(v("pings").select("pid", "kind"), "pid").where("kind IN ('click', 'view')")
    return behaviour.forest_by_trip(d.select("pid", "vid", "step", "turn", "kind"), ["step", "turn"], "kind", "vid").select("pid", "fold", "kind", "predicted")
