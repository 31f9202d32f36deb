"""Views of the driver's tables as pings, trails, catch events, logbooks and points.

Each is a list of expressions that Spark and DuckDB read alike, so that a query and its SQL start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Gear codes of the logbook view. Fixed values.
GEARS = (2, 5, 6, 7, 9, 10, 12, 14, 15, 18, 37, 38, 39, 40, 42)
_gear = "CASE o_orderkey % 15 " + " ".join(f"WHEN {k} THEN {g}" for k, g in enumerate(GEARS)) + " END"
_numbered = "cast(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS bigint)"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "pings": ("events", [
        "event_id AS pid", "user_id AS vid", "ts AS time", "value / 10 AS speed", "value AS value",
        "CASE WHEN event_type = 'signup' THEN concat('H', cast(event_id % 5 AS string)) END AS hid",
        "event_type IN ('signup', 'error') AS in_harbour", "event_type AS kind",
        "-43.5e0 + (event_id * 37 % 11200) / 100e0 AS lon", "36.25e0 + (event_id * 53 % 4850) / 100e0 AS lat",
    ]),
    "smooth": ("events", [
        "event_id AS pid", "user_id AS vid", "ts AS time", "value AS value",
        "-30e0 + user_id * 0.1e0 + value * 0.001e0 AS lon", "60e0 + user_id * 0.01e0 + value * 0.0005e0 AS lat",
    ]),
    "numbered": ("(SELECT DISTINCT * FROM lineitem)", ["*", f"l_orderkey * 1000 + {_numbered} AS rid"]),
    "trails": ("numbered", [
        "rid AS pid", "'XX' AS VE_COU", "cast(l_orderkey % 500 % 20 AS string) AS VE_REF", "l_shipdate AS time",
        "cast(l_orderkey % 500 AS string) AS FT_REF", "l_returnflag AS ir", "cast(l_quantity >= 10 AS int) AS state",
    ]),
    "catches": ("numbered", [
        "rid AS eid", "'XX' AS VE_COU", "cast(l_orderkey % 500 % 20 AS string) AS VE_REF", "cast(l_orderkey % 500 AS string) AS FT_REF",
        "CASE WHEN l_partkey % 3 <> 0 THEN cast(l_shipdate AS date) END AS date", "l_returnflag AS LE_RECT",
        "l_quantity AS LE_KG", "l_extendedprice AS LE_EURO",
    ]),
    "logbook": ("orders", [
        "o_orderkey AS visir", "o_custkey AS vid", f"{_gear} AS gid", "cast(o_orderdate AS date) AS date", "o_orderdate AS t1",
        "o_orderdate + interval '1' day * (o_orderkey % 20) AS t2", "CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice / 20000 END AS effort",
        "CASE WHEN o_orderkey % 11 <> 0 THEN cast(o_orderkey % 300 AS double) END AS mesh", "cast(o_orderkey % 90 AS double) AS mesh_min",
        "CASE WHEN o_orderkey % 5 <> 0 THEN cast(o_orderkey % 400 AS double) END AS sweeps",
        "CASE WHEN o_orderkey % 4 <> 0 THEN cast(o_orderkey % 6 AS double) END AS plow_width",
    ]),
    "stations": ("customer", ["c_custkey", "CASE c_custkey % 9 WHEN 0 THEN concat(cast(c_custkey * 7919 + 200000000 AS string), '0') WHEN 1 THEN cast(200 + c_custkey % 25 AS string) WHEN 2 THEN concat(cast(200 + c_custkey % 25 AS string), 'abcdef') WHEN 3 THEN concat('98', cast(200 + c_custkey % 25 AS string), '1234') ELSE lpad(cast(c_custkey * 7919 + 200000000 AS string), 9, '0') END AS mmsi", "c_acctbal"]),
    "flags": ("nation", ["n_nationkey + 200 AS MID", "n_name AS flag"]),
    "metiers": ("nation", ["n_nationkey", "concat(n_name, '_>=120_0_0') AS metier"]),
    "xyz": ("lineitem", ["cast(l_partkey AS double) AS x", "cast(l_suppkey AS double) AS y", "l_extendedprice AS z"]),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    source, columns = VIEWS[name]
    df = view(spark, sf_dir, "lineitem").distinct() if source.startswith("(") else view(spark, sf_dir, source)
    return df.selectExpr(*columns)


def sql_views(*names: str) -> str:
    """WITH clause that defines the views, and what they build on."""
    out: dict[str, str] = {}

    def add(name: str) -> None:
        if name in VIEWS and name not in out:
            source, columns = VIEWS[name]
            add(source)
            out[name] = f"{name} AS (SELECT {', '.join(columns)} FROM {source})"

    for n in names:
        add(n)
    return "WITH " + ",\n".join(out.values())
