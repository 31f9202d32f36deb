"""Logbook records: gears, mesh sizes, effort, gear width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import is_in

# Fixed values of the gear codes (gid) and their standards.
MESH = {9: 80, 7: 40, 10: 40, 12: 40, 14: 40, 15: 100, 38: 100, 40: 100}
EFFORT_CAPS = {6: 12.0, 7: 24.0, 14: 15.0}
WIDTH_CAPS = {6: 250.0, 7: 250.0, 9: 75.0, 14: 55.0}
SWEEP_GEARS, PLOW_GEARS = (6, 7, 9, 14), (15, 38, 40)
MEDIAN_GEARS = (6, 7, 9, 14, 15, 37, 38, 40)


def standard_mesh(lb: DataFrame) -> DataFrame:
    """mesh of gear 7 from mesh_min, and mesh.std by gear: fixed, by 147 mm for gears 5 and 6, by inches for gear 2, 203 where that has none."""
    gid, mesh = F.col("gid"), F.when(F.col("gid") == 7, F.col("mesh_min")).when(F.col("gid") != 7, F.col("mesh"))
    lb = lb.withColumn("mesh", mesh)
    std = None
    for g, size in MESH.items():
        std = F.when(gid == g, size) if std is None else std.when(gid == g, size)
    trawl = gid.isin(5, 6)
    std = std.when(trawl & ((F.col("mesh") <= 147) | F.col("mesh").isNull()), 135).when(trawl & (F.col("mesh") > 147), 155)
    inch = F.bround(F.col("mesh") / 2.54)
    inch = F.when(inch <= 66, 60).when(inch <= 76, 70).when(inch <= 87, 80).when(inch.isNotNull(), 90)
    std = std.when(gid == 2, F.bround(inch * 2.54)).cast("double")
    return lb.withColumn("mesh_std", F.when(gid == 2, F.coalesce(std, F.lit(203.0))).otherwise(std))


def lump_gears(lb: DataFrame) -> DataFrame:
    """Similar gears under one code, in order; -666 for unknown and left-out gears."""
    g = F.col("gid")
    g = F.when(g.isin(10, 12), 4).otherwise(g)
    g = F.when(g == 18, 18).when(g == 39, 18).otherwise(g)
    g = F.coalesce(g, F.lit(-666))
    g = F.when(g.isin(4, 12, 42), -666).otherwise(g)
    return lb.withColumn("gid", F.when(g.isin(15, 37, 38, 40), 15).otherwise(g).cast("int"))


def _median_fill(lb: DataFrame, x: str, gears=None) -> DataFrame:
    """Null `x` filled with its gear's median; records without a gear have none."""
    rows = lb if gears is None else lb.where(F.col("gid").isin(*gears))
    medians = rows.groupBy("gid").agg(F.median(x).alias("_median")).withColumnRenamed("gid", "_gid")
    return lb.join(medians, F.col("gid") == F.col("_gid"), "left").withColumn(x, F.coalesce(F.col(x), F.col("_median"))).drop("_median", "_gid")


def _cap_by_gear(lb: DataFrame, x: str, caps: dict[int, float]) -> DataFrame:
    value = F.col(x)
    for g, cap in caps.items():
        value = F.when((F.col("gid") == g) & (F.col(x) > cap), cap).otherwise(value)
    return lb.withColumn(x, value)


def cap_effort(lb: DataFrame) -> DataFrame:
    """Effort: gear medians for nulls, caps by gear. A record that ends after the vessel's next one starts is flagged and ends a minute before that."""
    lb = _cap_by_gear(_median_fill(lb, "effort"), "effort", EFFORT_CAPS)
    w = Window.partitionBy("vid").orderBy("t1", "visir")
    following = F.lead("t1").over(w)
    lb = lb.withColumn("_next", following).withColumn("overlap", F.col("t2") > F.col("_next"))
    cut = F.date_trunc("second", F.col("_next") - F.expr("interval 1 minute")).cast(dict(lb.dtypes)["t2"])
    return lb.withColumn("t2", F.when(F.coalesce(F.col("overlap"), F.lit(False)), cut).otherwise(F.col("t2"))).drop("_next")


def gear_width_proxy(lb: DataFrame) -> DataFrame:
    """gear_width: sweeps of trawls and seines, plow width of dredges, capped by gear; gear medians for nulls; 500 for gear 5."""
    width = F.when(is_in(F.col("gid"), SWEEP_GEARS), F.col("sweeps")).when(is_in(F.col("gid"), PLOW_GEARS), F.col("plow_width"))
    lb = _cap_by_gear(lb.withColumn("gear_width", width.cast("double")), "gear_width", WIDTH_CAPS)
    lb = _median_fill(lb, "gear_width", MEDIAN_GEARS)
    return lb.withColumn("gear_width", F.when(F.col("gid") == 5, 500.0).otherwise(F.col("gear_width")))


def benthis_width(df: DataFrame, lookup: DataFrame, parameters: DataFrame, metier: str = "metier5", length: str = "length", kw: str = "kw", out: str = "gear_width") -> DataFrame:
    """Gear width by métier from vessel length or engine power: a*v^b (power) or a*v+b (linear, length only)."""
    p = parameters.select(F.col("benthis_metier").alias("_bm"), F.col("a").alias("_a"), F.col("b").alias("_b"), F.col("model").alias("_m"), F.col("variable").alias("_v"))
    names = lookup.select(F.col("metier5").alias("_m5"), "benthis_metier")
    both = df.join(names, F.col(metier) == F.col("_m5"), "left").join(p, F.col("benthis_metier") == F.col("_bm"), "left")
    power, line = F.col("_m") == "power", F.col("_m") == "linear"
    by_kw, by_length = F.col("_v") == "avg_kw", F.col("_v") == "avg_oal"
    width = (
        F.when(power & by_kw, F.col("_a") * F.pow(F.col(kw), F.col("_b"))).when(power & by_length, F.col("_a") * F.pow(F.col(length), F.col("_b")))
        .when(line & by_length, F.col("_a") * F.col(length) + F.col("_b"))
    )
    return both.withColumn(out, width).drop("_m5", "benthis_metier", "_bm", "_a", "_b", "_m", "_v")


def logbook(mobile: DataFrame, static: DataFrame, catch: DataFrame, vids=None, years=None) -> DataFrame:
    """Mobile and static records with their catch summed by visir; `source` says which."""
    total = catch.groupBy(F.col("visir").alias("_visir")).agg(F.coalesce(F.sum("catch"), F.lit(0.0)).alias("catch"))
    parts = []
    for name, df in (("mobile", mobile), ("static", static)):
        if vids is not None:
            df = df.where(F.col("vid").isin(list(vids)))
        if years is not None:
            df = df.where(F.year("date").isin(list(years)))
        parts.append(df.join(total, F.col("visir") == F.col("_visir"), "left").drop("_visir").withColumn("source", F.lit(name)))
    out = parts[0].unionByName(parts[1], allowMissingColumns=True)
    return out.withColumns({c: F.col(c).cast(t) for c, t in (("date", "date"), ("datel", "date"), ("gid", "int")) if c in out.columns})
