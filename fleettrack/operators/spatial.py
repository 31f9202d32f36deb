"""Points in polygons. A polygon is an outer ring: array<struct<x, y>>; edges are straight in the plane, and the boundary is inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import NUMERIC, require

#: Corners of all rings, once for each cell that a ring is dealt to, up to which they are broadcast: some 32 MB.
BROADCAST_CORNERS = 2_000_000


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test of a point in a ring, with its boundary."""
    n = F.size(ring)
    at = lambda k: F.get(ring, k)

    def edge(k: Column) -> Column:
        a, b = at(k), at((k + 1) % n)
        return F.struct(a.x.alias("ax"), a.y.alias("ay"), b.x.alias("bx"), b.y.alias("by"))

    edges = F.transform(F.sequence(F.lit(0), n - 1), edge)
    cross = lambda e: (e.bx - e.ax) * (y - e.ay) - (e.by - e.ay) * (x - e.ax)
    on = F.exists(edges, lambda e: (cross(e) == 0) & x.between(F.least(e.ax, e.bx), F.greatest(e.ax, e.bx)) & y.between(F.least(e.ay, e.by), F.greatest(e.ay, e.by)))
    crosses = lambda e: ((e.ay > y) != (e.by > y)) & (F.when(e.by > e.ay, cross(e) < 0).otherwise(cross(e) > 0))
    odd = F.size(F.filter(edges, lambda e: ~crosses(e))) % 2 != n % 2
    return F.when(n >= 3, on | odd).otherwise(F.lit(False))


def _with_box(polygons: DataFrame, ring: str) -> DataFrame:
    x, y = F.transform(ring, lambda p: p.x), F.transform(ring, lambda p: p.y)
    return polygons.withColumns({"_x0": F.array_min(x), "_x1": F.array_max(x), "_y0": F.array_min(y), "_y1": F.array_max(y)})


def _dealt(polygons: DataFrame, ring: str, cell: float, small: int) -> tuple[DataFrame, bool]:
    """Polygons by the grid cells (_cx, _cy) of their bounding boxes, and whether their corners, counted, are few enough to broadcast."""
    if not dict(polygons.dtypes).get(ring, "").startswith("array<struct<"):
        raise ValueError(f"{ring} must be a ring, array<struct<x,y>>")
    slot = lambda c: F.floor(F.col(c) / cell)
    boxed = _with_box(polygons.where(F.size(ring) >= 3), ring)
    cells = (slot("_x1") - slot("_x0") + 1) * (slot("_y1") - slot("_y0") + 1)
    corners = boxed.agg(F.sum(cells * F.size(ring))).first()[0] or 0
    dealt = boxed.withColumn("_cx", F.explode(F.sequence(slot("_x0"), slot("_x1")))).withColumn("_cy", F.explode(F.sequence(slot("_y0"), slot("_y1"))))
    return dealt, corners <= small


def polygon_join(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", ring: str = "ring", how: str = "left", cell: float = 1.0, small: int = BROADCAST_CORNERS) -> DataFrame:
    """Join points with the polygons that hold them (a point in two is repeated).

    Polygons are dealt out to the grid cells of their bounding boxes; a point meets those of its cell, then its box, then its ring. Polygons with up to
    `small` corners in all their cells (counted first) are broadcast; more are joined by cell.
    """
    require(points, {x: NUMERIC, y: NUMERIC})
    dealt, few = _dealt(polygons, ring, cell, small)
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    inside = (F.floor(px / cell) == F.col("_cx")) & (F.floor(py / cell) == F.col("_cy")) & px.between(F.col("_x0"), F.col("_x1")) & py.between(F.col("_y0"), F.col("_y1")) & in_ring(px, py, F.col(ring))
    out = points.join(F.broadcast(dealt) if few else dealt, inside, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_x0", "_x1", "_y0", "_y1", "_cx", "_cy", ring)


def points_in_polygons(points: DataFrame, polygons: DataFrame, out: str = "inside", x: str = "lon", y: str = "lat", ring: str = "ring", cell: float = 1.0, small: int = BROADCAST_CORNERS) -> DataFrame:
    """Adds whether a point lies in any polygon: one join with the list of polygons of the point's cell. `points` needs no key."""
    require(points, {x: NUMERIC, y: NUMERIC})
    dealt, few = _dealt(polygons, ring, cell, small)
    held = dealt.groupBy("_cx", "_cy").agg(F.collect_list(F.struct("_x0", "_x1", "_y0", "_y1", F.col(ring).alias("ring"))).alias("_rings"))
    px, py = F.col(x).cast("double"), F.col(y).cast("double")
    both = points.join(F.broadcast(held) if few else held, (F.floor(px / cell) == F.col("_cx")) & (F.floor(py / cell) == F.col("_cy")), "left")
    hit = F.exists("_rings", lambda p: px.between(p["_x0"], p["_x1"]) & py.between(p["_y0"], p["_y1"]) & in_ring(px, py, p["ring"]))
    return both.withColumn(out, F.coalesce(hit, F.lit(False))).drop("_cx", "_cy", "_rings")


def keep_inside(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    return polygon_join(points, polygons, how="left_semi", **options)


def drop_inside(points: DataFrame, polygons: DataFrame, **options) -> DataFrame:
    return polygon_join(points, polygons, how="left_anti", **options)


remove_inside = drop_inside


def within_box(df: DataFrame, x: str, y: str, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """Rows in the box, edges included; nulls go."""
    return df.where(F.col(x).between(xmin, xmax) & F.col(y).between(ymin, ymax))


def bounding_box(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    return df.agg(F.min(x).alias("xmin"), F.min(y).alias("ymin"), F.max(x).alias("xmax"), F.max(y).alias("ymax"))


def whole_extent(df: DataFrame, x: str = "x", y: str = "y") -> DataFrame:
    """Bounding box at whole numbers."""
    return df.agg(F.floor(F.min(x)).alias("xmin"), F.ceil(F.max(x)).alias("xmax"), F.floor(F.min(y)).alias("ymin"), F.ceil(F.max(y)).alias("ymax"))
