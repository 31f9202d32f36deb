"""Sparse rasters: a grid is a small description, cells are rows (col, row, value). Nothing is made for empty cells."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


TILE = 4000


@dataclass(frozen=True)
class Grid:
    """Extent, cell size and reference system of a raster; rows count from the top."""

    xmin: float
    xmax: float
    ymin: float
    ymax: float
    res: float
    crs: str = ""

    @property
    def n_cols(self) -> int:
        return round((self.xmax - self.xmin) / self.res)

    @property
    def n_rows(self) -> int:
        return round((self.ymax - self.ymin) / self.res)

    def coarser(self, factor: int) -> Grid:
        return Grid(self.xmin, self.xmax, self.ymin, self.ymax, self.res * factor, self.crs)


#: Fixed values.
BASE_GRID = Grid(1107968, 2314240, -260096, 827392, 8, "EPSG:5325")


def rasterize(xyz: DataFrame, grid: Grid, agg: int = 1, fun: str = "mean", no_trim: bool = True, columns: Sequence[str] | None = None) -> DataFrame:
    """Mean or count of z by cell of `grid` made `agg` times coarser; points outside go. The first three columns are x, y, z unless named.

    The right and bottom edges belong to the last cells. With no_trim=False columns and rows count from the first ones in use.
    """
    if fun not in ("mean", "count", "sum", "min", "max"):
        raise ValueError(f"unknown function {fun}")
    x, y, z = columns or xyz.columns[:3]
    g = grid.coarser(agg)
    inside = xyz.where(F.col(x).between(g.xmin, g.xmax) & F.col(y).between(g.ymin, g.ymax) & F.col(z).isNotNull())
    col = F.least(F.floor((F.col(x) - F.lit(float(g.xmin))) / F.lit(float(g.res))), F.lit(g.n_cols - 1))
    row = F.least(F.floor((F.lit(float(g.ymax)) - F.col(y)) / F.lit(float(g.res))), F.lit(g.n_rows - 1))
    value = {"mean": F.avg, "count": F.count, "sum": F.sum, "min": F.min, "max": F.max}[fun](z)
    cells = inside.groupBy(col.cast("long").alias("col"), row.cast("long").alias("row")).agg(value.alias("value"))
    if no_trim:
        return cells
    first = F.broadcast(cells.agg(F.min("col").alias("_c"), F.min("row").alias("_r")))  # one row
    return cells.crossJoin(first).select((F.col("col") - F.col("_c")).alias("col"), (F.col("row") - F.col("_r")).alias("row"), "value")


def resolution_pyramid(xyz: DataFrame, grid: Grid, cutoff: int = 10, max_res: float = 1024, columns: Sequence[str] | None = None) -> DataFrame:
    """Every finest cell in use, with the mean of the finest level (doubling cell sizes up to `max_res`) that has `cutoff` points there.

    Counts and sums are aggregated level by level, each from the one below, so the points are read once.
    """
    x, y, z = columns or xyz.columns[:3]
    base = xyz.where(F.col(x).between(grid.xmin, grid.xmax) & F.col(y).between(grid.ymin, grid.ymax) & F.col(z).isNotNull())
    col = F.least(F.floor((F.col(x) - F.lit(float(grid.xmin))) / F.lit(float(grid.res))), F.lit(grid.n_cols - 1)).cast("long")
    row = F.least(F.floor((F.lit(float(grid.ymax)) - F.col(y)) / F.lit(float(grid.res))), F.lit(grid.n_rows - 1)).cast("long")
    level = base.groupBy(col.alias("col"), row.alias("row")).agg(F.count(z).alias("n"), F.sum(z).alias("s"))
    out, k, res = level.select("col", "row", F.when(F.col("n") >= cutoff, F.col("s") / F.col("n")).alias("value"), F.when(F.col("n") >= cutoff, F.lit(float(grid.res))).alias("res")), 0, grid.res
    while res * 2 <= max_res:
        k, res = k + 1, res * 2
        level = level.groupBy(F.floor(F.col("col") / 2).alias("col"), F.floor(F.col("row") / 2).alias("row")).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        up = level.where(F.col("n") >= cutoff).select(F.col("col").alias("_c"), F.col("row").alias("_r"), (F.col("s") / F.col("n")).alias("_v"))
        shift = lambda c, k=k: F.floor(F.col(c) / (1 << k))
        out = out.join(up, (shift("col") == F.col("_c")) & (shift("row") == F.col("_r")), "left")
        out = out.select("col", "row", F.coalesce("value", "_v").alias("value"), F.coalesce("res", F.when(F.col("_v").isNotNull(), F.lit(float(res)))).alias("res"))
    return out


def hillshade(cells: DataFrame, res: float, zscale: float = 1.0, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """Lambert shade (0 to 1) of each cell with all four neighbours; null at edges."""
    near = None
    for name, dc, dr in (("w", -1, 0), ("e", 1, 0), ("n", 0, -1), ("s", 0, 1)):
        side = cells.select((F.col("col") - dc).alias("col"), (F.col("row") - dr).alias("row"), F.lit(name).alias("side"), F.col("value").alias("v"))
        near = side if near is None else near.unionByName(side)
    own = cells.select("col", "row", F.lit("c").alias("side"), F.col("value").alias("v"))
    pick = lambda s: F.max(F.when(F.col("side") == s, F.col("v")))
    five = own.unionByName(near).groupBy("col", "row").agg(*[pick(s).alias(s) for s in "cwens"]).where(F.col("c").isNotNull())
    dx, dy = (F.col("e") - F.col("w")) / F.lit(2 * res / zscale), (F.col("n") - F.col("s")) / F.lit(2 * res / zscale)
    lx, ly, lz = F.sin(F.radians(F.lit(azimuth))) * F.cos(F.radians(F.lit(altitude))), F.cos(F.radians(F.lit(azimuth))) * F.cos(F.radians(F.lit(altitude))), F.sin(F.radians(F.lit(altitude)))
    lit = (lz - dx * lx - dy * ly) / F.sqrt(1 + dx * dx + dy * dy)
    shade = F.when(lit > 0, lit).when(lit <= 0, 0.0)
    return five.select("col", "row", F.col("c").alias("value"), shade.alias("shade"))


def shade_to_rgb(shaded: DataFrame, bands: Sequence[str] = ("r", "g", "b"), mask: str = "value") -> DataFrame:
    """Bands from 0-1 to 0-255; null where the original value is null."""
    return shaded.withColumns({b: F.when(F.col(mask).isNotNull(), F.col(b) * 255) for b in bands})


def shade_tiles(cells: DataFrame, res: float, zscale: float = 1.0, tile: int = TILE) -> DataFrame:
    """Hillshade as grey RGB with the tile (at most `tile` cells a side) of each cell; empty tiles never exist."""
    out = hillshade(cells, res, zscale).withColumns({b: F.col("shade") for b in "rgb"})
    return shade_to_rgb(out).withColumns({"tile_x": F.floor(F.col("col") / tile), "tile_y": F.floor(F.col("row") / tile)})


def write_tiles(cells: DataFrame, path: str) -> None:
    cells.write.mode("overwrite").partitionBy("tile_x", "tile_y").parquet(path)


def cell_centres(cells: DataFrame, grid: Grid) -> DataFrame:
    return cells.withColumns({"x": F.lit(float(grid.xmin)) + (F.col("col") + 0.5) * grid.res, "y": F.lit(float(grid.ymax)) - (F.col("row") + 0.5) * grid.res})


