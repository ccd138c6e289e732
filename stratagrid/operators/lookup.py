"""Rasters looked up at points, masks, noise repair. Equi-joins on the cell; the optimizer picks the strategy by size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.points import HIGH_NOISE, LOW_NOISE, valid
from stratagrid.model import GridSpec

CELL = ["cx", "cy"]


def on_terrain(points: DataFrame, terrain: DataFrame, how: str = "inner") -> DataFrame:
    """Adds ``dtm``, the terrain of the point's cell."""
    return points.join(terrain.select(*CELL, F.col("z").alias("dtm")), CELL, how)


def bilinear(points: DataFrame, raster: DataFrame, grid: GridSpec, value: str = "z") -> DataFrame:
    """Adds ``value`` interpolated from the point's cell and the next ones east and south, weighted from the cell's corner.

    A 2 by 2 neighbourhood is spread from the raster, so points are joined once; null where one of the four is missing.
    """
    spread = raster.select(
        "cx", "cy", F.col(value).alias("v"),
        F.explode(F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x in (0, 1) for y in (0, 1)))).alias("d")
    )
    corner = lambda x, y: F.max(F.when((F.col("d.dx") == x) & (F.col("d.dy") == y), F.col("v"))).alias(f"v{x}{y}")
    four = spread.groupBy(
        (F.col("cx") - F.col("d.dx")).alias("cx"), (F.col("cy") - F.col("d.dy")).alias("cy")
    ).agg(*(corner(x, y) for x in (0, 1) for y in (0, 1)))
    fx, fy = (F.col("x_raw") - grid.x0) / grid.cell - F.col("cx"), (grid.y0 - F.col("y_raw")) / grid.cell - F.col("cy")
    blend = (1 - fx) * (1 - fy) * F.col("v00") + fx * (1 - fy) * F.col("v10") + (1 - fx) * fy * F.col("v01") + fx * fy * F.col("v11")
    return points.join(four, CELL, "left").withColumn(value, blend).drop("v00", "v10", "v01", "v11")


def masked(rows: DataFrame, mask: DataFrame) -> DataFrame:
    """Rows in cells of the mask."""
    return rows.join(mask.select(*CELL).distinct(), CELL, "left_semi")


def unmatched(tiles: DataFrame, other: DataFrame, key: str = "tile") -> DataFrame:
    """Tiles without a partner of the same name."""
    return tiles.join(other.select(key).distinct(), key, "left_anti")


def repair_noise(points: DataFrame, terrain: DataFrame, low: float, high: float) -> DataFrame:
    """Valid points above ``dtm + high`` become high noise, those below ``dtm + low`` low noise; without terrain all stay."""
    both = on_terrain(points, terrain, "left")
    over = F.col("z_raw") - F.col("dtm")
    new = F.when(valid() & (over > high), HIGH_NOISE).when(valid() & (over < low), LOW_NOISE).otherwise(F.col("classification"))
    return both.withColumn("classification", new).drop("dtm")


def remove_points(points: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid points, and the header figures that change: counts by return and the bounds of heights."""
    kept = points.filter(valid())
    by_return = [F.count_if(F.col("return_number") == k).alias(f"n_return_{k}") for k in range(1, 6)]
    return kept, kept.groupBy("tile").agg(F.count("*").alias("n"), *by_return, F.min("z_raw").alias("z_min"), F.max("z_raw").alias("z_max"))
