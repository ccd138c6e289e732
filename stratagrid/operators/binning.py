"""Points to cells, cells to coarser cells, index ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.model import GridSpec


def _index(offset: Column, cell: int, size: int) -> Column:
    """Floor of the offset in cells; a point exactly on the far edge is in the last cell, one off the grid in none."""
    inside = (offset >= 0) & (offset <= cell * size)
    return F.when(inside, F.least(F.floor(offset / cell), F.lit(size - 1))).cast("int")


#: Part of a cell that a coordinate may lie off the grid by numerical error.
TOLERANCE = 1e-5


def interior_index(offset: Column, cell: float, size: int) -> Column:
    """Index of a coordinate ``offset`` from the grid's edge, floating point. One off the grid by less than ``TOLERANCE`` of a cell is in the
    outermost cell; one further off is an error when the result is computed."""
    at = offset / cell
    off = (at < -TOLERANCE) | (at > size + TOLERANCE)
    wrong = F.assert_true(~off, F.concat(F.lit("off the grid by more than numerical error: "), offset))
    return F.when(wrong.isNull(), F.least(F.greatest(F.floor(at), F.lit(0)), F.lit(size - 1))).cast("int")


def with_cell(points: DataFrame, grid: GridSpec, keep_outside: bool = False) -> DataFrame:
    """Adds ``cx, cy``. Points off the grid are dropped, or kept with nulls."""
    out = points.withColumns({
        "cx": _index(F.col("x_raw") - grid.x0, grid.cell, grid.size_x), "cy": _index(grid.y0 - F.col("y_raw"), grid.cell, grid.size_y)
    })
    return out if keep_outside else out.filter("cx is not null and cy is not null")


def cell_centre(grid: GridSpec) -> dict[str, Column]:
    return {"x": (F.col("cx") + 0.5) * grid.cell + grid.x0, "y": F.lit(grid.y0) - (F.col("cy") + 0.5) * grid.cell}


def coarse(times: int) -> dict[str, Column]:
    """Keys of the cell, ``times`` as wide, that holds a cell."""
    return {"bx": F.floor(F.col("cx") / times).cast("int"), "by": F.floor(F.col("cy") / times).cast("int")}


def cells_under(extents: DataFrame, grid: GridSpec) -> DataFrame:
    """One row for each cell that an extent ``xmin, xmax, ymin, ymax`` meets, clipped to the grid."""
    clip = lambda c, size: F.greatest(F.lit(0), F.least(c, F.lit(size - 1))).cast("int")
    meets = (F.col("xmax") >= grid.x0) & (F.col("xmin") <= grid.x0 + grid.cell * grid.size_x) & (F.col("ymin") <= grid.y0) & (F.col("ymax") >= grid.y0 - grid.cell * grid.size_y)
    x = F.sequence(
        clip(F.floor((F.col("xmin") - grid.x0) / grid.cell), grid.size_x), clip(F.floor((F.col("xmax") - grid.x0) / grid.cell), grid.size_x)
    )
    y = F.sequence(
        clip(F.floor((grid.y0 - F.col("ymax")) / grid.cell), grid.size_y), clip(F.floor((grid.y0 - F.col("ymin")) / grid.cell), grid.size_y)
    )
    return extents.filter(meets).withColumn("cx", F.explode(x)).withColumn("cy", F.explode(y))


def overlapping(left: DataFrame, right: DataFrame, bucket: int) -> DataFrame:
    """Pairs ``left_id, right_id`` of extents (``id, xmin, xmax, ymin, ymax``) that meet: a bucketed range join.

    Both sides are dealt to buckets; a pair is kept in the bucket of its common south-west corner alone.
    """

    def dealt(df: DataFrame, p: str) -> DataFrame:
        b = lambda c: F.floor(F.col(c) / bucket)
        named = df.select(*(F.col(c).alias(f"{p}_{c}") for c in ("id", "xmin", "xmax", "ymin", "ymax")))
        spread = named.withColumn("bx", F.explode(F.sequence(b(f"{p}_xmin"), b(f"{p}_xmax"))))
        return spread.withColumn("by", F.explode(F.sequence(b(f"{p}_ymin"), b(f"{p}_ymax"))))

    both = dealt(left, "left").join(dealt(right, "right"), ["bx", "by"])
    meets = (F.col("left_xmin") <= F.col("right_xmax")) & (F.col("right_xmin") <= F.col("left_xmax")) & (F.col("left_ymin") <= F.col("right_ymax")) & (F.col("right_ymin") <= F.col("left_ymax"))
    home = (F.floor(F.greatest("left_xmin", "right_xmin") / bucket) == F.col("bx")) & (F.floor(F.greatest("left_ymin", "right_ymin") / bucket) == F.col("by"))
    return both.filter(meets & home).select("left_id", "right_id")
