"""Grids and schemas."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

POINTS = T.StructType(
    [T.StructField("tile", T.StringType()), T.StructField("seq", T.LongType())]
    + [T.StructField(c, T.IntegerType()) for c in ("x_raw", "y_raw", "z_raw", "intensity", "return_number", "number_of_returns", "classification")]
    + [T.StructField(c, T.BooleanType()) for c in ("withheld", "synthetic", "key_point", "overlap", "edge", "scan_direction")]
    + [T.StructField("scan_angle_raw", T.IntegerType()), T.StructField("gps_time", T.DoubleType())]
    + [T.StructField(c, T.IntegerType()) for c in ("source_id", "red", "green", "blue", "nir")]
)


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid in raw units: ``x0``, ``y0`` is the north-west corner; rows grow southwards."""

    x0: int
    y0: int
    cell: int
    size_x: int
    size_y: int
    #: metres in one raw unit
    scale: float = 0.001

    def coarser(self, times: int) -> GridSpec:
        return GridSpec(self.x0, self.y0, self.cell * times, -(-self.size_x // times), -(-self.size_y // times), self.scale)
