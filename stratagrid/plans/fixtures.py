"""Synthetic points over the driver tables: a square of metre cells, millimetres, y to the north.

The square grows with the table, so that a cell holds about 37 points at every scale factor (40 by 40 cells at sf0.01).
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.model import GridSpec
from stratagrid.operators.binning import with_cell

POINTS_IN_CELL = 37.5
LEAST_SIDE = 8

#: Cells on a side, for DuckDB.
SIDE_SQL = f"sq AS (SELECT greatest({LEAST_SIDE}, CAST(floor(sqrt(count(*) / {POINTS_IN_CELL}::DOUBLE)) AS INT)) AS side FROM lineitem)"

_SIDES: dict[tuple[str, str], int] = {}


def grid(spark: SparkSession, sf_dir: str) -> GridSpec:
    """The grid of the points of ``sf_dir``; rows are counted from the file's own footer, once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SIDES:
        _SIDES[key] = max(LEAST_SIDE, int(math.sqrt(spark.read.parquet(f"{sf_dir}/lineitem.parquet").count() / POINTS_IN_CELL)))
    side = _SIDES[key]
    return GridSpec(0, side * 1000, 1000, side, side)


#: ``{w}`` is the width of the square. Reads the same in Spark and DuckDB. Flags and times that the tables lack are derived by arithmetic.
POINTS_SQL = """
SELECT CAST(concat('t', CAST(l_suppkey % 8 AS STRING)) AS STRING) AS tile,
  CAST((l_orderkey*37 + l_linenumber*1013) % {w} AS INT) AS x_raw,
  CAST((l_partkey*101 + l_suppkey*1709) % {w} AS INT) AS y_raw,
  CAST(CAST(round(l_extendedprice*100) AS BIGINT) % 60000 AS INT) AS z_raw,
  CAST(l_quantity AS INT)*1000 + CAST(round(l_tax*100) AS INT) AS intensity,
  CAST((l_linenumber-1)%5+1 AS INT) AS return_number,
  CAST(5 AS INT) AS number_of_returns,
  CAST(CASE WHEN l_returnflag='A' THEN 2 WHEN l_quantity>=50 THEN 18 WHEN l_quantity<=1 THEN 7 ELSE 1 END AS INT) AS classification,
  (CAST(round(l_tax*100) AS INT)=8) AS withheld,
  (l_orderkey % 7 = 0) AS edge, (l_partkey % 11 = 0) AS overlap, (l_suppkey % 2 = 1) AS scan_direction,
  CAST(round(l_discount*100) AS INT)*500-2500 AS scan_angle_raw,
  CAST(l_orderkey % 100000 AS DOUBLE) AS gps_time,
  CAST(l_suppkey AS INT) AS source_id,
  CAST(l_partkey % 256 AS INT) AS red, CAST(l_suppkey % 256 AS INT) AS green, CAST(l_orderkey % 256 AS INT) AS blue
FROM lineitem
"""

#: The points with their cells, for DuckDB; the far edges belong to the last cells. ``xs`` are the indices of a side.
CELLS_SQL = f"""
{SIDE_SQL}, xs AS (SELECT CAST(unnest(range(side)) AS INT) AS x FROM sq),
p AS (SELECT *, CAST(least(floor(x_raw/1000.0), side - 1) AS INT) AS cx, CAST(least(floor((side*1000 - y_raw)/1000.0), side - 1) AS INT) AS cy,
  (NOT withheld AND classification NOT IN (7,18)) AS ok FROM ({POINTS_SQL.replace("{w}", "(side*1000)").replace("FROM lineitem", "FROM lineitem, sq")}), sq)
"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = POINTS_SQL[: POINTS_SQL.rindex("FROM lineitem")].replace("{w}", str(grid(spark, sf_dir).y0))
    return spark.sql(body + "FROM {rows}", rows=spark.read.parquet(f"{sf_dir}/lineitem.parquet"))


def binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_cell(points(spark, sf_dir), grid(spark, sf_dir))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``cx, cy`` of the grid."""
    side = grid(spark, sf_dir).size_x
    return spark.range(side * side).select((F.col("id") % side).cast("int").alias("cx"), F.floor(F.col("id") / side).cast("int").alias("cy"))
