"""Terrain and counts by cell kept up to date while point tables arrive. An extension: nothing here has an event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from stratagrid.model import POINTS, GridSpec
from stratagrid.operators import aggregates
from stratagrid.operators.binning import with_cell


def arriving_points(spark: SparkSession, path: str, files_per_trigger: int = 64) -> DataFrame:
    return spark.readStream.schema(POINTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_terrain(points: DataFrame, grid: GridSpec) -> DataFrame:
    """The terrain aggregate of ``aggregates.dtm`` over a stream; state is one sum and count for each cell."""
    return aggregates.dtm(with_cell(points, grid))


def start(terrain: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return terrain.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
