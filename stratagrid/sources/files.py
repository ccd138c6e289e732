"""File tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns of the size table, by file extension.
SIZE_TYPES = {
    "fjdslam": ("fjdslam",), "geoslam": ("geoslam",), "jpeg": ("jpg", "jpeg"), "ldr": ("ldr",), "las": ("las",), "laz": ("laz",),
    "tiff": ("tif", "tiff")
}


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, length, modified``: files below a folder or glob. File contents are not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def tree_size(files: DataFrame) -> DataFrame:
    """Bytes by folder and type of file."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    sums = [F.sum(F.when(ext.isin(*e), F.col("length")).otherwise(0)).alias(k) for k, e in SIZE_TYPES.items()]
    return files.groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(*sums, F.sum("length").alias("total"))


def tile_name(path):
    """File name without folder and extension."""
    return F.regexp_extract(path, r"([^/]*?)(\.[^./]*)?$", 1)


def layer_counts(features: DataFrame) -> DataFrame:
    return features.groupBy("file", "layer").agg(F.count("*").alias("features"))


def append_to_name(path: Column, text: str) -> Column:
    """A path with ``text`` between the name and the extension of its file."""
    return F.regexp_replace(path, r"(?s)^(.*?)(\.[^./]*)?$", "$1" + text.replace("\\", r"\\").replace("$", r"\$") + "$2")


def replace_extension(path: Column, extension: str) -> Column:
    """A path with another extension, given with its dot; one without gets it."""
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(extension))


def paired_files(clouds: DataFrame, rasters: DataFrame, column: str = "raster") -> DataFrame:
    """Clouds ``path`` with the raster file of the same name in ``column``; a cloud without one is an error when the result is computed."""
    both = clouds.withColumn("_name", tile_name(F.col("path"))).join(
        rasters.select(tile_name(F.col("path")).alias("_name"), F.col("path").alias(column)), "_name", "left"
    )
    missing = F.assert_true(F.col(column).isNotNull(), F.concat(F.lit("no file of the name of "), F.col("path")))
    return both.withColumn("_ok", missing).filter("_ok is null").drop("_ok", "_name")


def bounding_polygons(headers: DataFrame) -> DataFrame:
    """``tile, crs, polygon`` (WKT) of the bounds in headers ``tile, x_min, x_max, y_min, y_max, wkt``. All files are in one system, else it is an error."""
    systems = headers.select("wkt").distinct().limit(2).collect()
    if len(systems) > 1:
        raise ValueError(f"files are in {systems[0].wkt} and in {systems[1].wkt}")
    corners = [("x_min", "y_min"), ("x_min", "y_max"), ("x_max", "y_max"), ("x_max", "y_min"), ("x_min", "y_min")]
    points = F.concat_ws(", ", *(F.format_string("%.3f %.3f", F.col(x), F.col(y)) for x, y in corners))
    return headers.select("tile", F.col("wkt").alias("crs"), F.concat(F.lit("POLYGON (("), points, F.lit("))")).alias("polygon"))
