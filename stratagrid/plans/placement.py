"""Queries of placing clouds and tiles: registration, change of system, virtual raster grids, tiles by place, indices, file pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import aggregates as agg
from stratagrid.operators import raster, transform
from stratagrid.operators.binning import interior_index
from stratagrid.plans.catalog import CELL, SURFACE, TERRAIN, query, rounded, with_points
from stratagrid.plans.fixtures import binned, grid, points
from stratagrid.sources.files import append_to_name, paired_files, replace_extension, tile_name

_TILES = [f"t{k}" for k in range(8)]

# --- registration and change of system ---

_BOUNDS = "min(x_raw) AS x0, max(x_raw) AS x1, min(y_raw) AS y0, max(y_raw) AS y1, min(z_raw) AS z0, max(z_raw) AS z1"


@query(with_points("""SELECT tile, any_value(source) AS source_id, CAST(sum(x) AS BIGINT) AS x_sum, CAST(sum(y) AS BIGINT) AS y_sum, CAST(min(x) AS INT) AS x_min, CAST(max(y) AS INT) AS y_max,
  CAST(count(*) FILTER (WHERE classification = 1) AS BIGINT) AS ones, round(any_value(600000 + 10 * k), 6) AS x_offset, 4900000::DOUBLE AS y_offset, 12.5::DOUBLE AS z_offset,
  round(0.001::DOUBLE / 0.3048, 12) AS x_scale, round(0.001::DOUBLE / 0.3048, 12) AS z_scale FROM (
  SELECT tile, k, CAST(20 + k AS INT) AS source, CASE classification WHEN 1 THEN 2 ELSE classification END AS classification,
    trunc(x_raw*cos(a) - y_raw*sin(a) + 0.5) AS x, trunc(x_raw*sin(a) + y_raw*cos(a) + 0.5) AS y FROM (SELECT *, CAST(substr(tile, 2) AS INT) AS k, radians(-(CAST(substr(tile, 2) AS INT) * 3.5::DOUBLE - 9)) AS a FROM p)) GROUP BY tile"""))
def register_points(spark, sf_dir):
    """Clouds of a scanner in metres placed in a system in feet: declination and nudge by file, source ids counted up."""
    p = points(spark, sf_dir)
    at = transform.Anchor(latitude=44.5, longitude=-123.25, z=12.5, project=lambda lat, lon, z: (600000.0, 4900000.0, z))
    params = transform.registration(
        spark, _TILES, at, declination=[3.5 * k - 9 for k in range(8)], nudge_x=[10.0 * k for k in range(8)], scanner_unit=1.0,
        horizontal_unit=0.3048, vertical_unit=0.3048, first_source_id=20
    )
    moved = transform.register(p, params, fix_classes=True).groupBy("tile").agg(
        F.max("source_id").alias("source_id"), F.sum("x_raw").alias("x_sum"), F.sum("y_raw").alias("y_sum"), F.min("x_raw").alias("x_min"), F.max("y_raw").alias("y_max"), F.count_if(F.col("classification") == 1).alias("ones")
    )
    heads = p.select("tile").distinct().select("tile", *(F.lit(0.001).alias(f"{a}_scale") for a in "xyz"))
    new = transform.registered_headers(heads, params).select(
        "tile", *(F.round(f"{a}_offset", 6).alias(f"{a}_offset") for a in "xyz"), *(F.round(f"{a}_scale", 12).alias(f"{a}_scale") for a in "xz")
    )
    return moved.join(new, "tile")


def _affine(x: float, y: float, z: float) -> tuple[float, float, float]:
    """A stand-in for a projection: turned, three times as large, in feet upwards."""
    return 3.2 * x + 0.4 * y + 500, -0.4 * x + 3.2 * y - 700, z / 0.3048


@query(with_points("""SELECT b.tile, round(any_value(sx), 9) AS x_scale, round(any_value(sz), 9) AS z_scale, round(any_value(3.2 * mx + 0.4 * my + 500), 4) AS x_offset, round(any_value(-0.4 * mx + 3.2 * my - 700), 4) AS y_offset,
  round(any_value(mz / 0.3048 + 1), 4) AS z_offset, round(any_value(a), 9) AS angle, CAST(min(trunc(dx*cos(a) - dy*sin(a) + 0.5)) AS INT) AS x_min, CAST(max(trunc(dx*sin(a) + dy*cos(a) + 0.5)) AS INT) AS y_max,
  CAST(sum(trunc(p.z_raw - mz / 0.001 + 0.5)) AS BIGINT) AS z_sum FROM (
    SELECT tile, (x0 + x1) * 0.001::DOUBLE / 2 AS mx, (y0 + y1) * 0.001::DOUBLE / 2 AS my, (z0 + z1) * 0.001::DOUBLE / 2 AS mz, 0.001::DOUBLE * (1 / 0.3048) AS sx, 0.001::DOUBLE * (1 / 0.3048) AS sz,
      -(pi() / 2 - atan2(3.2 * (y1 - y0) * 0.001::DOUBLE, 0.4 * (y1 - y0) * 0.001::DOUBLE)) AS a FROM (SELECT tile, """ + _BOUNDS + """ FROM p GROUP BY tile)) b
  JOIN (SELECT p.*, x_raw - (x0 + x1) / 2.0::DOUBLE AS dx, y_raw - (y0 + y1) / 2.0::DOUBLE AS dy FROM p JOIN (SELECT tile, """ + _BOUNDS + " FROM p GROUP BY tile) USING (tile)) p USING (tile) GROUP BY b.tile"))
def convert_crs(spark, sf_dir):
    """Clouds carried to a turned system in feet, their origin moved to the middle of their bounds."""
    p = points(spark, sf_dir)
    span = [f(f"{a}_raw").alias(f"{a}_{m}") for a in "xyz" for m, f in (("min", F.min), ("max", F.max))]
    heads = p.groupBy("tile").agg(*span).select(
        "tile", *((F.col(f"{a}_{m}") * F.lit(0.001)).alias(f"{a}_{m}") for a in "xyz" for m in ("min", "max")),
        *(F.lit(0.001).alias(f"{a}_scale") for a in "xyz"), *(F.lit(0.0).alias(f"{a}_offset") for a in "xyz")
    )
    params = transform.crs_conversion(heads, _affine, horizontal_unit=(1.0, 0.3048), vertical_unit=(1.0, 0.3048), nudge=(0.0, 0.0, 1.0))
    params = params.withColumns({f"t{a}": F.round(f"t{a}", 6) for a in "xyz"})
    moved = transform.rotate_shift(p, params).groupBy("tile").agg(
        F.min("x_raw").alias("x_min"), F.max("y_raw").alias("y_max"), F.sum("z_raw").alias("z_sum")
    )
    new = params.select(
        "tile", *(F.round(f"{a}_scale", 9).alias(f"{a}_scale") for a in "xz"), *(F.round(f"{a}_offset", 4).alias(f"{a}_offset") for a in "xyz"),
        F.round("angle", 9).alias("angle")
    )
    return moved.join(new, "tile")


# --- virtual rasters ---

_ORDERS = """places AS (SELECT o_orderkey AS k, concat('tile', o_orderkey) AS tile, CAST(o_orderkey % 977 * 50 + 300 AS DOUBLE) AS x0, CAST(7000 - o_orderkey // 977 * 50 AS DOUBLE) AS y0
  FROM (SELECT DISTINCT o_orderkey FROM orders) WHERE o_orderkey % 5 <> 0)"""


def _places(spark, sf_dir):
    """Tiles of 25 by 25 cells of 2 m, one for each order, on a grid with gaps."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey").distinct().filter(k % 5 != 0)
    x0, y0 = (k % 977 * 50 + 300).cast("double"), (7000 - F.floor(k / 977) * 50).cast("double")
    return rows.select(
        F.concat(F.lit("tile"), k).alias("tile"), x0.alias("x0"), y0.alias("y0"), F.lit(2.0).alias("cell"), F.lit(25).alias("size_x"),
        F.lit(25).alias("size_y"), F.lit("EPSG:32610").alias("crs")
    )


@query(f"WITH {_ORDERS} SELECT tile, CAST(round((x0 - (SELECT min(x0) FROM places)) / 50) AS INT) AS tile_x, CAST(round(((SELECT max(y0) FROM places) - y0) / 50) AS INT) AS tile_y FROM places")
def vrt_grid(spark, sf_dir):
    return raster.tile_grid(_places(spark, sf_dir)).select("tile", "tile_x", "tile_y")


@query(f"WITH {_ORDERS} SELECT concat('cloud', k) AS cloud, tile FROM places")
def tiles_by_place(spark, sf_dir):
    """Clouds inside tiles, or as large, find these by their centres."""
    tiles = raster.tile_grid(_places(spark, sf_dir))
    inset = F.col("n") % 20
    clouds = _places(spark, sf_dir).withColumn("n", F.substring("tile", 5, 20).cast("long")).select(
        F.concat(F.lit("cloud"), "n").alias("cloud"), (F.col("x0") + inset).alias("xmin"), (F.col("x0") + 50).alias("xmax"), (F.col("y0") - 50).alias("ymin"), (F.col("y0") - inset).alias("ymax")
    )
    return raster.matching_tile(clouds, tiles).select("cloud", "tile")


@query(with_points(
    "SELECT cx, cy, CAST(dsm AS BIGINT) AS dsm, round(ground_mean, 6) AS ground_mean, round(z, 6) AS z, CAST(n_ground AS BIGINT) AS n_ground FROM surface FULL JOIN terrain USING (cx, cy)",
    f"{SURFACE}, {TERRAIN}"
))
def vrt_assemble(spark, sf_dir):
    """Bands of two rasters stacked, after their tile sets are found to agree."""
    p, g = binned(spark, sf_dir), grid(spark, sf_dir)
    tiles = spark.createDataFrame(
        [("whole", float(g.x0), float(g.y0), float(g.cell), g.size_x, g.size_y, "EPSG:32610")],
        "tile string, x0 double, y0 double, cell double, size_x int, size_y int, crs string"
    )
    return rounded(
        raster.stack_bands({"dsm": (agg.dsm(p), ["dsm", "ground_mean"]), "dtm": (agg.dtm(p), ["z", "n_ground"])}, {"dsm": tiles, "dtm": tiles}), *CELL
    )


# --- indices, types, names ---


@query("SELECT CAST(CASE WHEN l_partkey % 3 = 0 THEN 0 WHEN l_partkey % 3 = 1 THEN 39 ELSE l_suppkey % 40 END AS INT) AS cx, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY 1")
def interior_indices(spark, sf_dir):
    """Coordinates inside a grid of 40 cells, or off it by numerical error."""
    k = F.col("l_partkey") % 3
    at = F.when(k == 0, -0.000009 * 2.5).when(k == 1, (40 + 0.000009) * 2.5).otherwise((F.col("l_suppkey") % 40 + 0.5) * 2.5)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(interior_index(at, 2.5, 40).alias("cx")).groupBy("cx").agg(F.count("*").alias("n"))


_NARROW = {
    "uint8": (0, 254, 255), "int8": (-127, 127, -128), "uint16": (0, 65534, 65535), "int16": (-32767, 32767, -32768),
    "uint32": (0, 4294967294, 4294967295), "int32": (-2147483647, 2147483647, -2147483648)
}
_VALUE = "CASE WHEN l_linenumber = 4 THEN NULL ELSE (l_extendedprice - 20000) * CASE l_linenumber WHEN 1 THEN 0.003 WHEN 2 THEN 1 WHEN 3 THEN 100000 ELSE 0.5 END END"


@query("SELECT " + ", ".join(
    f"CAST(sum(CASE WHEN v IS NULL THEN {missing} ELSE least(greatest(v, {low}), {high}) END) AS BIGINT) AS {k}, CAST(count(v) AS BIGINT) AS {k}_known" for k,
    (low, high, missing) in _NARROW.items()
) + f" FROM (SELECT round_even(CAST({_VALUE} AS DECIMAL(38, 6)), 0) AS v FROM lineitem)")
def narrowed_bands(spark, sf_dir):
    """Doubles held to the ranges of integer types, with their values for missing data, and back."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr(_VALUE).cast("decimal(38,6)").alias("v"))
    narrow = rows.select(*(agg.saturating_cast(F.col("v"), k).alias(k) for k in _NARROW))
    return narrow.agg(*(c for k in _NARROW for c in (F.sum(k).cast("long").alias(k), F.count(agg.restore_missing(F.col(k), k)).alias(f"{k}_known"))))


@query("""SELECT doc_id, concat('tile', doc_id) AS name, concat('/data/a.b/tile', doc_id, ' registered.las') AS written, concat('/data/a.b/tile', doc_id, '.gpkg') AS layer, concat('/dtm/tile', doc_id, '.tif') AS raster FROM documents""")
def tile_names(spark, sf_dir):
    """File names of a cloud: its tile, where its registered copy and its layer go, and its terrain raster by name."""
    files = spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "doc_id", F.concat(F.lit("/data/a.b/tile"), F.col("doc_id").cast("string"), F.lit(".las")).alias("path")
    )
    rasters = files.select(F.concat(F.lit("/dtm/"), tile_name(F.col("path")), F.lit(".tif")).alias("path"))
    path = F.col("path")
    return paired_files(files, rasters).select(
        "doc_id", tile_name(path).alias("name"), append_to_name(path, " registered").alias("written"),
        replace_extension(path, ".gpkg").alias("layer"), "raster"
    )
