"""Queries that write the fixture's tables as files of a format and read them back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratagrid.operators import aggregates as agg
from stratagrid.plans.catalog import CELL, SURFACE, TERRAIN, query, rounded, with_points
from stratagrid.plans.fixtures import binned, grid, points
from stratagrid.sources import documents, files, geopackage, geotiff, las
from stratagrid.staging import new_path

# --- point clouds ---

_WKT = 'PROJCS["WGS 84 / UTM zone 10N"]'
_OFFSET = (600000.0, 4900000.0, 100.0)


def _clouds(spark, sf_dir) -> str:
    """A folder of one file for each tile: colours, a record before the points and one behind them."""
    folder = new_path(spark, "las")
    las.write_points(
        points(spark, sf_dir), folder, 7, (0.001,) * 3, _OFFSET, _WKT, (61, 2024), [("stratagrid", 7, b"seven")], [("stratagrid", 70, b"x" * 70000)]
    ).write.format("noop").mode("overwrite").save()
    return folder


_AXES = ", ".join(f"round({f}({c}_raw) * 0.001::DOUBLE + {o}, 6) AS {c}_{f}" for c, o in zip("xyz", _OFFSET, strict=True) for f in ("min", "max"))


@query(with_points(f"""SELECT tile, '1.4' AS version, CAST(7 AS INT) AS format, CAST(36 AS INT) AS record_length, CAST(count(*) AS BIGINT) AS points, CAST(3 AS INT) AS records, DATE '2024-03-01' AS created,
  '{_WKT}' AS wkt, {_AXES} FROM p GROUP BY tile"""))
def las_info(spark, sf_dir):
    info = las.cloud_info(las.read_headers(spark, _clouds(spark, sf_dir)))
    return info.select(
        "tile", "version", "format", "record_length", "points", "records", "created", "wkt",
        *(F.round(f"{a}_{m}", 6).alias(f"{a}_{m}") for a in "xyz" for m in ("min", "max"))
    )


_RECORDS = [("LASF_Projection", 2112, len(_WKT) + 1), ("stratagrid", 7, 5), ("stratagrid", 70, 70000)]


@query(with_points("SELECT DISTINCT tile, user_id, CAST(record_id AS INT) AS record_id, CAST(size AS BIGINT) AS size FROM p, (VALUES " + ", ".join(f"('{u}', {r}, {n})" for u, r, n in _RECORDS) + ") v(user_id, record_id, size)"))
def las_records(spark, sf_dir):
    """Variable length records before the points and behind them."""
    heads = las.read_headers(spark, _clouds(spark, sf_dir))
    each = heads.select(files.tile_name(F.col("path")).alias("tile"), F.explode("vlrs").alias("v"))
    return each.select("tile", "v.user_id", "v.record_id", F.length("v.payload").cast("long").alias("size"))


_SUMMED = ("x_raw", "y_raw", "z_raw", "intensity", "number_of_returns", "scan_angle_raw", "gps_time", "source_id", "red", "green", "blue")
_MARKED = ("withheld", "edge", "overlap", "scan_direction")


@query(with_points("SELECT tile, classification, return_number, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in _SUMMED) + ", " + ", ".join(f"CAST(count(*) FILTER (WHERE {c}) AS BIGINT) AS {c}" for c in _MARKED)
    + ", CAST(sum((x_raw::BIGINT * 7 + y_raw * 13 + z_raw * 31 + intensity) % 1000003 * (source_id + red)) AS BIGINT) AS mixed FROM p GROUP BY tile, classification, return_number"))
def las_points(spark, sf_dir):
    """All points read back by splits; ``mixed`` ties the columns of a point together."""
    side = grid(spark, sf_dir).size_x
    got = las.read_points(spark, _clouds(spark, sf_dir), split_points=side * side)
    mixed = (F.col("x_raw").cast("long") * 7 + F.col("y_raw") * 13 + F.col("z_raw") * 31 + F.col("intensity")) % 1000003 * (F.col("source_id") + F.col("red"))
    sums = [F.sum(F.col(c).cast("long")).alias(c) for c in _SUMMED]
    return got.groupBy("tile", "classification", "return_number").agg(
        F.count("*").alias("n"), *sums, *(F.count_if(c).alias(c) for c in _MARKED), F.sum(mixed).alias("mixed")
    )


@query(with_points("SELECT tile, DATE '2020-12-31' AS created, 1::DOUBLE AS x_offset, 2::DOUBLE AS y_offset, round(max(x_raw) * 0.001::DOUBLE + 1, 6) AS x_max, round(min(y_raw) * 0.001::DOUBLE + 2, 6) AS y_min, CAST(count(*) AS BIGINT) AS points FROM p GROUP BY tile"))
def las_set_headers(spark, sf_dir):
    """Files whose date and offsets were overwritten."""
    folder = new_path(spark, "las")
    las.rewrite_headers(
        spark, _clouds(spark, sf_dir), folder, datetime.date(2020, 12, 31), (1.0, 2.0, 3.0)
    ).write.format("noop").mode("overwrite").save()
    got = las.read_headers(spark, folder)
    return got.select(
        files.tile_name(F.col("path")).alias("tile"), "created", "x_offset", "y_offset", F.round("x_max", 6).alias("x_max"),
        F.round("y_min", 6).alias("y_min"), "points"
    )


@query(with_points(f"SELECT tile, CAST(375 + 54 * 2 + {len(_WKT) + 1 + 5} + count(*) * 36 + 60 + 70000 AS BIGINT) AS length FROM p GROUP BY tile"))
def file_list(spark, sf_dir):
    return files.list_files(spark, _clouds(spark, sf_dir), "*.las").select(files.tile_name(F.col("path")).alias("tile"), "length")


@query(with_points(f"""SELECT tile, '{_WKT}' AS crs, format('POLYGON (({{:.3f}} {{:.3f}}, {{:.3f}} {{:.3f}}, {{:.3f}} {{:.3f}}, {{:.3f}} {{:.3f}}, {{:.3f}} {{:.3f}}))', x0, y0, x0, y1, x1, y1, x1, y0, x0, y0) AS polygon FROM (
  SELECT tile, min(x_raw) * 0.001::DOUBLE + 600000 AS x0, max(x_raw) * 0.001::DOUBLE + 600000 AS x1, min(y_raw) * 0.001::DOUBLE + 4900000 AS y0, max(y_raw) * 0.001::DOUBLE + 4900000 AS y1 FROM p GROUP BY tile)"""))
def bounding_polygons(spark, sf_dir):
    info = las.cloud_info(las.read_headers(spark, _clouds(spark, sf_dir)))
    return files.bounding_polygons(info)


# --- rasters and layers ---

_TILED = "concat('r', cy // 16, 'c', cx // 16) AS tile"


@query(with_points(
    f"SELECT {_TILED}, cx, cy, CAST(dsm AS DOUBLE) AS dsm, round(z, 6) AS z FROM surface LEFT JOIN (SELECT * FROM terrain WHERE (cx + cy) % 3 <> 0) USING (cx, cy) WHERE dsm IS NOT NULL OR z IS NOT NULL",
    f"{SURFACE}, {TERRAIN}"
))
def geotiff_tiles(spark, sf_dir):
    """Two bands written as files of 16 by 16 cells and read back; missing cells come back as nulls."""
    p, folder = binned(spark, sf_dir), new_path(spark, "geotiff")
    cells = agg.dsm(p).select(*CELL, F.col("dsm").cast("double").alias("dsm")).join(
        agg.dtm(p).filter("(cx + cy) % 3 <> 0").select(*CELL, "z"), list(CELL), "left"
    )
    geotiff.write_tiles(cells, folder, grid(spark, sf_dir), ["dsm", "z"], 16, "float64", 32610).write.format("noop").mode("overwrite").save()
    return rounded(geotiff.read_tiles(spark, folder, ["dsm", "z"], grid(spark, sf_dir)), *CELL)


@query(with_points(f"SELECT {_TILED}, cx, cy, CAST(count(*) AS DOUBLE) AS n FROM p GROUP BY cx, cy"))
def geotiff_counts(spark, sf_dir):
    """A band of counts in the smallest type that holds it."""
    counts, folder = binned(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n")), new_path(spark, "geotiff")
    kind = agg.smallest_integer_type(counts, "n").first().type
    geotiff.write_tiles(counts, folder, grid(spark, sf_dir), ["n"], 16, kind).write.format("noop").mode("overwrite").save()
    return geotiff.read_tiles(spark, folder, ["n"], grid(spark, sf_dir))


@query(with_points(f"SELECT {_TILED}, cx, cy, CAST(dsm AS BIGINT) AS dsm, round(ground_mean, 6) AS ground_mean FROM surface", SURFACE))
def raster_tables(spark, sf_dir):
    """A raster written as two band groups by tile, and read back."""
    path = new_path(spark, "raster")
    tile = F.concat(F.lit("r"), F.floor(F.col("cy") / 16), F.lit("c"), F.floor(F.col("cx") / 16)).alias("tile")
    documents.write_raster(
        agg.dsm(binned(spark, sf_dir)).select(tile, *CELL, "dsm", "ground_mean"), path, {"surface": ["dsm"], "diagnostics": ["ground_mean"]}
    )
    both = documents.read_raster(spark, path, "surface").join(documents.read_raster(spark, path, "diagnostics"), ["tile", *CELL])
    return rounded(both, *CELL)


_FEATURES = """SELECT concat('t', l_suppkey % 8) AS tile, CAST(l_suppkey AS BIGINT) AS tree_id, CAST(any_value(l_suppkey) * 0.5 AS DOUBLE) AS x, CAST(any_value(l_suppkey) * -0.25 AS DOUBLE) AS y,
  CASE WHEN l_suppkey % 5 <> 0 THEN max(l_extendedprice) END AS height, concat('tree ', l_suppkey) AS note FROM lineitem GROUP BY l_suppkey"""


def _layers(spark, sf_dir) -> str:
    k, folder = F.col("l_suppkey"), new_path(spark, "geopackage")
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_suppkey").agg(F.max("l_extendedprice").alias("top"))
    layer = rows.select(
        F.concat(F.lit("t"), k % 8).alias("tile"), (k * 0.5).cast("double").alias("x"), (k * -0.25).cast("double").alias("y"), k.alias("tree_id"),
        F.when(k % 5 != 0, F.col("top")).alias("height"), F.concat(F.lit("tree "), k).alias("note")
    )
    geopackage.write_layers(layer, folder, "treetops", 32610).write.format("noop").mode("overwrite").save()
    return folder


@query(_FEATURES)
def geopackage_layers(spark, sf_dir):
    """Points with their fields written as a layer of one file for each tile, and read back."""
    fields = T.StructType([T.StructField("tree_id", T.LongType()), T.StructField("height", T.DoubleType()), T.StructField("note", T.StringType())])
    return geopackage.read_layers(spark, _layers(spark, sf_dir), "treetops", fields)


@query(f"SELECT concat(tile, '.gpkg') AS file, 'treetops' AS layer, CAST(count(*) AS BIGINT) AS features FROM ({_FEATURES}) GROUP BY tile")
def geopackage_counts(spark, sf_dir):
    return geopackage.layer_counts(spark, _layers(spark, sf_dir))


# --- documents ---


@query(with_points("""SELECT b.band, b.type, CASE b.band WHEN 'dsm' THEN 'Gray' ELSE 'Red' END AS colour, t.tile, CAST(tx * 16 AS DOUBLE) AS x, CAST(ty * 16 AS DOUBLE) AS y, CAST(NULL AS VARCHAR) AS block
  FROM (SELECT DISTINCT concat('r', cy // 16, 'c', cx // 16) AS tile, cx // 16 AS tx, cy // 16 AS ty FROM p) t, (VALUES ('dsm', 'Float32'), ('red', 'UInt16')) b(band, type)"""))
def vrt_document(spark, sf_dir):
    """A virtual raster of all tiles and three bands as a document, read back without one band and without block sizes."""
    tiles = binned(spark, sf_dir).select(*(F.floor(F.col(c) / 16).cast("int").alias(f"t{c[1]}") for c in CELL)).distinct().collect()
    sources = lambda name: [{
        "kind": "ComplexSource", "file": f"{name}/r{t.ty}c{t.tx}.tif", "band": 1, "dst_xOff": t.tx * 16.0, "dst_yOff": t.ty * 16.0, "dst_xSize": 16.0,
        "dst_ySize": 16.0
    } for t in sorted(tiles)]
    kinds = (("dsm", "Float32", "Gray"), ("cmm3", "Float32", "Gray"), ("red", "UInt16", "Red"))
    side = grid(spark, sf_dir).size_x
    doc = {
        "size_x": side, "size_y": side, "srs": "EPSG:32610", "transform": [0.0, 1.0, 0.0, float(side), 0.0, -1.0],
        "bands": [{"name": n, "type": t, "no_data": "nan", "colour": c, "block": ("16", "16"), "sources": sources(n)} for n, t, c in kinds]
    }
    again = documents.read_vrt(documents.write_vrt(documents.drop_block_size(documents.keep_bands(
        documents.read_vrt(documents.write_vrt(doc)), ["dsm", "red"]
    ))))
    rows = [(
        b["name"], b["type"], b["colour"], s["file"].split("/")[1].split(".")[0], s["dst_xOff"], s["dst_yOff"], b["block"][0]
    ) for b in again["bands"] for s in b["sources"]]
    return spark.createDataFrame(rows, "band string, type string, colour string, tile string, x double, y double, block string")


@query("""SELECT concat('host', s_nationkey) AS computer, CAST(s_suppkey AS INT) AS thread, CAST(s_suppkey * 1048576 AS BIGINT) AS bytes, round(s_suppkey * 1048576::DOUBLE / (20.0::DOUBLE * 1048576), 6) AS mb_per_s,
  round(s_suppkey * 0.5::DOUBLE * 1000, 6) AS read_latency_us FROM supplier""")
def disk_benchmarks(spark, sf_dir):
    """Benchmark documents, one for each nation with a thread for each supplier, as rows."""
    k = F.col("s_suppkey").cast("string")
    target = [
        "<Target><Path>x</Path><BytesCount>", (F.col("s_suppkey") * 1048576).cast("string"),
        "</BytesCount><IOCount>5</IOCount><AverageReadLatencyMilliseconds>", (F.col("s_suppkey") * 0.5).cast("string"),
        "</AverageReadLatencyMilliseconds></Target>"
    ]
    thread = F.concat(F.lit("<Thread><Id>"), k, F.lit("</Id>"), *(F.lit(x) if isinstance(x, str) else x for x in target), F.lit("</Thread>"))
    host = F.concat(
        F.lit("<Results><System><ComputerName>host"), F.col("s_nationkey"),
        F.lit("</ComputerName></System><TimeSpan><TestTimeSeconds>20.0</TestTimeSeconds>"), F.concat_ws("", F.collect_list(thread)),
        F.lit("</TimeSpan></Results>")
    )
    path = new_path(spark, "benchmarks")
    spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy("s_nationkey").agg(host.alias("value")).select("value").write.option("maxRecordsPerFile", 1).text(path)
    got = documents.read_disk_benchmarks(spark, path)
    return got.select("computer", "thread", "bytes", F.round("mb_per_s", 6).alias("mb_per_s"), F.round("read_latency_us", 6).alias("read_latency_us"))
