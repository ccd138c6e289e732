"""Operators on hand-made grids and points, file round trips, and the catalogue against DuckDB."""

import math
import sys
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratagrid import staging
from stratagrid.functions import points as fp
from stratagrid.model import GridSpec
from stratagrid.operators import aggregates, crowns, grid_metrics, lookup, maxima, ordering, raster, stencil, transform
from stratagrid.operators.binning import interior_index, with_cell
from stratagrid.plans import catalog, formats, placement, segmentation  # noqa: F401
from stratagrid.sources import documents, files, geotiff, las

sys.path.insert(0, str(Path(__file__).parent))
import plain  # noqa: E402

SF = "/root/testdata/sf0.001"


def cells(spark, rows, name="z"):
    return spark.createDataFrame([(x, y, None if v is None else float(v)) for y, r in enumerate(rows) for x, v in enumerate(r)], f"cx int, cy int, {name} double")


def grid(df, name, size):
    got = {(r.cx, r.cy): r[name] for r in df.collect()}
    return [[got.get((x, y)) for x in range(size)] for y in range(size)]


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_catalogue(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "documents", "supplier", "part", "customer"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = catalog.QUERIES[name](spark, SF), con.sql(catalog.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    at = [want.columns.index(c) for c in got.columns]
    order = lambda rows: sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))
    assert order(got.collect()) == order(tuple(r[i] for i in at) for r in want.fetchall())


def test_edges_of_the_grid(spark):
    rows = [(0, 4000), (4000, 0), (4001, 100), (100, -1), (3999, 1), (1000, 3000)]
    got = with_cell(spark.createDataFrame(rows, "x_raw int, y_raw int"), GridSpec(0, 4000, 1000, 4, 4)).collect()
    assert {(r.x_raw, r.y_raw): (r.cx, r.cy) for r in got} == {(0, 4000): (0, 0), (4000, 0): (3, 3), (3999, 1): (3, 3), (1000, 3000): (1, 1)}


def test_binomial_with_nulls(spark):
    got = grid(stencil.binomial(cells(spark, [[1, 2, 3], [4, None, 6], [7, 8, None]]), "z"), "cmm", 3)
    assert got[1][1] is None and got[2][2] is None
    assert got[0][0] == pytest.approx((4 * 1 + 2 * 2 + 2 * 4) / 8)


def test_mean_repeats_borders(spark):
    z = np.arange(9.0).reshape(3, 3)
    pad = np.pad(z, 1, mode="edge")
    want = [[pad[y : y + 3, x : x + 3].mean() for x in range(3)] for y in range(3)]
    assert np.allclose(grid(stencil.mean3(cells(spark, z.tolist()), "z", 3, 3), "z", 3), want)


def test_slope_of_a_plane_and_fallbacks(spark):
    plane = [[x + 0.0 * y for x in range(3)] for y in range(3)]
    got = stencil.slope_aspect(cells(spark, plane), "z", 1.0).filter("cx = 1 and cy = 1").first()
    assert got.slope == pytest.approx(45) and got.aspect == pytest.approx(270)
    plane[0][0] = None
    assert stencil.slope_aspect(cells(spark, plane), "z", 1.0).filter("cx = 1 and cy = 1").first().slope == pytest.approx(45)
    alone = stencil.slope_aspect(cells(spark, [[None, None, None], [None, 5, None], [None, None, None]]), "z", 1.0).filter("cx = 1 and cy = 1").first()
    assert alone is None or alone.slope is None


@pytest.mark.parametrize("directions, squared", [(8, False), (8, True), (4, False), (4, True)])
def test_fill_one_hole(spark, directions, squared):
    z = [[float(x + 7 * y) for x in range(7)] for y in range(7)]
    z[3][3] = None
    full = spark.createDataFrame([(x, y) for x in range(7) for y in range(7)], "cx int, cy int")
    got = grid(stencil.fill(cells(spark, z), full, "z", 3, directions, squared), "z", 7)
    assert got[3][3] == pytest.approx(24) and got[0][1] == 1
    again = stencil.fill_all(cells(spark, z), full, "z", 3, 4, directions, squared)
    assert again.count() == 49


def test_fill_in_passes(spark):
    z = [[float(x) if x in (0, 8) else None for x in range(9)] for y in range(3)]
    full = spark.createDataFrame([(x, y) for x in range(9) for y in range(3)], "cx int, cy int")
    assert stencil.fill(cells(spark, z), full, "z", 2, 4).count() == 18
    got = grid(stencil.fill_all(cells(spark, z), full, "z", 2, 5, 4), "z", 9)
    assert got[1][4] is not None and got[1][1] == 0 and got[1][7] == 8
    nothing = spark.createDataFrame([], "cx int, cy int, z double")
    assert stencil.fill_all(nothing, full, "z", 2, 5).count() == 0


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_rounds_cost_one_shuffle_each(spark):
    df = cells(spark, np.random.default_rng(1).normal(size=(8, 8)).tolist()).withColumn("measured", F.col("cx") % 3 == 0)
    counts = [exchanges(stencil.stencil(df, "measured", 8, 8, k)) for k in (1, 2, 4, 6)]
    assert [c - counts[0] for c in counts] == [0, 1, 3, 5] or counts == [1, 2, 4, 6]
    p = spark.createDataFrame([(0, 0, 1, 2, 1, 1, False)], "cx int, cy int, z_raw int, intensity int, return_number int, classification int, withheld boolean")
    assert exchanges(grid_metrics.grid_metrics(p)) == 1


def test_patch_and_peak(spark):
    z = [[1] * 5 for _ in range(5)]
    z[1][1] = z[1][2] = 9
    z[4][4] = 8
    df = cells(spark, z).withColumn("h", F.col("z"))
    single, level = maxima.treetops_by_radius(df, "z", "h", 1.0)
    assert [(r.cx, r.cy) for r in single.collect()] == [(4, 4)]
    patch = maxima.patches(level.filter("z = 9")).collect()
    assert [(p.x, p.y, p.cells) for p in patch] == [(2.0, 1.5, 2)]


def test_patches_along_diagonals_and_snakes(spark):
    diagonal = [(3, 0), (2, 1), (1, 2), (0, 3)]
    line = [(100 + i, 50) for i in range(150)]
    level = spark.createDataFrame([(x, y, 9.0) for x, y in diagonal + line], "cx int, cy int, z double")
    got = sorted((p.x, p.y, p.cells) for p in maxima.patches(level).collect())
    assert got == [(2.0, 2.0, 4), (175.0, 50.5, 150)]
    with pytest.raises(RuntimeError, match="settle"):
        maxima.patches(level, most_rounds=1)


def plateaus():
    """A hill with a level top of three cells, and a ring of eight around a cell without data."""
    z = [[30000.0 - 100 * abs(x - 4) - 100 * abs(y - 4) for x in range(20)] for y in range(9)]
    z[4][3] = z[4][4] = z[4][5] = 30500.0
    for x in range(11, 20):
        for y in range(9):
            z[y][x] = 29000.0 - 300 * max(abs(x - 16), abs(y - 4))
    ring = [(15, 3), (16, 3), (17, 3), (15, 4), (17, 4), (15, 5), (16, 5), (17, 5)]
    for x, y in ring:
        z[y][x] = 31000.0
    z[4][16] = None
    return z, ring


def test_patches_are_treetops_with_crowns(spark):
    z, ring = plateaus()
    high = cells(spark, z).filter("z is not null").withColumn("h", (F.col("z") - 20000) / 1000)
    got = {(p.cx, p.cy): p for p in maxima.treetop_patches(high, "z", "h", 1.0).collect()}
    assert {k: (p.x, p.y, p.z, p.cells, p.h) for k, p in got.items()} == {(3, 4): (4.5, 4.5, 30500.0, 3, 10.5), (15, 3): (16.5, 4.5, 31000.0, 8, 11.0)}
    assert got[3, 4].radius == 2.0 and got[15, 3].radius == pytest.approx(1 + math.sqrt(2), abs=1e-6)
    surface = high.select("cx", "cy", (F.col("z") / 1000).alias("dsm"), F.col("h").alias("chm"))
    tops = maxima.treetop_patches(high, "z", "h", 1.0).select((F.col("cy") * 40 + F.col("cx")).cast("long").alias("tree_id"), *(F.floor(c).cast("int").alias(f"c{c}") for c in "xy"), (F.col("z") / 1000).alias("z"), "h")
    own = crowns.crowns(surface, tops, 1.0)
    by = {(r.cx, r.cy): r.tree_id for r in own.collect()}
    assert all(by[x, 4] == 163 for x in (3, 4, 5)) and all(by[c] == 135 for c in ring)
    counted = {r.tree_id: r for r in crowns.crown_classes(own, tops, surface.select("cx", "cy", F.lit(0).alias("class"))).collect()}
    assert {163, 135} == set(counted) and counted[163].unclassified >= 3


@pytest.mark.parametrize("method", maxima.METHODS)
def test_treetops_as_a_layer(spark, method):
    if method == "DsmRing":  # equal cells with a lower one between them: a patch of this method alone
        z, want = [[45000.0 - 100 * y for x in range(9)] for y in range(9)], [(4.5, 4.5, 20.0, 30.0, 2)]
        z[4][3] = z[4][5] = 50000.0
    else:
        z, want = plateaus()[0], [(4.5, 4.5, 20.0, 10.5, 3), (16.5, 4.5, 20.0, 11.0, 8)]
    df = cells(spark, z, "dsm").withColumns({"dsm": F.col("dsm") / 1000, "chm": F.col("dsm") / 1000 - 20})
    got = maxima.find_treetops(df, method, GridSpec(0, 9000, 1000, 20, 9)).orderBy("tree_id").collect()
    tops = [(r.x, r.y, round(r.elevation, 6), round(r.height, 6), r.cells) for r in got if r.cells > 1]
    assert set(want) <= set(tops)
    assert [r.tree_id for r in got] == list(range(1, len(got) + 1))
    with pytest.raises(ValueError, match="no treetop method"):
        maxima.find_treetops(df, "Other", GridSpec(0, 9000, 1000, 20, 9))


def test_cost_fields_against_a_plain_version():
    rng = np.random.default_rng(1)
    dsm = rng.normal(30, 4, (90, 100))
    chm = dsm - rng.normal(15, 2, dsm.shape)
    dsm[rng.random(dsm.shape) < 0.05], chm[rng.random(dsm.shape) < 0.02] = np.nan, np.nan
    row, col = rng.integers(0, 90, 60), rng.integers(0, 100, 60)
    z = np.where(rng.random(60) < 0.3, 45.0, np.nan)
    h, rules = np.where(np.isnan(z), np.nan, 20.0), crowns.CrownRules()
    tree, r, c, cost = crowns.cost_fields(dsm, chm, row, col, 1.0, rules, z, h)
    wide = [np.pad(a, crowns.REACH, constant_values=np.nan) for a in (dsm, chm)]
    for k in range(60):
        a, b = (w[row[k] : row[k] + 63, col[k] : col[k] + 63] for w in wide)
        want = np.full((63, 63), np.inf)
        if not np.isnan(np.fmax(a[31, 31], z[k])) and not np.isnan(np.fmax(b[31, 31], h[k])):
            want = plain.cost_field(a, b, 1.0, rules, z[k], h[k])
        got, own = np.full((63, 63), np.inf), tree == k
        got[r[own] - row[k] + 31, c[own] - col[k] + 31] = cost[own]
        assert (np.isinf(got) == np.isinf(want)).all() and np.allclose(got[np.isfinite(got)], want[np.isfinite(want)])


def test_crowns_across_blocks(spark, monkeypatch):
    rng = np.random.default_rng(4)
    z = (30 + 3 * rng.normal(size=(40, 50))).round(2)
    df = cells(spark, z.tolist(), "dsm").withColumn("chm", F.col("dsm") - 12)
    tops = spark.createDataFrame([(k, int(x), int(y)) for k, (x, y) in enumerate({(int(a), int(b)) for a, b in zip(rng.integers(0, 50, 40), rng.integers(0, 40, 40))})], "tree_id long, cx int, cy int")
    whole = sorted(crowns.crowns(df, tops, 1.0).collect())
    monkeypatch.setattr(crowns, "BLOCK", 9)
    monkeypatch.setattr(crowns, "SIDE_BY_SIDE", 3)
    assert sorted(crowns.crowns(df, tops, 1.0).collect()) == whole
    classes = df.select("cx", "cy", (F.col("cx") % 11).alias("class"))
    own = crowns.crowns(df, tops, 1.0)
    parted = sorted(crowns.crown_classes(own, tops, classes).collect())
    monkeypatch.setattr(crowns, "BLOCK", 1000)
    assert sorted(crowns.crown_classes(own, tops, classes).collect()) == parted
    other = tops.limit(1).withColumn("tree_id", F.lit(999).cast("long"))
    with pytest.raises(Exception, match="not in its own crown"):
        crowns.crown_classes(own, other, classes).collect()


def test_rings():
    count = np.bincount([r for r, _, _ in maxima.ring_offsets()])[1:]
    assert count.tolist() == [8, 12, 16, 32, 28, 40, 40, 48, 68, 56]


@pytest.mark.parametrize("n", [1, 9, 10, 19, 20, 21])
def test_quantiles(spark, n):
    rows = [(0, 0, 10 * i, i, 1, 1, False) for i in range(n)]
    p = spark.createDataFrame(rows, "cx int, cy int, z_raw int, intensity int, return_number int, classification int, withheld boolean")
    got = grid_metrics.grid_metrics(p).first()
    for k in range(1, 20):
        at = max(int(k * n / 20 + 0.5) - 1, 0) if n < 20 else k * n // 20 - 1
        assert got[f"zq{5 * k:02d}"] == 10 * at


def test_crowns_of_two_peaks(spark):
    z = [[max(0.0, 10 - 3 * math.hypot(x - 2, y - 3), 8 - 3 * math.hypot(x - 7, y - 3)) + 2 for x in range(10)] for y in range(7)]
    df = cells(spark, z, "dsm").withColumn("chm", F.col("dsm"))
    tops = spark.createDataFrame([(1, 2, 3), (2, 7, 3)], "tree_id long, cx int, cy int")
    got = crowns.crowns(df, tops, 1.0)
    by = {(r.cx, r.cy): r.tree_id for r in got.collect()}
    assert by[2, 3] == 1 and by[7, 3] == 2 and by[1, 3] == 1 and by[8, 3] == 2
    classes = df.select("cx", "cy", F.lit(5).alias("class"))
    counts = {r.tree_id: r.conifer for r in crowns.crown_classes(got, tops, classes).collect()}
    assert counts[1] == sum(v == 1 for v in by.values())
    assert crowns.merge_treetops(spark.createDataFrame([(1,), (3,)], "tree_id long"), crowns.crown_classes(got, tops, classes)).filter("tree_id = 3").first().conifer == 0


def test_transforms(spark):
    p = spark.createDataFrame([("a", 10, 0, 5, 0, 0, 5), ("b", 0, 10, 5, 1, 1, 1)], "tile string, x_raw int, y_raw int, z_raw int, return_number int, number_of_returns int, classification int")
    params = spark.createDataFrame([("a", 0, 0, 1, math.pi / 2), ("b", 0, 0, -2, 0.0)], "tile string, tx int, ty int, tz int, angle double")
    got = {r.tile: r for r in transform.register(p, params, fix_classes=True).collect()}
    assert (got["a"].x_raw, got["a"].y_raw, got["a"].z_raw, got["a"].return_number, got["a"].classification) == (0, 10, 4, 1, 3)
    assert (got["b"].x_raw, got["b"].y_raw, got["b"].z_raw, got["b"].classification) == (0, 10, 7, 2)
    assert transform.linear_crs((0, 0), (0, 10)) == pytest.approx(0) and transform.linear_crs((0, 0), (10, 10)) == pytest.approx(-math.pi / 4)


def test_what_a_registration_asks_for(spark):
    here = transform.Anchor(x=1.0, y=2.0)
    for wrong, text in (
        (lambda: transform.Anchor(x=1.0, y=2.0, latitude=3.0, longitude=4.0).place(), "either"), (lambda: transform.Anchor(latitude=3.0, longitude=4.0).place(), "projection"),
        (lambda: transform.registration(spark, ["a", "b"], here, 1.0, 2.0), "not both"), (lambda: transform.registration(spark, ["a", "b"], here, nudge_x=[1.0, 2.0, 3.0]), "for 2 files"),
    ):
        with pytest.raises(ValueError, match=text):
            wrong()
    rows = transform.registration(spark, ["a", "b"], here, rotation=[90.0, 0.0], nudge_y=5.0, first_source_id=7).collect()
    assert [(r.tile, round(r.angle, 9), r.new_source_id, r.y_offset) for r in rows] == [("a", round(math.pi / 2, 9), 7, 7.0), ("b", 0.0, 8, 7.0)]


def test_kept_origin_and_input_scale(spark):
    heads = spark.createDataFrame([("a", *[0.01] * 3, *[5.0, 6.0, 7.0], *[0.0, 0.0, 0.0], *[10.0, 20.0, 30.0])], "tile string, " + ", ".join(f"{a}_{m} double" for m in ("scale", "offset", "min", "max") for a in "xyz"))
    kept = transform.crs_conversion(heads, lambda x, y, z: (x + 1, y, z), input_scale=2.0, maintain_origin=True).first()
    assert (kept.tx, kept.ty, kept.tz, kept.x_offset, kept.y_offset, kept.x_scale, kept.angle) == (0, 0, 0, 11.0, 12.0, 0.02, 0)


TILE = "tile string, x0 double, y0 double, cell double, size_x int, size_y int, crs string"


def test_virtual_raster_grids(spark):
    rows = [("a", 0.0, 100.0, 1.0, 50, 50, "x"), ("b", 50.0, 100.0, 1.0, 50, 50, "x"), ("c", 0.0, 50.0, 1.0, 50, 50, "x")]
    tiles = raster.tile_grid(spark.createDataFrame(rows, TILE))
    assert {(r.tile, r.tile_x, r.tile_y) for r in tiles.collect()} == {("a", 0, 0), ("b", 1, 0), ("c", 0, 1)}
    extent = lambda *e: spark.createDataFrame([e], "xmin double, xmax double, ymin double, ymax double")
    assert raster.matching_tile(extent(50.0, 100.0, 50.0, 100.0), tiles).first().tile == "b"
    for off in ((40.0, 60.0, 60.0, 90.0), (60.0, 70.0, 10.0, 20.0)):
        with pytest.raises(Exception, match="no tile holds"):
            raster.matching_tile(extent(*off), tiles).collect()
    with pytest.raises(ValueError, match="differ in system"):
        raster.tile_grid(spark.createDataFrame([*rows, ("d", 50.0, 50.0, 2.0, 25, 25, "x")], TILE))
    with pytest.raises(Exception, match="two tiles"):
        raster.tile_grid(spark.createDataFrame([*rows, ("d", 0.0, 50.0, 1.0, 50, 50, "x")], TILE)).collect()
    with pytest.raises(ValueError, match="at least one"):
        raster.tile_grid(spark.createDataFrame([], TILE))


@pytest.mark.parametrize("change, text", [(lambda r: (*r[:6], "y"), "is in x while"), (lambda r: (*r[:3], 2.0, *r[4:]), "differ in resolution"), (lambda r: (r[0], r[1] + 50, *r[2:]), "differ in extent")])
def test_alignment_of_tile_sets(spark, change, text):
    rows = [("a", 0.0, 100.0, 1.0, 50, 50, "x"), ("b", 50.0, 100.0, 1.0, 50, 50, "x")]
    one, other = spark.createDataFrame(rows, TILE), spark.createDataFrame([change(r) for r in rows], TILE)
    raster.check_alignment({"one": one, "again": one})
    cells_of = {k: (spark.createDataFrame([(0, 0, 1.0)], "cx int, cy int, z double"), ["z"]) for k in ("one", "other")}
    with pytest.raises(ValueError, match=text):
        raster.stack_bands(cells_of, {"one": one, "other": other})


def test_indices_off_the_grid(spark):
    got = lambda v: spark.range(1).select(interior_index(F.lit(v), 1.0, 4).alias("i")).first().i
    assert [got(v) for v in (-0.000009, 0.0, 1.0, 3.999, 4.0, 4.000009)] == [0, 0, 1, 3, 3, 3]
    for v in (-0.0001, 4.0001):
        with pytest.raises(Exception, match="off the grid"):
            got(v)


def test_file_pairs_and_names(spark):
    clouds = spark.createDataFrame([("/a/b.c/one.las",), ("/a/two.las",)], "path string")
    with pytest.raises(Exception, match="no file of the name"):
        files.paired_files(clouds, spark.createDataFrame([("/d/one.tif",)], "path string")).collect()
    names = clouds.select(files.append_to_name(F.col("path"), " $1x").alias("a"), files.replace_extension(F.col("path"), ".tif").alias("b")).collect()
    assert [tuple(r) for r in names] == [("/a/b.c/one $1x.las", "/a/b.c/one.tif"), ("/a/two $1x.las", "/a/two.tif")]


@pytest.mark.parametrize("kind", ["uint8", "int16", "float32", "float64"])
def test_geotiff_files(kind):
    rng = np.random.default_rng(2)
    bands = {n: (rng.random((7, 9)) * 100).astype(kind) for n in ("z", "n & more")}
    raw = geotiff.encode(geotiff.Raster(bands, 600000.5, 4900000.25, 0.5, 32610, geotiff.default_no_data(kind)))
    got = geotiff.decode(raw)
    assert (got.x0, got.y0, got.cell, got.epsg) == (600000.5, 4900000.25, 0.5, 32610) and list(got.bands) == list(bands)
    assert all((got.bands[k] == v).all() and got.bands[k].dtype == v.dtype for k, v in bands.items())
    with pytest.raises(ValueError, match="not a TIFF"):
        geotiff.decode(b"xx" + raw)


def test_geotiff_of_others():
    """Big endian, interleaved, several plain strips."""
    import struct

    z = np.arange(24, dtype=">u2").reshape(4, 3, 2)
    entries = [(256, 3, 1, 3 << 16), (257, 3, 1, 4 << 16), (258, 3, 2, 16 << 16 | 16), (273, 4, 2, 200), (277, 3, 1, 2 << 16), (278, 3, 1, 2 << 16), (279, 4, 2, 208)]
    raw = b"MM" + struct.pack(">HIH", 42, 8, len(entries)) + b"".join(struct.pack(">HHII", *e) for e in entries) + struct.pack(">I", 0)
    raw = raw.ljust(200, b"\0") + struct.pack(">4I", 216, 240, 24, 24) + z.tobytes()
    got = geotiff.decode(raw)
    assert list(got.bands) == ["band1", "band2"] and (got.bands["band2"] == z[:, :, 1]).all()


def test_packing_and_flags(spark):
    df = spark.range(1).select(fp.pack_cell(F.lit(-3), F.lit(-7)).alias("k"))
    assert df.select(*fp.unpack_cell(F.col("k"))).first() == (-3, -7)
    flags = fp.class_flags(F.lit(0b10001100), True)
    got = spark.range(1).select(*(v.alias(k) for k, v in flags.items())).first()
    assert got.withheld and got.overlap and got.edge and not got.synthetic and not got.scan_direction


def test_duplicate_tile_is_an_error(spark):
    a = spark.createDataFrame([("a", 0, 0, 1)], "tile string, tile_x int, tile_y int, v int")
    b = spark.createDataFrame([("b", 0, 0, 1)], a.schema)
    with pytest.raises(Exception, match="two tiles"):
        raster.assemble([a, b]).collect()
    assert raster.assemble([a]).count() == 1


def test_statistics_merge_whatever_the_tiles(spark):
    df = cells(spark, np.random.default_rng(1).normal(size=(8, 8)).tolist())
    whole = aggregates.band_statistics(df, "z", []).first()
    for k in (2, 3):
        parts = aggregates.band_statistics(df.withColumn("tile", raster.tile_of(k)), "z", ["tile"])
        got = aggregates.merge_statistics(parts, []).first()
        assert got.cells == 64 and got.mean == pytest.approx(whole.mean) and got.sd == pytest.approx(whole.sd)


def test_las_round_trip(spark, tmp_path):
    rng = np.random.default_rng(0)
    n = 500
    pdf = pd.DataFrame({"x_raw": rng.integers(-10**6, 10**6, n), "y_raw": rng.integers(0, 10**6, n), "z_raw": rng.integers(0, 9**5, n), "intensity": rng.integers(0, 65536, n), "return_number": rng.integers(0, 6, n), "number_of_returns": rng.integers(0, 6, n), "classification": rng.integers(0, 23, n), "withheld": rng.random(n) < 0.1, "overlap": rng.random(n) < 0.1, "edge": rng.random(n) < 0.1, "scan_angle_raw": rng.integers(-9000, 9000, n), "source_id": rng.integers(0, 65536, n), "gps_time": rng.random(n)})
    (tmp_path / "one.las").write_bytes(las.encode_file(pdf, wkt='PROJCS["x"]', day=(60, 2024)))
    got = las.read_points(spark, str(tmp_path)).orderBy("seq").toPandas()
    for c in pdf:
        assert (got[c].to_numpy() == pdf[c].to_numpy()).all(), c
    head = las.read_headers(spark, str(tmp_path)).first()
    assert (head.version, head.format, head.points, head.wkt, str(head.created)) == ("1.4", 6, n, 'PROJCS["x"]', "2024-02-29")
    assert files.list_files(spark, str(tmp_path)).count() == 1


def some_points(n=700):
    rng = np.random.default_rng(5)
    return pd.DataFrame({
        "tile": rng.choice(["a", "b"], n), "seq": np.arange(n), "x_raw": rng.integers(-10**6, 10**6, n), "y_raw": rng.integers(0, 10**6, n), "z_raw": rng.integers(0, 9**5, n), "intensity": rng.integers(0, 65536, n),
        "return_number": rng.integers(1, 8, n), "number_of_returns": rng.integers(1, 8, n), "classification": rng.integers(0, 23, n), "withheld": rng.random(n) < 0.1, "synthetic": rng.random(n) < 0.1, "key_point": rng.random(n) < 0.1,
        "overlap": rng.random(n) < 0.1, "edge": rng.random(n) < 0.1, "scan_direction": rng.random(n) < 0.5, "scan_angle_raw": rng.integers(-9000, 9000, n), "source_id": rng.integers(0, 65536, n), "gps_time": rng.random(n),
        **{c: rng.integers(0, 65536, n) for c in ("red", "green", "blue", "nir")},
    })


@pytest.mark.parametrize("form", range(11))
def test_las_formats(spark, tmp_path, form):
    pdf = some_points()
    out = las.write_points(spark.createDataFrame(pdf).repartition(5), str(tmp_path / "out"), form, (0.01, 0.01, 0.001), (5.0, 6.0, 7.0), 'PROJCS["y"]', (61, 2023), [("me", 7, b"seven")], [("far", 8, b"x" * 70000)])
    assert sorted((r.tile, r.points) for r in out.collect()) == sorted(pdf.groupby("tile").size().items())
    head = {r.path[-5]: r for r in las.read_headers(spark, str(tmp_path / "out")).collect()}
    for tile, own in pdf.groupby("tile"):
        h = head[tile]
        assert (h.format, h.points, h.record_length, h.wkt, str(h.created)) == (form, len(own), las.RECORD_LENGTH[form], 'PROJCS["y"]', "2023-03-02")
        assert [(v.user_id, v.record_id, len(v.payload)) for v in h.vlrs] == [("LASF_Projection", 2112, 12), ("me", 7, 5), ("far", 8, 70000)]
        assert h.by_return[:7] == np.bincount(own.return_number, minlength=8)[1:8].tolist() and h.x_max == pytest.approx(own.x_raw.max() * 0.01 + 5)
    got = las.read_points(spark, str(tmp_path / "out"), split_points=97).orderBy("tile", "seq").toPandas()
    want = pdf.sort_values(["tile", "seq"]).reset_index(drop=True)
    lost = {"seq", "scan_angle_raw", "overlap"} if form < 6 else {"seq"}
    lost |= set() if form in las._TIME_AT else {"gps_time"}
    lost |= set() if form in las._COLOUR_AT else {"red", "green", "blue"}
    lost |= set() if form in las._NIR_AT else {"nir"}
    for c in set(pdf.columns) - lost:
        assert (got[c].to_numpy() == want[c].to_numpy()).all(), c
    for c in lost & {"gps_time", "red", "nir"}:
        assert got[c].isna().all()
    if form < 6:
        assert np.abs(got.scan_angle_raw.to_numpy() - want.scan_angle_raw.to_numpy()).max() <= 84


def test_a_file_of_three_gigabytes(spark, tmp_path):
    """Header and last record of a sparse file; nothing else of it is read."""
    n, tail = 100_000_000, some_points(3)
    head = las.encode_header(n, [n] + [0] * 14, [(0.0, 1.0)] * 3, 6, (0.001,) * 3, (0.0,) * 3, b"", 0, 0, (1, 2024))
    with open(tmp_path / "BIG.LAS", "wb") as f:
        f.write(head)
        f.seek(len(head) + (n - 3) * 30)
        f.write(las.encode_points(tail, 6))
    got = las.read_headers(spark, str(tmp_path)).first()
    assert got.points == n and (tmp_path / "BIG.LAS").stat().st_size > 2.9e9
    with las.RangeReader(f"file:{tmp_path}/BIG.LAS") as file:
        last = las.decode_points(file.read(got.points_at + (n - 3) * 30, 90), 6, 30)
    assert last["x_raw"].tolist() == tail.x_raw.tolist() and last["source_id"].tolist() == tail.source_id.tolist()
    assert las.read_points(spark, str(tmp_path)).rdd.getNumPartitions() == -(-n // las.SPLIT_POINTS)


def test_changed_headers(spark, tmp_path):
    import datetime

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.laS").write_bytes(las.encode_file(some_points(50)))
    las.rewrite_headers(spark, str(tmp_path / "in"), str(tmp_path / "out"), datetime.date(2020, 12, 31), (1.0, 2.0, 3.0)).collect()
    old, new = (las.read_headers(spark, str(tmp_path / k)) for k in ("in", "out"))
    drop = ["path"]
    assert las.set_header(old, datetime.date(2020, 12, 31), (1.0, 2.0, 3.0)).drop(*drop).collect() == new.drop(*drop).collect()
    assert las.created_on(2023, 400) == datetime.date(2023, 12, 31) and las.created_on(0, 5) is None and las.created_on(2024, 0) is None
    short = las.encode_file(some_points(50))[:-10]
    (tmp_path / "in" / "a.laS").write_bytes(short)
    with pytest.raises(Exception, match="ends before its last point"):
        las.read_points(spark, str(tmp_path / "in")).count()


def test_vrt_round_trip():
    doc = {"size_x": 4, "size_y": 3, "srs": "EPSG:32610", "transform": [0.0, 1.0, 0.0, 9.0, 0.0, -1.0], "bands": [{"name": n, "type": "Float32", "no_data": "nan", "colour": "Gray", "block": ("2", "2"), "sources": [{"kind": "ComplexSource", "file": f"{n}.tif", "band": 1, "dst_xOff": 0.0}]} for n in ("dsm", "cmm3")]}
    again = documents.read_vrt(documents.write_vrt(doc))
    assert again == doc
    assert [b["name"] for b in documents.keep_bands(again, ["cmm3"])["bands"]] == ["cmm3"]
    assert 'blockXSize' not in documents.write_vrt(documents.drop_block_size(doc))


def test_disk_benchmark(spark, tmp_path):
    thread = "<Thread><Id>{}</Id><Target><Path>x</Path><BytesCount>{}</BytesCount><IOCount>5</IOCount><ReadBytes>{}</ReadBytes><WriteBytes>0</WriteBytes></Target></Thread>"
    body = "".join(thread.format(k, 1048576 * 30 * k, 1048576 * 30 * k) for k in (1, 2))
    (tmp_path / "r.xml").write_text(f"<Results><System><ComputerName>c</ComputerName></System><TimeSpan><TestTimeSeconds>30.0</TestTimeSeconds>{body}</TimeSpan></Results>")
    got = documents.read_disk_benchmarks(spark, str(tmp_path)).orderBy("thread").collect()
    assert [r.mb_per_s for r in got] == [1.0, 2.0]


def test_raster_sink(spark, tmp_path):
    df = cells(spark, [[1, None], [float("nan"), -9999]]).withColumn("tile", F.lit("a"))
    documents.write_raster(df, str(tmp_path / "out"))
    got = documents.read_raster(spark, str(tmp_path / "out"), no_data=-9999.0)
    assert sorted((r.cx, r.cy) for r in got.filter("z is null").collect()) == [(0, 1), (1, 0), (1, 1)]


def test_streaming_terrain(spark, tmp_path):
    from stratagrid.model import POINTS
    from stratagrid.streaming import tiles

    rows = spark.createDataFrame([("a", 0, 500, 500, 100), ("a", 1, 600, 500, 300)], "tile string, seq long, x_raw int, y_raw int, z_raw int")
    rows = rows.withColumn("classification", F.lit(2)).withColumn("withheld", F.lit(False))
    full = rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in POINTS))
    full.write.parquet(str(tmp_path / "in"))
    q = tiles.start(tiles.running_terrain(tiles.arriving_points(spark, str(tmp_path / "in")), GridSpec(0, 1000, 1000, 1, 1)), "terrain", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert spark.table("terrain").first().z == 200


def test_lookup_without_terrain_changes_nothing(spark):
    p = spark.createDataFrame([(0, 0, 10**6, 1, False)], "cx int, cy int, z_raw int, classification int, withheld boolean")
    none = spark.createDataFrame([], "cx int, cy int, z double")
    assert lookup.repair_noise(p, none, -1, 1).first().classification == 1


def test_entry_without_the_llm_folders(tmp_path):
    import shutil
    import subprocess
    import sys

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "stratagrid", tmp_path / "stratagrid", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and out.stdout.split()[0] == str(len(catalog.QUERIES)), out.stderr


def test_first_read_point_wins_ties(spark):
    rows = [(0, 0, 9, 1, 5, 7, 2), (0, 0, 9, 1, 4, 3, 1), (0, 0, 8, 1, 1, 1, 0)]
    p = spark.createDataFrame([(*r, 1, 1, 0, 0, False) for r in rows], "cx int, cy int, z_raw int, classification int, source_id int, return_number int, seq long, intensity int, x_raw int, y_raw int, k int, withheld boolean")
    assert aggregates.dsm(p, seq="seq").first().source_id == 4 and aggregates.dsm(p.withColumn("seq", -F.col("seq")), seq="seq").first().source_id == 5
    got = aggregates.dsm(p, gap=1).first()
    assert (got.dsm, got.subsurface, got.source_id) == (9, 8, 4) and aggregates.dsm(p, gap=2).first().subsurface is None


def test_histogram_has_a_limit(spark):
    df = spark.createDataFrame([(1.0,), (None,), (99.0,)], "v double")
    assert {(r.bin, r.n) for r in aggregates.histogram(df, "v", 0.0, 1.0, 5).collect()} == {(1, 1), (-1, 1)}
    for bins in (0, 1_000_001):
        with pytest.raises(ValueError, match="bins"):
            aggregates.histogram(df, "v", 0.0, 1.0, bins)


def test_saturating_casts(spark):
    df = spark.createDataFrame([(v,) for v in (-1e9, -0.5, 0.5, 1.5, 254.6, 1e9, None)], "v double")
    got = [int(r.x) for r in df.select(aggregates.saturating_cast(F.col("v"), "uint8").alias("x")).collect()]
    assert got == [0, 0, 0, 2, 254, 254, 255]
    back = [r.x for r in df.select(aggregates.restore_missing(aggregates.saturating_cast(F.col("v"), "int8"), "int8").alias("x")).collect()]
    assert back[-1] is None and [int(x) for x in back[:-1]] == [-127, 0, 0, 2, 127, 127]


def test_running_sums(spark):
    rng = np.random.default_rng(6)
    rows = [(int(k), int(v)) for k, v in zip(rng.integers(0, 40, 500), rng.integers(-9, 9, 500))] + [(None, 3)]
    df = spark.createDataFrame(rows, "k int, v int").repartition(7)
    got = ordering.running(df, [F.col("k"), F.col("v")], {"i": F.lit(1), "total": F.col("v")}).orderBy("i").collect()
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [(r.k, r.v) for r in got] == order and [r.i for r in got] == list(range(1, 502))
    assert [r.total for r in got] == np.cumsum([v for _, v in order]).tolist()
    assert ordering.running(df.limit(0), [F.col("k")], {"i": F.lit(1)}).count() == 0


def test_staging_needs_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()
        sparkContext = type("C", (), {"master": "spark://host:7077", "applicationId": "x"})()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())


def test_staged_tables_are_removed(spark):
    first = staging.stage(spark.range(5), "first")
    path = staging._PATHS[first]
    second = staging.stage(first.filter("id > 1"), "second", over=first)
    assert second.count() == 3 and not Path(path).exists() and Path(staging._PATHS[second]).exists()
    staging.discard(second, spark.range(3))
