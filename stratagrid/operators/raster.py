"""Assembly of tiles and bands, sampling, tile tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.operators.ordering import running

CELL = ["cx", "cy"]


def assemble(tiles: list[DataFrame], by: tuple[str, str] = ("tile_x", "tile_y")) -> DataFrame:
    """Tiles to one virtual raster. A tile position that two tiles claim is an error when the result is computed."""
    out = reduce(lambda a, b: a.unionByName(b), tiles)
    claims = out.groupBy(*by).agg(F.count_distinct("tile").alias("k"))
    bad = F.assert_true(F.col("k") == 1, F.concat(F.lit("two tiles at "), F.concat_ws(",", *by)))
    return out.join(claims.withColumn("ok", bad), list(by)).filter("ok is null").drop("k", "ok")


def tile_grid(tiles: DataFrame) -> DataFrame:
    """Adds ``tile_x, tile_y`` to tiles ``tile, x0, y0, cell, size_x, size_y, crs``: columns eastwards, rows southwards from the north-west origin.

    Tiles of a virtual raster agree in system, cell size and number of cells; others, and two tiles at one place, are errors.
    """
    shapes = tiles.select("crs", "cell", "size_x", "size_y").distinct().limit(2).collect()
    if len(shapes) != 1:
        raise ValueError(f"tiles differ in system, cell or size: {[tuple(s) for s in shapes]}" if shapes else "a virtual raster has at least one tile")
    west, north = tiles.agg(F.min("x0"), F.max("y0")).first()
    wide, high = shapes[0].cell * shapes[0].size_x, shapes[0].cell * shapes[0].size_y
    placed = tiles.withColumns({
        "tile_x": F.bround((F.col("x0") - west) / wide).cast("int"), "tile_y": F.bround((north - F.col("y0")) / high).cast("int")
    })
    return assemble([placed])


def matching_tile(extents: DataFrame, tiles: DataFrame) -> DataFrame:
    """Adds to extents ``xmin, xmax, ymin, ymax`` the ``tile`` of a gridded tile set (``tile_grid``) that their centre is in.

    An extent that no tile holds, or that reaches beyond the tile, is an error when the result is computed.
    """
    first = tiles.first()
    wide, high = first.cell * first.size_x, first.cell * first.size_y
    west, north = first.x0 - first.tile_x * wide, first.y0 + first.tile_y * high
    x, y = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    placed = extents.withColumns({"tile_x": F.floor((x - west) / wide).cast("int"), "tile_y": F.floor((north - y) / high).cast("int")})
    found = placed.join(tiles.select("tile_x", "tile_y", "tile"), ["tile_x", "tile_y"], "left")
    left, top = west + F.col("tile_x") * wide, north - F.col("tile_y") * high
    slack = 1e-6 * wide
    within = (F.col("xmin") >= left - slack) & (F.col("xmax") <= left + wide + slack) & (F.col("ymax") <= top + slack) & (F.col("ymin") >= top - high - slack)
    place = F.concat_ws(", ", "xmin", "xmax", "ymin", "ymax")
    ok = F.assert_true(F.col("tile").isNotNull() & within, F.concat(F.lit("no tile holds the extent "), place))
    return found.withColumn("_ok", ok).filter("_ok is null").drop("_ok", "tile_x", "tile_y")


def check_alignment(sets: dict[str, DataFrame]) -> None:
    """An error unless all tile sets (``tile, x0, y0, cell, size_x, size_y, crs``) agree in system, cell, size and tiles."""
    base, first = None, None
    for name, tiles in sets.items():
        own = tiles.select("crs", "cell", "size_x", "size_y").distinct().limit(2).collect()
        if len(own) != 1:
            raise ValueError(f"the tiles of {name} differ among themselves: {[tuple(s) for s in own]}")
        if base is None:
            base, first = own[0], name
        elif own[0].crs != base.crs:
            raise ValueError(f"{first} is in {base.crs} while {name} is in {own[0].crs}")
        elif own[0] != base:
            raise ValueError(f"{first} and {name} differ in resolution: {tuple(base)[1:]} and {tuple(own[0])[1:]}")
    apart = misaligned({n: t.select(F.concat_ws("|", "tile", "x0", "y0").alias("tile")) for n, t in sets.items()}).limit(5).collect()
    if apart:
        raise ValueError(f"tile sets differ in extent: {', '.join(f'{r.name} alone has {r.tile}' for r in apart)}")


def stack_bands(rasters: dict[str, tuple[DataFrame, list[str]]], tiles: dict[str, DataFrame] | None = None) -> DataFrame:
    """Bands of several rasters side by side by cell; names get the raster's as a prefix where they clash.

    With the ``tiles`` of each raster their alignment is checked first.
    """
    if tiles:
        check_alignment(tiles)
    seen: set[str] = set()
    out = None
    for name, (df, bands) in rasters.items():
        named = df.select(*CELL, *(F.col(b).alias(b if b not in seen else f"{name}_{b}") for b in bands))
        seen |= set(bands)
        out = named if out is None else out.join(named, CELL, "full")
    return out


def misaligned(rasters: dict[str, DataFrame]) -> DataFrame:
    """``name, tile`` that are not in all tile sets: none when bands may be stacked."""
    tables = reduce(lambda a, b: a.unionByName(b), (df.select("tile").distinct().withColumn("name", F.lit(n)) for n, df in rasters.items()))
    return tables.withColumn("k", F.count("*").over(Window.partitionBy("tile"))).filter(F.col("k") < len(rasters)).select("name", "tile")


def sample_tiles(tiles: DataFrame, order: list[str], least: int, fraction: float) -> DataFrame:
    """Systematic sample: the first tile, then one each time the running count grows."""
    numbered = running(tiles, [F.col(c) for c in order], {"i": F.lit(1)}).withColumn("i", F.col("i") - 1)
    f = max(least / max(1, tiles.count()), fraction)
    take = (F.col("i") == 0) | (F.floor(F.col("i") * f) != F.floor((F.col("i") - 1) * f))
    return numbered.filter(F.lit(f > 0) & take).withColumn("i", F.col("i").cast("int"))


def unpivot_bands(raster: DataFrame, bands: list[str], keys: list[str]) -> DataFrame:
    """One row for each cell and band."""
    pairs = F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("value")) for b in bands))
    return raster.select(*keys, F.explode(pairs).alias("b")).select(*keys, "b.band", "b.value")


def tile_of(cells_per_tile: int) -> Column:
    return F.concat(F.lit("r"), F.floor(F.col("cy") / cells_per_tile), F.lit("c"), F.floor(F.col("cx") / cells_per_tile))


def row_major(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy("tile_y", "tile_x")


def colour_interpretation(band: Column) -> Column:
    """Colour role by band name."""
    b = F.lower(band)
    return F.when(b == "red", "Red").when(b == "green", "Green").when(b == "blue", "Blue").when(b.isin("nir", "nearinfrared"), "NIR").otherwise("Gray")
