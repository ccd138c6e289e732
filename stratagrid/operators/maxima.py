"""Rings, local maxima and treetops.

Cells with a higher neighbour among the eight are dropped first by one scatter, which leaves a few
per cent; only the rest is joined with rings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.points import pack_cell, unpack_cell
from stratagrid.model import GridSpec
from stratagrid.operators.binning import cell_centre
from stratagrid.operators.components import components
from stratagrid.operators.ordering import running
from stratagrid.operators.stencil import scatter, square
from stratagrid.staging import stage

CELL = ["cx", "cy"]
RINGS = 10


def ring_offsets(most: int = RINGS) -> list[tuple[int, int, int]]:
    """``(ring, dx, dy)``: ring r has the offsets whose length rounds to r."""
    out = []
    for y in range(-most - 1, most + 2):
        for x in range(-most - 1, most + 2):
            r = int((x * x + y * y) ** 0.5 + 0.5)
            if 1 <= r <= most:
                out.append((r, x, y))
    return out


def peaks(cells: DataFrame, value: str) -> DataFrame:
    """Cells without a higher one among the eight around; ``level`` is 1 where one of these is equal, else 0."""
    centre = (F.col("dx") == 0) & (F.col("dy") == 0)
    got = scatter(cells, value, square()).groupBy(*CELL).agg(
        F.max(F.when(centre, F.col("v"))).alias("z"), F.max(F.when(~centre, F.col("v"))).alias("around")
    )
    ok = F.col("z").isNotNull() & (F.col("around").isNull() | (F.col("around") <= F.col("z")))
    return got.filter(ok).select(*CELL, "z", F.coalesce((F.col("around") == F.col("z")).cast("int"), F.lit(0)).alias("level"))


def with_rings(tops: DataFrame, cells: DataFrame, value: str, most: int | Column = RINGS, limit: int = RINGS) -> DataFrame:
    """``tops`` by ring: ``hx, hy, z0, ring, dx, dy, v``."""
    offsets = F.array(*(F.struct(F.lit(r).alias("ring"), F.lit(x).alias("dx"), F.lit(y).alias("dy")) for r, x, y in ring_offsets(limit)))
    asked = tops.withColumn("d", F.explode(F.filter(offsets, lambda d: d["ring"] <= most)))
    asked = asked.withColumns({
        "hx": F.col("cx"), "hy": F.col("cy"), "cx": F.col("cx") + F.col("d.dx"), "cy": F.col("cy") + F.col("d.dy"), "z0": F.col("z")
    }).drop("z")
    return asked.join(
        cells.filter(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v")), CELL
    ).withColumns({"ring": F.col("d.ring"), "dx": F.col("d.dx"), "dy": F.col("d.dy")}).drop("d", "cx", "cy")


def local_maxima(cells: DataFrame, value: str, statistics: int = 5) -> DataFrame:
    """Peaks with the first ring that holds a higher cell (``RINGS`` if none), and figures of the first rings."""
    tops = peaks(cells, value)
    met = with_rings(tops, cells, value)
    v, ring = F.col("v").cast("double"), F.col("ring")
    figures = []
    for k in range(1, statistics + 1):
        on = F.when(ring == k, v)
        figures += [
            F.max(on).alias(f"ring{k}_max"), F.avg(on).alias(f"ring{k}_mean"), F.min(on).alias(f"ring{k}_min"),
            F.var_pop(on).alias(f"ring{k}_variance")
        ]
    got = met.groupBy("hx", "hy").agg(F.min(F.when(F.col("v") > F.col("z0"), ring)).alias("first"), *figures)
    names = [f"ring{k}_{n}" for k in range(1, statistics + 1) for n in ("max", "mean", "min", "variance")]
    return tops.join(got.withColumnsRenamed({"hx": "cx", "hy": "cy"}), CELL, "left").select(
        *CELL, "z", F.coalesce("first", F.lit(RINGS)).alias("radius"), *names
    )


def tops_by_radius(
    cells: DataFrame, value: str, height: str, metres: float, minimum: float = 1.5, slope: float = 0.055, base: float = 0.4, most: float = 5.0
) -> DataFrame:
    """Cells that nothing within ``min(slope h + base, most)`` metres is above, at least ``minimum`` high; ``level`` is 1 beside an equal one.

    ``metres`` is the width of a cell; heights are in metres.
    """
    tall = cells.filter(F.col(height) >= minimum)
    tops = peaks(cells, value).join(tall.select(*CELL, F.col(height).alias("h")), CELL)
    radius = F.least(F.lit(slope) * F.col("h") + base, F.lit(most)) / metres
    rows = F.greatest(F.floor(radius + 0.5), F.lit(1)).cast("int")
    reach = int(most / metres + 0.5) + 1
    y = F.sequence(-rows, rows)
    wide = lambda dy: F.greatest(
        F.when(F.abs(dy) < radius, F.floor(F.sqrt(F.greatest(radius * radius - dy * dy, F.lit(0.0))) + 0.5)).otherwise(0),
        F.when(F.abs(dy) < 2, 1).otherwise(0)
    ).cast("int")
    disc = F.flatten(F.transform(y, lambda dy: F.transform(F.sequence(-wide(dy), wide(dy)), lambda dx: F.struct(dx.alias("dx"), dy.alias("dy")))))
    asked = tops.select(F.col("cx").alias("hx"), F.col("cy").alias("hy"), "z", F.explode(disc).alias("d")).filter(F.abs("d.dx") <= reach)
    asked = asked.select("hx", "hy", "z", (F.col("hx") + F.col("d.dx")).alias("cx"), (F.col("hy") + F.col("d.dy")).alias("cy"))
    higher = asked.join(cells.select(*CELL, F.col(value).alias("v")), CELL).filter("v > z").select(F.col("hx").alias("cx"), F.col("hy").alias("cy")).distinct()
    return tops.join(higher, CELL, "left_anti").withColumn("radius", rows)


def treetops_by_radius(cells: DataFrame, value: str, height: str, metres: float, **rules: float) -> tuple[DataFrame, DataFrame]:
    """``tops_by_radius`` as single treetops, and the cells that have an equal neighbour, which form patches."""
    kept = tops_by_radius(cells, value, height, metres, **rules)
    return kept.filter("level = 0").drop("level"), kept.filter("level > 0").drop("level")


def treetops_by_rings(
    cells: DataFrame, value: str, height: str, metres: float, minimum: float = 1.5, unit: float = 1.0, prominence: float = 0.02
) -> DataFrame:
    """Peaks that the inner rings do not exceed and whose mean rise over the rings' tops passes ``prominence`` of the height.

    ``unit`` is the length of one unit of ``value`` in metres. A ring without cells rules a peak out. ``radius`` counts the rings, from
    the first, that stay below the peak; ``patch`` tells whether a cell of the inner rings is as high.
    """
    tall = cells.filter(F.col(height) >= minimum)
    tops = peaks(cells, value).join(tall.select(*CELL, F.col(height).alias("h")), CELL)
    most = F.least(F.floor(F.least(F.lit(0.045) * F.col("h") + 0.5, F.lit(4.0)) / metres + 0.5), F.lit(RINGS)).cast("int")
    half = F.floor(most / 2) + 0.5
    tops = tops.withColumns({"most": most, "inner": F.greatest(F.bround(half), F.lit(1)).cast("int") + 1})
    met = with_rings(tops, cells, value, F.col("most"), min(RINGS, int(4.0 / metres + 0.5)))
    by_ring = met.groupBy("hx", "hy", "ring").agg(
        F.first("z0").alias("z"), F.first("h").alias("h"), F.first("most").alias("most"), F.first("inner").alias("inner"), F.max("v").alias("top")
    )
    got = by_ring.groupBy("hx", "hy").agg(
        F.first("z").alias("z"), F.first("h").alias("h"), F.first("most").alias("most"), F.count("*").alias("rings"), F.sum(F.col("z") - F.col("top")).alias("net"),
        F.max(F.when(F.col("ring") <= F.col("inner"), F.col("top"))).alias("near"), F.first("inner").alias("inner"), F.min(F.when(F.col("top") >= F.col("z"), F.col("ring") - 1)).alias("clear"),
    )
    ok = (F.col("rings") == F.col("most")) & (F.col("near") <= F.col("z")) & (F.col("net") * unit / F.col("h") > prominence)
    return got.filter(ok).select(
        F.col("hx").alias("cx"), F.col("hy").alias("cy"), "z", "h", (F.col("net") * unit / F.col("h")).alias("prominence"),
        (F.col("near") == F.col("z")).alias("patch"), F.coalesce("clear", "most").alias("radius"), "most", "inner"
    )


def _id() -> Column:
    """One long for a cell, in row-major order."""
    return pack_cell(F.col("cy"), F.col("cx"))


def _equal_neighbours(level: DataFrame) -> DataFrame:
    """Edges ``a, b`` between adjacent cells of one height."""
    half = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in ((1, 0), (-1, 1), (0, 1), (1, 1))))
    sent = level.select(_id().alias("a"), "z", "cx", "cy", F.explode(half).alias("d")).select(
        "a", "z", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy")
    )
    return sent.join(level.select(*CELL, "z", _id().alias("b")), [*CELL, "z"]).select("a", "b")


def patches(level: DataFrame, edges: DataFrame | None = None, most_rounds: int = 60) -> DataFrame:
    """Connected cells of one height to one treetop each: least cell ``cx, cy`` (by row), mean index plus a half, cells and height.

    Cells are connected by ``edges(a, b)`` of their ids, or where they are adjacent. Columns ``h`` and ``ground`` are averaged, and a
    ``radius`` in cells grows by half the patch's diagonal. It is an error if ``most_rounds`` do not settle the components.
    """
    level = stage(level, "level")
    of = components(_equal_neighbours(level) if edges is None else edges, most_rounds).withColumnsRenamed({"id": "_id", "component": "_label"})
    own = level.withColumn("_id", _id()).join(of, "_id", "left").withColumn("_label", F.coalesce("_label", "_id"))
    more = [F.avg(c).alias(c) for c in ("h", "ground") if c in level.columns]
    if "radius" in level.columns:
        wide = [F.max(c) - F.min(c) for c in CELL]
        more.append((F.max("radius") + 0.5 * F.hypot(*wide)).alias("radius"))
    got = own.groupBy("_label", "z").agg(F.avg("cx").alias("mx"), F.avg("cy").alias("my"), F.count("*").alias("cells"), *more)
    cy, cx = unpack_cell(F.col("_label"))
    return got.select(
        cx.alias("cx"), cy.alias("cy"), (F.col("mx") + 0.5).alias("x"), (F.col("my") + 0.5).alias("y"), "z", "cells",
        *(c for c in ("h", "radius", "ground") if c in level.columns)
    )


def treetop_patches(cells: DataFrame, value: str, height: str, metres: float, ground: str | None = None, **rules: float) -> DataFrame:
    """Treetops of several cells: those that ``treetops_by_radius`` finds level, and their equal neighbours, as ``patches``."""
    return _radius_patches(treetops_by_radius(cells, value, height, metres, **rules)[1], cells, value, height, ground)


def _radius_patches(level: DataFrame, cells: DataFrame, value: str, height: str, ground: str | None) -> DataFrame:
    where = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in square()))
    sent = level.select(*CELL, "z", "radius", F.explode(where).alias("d")).select(
        (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), "z", "radius"
    )
    near = sent.groupBy(*CELL, "z").agg(F.max("radius").alias("radius"))
    known = [F.col(ground).alias("ground")] if ground else []
    return patches(near.join(cells.select(*CELL, F.col(value).alias("v"), F.col(height).alias("h"), *known), CELL).filter("v = z").drop("v"))


def ring_patches(found: DataFrame, cells: DataFrame, value: str, height: str, ground: str | None = None) -> DataFrame:
    """Treetops of several cells by the ring method: peaks ``found`` with the equal cells of their inner rings, which need not be adjacent."""
    level = found.filter("patch").select(*CELL, "z", "most", "inner")
    met = with_rings(level, cells, value, F.least("inner", "most")).filter("v = z0")
    pairs = stage(
        met.select("hx", "hy", (F.col("hx") + F.col("dx")).alias("ox"), (F.col("hy") + F.col("dy")).alias("oy"), F.col("z0").alias("z"), "most"),
        "ring-pairs"
    )
    edges = pairs.select(pack_cell(F.col("hy"), F.col("hx")).alias("a"), pack_cell(F.col("oy"), F.col("ox")).alias("b"))
    members = pairs.select(
        F.col("hx").alias("cx"), F.col("hy").alias("cy"), "z", "most"
    ).unionByName(pairs.select(F.col("ox").alias("cx"), F.col("oy").alias("cy"), "z", "most"))
    known = [F.col(ground).alias("ground")] if ground else []
    nodes = members.groupBy(*CELL, "z").agg(F.max("most").alias("radius")).join(cells.select(*CELL, F.col(height).alias("h"), *known), CELL)
    return patches(nodes, edges)


METHODS = ("ChmRadius", "DsmRadius", "DsmRing")


def find_treetops(cells: DataFrame, method: str, grid: GridSpec, minimum: float = 1.5) -> DataFrame:
    """``tree_id, x, y, elevation, height, radius, cells``: treetops of one cell and of patches, numbered row by row from 1.

    ``cells`` has ``dsm`` and ``chm`` in metres; ``elevation`` is that of the ground, surface less canopy height. The methods
    search canopy height or surface within a radius, or the surface by rings. Lengths are in metres.
    """
    if method not in METHODS:
        raise ValueError(f"no treetop method {method}; there are {', '.join(METHODS)}")
    metres, value = grid.cell * grid.scale, "chm" if method == "ChmRadius" else "dsm"
    surface = cells.filter("dsm is not null and chm is not null").select(*CELL, "dsm", "chm", (F.col("dsm") - F.col("chm")).alias("ground"))
    known = stage(surface, "surface")  # both kinds of treetops and the rounds of their patches read it
    if method == "DsmRing":
        found = stage(treetops_by_rings(known, value, "chm", metres, minimum), "tops")
        single = found.filter("not patch").select(*CELL, "radius")
        several = ring_patches(found, known, value, "chm", "ground")
    else:
        found = stage(tops_by_radius(known, value, "chm", metres, minimum), "tops")
        single = found.filter("level = 0").select(*CELL, "radius")
        several = _radius_patches(found.filter("level > 0").drop("level"), known, value, "chm", "ground")
    ones = single.join(known, CELL).select(
        *CELL, (F.col("cx") + 0.5).alias("x"), (F.col("cy") + 0.5).alias("y"), F.col("radius").cast("double").alias("radius"),
        F.col("chm").alias("h"), "ground", F.lit(1).cast("long").alias("cells")
    )
    tops = ones.unionByName(several.select(*CELL, "x", "y", F.col("radius").cast("double").alias("radius"), "h", "ground", "cells"))
    x, y = grid.x0 * grid.scale + F.col("x") * metres, grid.y0 * grid.scale - F.col("y") * metres
    return running(tops, [F.col("cy"), F.col("cx")], {"tree_id": F.lit(1)}).select(
        F.col("tree_id").cast("long").alias("tree_id"), x.alias("x"), y.alias("y"), F.col("ground").alias("elevation"), F.col("h").alias("height"), (F.col("radius") * metres).alias("radius"), "cells"
    )


def maxima_layer(surface: DataFrame, grid: GridSpec, statistics: int = 5) -> DataFrame:
    """Local maxima of ``dsm`` as a layer: ``id, source_id, x, y, radius, dsm_z, height, cmm_z`` and the figures of the first rings.

    ``surface`` has ``dsm, chm, cmm, source_id`` by cell; ids count row by row from 1, ``radius`` is in raw units.
    """
    found = local_maxima(surface, "dsm", statistics)
    got = found.join(surface.select(*CELL, "source_id", F.col("chm").alias("height"), F.col("cmm").alias("cmm_z")), CELL)
    centre = cell_centre(grid)
    rings = [c for c in found.columns if c.startswith("ring")]
    return running(got, [F.col("cy"), F.col("cx")], {"id": F.lit(1)}).select(
        F.col("id").cast("long").alias("id"), "source_id", centre["x"].alias("x"), centre["y"].alias("y"), (F.col("radius") * grid.cell).alias("radius"), F.col("z").alias("dsm_z"), "height", "cmm_z", *rings
    )
