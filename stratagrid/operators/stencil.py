"""Neighbourhood operators.

A stencil scatters each cell's value to the cells that read it and groups by cell: one shuffle with
partial sums, no self-join, and tile borders do not exist. Cells are rows; a missing cell is a missing or
null row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.staging import stage

CELL = ["cx", "cy"]


def scatter(cells: DataFrame, value: str, offsets: list[tuple[int, int]], keep: list[str] | None = None) -> DataFrame:
    """``cx, cy, dx, dy, v`` and the columns ``keep``: for each cell the values at ``(cx + dx, cy + dy)``; nulls are not sent."""
    more = keep or []
    where = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in offsets))
    sent = cells.filter(F.col(value).isNotNull()).select("cx", "cy", *more, F.col(value).alias("v"), F.explode(where).alias("d"))
    return sent.select((F.col("cx") - F.col("d.dx")).alias("cx"), (F.col("cy") - F.col("d.dy")).alias("cy"), "d.dx", "d.dy", *more, "v")


def square(reach: int = 1) -> list[tuple[int, int]]:
    return [(x, y) for y in range(-reach, reach + 1) for x in range(-reach, reach + 1)]


def _at(x: int, y: int) -> Column:
    return F.max(F.when((F.col("dx") == x) & (F.col("dy") == y), F.col("v")))


def binomial(cells: DataFrame, value: str, name: str = "cmm") -> DataFrame:
    """Weights 1-2-1 by 1-2-1 over the cells that are there; a missing centre stays missing."""
    weight = (2 - F.abs("dx")) * (2 - F.abs("dy"))
    got = scatter(cells, value, square()).groupBy(*CELL).agg((F.sum(weight * F.col("v")) / F.sum(weight)).alias(name), _at(0, 0).alias("centre"))
    return got.filter("centre is not null").select(*CELL, name)


def _mean_of_nine(cells: DataFrame, value: str, size_x: int, size_y: int, keep: dict[str, Column]) -> DataFrame:
    """``cx, cy, mean`` and the kept columns of the cell itself, by one scatter and one grouping.

    A border cell stands for the cells beyond it, so it is sent with the number of places it stands for.
    """
    where = F.array(*(F.struct(F.lit(x).alias("dx"), F.lit(y).alias("dy")) for x, y in square()))
    read = cells.select(*CELL, F.col(value).alias("v"), *(c.alias(k) for k, c in keep.items()), F.explode(where).alias("d"))
    x, y = F.col("cx") - F.col("d.dx"), F.col("cy") - F.col("d.dy")
    # times that the cell (x, y), clamped into the grid, reads this one
    wide = lambda c, d, size: 1 + F.when((c == 0) & (d == 0), 1).otherwise(0) + F.when((c == size - 1) & (d == 0), 1).otherwise(0)
    weight = wide(F.col("cx"), F.col("d.dx"), size_x) * wide(F.col("cy"), F.col("d.dy"), size_y)
    own = (F.col("d.dx") == 0) & (F.col("d.dy") == 0)
    sent = read.select(x.alias("cx"), y.alias("cy"), "v", weight.alias("w"), own.alias("own"), *(F.when(own, F.col(k)).alias(k) for k in keep))
    inside = F.col("cx").between(0, size_x - 1) & F.col("cy").between(0, size_y - 1)
    got = sent.filter(inside).groupBy(*CELL).agg(
        F.sum(F.col("w") * F.col("v")).alias("s"), F.sum(F.when(F.col("v").isNotNull(), F.col("w"))).alias("w"), F.max("own").alias("own"), *(F.max(k).alias(k) for k in keep)
    )
    return got.select(*CELL, F.when(F.col("w") == 9, F.col("s") / 9).alias("mean"), "own", *keep)


def mean3(cells: DataFrame, value: str, size_x: int, size_y: int) -> DataFrame:
    """Mean of nine with the border repeated outwards; null where one of them is missing."""
    return _mean_of_nine(cells, value, size_x, size_y, {}).select(*CELL, F.col("mean").alias(value))


def smooth(cells: DataFrame, value: str, size_x: int, size_y: int, rounds: int) -> DataFrame:
    """``mean3``, ``rounds`` times, with nothing put back."""
    for _ in range(rounds):
        cells = mean3(cells, value, size_x, size_y)
    return cells


def stencil(cells: DataFrame, measured: str, size_x: int, size_y: int, rounds: int) -> DataFrame:
    """Smooth, then put measured cells back, ``rounds`` times; ``measured`` marks the cells, ``z`` holds the values.

    A round is one shuffle: each cell's own value and mark travel with what it sends.
    """
    for _ in range(rounds):
        got = _mean_of_nine(cells, "z", size_x, size_y, {measured: F.col(measured), "z": F.col("z")}).filter("own")
        cells = got.select(*CELL, measured, F.when(F.col(measured), F.col("z")).otherwise(F.coalesce("mean", "z")).alias("z"))
    return cells


def slope_aspect_of(cells: DataFrame, values: list[str], cell_size: float) -> DataFrame:
    """``slope_aspect`` of several bands of one raster, such as surface and canopy maxima: ``<band>_slope, <band>_aspect``.

    Bands are scattered as rows of one table, so all of them take one shuffle and one more brings them side by side.
    """
    long = cells.select(
        *CELL, F.explode(F.array(*(F.struct(F.lit(b).alias("band"), F.col(b).cast("double").alias("v")) for b in values))).alias("b")
    ).select(*CELL, "b.band", "b.v")
    got = slope_aspect(long, "v", cell_size, ["band"])
    pick = lambda b, c: F.max(F.when(F.col("band") == b, F.col(c))).alias(f"{b}_{c}")
    return got.groupBy(*CELL).agg(*(pick(b, c) for b in values for c in ("slope", "aspect")))


def slope_aspect(cells: DataFrame, value: str, cell_size: float, by: list[str] | None = None) -> DataFrame:
    """Degrees, by cell (and by the columns ``by``). Differences of the four corners, else of the four sides, else to one side of the centre; else null."""
    keys = [*CELL, *(by or [])]
    n = {"nw": (-1, -1), "n": (0, -1), "ne": (1, -1), "w": (-1, 0), "c": (0, 0), "e": (1, 0), "sw": (-1, 1), "s": (0, 1), "se": (1, 1)}
    got = scatter(cells, value, list(n.values()), by or []).groupBy(*keys).agg(*(_at(*d).cast("double").alias(k) for k, d in n.items())).filter("c is not null")
    c = F.col
    corners = c("nw").isNotNull() & c("ne").isNotNull() & c("sw").isNotNull() & c("se").isNotNull()
    sides = c("n").isNotNull() & c("s").isNotNull() & c("e").isNotNull() & c("w").isNotNull()
    quarter = 4 * cell_size
    one_x = F.when(c("n").isNotNull(), c("n") - c("c")).otherwise(c("c") - c("s")) * 4
    one_y = F.when(c("w").isNotNull(), c("c") - c("w")).otherwise(c("e") - c("c")) * 4
    fx = F.when(corners, c("nw") - c("sw") + c("ne") - c("se")).when(sides, 2 * (c("n") - c("s"))).otherwise(one_x) / quarter
    fy = F.when(corners, c("se") - c("sw") + c("ne") - c("nw")).when(sides, 2 * (c("e") - c("w"))).otherwise(one_y) / quarter
    both = got.select(*keys, fx.alias("fx"), fy.alias("fy"))
    known = c("fx").isNotNull() & c("fy").isNotNull()
    turn = -F.degrees(F.atan2("fx", "fy")) - 90
    turn = F.when(turn < 0, turn + 360).otherwise(turn)
    return both.select(
        *keys, F.when(known, F.degrees(F.atan(F.sqrt(c("fx") * c("fx") + c("fy") * c("fy"))))).alias("slope"),
        F.when(known, F.when(turn == 360, 0.0).otherwise(turn)).alias("aspect")
    )


# Fixed value: the diagonal of a cell as the fill rules use it.
DIAGONAL = 1.414214


def fill(cells: DataFrame, grid_cells: DataFrame, value: str, reach: int, directions: int = 8, square_weights: bool = False) -> DataFrame:
    """One pass over the holes of ``grid_cells`` (all ``cx, cy``): the nearest value along each ray, weighted by 1/d or 1/d².

    Only holes take part in the rays: values are sent along them up to ``reach`` cells (diagonals as far in
    distance), the nearest of each ray is kept by a minimum, and the rays of a hole are averaged.
    """
    diagonal = round(reach / DIAGONAL)
    rays = [(dx, dy, d) for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)) for d in range(1, reach + 1)]
    if directions == 8:
        rays += [(dx, dy, d) for dx in (1, -1) for dy in (1, -1) for d in range(1, diagonal + 1)]
    holes = grid_cells.join(cells.filter(F.col(value).isNotNull()).select(*CELL), CELL, "left_anti")
    asks = F.explode(F.array(*(F.struct(F.lit(x).alias("rx"), F.lit(y).alias("ry"), F.lit(d).alias("d")) for x, y, d in rays))).alias("r")
    asked = holes.select(F.col("cx").alias("hx"), F.col("cy").alias("hy"), asks).select(
        "hx", "hy", "r.*", (F.col("hx") + F.col("r.rx") * F.col("r.d")).alias("cx"), (F.col("hy") + F.col("r.ry") * F.col("r.d")).alias("cy")
    )
    found = asked.join(cells.filter(F.col(value).isNotNull()).select(*CELL, F.col(value).alias("v")), CELL)
    nearest = found.groupBy("hx", "hy", "rx", "ry").agg(F.min(F.struct("d", "v")).alias("m"))
    diag = (F.col("rx") != 0) & (F.col("ry") != 0)
    d = F.col("m.d").cast("double")
    weight = F.when(diag, 0.5 / (d * d)).otherwise(1 / (d * d)) if square_weights else F.when(diag, 1 / (DIAGONAL * d)).otherwise(1 / d)
    filled = nearest.groupBy(F.col("hx").alias("cx"), F.col("hy").alias("cy")).agg((F.sum(weight * F.col("m.v")) / F.sum(weight)).alias(value))
    return cells.filter(F.col(value).isNotNull()).select(
        *CELL, F.col(value).cast("double").alias(value), F.lit(False).alias("filled")
    ).unionByName(filled.withColumn("filled", F.lit(True)))


def fill_all(
    cells: DataFrame, grid_cells: DataFrame, value: str, reach: int, rounds: int, directions: int = 8, square_weights: bool = False
) -> DataFrame:
    """Passes until no hole is left, ``rounds`` are done or a pass fills nothing; each pass reads the staged table of the one before."""
    total, before = grid_cells.count(), -1
    for _ in range(rounds):
        filled = fill(cells.select(*CELL, value), grid_cells, value, reach, directions, square_weights)
        cells = stage(filled, "filled", over=cells)
        now = cells.count()
        if now in (total, before):
            break
        before = now
    return cells.select(*CELL, value)
