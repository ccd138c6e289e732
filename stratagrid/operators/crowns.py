"""Crown segmentation: a cost field around each treetop, cells to the cheapest tree, classes by crown."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELL = ["cx", "cy"]

#: Cells from a treetop to the edge of its window.
REACH = 31


@dataclass(frozen=True)
class CrownRules:
    crown_ratio: float = 0.75
    cost_scale: float = 1.0
    cost_limit: float = 20.0
    minimum_height: float = 1.0
    above_top_penalty: float = 2.0


_ORDER = ((-1, 0), (1, 0), (0, 1), (0, -1), (-1, -1), (-1, 1), (1, 1), (1, -1))


def _sides(dy: int, dx: int) -> tuple[tuple[int, int], ...]:
    """The three cells, seen from one entered by the step ``dy, dx``, on the side it is entered from."""
    if dx and dy:
        return (-dy, 0), (-dy, -dx), (0, -dx)
    return tuple((k, -dx) for k in (-1, 0, 1)) if dx else tuple((-dy, k) for k in (-1, 0, 1))


def cost_fields(
    dsm: np.ndarray, chm: np.ndarray, row: np.ndarray, col: np.ndarray, cell: float, rules: CrownRules, z: np.ndarray, height: np.ndarray, reach: int = REACH
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path costs around many treetops of one raster: ``tree, row, column, cost`` of the cells that their crowns reach.

    From each treetop cells are visited breadth first within ``reach``. A step costs its length, uphill its length in space, and
    above the treetop the penalty for the rise. Cells below the crown's base or the least height are not entered; a cell is left
    only while its cost is below its own height (scaled) and the limit. Each cell is priced once, from the
    three cells on the side it is entered from. The top is the treetop's cell or, where that is higher or the cell has no
    data, the treetop's own ``z`` and ``height``: the centre of a patch need not be one of its cells.

    All trees take their steps side by side: the n-th visit of every tree is one pass over arrays, so the order of visits
    within a tree is that of its own queue.
    """
    side, pad = 2 * reach + 3, reach + 1  # windows have a border of their own, which is never entered
    wide = dsm.shape[1] + 2 * pad
    dsm, chm = (np.pad(a, pad, constant_values=np.nan).ravel() for a in (dsm, chm))
    trees, mid = len(row), pad * side + pad
    corner = row * wide + col  # of the window, in the padded raster
    place = (np.arange(side)[:, None] * wide + np.arange(side)[None]).ravel()
    centre = corner + place[mid]
    top = np.fmax(dsm[centre], z)
    high = np.fmax(chm[centre], height)
    base = top - rules.crown_ratio * high
    bare = np.isnan(dsm[centre])
    cost = np.full((trees, side * side), np.inf)
    seen = np.zeros((trees, side, side), bool)
    seen[:, 0], seen[:, -1], seen[:, :, 0], seen[:, :, -1] = True, True, True, True
    seen = seen.reshape(trees, -1)
    queue = np.zeros((trees, (2 * reach + 1) ** 2), np.int32)
    cost[:, mid], seen[:, mid], queue[:, 0] = 0, True, mid
    last = np.ones(trees, np.int64)
    live, visit = np.flatnonzero(~np.isnan(top) & ~np.isnan(high)), 0
    cost[np.isnan(top) | np.isnan(high)] = np.inf
    while len(live):
        at = queue[live, visit].astype(np.int64)
        for dy, dx in _ORDER:
            to = at + dy * side + dx
            seen_before = seen[live, to]
            seen[live, to] = True
            own = corner[live] + place[to]
            h, v = chm[own], dsm[own]
            t = np.flatnonzero(~seen_before & (h >= rules.minimum_height) & (v >= base[live]))
            if not len(t):
                continue
            tree, to, v, h = live[t], to[t], v[t], h[t]
            best = np.full(len(t), np.inf)
            for by, bx in _sides(dy, dx):
                other = to + by * side + bx
                before = cost[tree, other]
                below = dsm[corner[tree] + place[other]]
                below = np.where(bare[tree] & (other == mid), top[tree], below)
                rise = v - below
                run = cell * (math.sqrt(2) if by and bx else 1.0)
                step = np.where(rise > 0, np.hypot(run, rise), run) + np.where(v > top[tree], rules.above_top_penalty * rise, 0.0)
                best = np.fmin(best, np.where(np.isfinite(before), before + step, np.inf))
            cost[tree, to] = best
            on = (best < rules.cost_scale * h) & (best < rules.cost_limit)
            queue[tree[on], last[tree[on]]] = to[on]
            last[tree[on]] += 1
        visit += 1
        live = live[last[live] > visit]
    tree, to = np.nonzero(np.isfinite(cost))
    return tree, row[tree] + to // side - pad, col[tree] + to % side - pad, cost[tree, to]


#: Cells on a side of the blocks that trees are grouped by, and trees that are grown side by side.
BLOCK = 128
SIDE_BY_SIDE = 512


def _block(c: str, shift: int = 0) -> Column:
    return F.floor((F.col(c) + shift) / BLOCK).cast("int")


def _with_halo(cells: DataFrame, reach: int) -> DataFrame:
    """Cells with the blocks ``bx, by`` whose trees may read them: their own and those that they are within ``reach`` of."""
    span = lambda c: F.explode(F.sequence(_block(c, -reach), _block(c, reach)))
    return cells.withColumn("bx", span("cx")).withColumn("by", span("cy"))


def crowns(cells: DataFrame, treetops: DataFrame, cell: float, rules: CrownRules = CrownRules(), reach: int = REACH) -> DataFrame:
    """``cx, cy, tree_id, cost``: each cell goes to the tree of least cost, ties to the least id. Costs are compared to a billionth.

    ``cells`` has ``dsm, chm`` in metres, ``treetops`` ``tree_id, cx, cy`` and, where there are patches, their own ``z, h``. Trees are grouped
    by blocks; a cell is sent to its own block and to those within ``reach``, at most four of them, and blocks without trees get none.
    """
    own_top = [F.col(c).cast("double").alias(c) if {"z", "h"} <= set(treetops.columns) else F.lit(math.nan).alias(c) for c in ("z", "h")]
    tops = treetops.select(
        F.col("tree_id").cast("long").alias("tree_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), *own_top, _block("cx").alias("bx"),
        _block("cy").alias("by")
    )
    own = _with_halo(cells.select(*CELL, F.col("dsm").cast("double").alias("dsm"), F.col("chm").cast("double").alias("chm")), reach)
    own = own.join(tops.select("bx", "by").distinct(), ["bx", "by"], "left_semi")

    def grow(key: tuple, raster: pd.DataFrame, trees: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(trees.tx.min()) - reach, int(trees.ty.min()) - reach
        shape = (int(trees.ty.max()) + reach - y0 + 1, int(trees.tx.max()) + reach - x0 + 1)
        dsm, chm = np.full(shape, np.nan), np.full(shape, np.nan)
        y, x = raster.cy.to_numpy(np.int64) - y0, raster.cx.to_numpy(np.int64) - x0
        inside = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1])
        dsm[y[inside], x[inside]], chm[y[inside], x[inside]] = raster.dsm.to_numpy()[inside], raster.chm.to_numpy()[inside]
        best, owner = np.full(shape, np.inf), np.zeros(shape, np.int64)
        trees = trees.sort_values("tree_id")
        for i in range(0, len(trees), SIDE_BY_SIDE):
            some = trees.iloc[i : i + SIDE_BY_SIDE]
            tree, r, c, cost = cost_fields(
                dsm, chm, some.ty.to_numpy(np.int64) - y0, some.tx.to_numpy(np.int64) - x0, cell, rules, some.z.to_numpy(float),
                some.h.to_numpy(float), reach
            )
            ids, cost = some.tree_id.to_numpy(np.int64)[tree], np.round(cost, 9)
            inside = (r >= 0) & (r < shape[0]) & (c >= 0) & (c < shape[1])
            ids, r, c, cost = ids[inside], r[inside], c[inside], cost[inside]
            order = np.lexsort((ids, cost, c, r))
            r, c, cost, ids = r[order], c[order], cost[order], ids[order]
            first = np.ones(len(r), bool)
            first[1:] = (r[1:] != r[:-1]) | (c[1:] != c[:-1])
            r, c, cost, ids = r[first], c[first], cost[first], ids[first]
            less = cost < best[r, c]  # of equal costs the trees before, with smaller ids, keep the cell
            best[r[less], c[less]], owner[r[less], c[less]] = cost[less], ids[less]
        r, c = np.nonzero(np.isfinite(best))
        return pd.DataFrame({"cx": (c + x0).astype(np.int32), "cy": (r + y0).astype(np.int32), "tree_id": owner[r, c], "cost": best[r, c]})

    grown = own.groupBy("bx", "by").cogroup(tops.groupBy("bx", "by")).applyInPandas(grow, "cx int, cy int, tree_id long, cost double")
    return grown.groupBy(*CELL).agg(F.min(F.struct("cost", "tree_id")).alias("m")).select(*CELL, "m.tree_id", "m.cost")


# Land cover classes by code.
LAND_COVER = (
    "unclassified", "bare", "bare_shadow", "brown_tree", "grey_tree", "conifer", "conifer_shadow", "conifer_deep_shadow", "hardwood",
    "hardwood_shadow", "hardwood_deep_shadow"
)


def crown_classes(crown_cells: DataFrame, treetops: DataFrame, classes: DataFrame, reach: int = REACH) -> DataFrame:
    """Cells of each land cover class in a crown that are connected by sides to its treetop; a missing class is unclassified.

    Crowns are grouped by the block of their treetop, and in a block all spread from their treetops at once. A treetop whose cell
    belongs to no crown, or to another tree's, is an error when the result is computed.
    """
    tops = treetops.select(
        F.col("tree_id").cast("long").alias("tree_id"), F.col("cx").alias("tx"), F.col("cy").alias("ty"), _block("cx").alias("bx"),
        _block("cy").alias("by")
    )
    at_top = crown_cells.select(F.col("cx").alias("tx"), F.col("cy").alias("ty"), F.col("tree_id").alias("owner"))
    wrong = F.concat(F.lit("treetop "), F.col("tree_id"), F.lit(" is not in its own crown"))
    tops = tops.join(at_top, ["tx", "ty"], "left").withColumn(
        "ok", F.assert_true(F.col("owner") == F.col("tree_id"), wrong)
    ).filter("ok is null").drop("ok", "owner")
    both = crown_cells.select(*CELL, "tree_id").join(classes.select(*CELL, "class"), CELL, "left").join(tops, "tree_id")

    def count(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x0, y0 = int(pdf.cx.min()) - 1, int(pdf.cy.min()) - 1
        shape = (int(pdf.cy.max()) - y0 + 2, int(pdf.cx.max()) - x0 + 2)
        ids, number = np.unique(pdf.tree_id.to_numpy(np.int64), return_inverse=True)
        owner, kind, reached = np.full(shape, -1), np.zeros(shape, np.int64), np.zeros(shape, bool)
        y, x = pdf.cy.to_numpy(np.int64) - y0, pdf.cx.to_numpy(np.int64) - x0
        owner[y, x], kind[y, x] = number, pdf["class"].fillna(0).to_numpy(np.int64)
        reached[pdf.ty.to_numpy(np.int64) - y0, pdf.tx.to_numpy(np.int64) - x0] = True
        n = 0
        while n != (n := int(reached.sum())):
            for a, b in ((np.s_[1:], np.s_[:-1]), (np.s_[:-1], np.s_[1:])):
                reached[a] |= reached[b] & (owner[a] == owner[b])
                reached[:, a] |= reached[:, b] & (owner[:, a] == owner[:, b])
        reached &= owner >= 0
        out = np.zeros((len(ids), len(LAND_COVER)), np.int64)
        np.add.at(out, (owner[reached], kind[reached]), 1)
        return pd.DataFrame(np.column_stack([ids, out]), columns=["tree_id", *LAND_COVER])

    return both.groupBy("bx", "by").applyInPandas(count, "tree_id long, " + ", ".join(f"{c} long" for c in LAND_COVER))


def merge_treetops(treetops: DataFrame | list[DataFrame], counts: DataFrame) -> DataFrame:
    """One layer of the treetops of all tiles with their class counts; trees without crowns count nothing."""
    tiles = treetops if isinstance(treetops, list) else [treetops]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiles).join(counts, "tree_id", "left").fillna(0, list(LAND_COVER))
