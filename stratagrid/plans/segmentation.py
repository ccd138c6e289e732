"""Queries of treetops and crowns.

Treetops are searched on a surface in steps of 3 m, which has many cells of one height side by side. Crowns grow on a
slope, where the cost of every path has a closed form that SQL can state; ``crowns_rough`` grows them on the fixture's own
surface, whose costs hang on the order of visits, and is tested against a plain version.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagrid.operators import aggregates as agg
from stratagrid.operators import crowns as cr
from stratagrid.operators import maxima, stencil
from stratagrid.plans import catalog
from stratagrid.plans.catalog import CELL, HOLED, SURFACE, _NINE, _RINGS, query, rounded, with_points
from stratagrid.plans.fixtures import binned, grid, grid_cells
from stratagrid.staging import stage

# --- treetops ---

_STEPS = SURFACE + """, cells AS (SELECT cx, cy, dsm, dsm - (20 + cx / 16::DOUBLE + cy / 32::DOUBLE) AS chm, 20 + cx / 16::DOUBLE + cy / 32::DOUBLE AS terrain FROM (
  SELECT cx, cy, floor(dsm / 3000.0) * 3 AS dsm FROM surface WHERE dsm IS NOT NULL AND (cx * 7 + cy * 3) % 11 <> 0))"""


def _steps(spark, sf_dir):
    cells = catalog.holed(spark, sf_dir).select("cx", "cy", (F.floor(F.col("z") / 3000.0) * 3).cast("double").alias("dsm"))
    return cells.withColumn("chm", F.col("dsm") - (20 + F.col("cx") / 16 + F.col("cy") / 32))


def _patch_sql(nodes: str, edges: str, name: str) -> str:
    """Components of ``nodes(cx, cy, v, radius)`` under symmetric ``edges(cx, cy, ox, oy)``; ``name`` gets one row for each."""
    return f"""{name}_reach AS (SELECT cx, cy, cx AS ox, cy AS oy FROM {nodes} UNION SELECT r.cx, r.cy, e.ox, e.oy FROM {name}_reach r JOIN {edges} e ON e.cx = r.ox AND e.cy = r.oy),
  {name}_label AS (SELECT cx, cy, min(oy * 1000000 + ox) AS label FROM {name}_reach GROUP BY cx, cy),
  {name} AS (SELECT label % 1000000 AS cx, label // 1000000 AS cy, avg(n.cx) + 0.5 AS x, avg(n.cy) + 0.5 AS y, any_value(v) AS v, count(*) AS cells, avg(c.chm) AS h, avg(c.dsm - c.chm) AS ground,
    max(radius) + 0.5 * sqrt(pow(max(n.cx) - min(n.cx), 2) + pow(max(n.cy) - min(n.cy), 2)) AS radius
    FROM {nodes} n JOIN {name}_label l ON l.cx = n.cx AND l.cy = n.cy JOIN cells c ON c.cx = n.cx AND c.cy = n.cy GROUP BY label)"""


def _radius_sql(v: str, name: str) -> str:
    """Treetops by radius on band ``v``: ``name_single`` and ``name``."""
    return f"""{name}_t AS (SELECT cx, cy, {v} AS v, least(0.055*chm + 0.4, 5.0)::DOUBLE AS r, greatest(floor(least(0.055*chm + 0.4, 5.0) + 0.5), 1) AS rr FROM cells WHERE chm >= 1.5),
  {name}_ok AS (SELECT *, EXISTS (SELECT 1 FROM cells o WHERE abs(o.cx - t.cx) <= 1 AND abs(o.cy - t.cy) <= 1 AND (o.cx <> t.cx OR o.cy <> t.cy) AND o.{v} = t.v) AS level FROM {name}_t t WHERE NOT EXISTS (
    SELECT 1 FROM cells o, range(-6, 7) w(dy) WHERE abs(dy) <= t.rr AND o.cy = t.cy + dy AND o.{v} > t.v
      AND abs(o.cx - t.cx) <= greatest(CASE WHEN abs(dy) < t.r THEN floor(sqrt(greatest(t.r*t.r - dy*dy, 0)) + 0.5) ELSE 0 END, CASE WHEN abs(dy) < 2 THEN 1 ELSE 0 END))),
  {name}_nodes AS (SELECT o.cx, o.cy, o.{v} AS v, max(rr) AS radius FROM {name}_ok t JOIN cells o ON abs(o.cx - t.cx) <= 1 AND abs(o.cy - t.cy) <= 1 AND o.{v} = t.v WHERE level GROUP BY ALL),
  {name}_edges AS (SELECT a.cx, a.cy, b.cx AS ox, b.cy AS oy FROM {name}_nodes a JOIN {name}_nodes b ON abs(a.cx - b.cx) <= 1 AND abs(a.cy - b.cy) <= 1 AND a.v = b.v),
  {_patch_sql(name + '_nodes', name + '_edges', name)},
  {name}_single AS (SELECT t.cx, t.cy, t.cx + 0.5 AS x, t.cy + 0.5 AS y, 1 AS cells, chm AS h, dsm - chm AS ground, CAST(rr AS DOUBLE) AS radius FROM {name}_ok t JOIN cells USING (cx, cy) WHERE NOT level)"""


_RING = f"""ring_t AS (SELECT *, CAST(greatest(round_even(floor(m / 2) + 0.5, 0), 1) AS INT) + 1 AS i FROM (
    SELECT cx, cy, dsm AS v, chm, CAST(least(floor(least(0.045*chm + 0.5, 4.0) + 0.5), 10) AS INT) AS m FROM cells c WHERE chm >= 1.5
      AND NOT EXISTS (SELECT 1 FROM cells o WHERE abs(o.cx - c.cx) <= 1 AND abs(o.cy - c.cy) <= 1 AND o.dsm > c.dsm))),
  {_RINGS.split(', ' + chr(10) + '  met AS')[0].split(',' + chr(10) + '  met AS')[0]},
  ring_met AS (SELECT t.cx, t.cy, t.v, t.m, t.i, t.chm, ring, o.cx AS ox, o.cy AS oy, o.dsm AS w FROM ring_t t, rings JOIN cells o ON o.cx = t.cx + dx AND o.cy = t.cy + dy WHERE ring <= t.m),
  ring_ok AS (SELECT cx, cy, any_value(v) AS v, any_value(m) AS m, any_value(i) AS i, max(top) FILTER (WHERE ring <= i) = any_value(v) AS patch, coalesce(min(ring - 1) FILTER (WHERE top >= v), any_value(m)) AS clear
    FROM (SELECT cx, cy, ring, any_value(v) AS v, any_value(m) AS m, any_value(i) AS i, any_value(chm) AS h, max(w) AS top FROM ring_met WHERE ring <= m GROUP BY cx, cy, ring)
    GROUP BY cx, cy HAVING count(*) = any_value(m) AND max(top) FILTER (WHERE ring <= i) <= any_value(v) AND sum(v - top) / any_value(h) > 0.02),
  ring_pairs AS (SELECT k.cx, k.cy, r.ox, r.oy, k.v, k.m FROM ring_ok k JOIN ring_met r ON r.cx = k.cx AND r.cy = k.cy AND r.ring <= k.i AND r.w = k.v WHERE patch),
  ring_nodes AS (SELECT cx, cy, v, max(m) AS radius FROM (SELECT cx, cy, v, m FROM ring_pairs UNION ALL SELECT ox, oy, v, m FROM ring_pairs) GROUP BY ALL),
  ring_edges AS (SELECT cx, cy, ox, oy FROM ring_pairs UNION SELECT ox, oy, cx, cy FROM ring_pairs),
  {_patch_sql('ring_nodes', 'ring_edges', 'ring')},
  ring_single AS (SELECT k.cx, k.cy, k.cx + 0.5 AS x, k.cy + 0.5 AS y, 1 AS cells, chm AS h, dsm - chm AS ground, CAST(clear AS DOUBLE) AS radius FROM ring_ok k JOIN cells USING (cx, cy) WHERE NOT patch)"""


def _tops_sql(name: str, method: str) -> str:
    rows = " UNION ALL ".join(f"SELECT cx, cy, x, y, ground, h, radius, cells FROM {t}" for t in (name, f"{name}_single"))
    return f"""SELECT '{method}' AS method, CAST(row_number() OVER (ORDER BY cy, cx) AS BIGINT) AS tree_id, round(x, 6) AS x, round(side - y, 6) AS y, round(ground, 6) AS elevation,
  round(h, 6) AS height, round(radius, 6) AS radius, CAST(cells AS BIGINT) AS cells FROM ({rows}), sq"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


@query(recursive(with_points(
    " UNION ALL ".join(_tops_sql(n, m) for n, m in (("chm_", "ChmRadius"), ("dsm_", "DsmRadius"), ("ring", "DsmRing"))),
    f"{_STEPS}, {_radius_sql('chm', 'chm_')}, {_radius_sql('dsm', 'dsm_')}, {_RING}"
)))
def treetops_full(spark, sf_dir):
    """Treetops by all three methods as the rows of a layer, patches merged."""
    cells, out = stage(_steps(spark, sf_dir), "steps"), None
    for method in maxima.METHODS:
        tops = maxima.find_treetops(cells, method, grid(spark, sf_dir)).select(F.lit(method).alias("method"), "*")
        out = tops if out is None else out.unionByName(tops)
    return out.select("method", "tree_id", *(F.round(c, 6).alias(c) for c in ("x", "y", "elevation", "height", "radius")), "cells")


@query(recursive(with_points(
    "SELECT CAST(cx AS INT) AS cx, CAST(cy AS INT) AS cy, round(x, 6) AS x, round(y, 6) AS y, v AS z, CAST(cells AS BIGINT) AS cells, round(h, 6) AS h, round(radius, 6) AS radius FROM dsm_",
    f"{_STEPS}, {_radius_sql('dsm', 'dsm_')}"
)))
def treetop_patches(spark, sf_dir):
    """Treetops of several equal cells, which ``treetops_radius`` leaves out."""
    return rounded(maxima.treetop_patches(_steps(spark, sf_dir), "dsm", "chm", 1.0), *CELL)


_LAYER = [f"ring{k}_{n}" for k in (1, 2) for n in ("max", "mean", "min", "variance")]


@query(with_points(f"""SELECT CAST(row_number() OVER (ORDER BY t.cy, t.cx) AS BIGINT) AS id, CAST(any_value(s.source_id) AS BIGINT) AS source_id, t.cx * 1000.0 + 500 AS x, any_value(side) * 1000 - (t.cy * 1000.0 + 500) AS y,
  CAST(coalesce(min(ring) FILTER (WHERE v > z0), 10) * 1000 AS BIGINT) AS radius, t.z AS dsm_z, round(any_value(s.chm), 6) AS height, round(any_value(m.z), 6) AS cmm_z,
  {', '.join(f"round({f}(v) FILTER (WHERE ring = {k}), {4 if n == 'variance' else 6}) AS ring{k}_{n}" for k in (1, 2) for n, f in (("max", "max"), ("mean", "avg"), ("min", "min"), ("variance", "var_pop")))}
  FROM tops t JOIN top s ON s.cx = t.cx AND s.cy = t.cy JOIN cmm m ON m.cx = t.cx AND m.cy = t.cy LEFT JOIN met ON met.cx = t.cx AND met.cy = t.cy, sq GROUP BY t.cx, t.cy, t.z""",
  f"""{HOLED}, {_NINE}, {catalog._TOPS}, {_RINGS}, cmm AS ({catalog._CMM}), {catalog.TERRAIN}, top AS (
  SELECT p.cx, p.cy, {catalog._TOP.format('source_id')} AS source_id, max(z_raw) FILTER (WHERE classification <> 2) - any_value(t.z) AS chm FROM p LEFT JOIN terrain t USING (cx, cy) WHERE ok GROUP BY p.cx, p.cy)"""))
def maxima_layer(spark, sf_dir):
    """Local maxima with their source, canopy height, canopy maxima model and the figures of two rings."""
    p = binned(spark, sf_dir)
    surface = agg.chm(agg.dsm(p), agg.dtm(p)).join(
        catalog.holed(spark, sf_dir).select("cx", "cy"), list(CELL), "left_semi"
    ).withColumn("dsm", F.col("dsm").cast("double"))
    surface = surface.join(stencil.binomial(surface, "dsm"), list(CELL))
    got = rounded(maxima.maxima_layer(surface.select(*CELL, "dsm", F.expr("dsm - dtm").alias("chm"), "cmm", "source_id"), grid(spark, sf_dir), 2))
    return got.select(*(F.round(c, 4).alias(c) if c.endswith("variance") else c for c in got.columns))


# --- crowns ---

_SLOPE = 1 / 16
_TREES = "trees AS (SELECT CAST(b.x AS BIGINT) * side + a.x AS tree_id, a.x AS cx, b.x AS cy FROM xs a, xs b, sq WHERE (a.x * 7 + b.x * 13) % 61 = 0)"
#: Costs on a slope of one in sixteen to the east: every path upwards lies above its treetop. A crown is 12 m high everywhere.
_GROWN = f"""steps AS (SELECT a.x AS dx, b.x AS dy, least(abs(a.x), abs(b.x)) AS n FROM (SELECT unnest(range(-31, 32)) AS x) a, (SELECT unnest(range(-31, 32)) AS x) b),
  priced AS (SELECT dx, dy, CASE WHEN dx > 0 THEN n * (sqrt(2 + {_SLOPE}::DOUBLE * {_SLOPE}) + 2 * {_SLOPE}::DOUBLE) + (abs(dx) - n) * (sqrt(1 + {_SLOPE}::DOUBLE * {_SLOPE}) + 2 * {_SLOPE}::DOUBLE) + (abs(dy) - n)
    ELSE n * sqrt(2::DOUBLE) + (abs(dx) - n) + (abs(dy) - n) END AS cost FROM steps),
  reached AS (SELECT * FROM priced a WHERE EXISTS (SELECT 1 FROM priced b WHERE abs(a.dx - b.dx) <= 1 AND abs(a.dy - b.dy) <= 1 AND b.cost < 12)),
  grown AS (SELECT t.cx + dx AS cx, t.cy + dy AS cy, arg_min(tree_id, {{'c': round(cost, 9), 't': tree_id}}) AS tree_id, min(round(cost, 9)) AS cost
    FROM trees t, reached, sq WHERE t.cx + dx BETWEEN 0 AND side - 1 AND t.cy + dy BETWEEN 0 AND side - 1 GROUP BY 1, 2)"""
_COUNTED = f"""inside AS (SELECT cx, cy, tree_id FROM trees UNION SELECT g.cx, g.cy, g.tree_id FROM inside i JOIN grown g ON g.tree_id = i.tree_id AND abs(g.cx - i.cx) + abs(g.cy - i.cy) = 1),
  counted AS (SELECT tree_id, {', '.join(f"CAST(count(*) FILTER (WHERE (cx + cy) % 11 = {k}) AS BIGINT) AS {n}" for k, n in enumerate(cr.LAND_COVER))} FROM inside GROUP BY tree_id)"""


def _sloped(spark, sf_dir):
    cells = grid_cells(spark, sf_dir).select(*CELL, (25 + F.col("cx") * _SLOPE).alias("dsm"), F.lit(12.0).alias("chm"))
    number = (F.col("cy").cast("long") * grid(spark, sf_dir).size_x + F.col("cx")).alias("tree_id")
    return cells, cells.filter((F.col("cx") * 7 + F.col("cy") * 13) % 61 == 0).select(number, *CELL)


def _classes(spark, sf_dir):
    return grid_cells(spark, sf_dir).select(*CELL, ((F.col("cx") + F.col("cy")) % 11).alias("class"))


@query(with_points("SELECT cx, cy, tree_id, round(cost, 6) AS cost FROM grown", f"{_TREES}, {_GROWN}"))
def crowns(spark, sf_dir):
    return rounded(cr.crowns(*_sloped(spark, sf_dir), 1.0), *CELL)


@query(recursive(with_points("SELECT * FROM counted", f"{_TREES}, {_GROWN}, {_COUNTED}")))
def crown_classes(spark, sf_dir):
    cells, tops = _sloped(spark, sf_dir)
    return cr.crown_classes(cr.crowns(cells, tops, 1.0), tops, _classes(spark, sf_dir))


@query(recursive(with_points(
    f"SELECT tree_id, cx, cy, {', '.join(f'coalesce({n}, 0) AS {n}' for n in cr.LAND_COVER)} FROM (SELECT * FROM trees UNION ALL SELECT -1, 0, 0) LEFT JOIN counted USING (tree_id)",
    f"{_TREES}, {_GROWN}, {_COUNTED}"
)))
def merge_treetops(spark, sf_dir):
    """Layers of four tiles, and of one whose only tree has no crown, merged with their class counts."""
    cells, tops = _sloped(spark, sf_dir)
    counts = cr.crown_classes(cr.crowns(cells, tops, 1.0), tops, _classes(spark, sf_dir))
    tiles = [tops.filter(F.col("tree_id") % 4 == k) for k in range(4)]
    return cr.merge_treetops([*tiles, spark.sql("SELECT -1L AS tree_id, 0 AS cx, 0 AS cy")], counts)


def rough_trees(spark, sf_dir):
    """The fixture's own surface in metres, and its treetops, single ones and patches."""
    high = stage(catalog._high(spark, sf_dir), "high")
    cells = high.select("cx", "cy", (F.col("z") / 1000).alias("dsm"), F.col("h").alias("chm"))
    tree_id = (F.col("cy").cast("long") * grid(spark, sf_dir).size_x + F.col("cx")).alias("tree_id")
    own_z = (F.col("z") / 1000).alias("z")
    single = maxima.treetops_by_radius(high, "z", "h", 1.0)[0].select(tree_id, "cx", "cy", own_z, "h")
    several = maxima.treetop_patches(high, "z", "h", 1.0).select(tree_id, *(F.floor(c).cast("int").alias(f"c{c}") for c in "xy"), own_z, "h")
    return cells, single.unionByName(several)


@query()
def crowns_rough(spark, sf_dir):
    return rounded(cr.crowns(*rough_trees(spark, sf_dir), 1.0), *CELL)
