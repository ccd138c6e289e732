"""Queries over the synthetic points, each with SQL that says the same. Figures are rounded to six places on both sides.

Queries of segmentation, placement and file formats are in modules of their own, which add to the same tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagrid.functions.points import class_flags, coordinate, ground, pack_cell, to_metres, unpack_cell, valid
from stratagrid.operators import aggregates as agg
from stratagrid.operators import grid_metrics as gm
from stratagrid.operators import lookup, maxima, raster, stencil, transform
from stratagrid.operators.binning import cells_under, overlapping
from stratagrid.plans.fixtures import CELLS_SQL, binned, grid, grid_cells, points
from stratagrid.sources.files import layer_counts, tree_size

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def with_points(body: str, more: str = "") -> str:
    return f"WITH {CELLS_SQL}{',' + more if more else ''} {body}"


def rounded(df: DataFrame, *keys: str) -> DataFrame:
    """Doubles to six places, counts to long."""
    kinds = dict(df.dtypes)
    out = []
    for c in df.columns:
        t = kinds[c]
        out.append(F.round(c, 6).alias(c) if t in ("double", "float") else F.col(c).cast("long").alias(c) if t in ("int", "bigint", "smallint") and c not in keys else F.col(c))
    return df.select(*out)


CELL = ("cx", "cy")
R = "round(CAST({} AS DOUBLE), 6)"
TERRAIN = "terrain AS (SELECT cx, cy, sum(z_raw)::DOUBLE / count(*) AS z, count(*) AS n_ground FROM p WHERE ok AND classification = 2 GROUP BY cx, cy)"
SURFACE = "surface AS (SELECT cx, cy, max(z_raw) FILTER (WHERE classification <> 2) AS dsm, avg(z_raw) FILTER (WHERE classification = 2) AS ground_mean FROM p WHERE ok GROUP BY cx, cy)"
#: The raster that the stencils read: the surface, with a hole where the indices say so.
HOLED = SURFACE + ", cells AS (SELECT cx, cy, CAST(dsm AS DOUBLE) AS z FROM surface WHERE dsm IS NOT NULL AND (cx * 7 + cy * 3) % 11 <> 0)"


def holed(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = agg.dsm(binned(spark, sf_dir)).filter("dsm is not null and (cx * 7 + cy * 3) % 11 <> 0")
    return cells.select("cx", "cy", F.col("dsm").cast("double").alias("z"))


# --- points ---


@query(with_points("SELECT classification, CAST(count(*) AS BIGINT) AS n, CAST(sum(z_raw) AS BIGINT) AS z_sum FROM p WHERE ok GROUP BY classification"))
def points_valid(spark, sf_dir):
    return points(spark, sf_dir).filter(valid()).groupBy("classification").agg(F.count("*").alias("n"), F.sum("z_raw").alias("z_sum"))


@query(with_points("SELECT cx, cy, CAST(count(*) AS BIGINT) AS n, CAST(sum(CAST(ok AS INT)) AS BIGINT) AS n_valid FROM p GROUP BY cx, cy"))
def point_bin(spark, sf_dir):
    return binned(spark, sf_dir).groupBy(*CELL).agg(F.count("*").alias("n"), F.count_if(valid()).alias("n_valid"))


@query("""
WITH f AS (SELECT CAST(l_partkey % 256 AS INT) AS b FROM lineitem)
SELECT (b & 1) <> 0 AS synthetic, (b & 2) <> 0 AS key_point, (b & 4) <> 0 AS withheld, (b & 8) <> 0 AS overlap, (b & 64) <> 0 AS scan_direction, (b & 128) <> 0 AS edge,
  CAST(count(*) AS BIGINT) AS n FROM f GROUP BY ALL""")
def flags_decode(spark, sf_dir):
    byte = (F.col("l_partkey") % 256).cast("int")
    flags = class_flags(F.col("b"), extended=True)
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(byte.alias("b")).select(*(v.alias(k) for k, v in flags.items())).groupBy(*flags).agg(F.count("*").alias("n"))


@query(with_points(f"SELECT cx, cy, {R.format('z')} AS z, CAST(n_ground AS BIGINT) AS n_ground FROM terrain", TERRAIN))
def dtm(spark, sf_dir):
    return rounded(agg.dtm(binned(spark, sf_dir)), *CELL)


#: Classes of the fixture spread over more codes, so that every counter has points.
_CODE = "CASE WHEN classification <> 1 THEN classification ELSE CAST(list_extract([0, 1, 3, 4, 5, 6, 9, 12], CAST(blue % 8 + 1 AS INT)) AS INT) END"
_NAMED = ("never_classified", "unclassified", "ground", "low_vegetation", "medium_vegetation", "high_vegetation")


@query(with_points("SELECT tile, " + ", ".join(f"CAST(count(*) FILTER (WHERE ok AND c = {k}) AS BIGINT) AS {v}" for k, v in enumerate(_NAMED)) + """,
  CAST(count(*) FILTER (WHERE c = 7) AS BIGINT) AS low_noise, CAST(count(*) FILTER (WHERE c = 18) AS BIGINT) AS high_noise,
  CAST(count(*) FILTER (WHERE NOT ok AND c NOT IN (7, 18)) AS BIGINT) AS withheld_points, CAST(count(*) FILTER (WHERE ok AND c > 5) AS BIGINT) AS other,
  CAST(count(*) AS BIGINT) AS total FROM (SELECT *, """ + _CODE + " AS c FROM p) GROUP BY tile"))
def class_counts(spark, sf_dir):
    codes = F.array(*(F.lit(k) for k in (0, 1, 3, 4, 5, 6, 9, 12)))
    spread = F.when(F.col("classification") != 1, F.col("classification")).otherwise(F.element_at(codes, (F.col("blue") % 8 + 1).cast("int")))
    return agg.class_counts(points(spark, sf_dir).withColumn("classification", spread))


@query(with_points("""SELECT cx, cy, CAST(count(*) FILTER (WHERE ok) AS BIGINT) AS accepted, round(avg(abs(scan_angle_raw)) FILTER (WHERE ok) * 0.006, 6) AS angle_mean_abs,
  round(min(scan_angle_raw) FILTER (WHERE ok) * 0.006::DOUBLE, 6) AS angle_min, round(max(scan_angle_raw) FILTER (WHERE ok) * 0.006::DOUBLE, 6) AS angle_max,
  round(avg(CAST(scan_direction AS INT)) FILTER (WHERE ok), 6) AS direction_mean, CAST(count(*) FILTER (WHERE NOT ok) AS BIGINT) AS noise_or_withheld,
  CAST(count(*) FILTER (WHERE ok AND edge) AS BIGINT) AS edge_points, CAST(count(*) FILTER (WHERE ok AND overlap) AS BIGINT) AS overlap_points,
  round(min(gps_time) FILTER (WHERE ok), 6) AS gps_min, round(avg(gps_time) FILTER (WHERE ok), 6) AS gps_mean, round(max(gps_time) FILTER (WHERE ok), 6) AS gps_max FROM p GROUP BY cx, cy"""))
def scan_metrics(spark, sf_dir):
    return rounded(agg.scan_metrics(binned(spark, sf_dir)), *CELL)


def _whole(c: str, rn: int) -> str:
    return f"CAST(sum({c}) FILTER (WHERE ok AND return_number={rn}) // nullif(count(*) FILTER (WHERE ok AND return_number={rn}), 0) AS BIGINT)"


@query(with_points(f"""SELECT cx, cy, {_whole('red', 1)} AS red, {_whole('green', 1)} AS green, {_whole('blue', 1)} AS blue, {_whole('intensity', 1)} AS intensity1, {_whole('intensity', 2)} AS intensity2,
  CAST(count(*) FILTER (WHERE ok AND return_number=1) AS BIGINT) AS n_first, CAST(count(*) FILTER (WHERE ok AND return_number=2) AS BIGINT) AS n_second,
  round(avg(abs(scan_angle_raw)) FILTER (WHERE ok) * 0.006, 6) AS angle_mean_abs FROM p WHERE return_number <= 2 GROUP BY cx, cy"""))
def orthoimage(spark, sf_dir):
    return rounded(agg.orthoimage(binned(spark, sf_dir)), *CELL)


@query(with_points("SELECT tile, " + ", ".join(f"{f}({c}) AS {c[0]}_{f}" for c in ("x_raw", "y_raw", "z_raw") for f in ("min", "max")) + " FROM p GROUP BY tile"))
def bounding_boxes(spark, sf_dir):
    return agg.bounding_boxes(points(spark, sf_dir))


_STATS = "CAST(count(*) AS BIGINT) AS cells, CAST(count(*) - count(v) AS BIGINT) AS no_data, round(min(v), 6) AS minimum, round(avg(v), 6) AS mean, round(max(v), 6) AS maximum, round(stddev_pop(v), 6) AS sd"


@query(with_points(f"SELECT {_STATS} FROM (SELECT CAST(dsm AS DOUBLE) AS v FROM surface)", SURFACE))
def band_stats(spark, sf_dir):
    return rounded(agg.band_statistics(agg.dsm(binned(spark, sf_dir)), "dsm", []))


@query(with_points(
    f"SELECT tile, band, {_STATS} FROM (SELECT concat('r', cy // 10, 'c', cx // 10) AS tile, 'dsm' AS band, CAST(dsm AS DOUBLE) AS v FROM surface UNION ALL SELECT concat('r', cy // 10, 'c', cx // 10), 'ground_mean', ground_mean FROM surface) GROUP BY tile, band",
    SURFACE
))
def tile_stats(spark, sf_dir):
    long = raster.unpivot_bands(agg.dsm(binned(spark, sf_dir)).withColumn("tile", raster.tile_of(10)), ["dsm", "ground_mean"], ["tile"])
    return rounded(agg.band_statistics(long, "value", ["tile", "band"]))


@query(with_points(
    "SELECT CAST(CASE WHEN b BETWEEN 0 AND 11 THEN b ELSE -1 END AS INT) AS bin, CAST(count(*) AS BIGINT) AS n FROM (SELECT floor((dsm - 30000) / 2500.0) AS b FROM surface WHERE dsm IS NOT NULL) GROUP BY ALL",
    SURFACE
))
def band_histogram(spark, sf_dir):
    return agg.histogram(agg.dsm(binned(spark, sf_dir)), "dsm", 30000, 2500.0, 12)


@query(with_points(f"SELECT {_STATS} FROM (SELECT CAST(dsm AS DOUBLE) AS v FROM surface)", SURFACE))
def merged_stats(spark, sf_dir):
    parts = agg.band_statistics(agg.dsm(binned(spark, sf_dir)).withColumn("tile", raster.tile_of(8)), "dsm", ["tile"])
    return rounded(agg.merge_statistics(parts, []))


@query(with_points("SELECT CAST(max(n) AS BIGINT) AS maximum, CASE WHEN max(n) < 255 THEN 'uint8' WHEN max(n) < 65535 THEN 'uint16' WHEN max(n) < 4294967295 THEN 'uint32' ELSE 'uint64' END AS type FROM (SELECT count(*) AS n FROM p GROUP BY cx, cy)"))
def compact_type(spark, sf_dir):
    return agg.smallest_integer_type(binned(spark, sf_dir).groupBy(*CELL).count(), "count")


# --- surface ---

_TOP = "first({} ORDER BY z_raw DESC, source_id, return_number, intensity, x_raw, y_raw) FILTER (WHERE classification <> 2)"


@query(with_points(f"""SELECT cx, cy, CAST(max(z_raw) FILTER (WHERE classification <> 2) AS BIGINT) AS dsm, CAST(count(*) FILTER (WHERE classification <> 2) AS BIGINT) AS n_aerial,
  CAST(count(*) FILTER (WHERE classification = 2) AS BIGINT) AS n_ground, round(avg(z_raw) FILTER (WHERE classification <> 2), 6) AS aerial_mean, round(avg(z_raw) FILTER (WHERE classification = 2), 6) AS ground_mean,
  CAST({_TOP.format('source_id')} AS BIGINT) AS source_id, CAST({_TOP.format('return_number')} AS BIGINT) AS return_number FROM p WHERE ok GROUP BY cx, cy"""))
def dsm(spark, sf_dir):
    return rounded(agg.dsm(binned(spark, sf_dir)), *CELL)


@query(with_points("""SELECT s.cx, s.cy, round(CASE WHEN t.z IS NOT NULL THEN dsm - t.z WHEN dsm >= ground_mean THEN dsm - ground_mean END, 6) AS chm
  FROM surface s LEFT JOIN (SELECT * FROM terrain WHERE (cx + cy) % 3 <> 0) t USING (cx, cy)""", f"{TERRAIN}, {SURFACE}"))
def chm(spark, sf_dir):
    p = binned(spark, sf_dir)
    return rounded(agg.chm(agg.dsm(p), agg.dtm(p).filter("(cx + cy) % 3 <> 0")).select("cx", "cy", "chm"), *CELL)


@query(with_points(
    "SELECT cx, cy, CAST(max(z_raw) FILTER (WHERE z_raw <= dsm - 2000) AS BIGINT) AS subsurface FROM p JOIN surface USING (cx, cy) WHERE ok AND classification <> 2 GROUP BY cx, cy",
    SURFACE
))
def subsurface(spark, sf_dir):
    return rounded(agg.dsm(binned(spark, sf_dir), gap=2000).filter("n_aerial > 0").select("cx", "cy", "subsurface"), *CELL)


# --- grid metrics ---

_LISTS = "g AS (SELECT cx, cy, count(*) AS n, list_sort(list(z_raw)) AS z, list_sort(list(intensity)) AS i FROM p WHERE ok GROUP BY cx, cy)"


def _moments(c: str, p: str) -> str:
    d = f"list_transform({c}, lambda x: CAST(x AS HUGEINT))"
    s = {k: f"CAST(list_sum(list_transform({d}, lambda x: {'*'.join(['x'] * k)})) AS HUGEINT)" for k in (1, 2, 3, 4)}
    n = "CAST(n AS HUGEINT)"
    var = f"(CAST({n}*{s[2]} - {s[1]}*{s[1]} AS DOUBLE)/n/n)"
    c3 = f"(CAST({n}*{n}*{s[3]} - 3*{n}*{s[1]}*{s[2]} + 2*{s[1]}*{s[1]}*{s[1]} AS DOUBLE)/n/n)"
    c4 = f"(CAST({n}*{n}*{n}*{s[4]} - 4*{n}*{n}*{s[3]}*{s[1]} + 6*{n}*{s[2]}*{s[1]}*{s[1]} - 3*{s[1]}*{s[1]}*{s[1]}*{s[1]} AS DOUBLE)/n/n/n)"
    return (
        f"round(CAST({s[1]} AS DOUBLE)/n, 6) AS {p}_mean, round(sqrt({var}), 6) AS {p}_sd, "
        f"round(CASE WHEN n > 2 THEN {c3}/pow(nullif({var},0), 1.5)*n/((n-1)*(n-2)) END, 6) AS {p}_skew, round(CASE WHEN n > 3 THEN {c4}/nullif({var},0)/{var}*n*(n+1)/((n-1)*(n-2)*(n-3)) END, 6) AS {p}_kurtosis"
    )


def _q(c: str, k: int, steps: int) -> str:
    return f"{c}[CASE WHEN n < {steps} THEN greatest(CAST(floor({k}*n/{steps}.0 + 0.5) AS INT), 1) ELSE {k}*n//{steps} END]"


_ZQ = "SELECT cx, cy, " + ", ".join(f"CAST({_q('z', k, 20)} AS BIGINT) AS zq{5 * k:02d}" for k in range(1, 20)) + " FROM g"
_CORE = f"SELECT cx, cy, CAST(n AS BIGINT) AS n, CAST(z[n] AS BIGINT) AS z_max, {_moments('z', 'z')} FROM g"
_ENTROPY = """SELECT cx, cy, round(sum(c / n * ln(c / n)) / ln(1 / any_value(h)), 6) AS z_entropy FROM (
  SELECT cx, cy, k, CAST(count(*) AS DOUBLE) AS c, any_value(n) AS n, any_value(h) AS h FROM (
    SELECT cx, cy, n, ceil((z[n] - z[1]) / 1000.0 + 0.5) + 1 AS h, floor((unnest(z) - z[1]) / 1000.0 + 0.5) AS k FROM g) GROUP BY cx, cy, k) GROUP BY cx, cy"""
_ZPCUM = "SELECT cx, cy, " + ", ".join(f"round(len(list_filter(z, lambda x: (x - z[1]) * 10 < {q} * (z[n] - z[1]))) / n, 6) AS zpcum{10 * q}" for q in range(1, 10)) + " FROM g"
_RETURNS = "SELECT cx, cy, " + ", ".join(
    f"round(count(*) FILTER (WHERE return_number={k}) / count(*), 6) AS p_{n}" for k, n in enumerate(gm.RETURNS, 1)
) + ", round(count(*) FILTER (WHERE classification=2) / count(*), 6) AS p_ground FROM p WHERE ok GROUP BY cx, cy"
_I50 = "(CASE WHEN n < 20 THEN greatest(CAST(floor(10*n/20.0 + 0.5) AS INT) - 1, 0) ELSE 10*n//20 - 1 END)"
_INTENSITY = (
    "SELECT cx, cy, CAST(max(i[n]) AS BIGINT) AS i_max, " + ", ".join(f"any_value({c}) AS {c}" for c in ("i_mean", "i_sd", "i_skew", "i_kurtosis")) + ", "
    + ", ".join(f"CAST(any_value({_q('i', k, 10)}) AS BIGINT) AS iq{10 * k}" for k in range(1, 10))
    + ", round(avg(intensity) FILTER (WHERE return_number = 1), 6) AS i_first, round(coalesce(sum(intensity) FILTER (WHERE z_raw >= q50), 0) / (any_value(n) - any_value(i50)), 6) AS i_above_median,"
    + " round(coalesce(sum(intensity) FILTER (WHERE z_raw < q50), 0) / nullif(any_value(i50), 0), 6) AS i_below_median, "
    + ", ".join(f"round(coalesce(sum(intensity) FILTER (WHERE z_raw < {_q('z', 2 * k, 20)}), 0) / sum(intensity), 6) AS ipcumzq{10 * k}" for k in (1, 3, 5, 7, 9))
    + ", CAST(sum(intensity) AS BIGINT) AS i_total, round(coalesce(sum(intensity) FILTER (WHERE classification = 2), 0) / sum(intensity), 6) AS i_pground"
    + " FROM (SELECT *, z[i50 + 1] AS q50 FROM p JOIN h USING (cx, cy) WHERE ok) GROUP BY cx, cy"
)
_H = f"{_LISTS}, h AS (SELECT *, {_I50} AS i50, {_moments('i', 'i')} FROM g)"


def _above_sql(times: int) -> str:
    """Heights over the mean and over the ground, of cells ``times`` as wide."""
    return f"""SELECT c.cx, c.cy, round(any_value(u.z), 6) AS z_ground_mean, round(count(*) FILTER (WHERE z_raw * c.n > c.s) / count(*), 6) AS p_above_mean,
  round(count(*) FILTER (WHERE z_raw > 2000 + coalesce(u.z, 0)) / count(*), 6) AS p_above_threshold
  FROM (SELECT cx // {times} AS cx, cy // {times} AS cy, z_raw FROM p WHERE ok) q
  JOIN (SELECT cx // {times} AS cx, cy // {times} AS cy, count(*) AS n, sum(z_raw) AS s FROM p WHERE ok GROUP BY ALL) c USING (cx, cy)
  LEFT JOIN (SELECT cx // {times} AS cx, cy // {times} AS cy, avg(z) AS z FROM terrain GROUP BY ALL) u USING (cx, cy) GROUP BY c.cx, c.cy"""


def _bands(df: DataFrame, *prefixes: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefixes)]


def _metrics(spark, sf_dir):
    return gm.grid_metrics(binned(spark, sf_dir))


@query(with_points(
    " JOIN ".join([f"SELECT * FROM ({_CORE})", *(f"({x}) USING (cx, cy)" for x in (_ZQ, _ENTROPY, _ZPCUM, _RETURNS, _INTENSITY, _above_sql(1)))]),
    f"{_H}, {TERRAIN}"
))
def grid_metrics(spark, sf_dir):
    """All bands at once: one shuffle of the points."""
    p = binned(spark, sf_dir)
    return rounded(gm.grid_metrics(p, gm.ground_under(agg.dtm(p), 1)), *CELL)


@query(with_points(_CORE, _LISTS))
def gm_core(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir).select(*CELL, "n", "z_max", *(f"z_{k}" for k in gm.MOMENTS)), *CELL)


@query(with_points(_ZQ, _LISTS))
def gm_zquantiles(spark, sf_dir):
    got = _metrics(spark, sf_dir)
    return rounded(got.select(*CELL, *_bands(got, "zq")), *CELL)


@query(with_points(_ENTROPY, _LISTS))
def gm_entropy(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir).select(*CELL, "z_entropy"), *CELL)


@query(with_points(_ZPCUM, _LISTS))
def gm_zpcum(spark, sf_dir):
    got = _metrics(spark, sf_dir)
    return rounded(got.select(*CELL, *_bands(got, "zpcum")), *CELL)


@query(with_points(_RETURNS))
def gm_returns(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir).select(*CELL, *(f"p_{k}" for k in gm.RETURNS), "p_ground"), *CELL)


@query(with_points(_INTENSITY, _H))
def gm_intensity(spark, sf_dir):
    got = _metrics(spark, sf_dir)
    return rounded(got.select(*CELL, *_bands(got, "i")), *CELL)


@query(with_points(_above_sql(2), TERRAIN))
def gm_ground(spark, sf_dir):
    p = binned(spark, sf_dir)
    wide = p.withColumns({"cx": F.floor(F.col("cx") / 2).cast("int"), "cy": F.floor(F.col("cy") / 2).cast("int")})
    return rounded(gm.grid_metrics(wide, gm.ground_under(agg.dtm(p), 2)).select(*CELL, "z_ground_mean", "p_above_mean", "p_above_threshold"), *CELL)


# --- lookups ---


@query(with_points(
    "SELECT cx, cy, CAST(sum(intensity) // count(*) AS BIGINT) AS intensity, CAST(count(*) AS BIGINT) AS n FROM p JOIN terrain USING (cx, cy) WHERE ok AND z_raw - z BETWEEN -5000 AND 10000 GROUP BY cx, cy",
    TERRAIN
))
def intensity_slice(spark, sf_dir):
    p = binned(spark, sf_dir)
    return rounded(agg.intensity_slice(lookup.on_terrain(p, agg.dtm(p)), -5000, 10000), *CELL)


@query(with_points("""SELECT CAST(CASE WHEN ok AND z_raw - z > 20000 THEN 18 WHEN ok AND z_raw - z < -20000 THEN 7 ELSE classification END AS INT) AS classification, CAST(count(*) AS BIGINT) AS n
  FROM p LEFT JOIN (SELECT * FROM terrain WHERE (cx + cy) % 3 <> 0) USING (cx, cy) GROUP BY 1""", TERRAIN))
def noise_repair(spark, sf_dir):
    p = binned(spark, sf_dir)
    return lookup.repair_noise(p, agg.dtm(p).filter("(cx + cy) % 3 <> 0"), -20000, 20000).groupBy("classification").agg(F.count("*").alias("n"))


@query(with_points("SELECT tile, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"CAST(count(*) FILTER (WHERE return_number={k}) AS BIGINT) AS n_return_{k}" for k in range(1, 6)) + ", min(z_raw) AS z_min, max(z_raw) AS z_max FROM p WHERE ok GROUP BY tile"))
def remove_points(spark, sf_dir):
    return lookup.remove_points(points(spark, sf_dir))[1]


@query(with_points("""SELECT q.cx, q.cy, CAST(count(*) AS BIGINT) AS n, round(sum((1-fx)*(1-fy)*a.z + fx*(1-fy)*b.z + (1-fx)*fy*c.z + fx*fy*d.z) + 0.0000001, 3) AS z_sum
  FROM (SELECT *, x_raw/1000.0::DOUBLE - cx AS fx, (side*1000-y_raw)/1000.0::DOUBLE - cy AS fy FROM p WHERE ok) q
  JOIN terrain a ON a.cx=q.cx AND a.cy=q.cy JOIN terrain b ON b.cx=q.cx+1 AND b.cy=q.cy JOIN terrain c ON c.cx=q.cx AND c.cy=q.cy+1 JOIN terrain d ON d.cx=q.cx+1 AND d.cy=q.cy+1
  GROUP BY q.cx, q.cy""", TERRAIN))
def bilinear_lookup(spark, sf_dir):
    p = binned(spark, sf_dir)
    got = lookup.bilinear(p.filter(valid()), agg.dtm(p), grid(spark, sf_dir)).filter("z is not null")
    return got.groupBy(*CELL).agg(F.count("*").alias("n"), F.round(F.sum("z") + 0.0000001, 3).alias("z_sum"))


@query(with_points(
    "SELECT cx, cy, CAST(count(*) AS BIGINT) AS n FROM p WHERE ok AND EXISTS (SELECT 1 FROM surface s WHERE s.cx = p.cx AND s.cy = p.cy AND s.dsm > 55000) GROUP BY cx, cy",
    SURFACE
))
def cell_mask(spark, sf_dir):
    p = binned(spark, sf_dir)
    return lookup.masked(p.filter(valid()), agg.dsm(p).filter("dsm > 55000")).groupBy(*CELL).agg(F.count("*").alias("n"))


# --- stencils ---

_NINE = "d AS (SELECT a.x AS dx, b.y AS dy FROM (VALUES (-1), (0), (1)) a(x), (VALUES (-1), (0), (1)) b(y))"


@query(with_points("""SELECT c.cx, c.cy, round(sum((2-abs(dx))*(2-abs(dy))*o.z) / sum((2-abs(dx))*(2-abs(dy))), 6) AS cmm
  FROM cells c, d JOIN cells o ON o.cx = c.cx + dx AND o.cy = c.cy + dy GROUP BY c.cx, c.cy""", f"{HOLED}, {_NINE}"))
def cmm3(spark, sf_dir):
    return rounded(stencil.binomial(holed(spark, sf_dir), "z"), *CELL)


_FULL = SURFACE + """, cells AS (SELECT a.x AS cx, b.x AS cy, CAST(dsm AS DOUBLE) AS z, (a.x * 7 + b.x * 3) % 11 <> 0 AS measured
  FROM xs a, xs b LEFT JOIN surface s ON s.cx = a.x AND s.cy = b.x), ends AS (SELECT side - 1 AS last FROM sq)"""


def _mean_sql(cells: str) -> str:
    return f"""SELECT c.cx, c.cy, CASE WHEN count(o.z) = 9 THEN sum(o.z) / 9 END AS z
  FROM {cells} c, d, ends JOIN {cells} o ON o.cx = greatest(0, least(last, c.cx + dx)) AND o.cy = greatest(0, least(last, c.cy + dy)) GROUP BY c.cx, c.cy"""


def _stencil_sql(cells: str) -> str:
    return f"SELECT c.cx, c.cy, measured, CASE WHEN measured THEN c.z ELSE coalesce(m.z, c.z) END AS z FROM {cells} c JOIN ({_mean_sql(cells)}) m USING (cx, cy)"


def _full(spark, sf_dir):
    cells = grid_cells(spark, sf_dir).join(
        agg.dsm(binned(spark, sf_dir)).select("cx", "cy", F.col("dsm").cast("double").alias("z")), list(CELL), "left"
    )
    return cells.withColumn("measured", (F.col("cx") * 7 + F.col("cy") * 3) % 11 != 0)


@query(with_points(f"SELECT cx, cy, round(z, 6) AS z FROM ({_mean_sql('cells')})", f"{_FULL}, {_NINE}"))
def mean3x3(spark, sf_dir):
    side = grid(spark, sf_dir).size_x
    return rounded(stencil.mean3(_full(spark, sf_dir), "z", side, side), *CELL)


@query(with_points(
    "SELECT cx, cy, round(z, 6) AS z FROM three",
    f"{_FULL}, {_NINE}, one AS ({_mean_sql('cells')}), two AS ({_mean_sql('one')}), three AS ({_mean_sql('two')})"
))
def smooth_three(spark, sf_dir):
    side = grid(spark, sf_dir).size_x
    return rounded(stencil.smooth(_full(spark, sf_dir), "z", side, side, 3), *CELL)


@query(with_points(
    "SELECT cx, cy, round(z, 6) AS z FROM three",
    f"{_FULL}, {_NINE}, one AS ({_stencil_sql('cells')}), two AS ({_stencil_sql('one')}), three AS ({_stencil_sql('two')})"
))
def stencil_smooth(spark, sf_dir):
    """Three rounds of smoothing with the measured cells put back."""
    side = grid(spark, sf_dir).size_x
    return rounded(stencil.stencil(_full(spark, sf_dir), "measured", side, side, 3).select("cx", "cy", "z"), *CELL)


_COMPASS = {"nw": (-1, -1), "n": (0, -1), "ne": (1, -1), "w": (-1, 0), "c": (0, 0), "e": (1, 0), "sw": (-1, 1), "s": (0, 1), "se": (1, 1)}


def _slope_sql(cells: str) -> str:
    around = ", ".join(f"max(CASE WHEN dx={x} AND dy={y} THEN o.z END) AS {k}" for k, (x, y) in _COMPASS.items())
    return f"""SELECT cx, cy, round(CASE WHEN fx IS NOT NULL AND fy IS NOT NULL THEN degrees(atan(sqrt(fx*fx + fy*fy))) END, 6) AS slope,
    round(CASE WHEN fx IS NOT NULL AND fy IS NOT NULL THEN CASE WHEN t < 0 THEN CASE WHEN t + 360 = 360 THEN 0 ELSE t + 360 END ELSE t END END, 6) AS aspect
  FROM (SELECT *, -degrees(atan2(fx, fy)) - 90 AS t FROM (SELECT cx, cy,
    CASE WHEN nw+ne+sw+se IS NOT NULL THEN (nw-sw+ne-se)/4000 WHEN n+s+e+w IS NOT NULL THEN 2*(n-s)/4000 WHEN n IS NOT NULL THEN 4*(n-c)/4000 ELSE 4*(c-s)/4000 END AS fx,
    CASE WHEN nw+ne+sw+se IS NOT NULL THEN (se-sw+ne-nw)/4000 WHEN n+s+e+w IS NOT NULL THEN 2*(e-w)/4000 WHEN w IS NOT NULL THEN 4*(c-w)/4000 ELSE 4*(e-c)/4000 END AS fy
    FROM (SELECT c.cx, c.cy, {around} FROM {cells} c, d JOIN {cells} o ON o.cx = c.cx + dx AND o.cy = c.cy + dy GROUP BY c.cx, c.cy)))"""


@query(with_points(_slope_sql("cells"), f"{HOLED}, {_NINE}"))
def slope_aspect(spark, sf_dir):
    return rounded(stencil.slope_aspect(holed(spark, sf_dir), "z", 1000.0), *CELL)


_CMM = "SELECT c.cx, c.cy, sum((2-abs(dx))*(2-abs(dy))*o.z) / sum((2-abs(dx))*(2-abs(dy))) AS z FROM cells c, d JOIN cells o ON o.cx = c.cx + dx AND o.cy = c.cy + dy GROUP BY c.cx, c.cy"


@query(with_points(
    f"SELECT cx, cy, a.slope AS z_slope, a.aspect AS z_aspect, b.slope AS cmm_slope, b.aspect AS cmm_aspect FROM ({_slope_sql('cells')}) a JOIN ({_slope_sql('cmm')}) b USING (cx, cy)",
    f"{HOLED}, {_NINE}, cmm AS ({_CMM})"
))
def slope_aspect_bands(spark, sf_dir):
    """Slope and aspect of the surface and of the canopy maxima model together."""
    cells = holed(spark, sf_dir)
    both = cells.join(stencil.binomial(cells, "z"), list(CELL))
    return rounded(stencil.slope_aspect_of(both, ["z", "cmm"], 1000.0), *CELL)


def _fill_sql(reach: int, directions: int, squared: bool) -> str:
    diagonal = round(reach / stencil.DIAGONAL)
    rays = [(x, y, d) for x, y in ((1, 0), (-1, 0), (0, 1), (0, -1)) for d in range(1, reach + 1)]
    if directions == 8:
        rays += [(x, y, d) for x in (1, -1) for y in (1, -1) for d in range(1, diagonal + 1)]
    values = ", ".join(f"({x},{y},{d})" for x, y, d in rays)
    weight = "CASE WHEN rx<>0 AND ry<>0 THEN 0.5/(d*d) ELSE 1.0/(d*d) END" if squared else "CASE WHEN rx<>0 AND ry<>0 THEN 1/(1.414214*d) ELSE 1.0/d END"
    return with_points(f"""SELECT cx, cy, round(z, 6) AS z, false AS filled FROM cells UNION ALL
      SELECT hx, hy, round(sum(w * z) / sum(w), 6), true FROM (SELECT hx, hy, z, CAST({weight} AS DOUBLE) AS w FROM (
        SELECT hx, hy, rx, ry, min(d)::DOUBLE AS d, arg_min(c.z, d) AS z FROM holes, r JOIN cells c ON c.cx = hx + rx*d AND c.cy = hy + ry*d GROUP BY hx, hy, rx, ry)) GROUP BY hx, hy""",
        f"{HOLED}, r AS (SELECT * FROM (VALUES {values}) t(rx, ry, d)), holes AS (SELECT a.x AS hx, b.x AS hy FROM xs a, xs b WHERE NOT EXISTS (SELECT 1 FROM cells c WHERE c.cx = a.x AND c.cy = b.x))")


def _fill(directions: int, squared: bool):
    def run(spark, sf_dir):
        return rounded(stencil.fill(holed(spark, sf_dir), grid_cells(spark, sf_dir), "z", 5, directions, squared), *CELL)

    run.__name__ = f"fill_{directions}dir_{'squared' if squared else 'linear'}"
    query(_fill_sql(5, directions, squared))(run)


for _d in (8, 4):
    for _s in (False, True):
        _fill(_d, _s)


# --- maxima and treetops ---

_TOPS = "tops AS (SELECT c.cx, c.cy, c.z FROM cells c WHERE NOT EXISTS (SELECT 1 FROM cells o WHERE abs(o.cx - c.cx) <= 1 AND abs(o.cy - c.cy) <= 1 AND o.z > c.z))"
_RINGS = """rings AS (SELECT x AS dx, y AS dy, CAST(floor(sqrt(x*x + y*y) + 0.5) AS INT) AS ring FROM range(-11, 12) a(x), range(-11, 12) b(y) WHERE floor(sqrt(x*x + y*y) + 0.5) BETWEEN 1 AND 10),
  met AS (SELECT t.cx, t.cy, t.z AS z0, ring, o.z AS v FROM tops t, rings JOIN cells o ON o.cx = t.cx + dx AND o.cy = t.cy + dy)"""


@query(with_points(
    "SELECT t.cx, t.cy, t.z, CAST(coalesce(min(ring) FILTER (WHERE v > z0), 10) AS BIGINT) AS radius FROM tops t LEFT JOIN met USING (cx, cy) GROUP BY t.cx, t.cy, t.z",
    f"{HOLED}, {_TOPS}, {_RINGS}"
))
def local_maxima(spark, sf_dir):
    return rounded(maxima.local_maxima(holed(spark, sf_dir), "z", 0), *CELL)


@query(with_points(
    "SELECT cx, cy, " + ", ".join(
        f"round({f}(v) FILTER (WHERE ring = {k}), {4 if n == 'variance' else 6}) AS ring{k}_{n}" for k in range(1, 6) for n,
        f in (("max", "max"), ("mean", "avg"), ("min", "min"), ("variance", "var_pop"))
    ) + " FROM met GROUP BY cx, cy",
    f"{HOLED}, {_TOPS}, {_RINGS}"
))
def ring_stats(spark, sf_dir):
    got = maxima.local_maxima(holed(spark, sf_dir), "z")
    return got.select("cx", "cy", *(F.round(c, 4 if c.endswith("variance") else 6).alias(c) for c in got.columns if c.startswith("ring")))


_HIGH = HOLED + ", high AS (SELECT *, (z - 20000) / 1000.0 AS h FROM cells)"


def _high(spark, sf_dir):
    return holed(spark, sf_dir).withColumn("h", (F.col("z") - 20000) / 1000.0)


@query(with_points("""SELECT t.cx, t.cy, t.z, CAST(t.rr AS BIGINT) AS radius FROM t WHERE NOT EXISTS (
    SELECT 1 FROM cells o, range(-6, 7) w(dy) WHERE abs(dy) <= t.rr AND o.cy = t.cy + dy AND o.z > t.z AND abs(o.cx - t.cx) <= greatest(CASE WHEN abs(dy) < t.r THEN floor(sqrt(greatest(t.r*t.r - dy*dy, 0)) + 0.5) ELSE 0 END, CASE WHEN abs(dy) < 2 THEN 1 ELSE 0 END))
  AND NOT EXISTS (SELECT 1 FROM cells o WHERE abs(o.cx - t.cx) <= 1 AND abs(o.cy - t.cy) <= 1 AND (o.cx <> t.cx OR o.cy <> t.cy) AND o.z = t.z)""",
    _HIGH + ", t AS (SELECT cx, cy, z, least(0.055*h + 0.4, 5.0)::DOUBLE AS r, greatest(floor(least(0.055*h + 0.4, 5.0) + 0.5), 1) AS rr FROM high WHERE h >= 1.5)"))
def treetops_radius(spark, sf_dir):
    return rounded(maxima.treetops_by_radius(_high(spark, sf_dir), "z", "h", 1.0)[0].select("cx", "cy", "z", "radius"), *CELL)


@query(with_points("""SELECT cx, cy, any_value(z0) AS z, round(sum(z0 - top) * 0.001 / any_value(h), 6) AS prominence, max(top) FILTER (WHERE ring <= i) = any_value(z0) AS patch
  FROM (SELECT t.cx, t.cy, m.ring, any_value(t.z) AS z0, any_value(t.h) AS h, any_value(t.m) AS m, any_value(t.i) AS i, max(v) AS top FROM t JOIN met m ON m.cx = t.cx AND m.cy = t.cy AND m.ring <= t.m GROUP BY t.cx, t.cy, m.ring)
  GROUP BY cx, cy HAVING count(*) = any_value(m) AND max(top) FILTER (WHERE ring <= i) <= any_value(z0) AND sum(z0 - top) * 0.001 / any_value(h) > 0.02""",
    f"""{_HIGH}, {_TOPS}, {_RINGS}, t AS (SELECT *, CAST(greatest(round_even(floor(m / 2) + 0.5, 0), 1) AS INT) + 1 AS i FROM (
      SELECT cx, cy, z, h, CAST(least(floor(least(0.045*h + 0.5, 4.0) + 0.5), 10) AS INT) AS m FROM high WHERE h >= 1.5))"""))
def treetops_ring(spark, sf_dir):
    got = maxima.treetops_by_rings(_high(spark, sf_dir), "z", "h", 1.0, unit=0.001)
    return got.select("cx", "cy", "z", F.round("prominence", 6).alias("prominence"), "patch")


# --- transforms, assembly, tables ---


@query(with_points("SELECT CAST(greatest(return_number - 1, 1) AS INT) AS return_number, CAST(CASE classification WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 5 THEN 3 ELSE classification END AS INT) AS classification, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY 1, 2"))
def return_repair(spark, sf_dir):
    zeroed = points(spark, sf_dir).withColumn("return_number", F.col("return_number") - 1)
    return transform.repair_classes(transform.repair_returns(zeroed)).groupBy("return_number", "classification").agg(F.count("*").alias("n"))


@query(with_points("SELECT tile, min(x_raw) AS min_x_raw, max(x_raw) AS max_x_raw, min(y_raw) AS min_y_raw, max(y_raw) AS max_y_raw, min(z_raw) AS min_z_raw, max(z_raw) AS max_z_raw FROM p GROUP BY tile"))
def raw_bounds(spark, sf_dir):
    return transform.raw_bounds(points(spark, sf_dir))


@query("SELECT o_orderkey, CAST(i AS INT) AS i FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders) WHERE i = 0 OR floor(i * greatest(5.0::DOUBLE / n, 0.1)) <> floor((i - 1) * greatest(5.0::DOUBLE / n, 0.1))")
def tile_sample(spark, sf_dir):
    return raster.sample_tiles(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey"), ["o_orderkey"], 5, 0.1)


_EXT = "CASE doc_id % 8 WHEN 0 THEN 'las' WHEN 1 THEN 'laz' WHEN 2 THEN 'tif' WHEN 3 THEN 'jpg' WHEN 4 THEN 'ldr' WHEN 5 THEN 'geoslam' WHEN 6 THEN 'fjdslam' ELSE 'txt' END"


@query("SELECT concat('/', source) AS path, " + ", ".join(
    f"CAST(sum(CASE WHEN e = '{e}' THEN n_chars ELSE 0 END) AS BIGINT) AS {k}" for k,
    e in {"fjdslam": "fjdslam", "geoslam": "geoslam", "jpeg": "jpg", "ldr": "ldr", "las": "las", "laz": "laz", "tiff": "tif"}.items()
) + f", CAST(sum(n_chars) AS BIGINT) AS total FROM (SELECT *, {_EXT} AS e FROM documents) GROUP BY source")
def file_tree_size(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tree_size(docs.select(
        F.expr(f"concat('/', source, '/', cast(doc_id as string), '.', {_EXT})").alias("path"), F.col("n_chars").alias("length")
    ))


#: Boxes of one to eight metres around places that the suppliers' keys give, some of them across the edge of the grid or off it.
_BOXES = """boxes AS (SELECT s_suppkey AS id, CAST(x AS INT) AS xmin, CAST(x + 1000 + s_suppkey * 131 % 7000 AS INT) AS xmax, CAST(y AS INT) AS ymin, CAST(y + 1000 + s_suppkey * 389 % 7000 AS INT) AS ymax
  FROM (SELECT s_suppkey, s_suppkey * 7919 % (side * 1000 + 12000) - 10000 AS x, s_suppkey * 104729 % (side * 1000 + 12000) - 10000 AS y FROM supplier, sq))"""


def _boxes(spark, sf_dir):
    k, span = F.col("s_suppkey"), grid(spark, sf_dir).y0 + 12000
    x, y = k * 7919 % span - 10000, k * 104729 % span - 10000
    place = {"xmin": x, "xmax": x + 1000 + k * 131 % 7000, "ymin": y, "ymax": y + 1000 + k * 389 % 7000}
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(k.alias("id"), *(v.cast("int").alias(n) for n, v in place.items()))


@query(with_points("""SELECT id, a.x AS cx, b.x AS cy FROM boxes, sq, xs a, xs b WHERE xmax >= 0 AND xmin <= side * 1000 AND ymax >= 0 AND ymin <= side * 1000
  AND a.x BETWEEN greatest(0, least(side - 1, floor(xmin/1000.0))) AND greatest(0, least(side - 1, floor(xmax/1000.0)))
  AND b.x BETWEEN greatest(0, least(side - 1, floor((side*1000-ymax)/1000.0))) AND greatest(0, least(side - 1, floor((side*1000-ymin)/1000.0)))""", _BOXES))
def extent_cells(spark, sf_dir):
    return cells_under(_boxes(spark, sf_dir), grid(spark, sf_dir)).select("id", "cx", "cy")


@query(with_points(
    "SELECT a.id AS left_id, b.id AS right_id FROM boxes a JOIN boxes b ON a.xmin <= b.xmax AND b.xmin <= a.xmax AND a.ymin <= b.ymax AND b.ymin <= a.ymax",
    _BOXES
))
def extent_overlaps(spark, sf_dir):
    boxes = _boxes(spark, sf_dir)
    return overlapping(boxes, boxes, 10000)


@query(with_points("SELECT DISTINCT tile FROM p WHERE tile NOT IN (SELECT tile FROM p WHERE source_id % 8 < 5)"))
def unmerged_tiles(spark, sf_dir):
    p = points(spark, sf_dir)
    return lookup.unmatched(p.select("tile").distinct(), p.filter("source_id % 8 < 5"))


@query(with_points("SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(z_raw) AS BIGINT) AS z_sum FROM p WHERE ok AND classification = 2"))
def ground_points(spark, sf_dir):
    return points(spark, sf_dir).filter(ground()).agg(F.count("*").alias("n"), F.sum("z_raw").alias("z_sum"))


# --- placement, names, tile sets ---

_EXTENTS = "ext AS (SELECT tile, min(x_raw) AS xmin, max(x_raw) AS xmax, min(y_raw) AS ymin, max(y_raw) AS ymax FROM p GROUP BY tile)"


def _extents(spark, sf_dir):
    return points(spark, sf_dir).groupBy("tile").agg(
        F.min("x_raw").alias("xmin"), F.max("x_raw").alias("xmax"), F.min("y_raw").alias("ymin"), F.max("y_raw").alias("ymax")
    )


@query(with_points("""SELECT tile, round(min(x), 6) AS xmin, round(max(x), 6) AS xmax, round(min(y), 6) AS ymin, round(max(y), 6) AS ymax FROM (
  SELECT tile, cx_ * cos(0.3::DOUBLE) - cy_ * sin(0.3::DOUBLE) + 100 AS x, cx_ * sin(0.3::DOUBLE) + cy_ * cos(0.3::DOUBLE) - 50 AS y
  FROM (SELECT tile, unnest([xmin, xmin, xmax, xmax]) AS cx_, unnest([ymin, ymax, ymin, ymax]) AS cy_ FROM ext)) GROUP BY tile""", _EXTENTS))
def rotated_extents(spark, sf_dir):
    placed = _extents(spark, sf_dir).withColumns({"angle": F.lit(0.3), "tx": F.lit(100), "ty": F.lit(-50)})
    return transform.rotated_extent(placed).select("tile", *(F.round(f"new_{c}", 6).alias(c) for c in ("xmin", "xmax", "ymin", "ymax")))


@query(with_points("""SELECT tile, CAST(x0 AS BIGINT) AS gx0, CAST(x1 AS BIGINT) AS gx1, CAST(y0 AS BIGINT) AS gy0, CAST(y1 AS BIGINT) AS gy1, CAST((x1 - x0) / 1500 AS INT) AS size_x, CAST((y1 - y0) / 1500 AS INT) AS size_y FROM (
  SELECT tile, floor(xmin / 1500.0) * 1500 AS x0, ceil(xmax / 1500.0) * 1500 AS x1, floor(ymin / 1500.0) * 1500 AS y0, ceil(ymax / 1500.0) * 1500 AS y1 FROM ext)""", _EXTENTS))
def snapped_grids(spark, sf_dir):
    return transform.snapped_grid(_extents(spark, sf_dir), 1500).select(
        "tile", *(F.col(c).cast("long").alias(c) for c in ("gx0", "gx1", "gy0", "gy1")), "size_x", "size_y"
    )


@query(with_points("SELECT tile, round(min(600000 + x_raw * 0.001::DOUBLE), 6) AS x_min, round(max(z_raw * 0.001::DOUBLE), 6) AS z_max, round(max(z_raw * 0.3048::DOUBLE), 6) AS z_metres FROM p GROUP BY tile"))
def scaled_coordinates(spark, sf_dir):
    xyz = points(spark, sf_dir).select(
        "tile", coordinate(F.col("x_raw"), 0.001, 600000.0).alias("x"), coordinate(F.col("z_raw"), 0.001, 0.0).alias("z"),
        to_metres(F.col("z_raw"), True).alias("m")
    )
    return rounded(xyz.groupBy("tile").agg(F.min("x").alias("x_min"), F.max("z").alias("z_max"), F.max("m").alias("z_metres")), "tile")


@query(with_points("SELECT tile, CAST(21 AS INT) AS source_id, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY tile"))
def source_override(spark, sf_dir):
    return transform.set_source(points(spark, sf_dir), 21).groupBy("tile", "source_id").agg(F.count("*").alias("n"))


@query(with_points("SELECT DISTINCT cx, cy, CAST(cx AS BIGINT) * 4294967296 + cy AS packed FROM p"))
def packed_cells(spark, sf_dir):
    packed = binned(spark, sf_dir).select(pack_cell(F.col("cx"), F.col("cy")).alias("packed")).distinct()
    x, y = unpack_cell(F.col("packed"))
    return packed.select(x.cast("int").alias("cx"), y.cast("int").alias("cy"), "packed")


@query(with_points("SELECT CAST(floor(cy / 10) AS INT) AS tile_y, CAST(floor(cx / 10) AS INT) AS tile_x, concat('r', CAST(floor(cy / 10) AS INT), 'c', CAST(floor(cx / 10) AS INT)) AS name, CAST(count(*) AS BIGINT) AS n FROM p GROUP BY ALL ORDER BY 1, 2"))
def tiles_row_major(spark, sf_dir):
    where = [F.floor(F.col(c) / 10).cast("int").alias(f"tile_{c[1]}") for c in ("cy", "cx")]
    return raster.row_major(binned(spark, sf_dir).select(*where, raster.tile_of(10).alias("name")).groupBy("tile_y", "tile_x", "name").agg(F.count("*").alias("n")))


@query(with_points("SELECT name, tile FROM (SELECT DISTINCT 'low' AS name, tile FROM p WHERE source_id % 8 < 6 UNION ALL SELECT DISTINCT 'high', tile FROM p WHERE source_id % 8 > 1) WHERE tile IN ('t0', 't1', 't6', 't7')"))
def misaligned_tiles(spark, sf_dir):
    p = points(spark, sf_dir)
    return raster.misaligned({"low": p.filter("source_id % 8 < 6"), "high": p.filter("source_id % 8 > 1")})


@query(with_points("SELECT tile_x, CAST(0 AS INT) AS tile_y, tile, CAST(n AS BIGINT) AS n FROM (SELECT CAST(substr(tile, 2) AS INT) AS tile_x, tile, count(*) AS n FROM p GROUP BY tile)"))
def assembled_tiles(spark, sf_dir):
    n = points(spark, sf_dir).groupBy("tile").agg(F.count("*").alias("n")).select(
        F.substring("tile", 2, 9).cast("int").alias("tile_x"), F.lit(0).alias("tile_y"), "tile", "n"
    )
    return raster.assemble([n.filter("tile_x < 3"), n.filter("tile_x >= 3")])


@query(with_points(
    "SELECT cx, cy, 'z' AS band, round(z, 6) AS value FROM terrain UNION ALL SELECT cx, cy, 'n_ground', CAST(n_ground AS DOUBLE) FROM terrain",
    TERRAIN
))
def band_rows(spark, sf_dir):
    return rounded(raster.unpivot_bands(agg.dtm(binned(spark, sf_dir)), ["z", "n_ground"], list(CELL)), *CELL)


_BAND = "CASE l_linenumber WHEN 1 THEN 'red' WHEN 2 THEN 'Green' WHEN 3 THEN 'blue' WHEN 4 THEN 'NIR' ELSE 'intensity' END"


@query(f"SELECT DISTINCT {_BAND} AS band, CASE l_linenumber WHEN 1 THEN 'Red' WHEN 2 THEN 'Green' WHEN 3 THEN 'Blue' WHEN 4 THEN 'NIR' ELSE 'Gray' END AS colour FROM lineitem")
def band_colours(spark, sf_dir):
    bands = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.expr(_BAND).alias("band")).distinct()
    return bands.select("band", raster.colour_interpretation(F.col("band")).alias("colour"))


@query("SELECT source AS file, lang AS layer, CAST(count(*) AS BIGINT) AS features FROM documents GROUP BY source, lang")
def vector_layer_counts(spark, sf_dir):
    return layer_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("source").alias("file"), F.col("lang").alias("layer")))
