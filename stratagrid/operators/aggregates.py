"""Per-cell and per-tile aggregates. Each is one grouping whose sums combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagrid.functions.points import GROUND, HIGH_NOISE, LOW_NOISE, aerial, ground, ratio, valid

CELL = ["cx", "cy"]


def dtm(points: DataFrame) -> DataFrame:
    """Terrain: mean and number of ground points by cell."""
    return points.filter(ground()).groupBy(*CELL).agg(
        ratio(F.sum(F.col("z_raw").cast("long")), F.count("*")).alias("z"), F.count("*").alias("n_ground")
    )


def _z_order(seq: str | None) -> Column:
    """Greatest for the top point. Of equal heights the first read wins where points have a sequence, else values settle it."""
    if seq:
        return F.struct("z_raw", (-F.col(seq)).alias(seq))
    return F.struct("z_raw", *((-F.col(c)).alias(c) for c in ("source_id", "return_number", "intensity", "x_raw", "y_raw")))


def dsm(points: DataFrame, gap: int | None = None, seq: str | None = None) -> DataFrame:
    """Surface: top of the aerial points with its source and return, means and counts of aerial and ground points.

    With ``gap`` also the subsurface: the highest aerial point at least ``gap`` below the top, by a second grouping of
    the points that lie that far below.
    """
    up, down = aerial(), ground()
    z = F.col("z_raw")
    top = F.max_by(F.struct("source_id", "return_number"), F.when(up, _z_order(seq)))
    aggs = [
        F.max(F.when(up, z)).alias("dsm"), top.alias("top"), F.count_if(up).alias("n_aerial"), F.count_if(down).alias("n_ground"),
        ratio(F.sum(F.when(up, z.cast("long"))), F.count_if(up)).alias("aerial_mean"), ratio(F.sum(F.when(down, z.cast("long"))), F.count_if(down)).alias("ground_mean"),
    ]
    out = points.filter(valid()).groupBy(*CELL).agg(*aggs)
    more = {
        "source_id": F.when(F.col("n_aerial") > 0, F.col("top.source_id")), "return_number": F.when(F.col("n_aerial") > 0, F.col("top.return_number"))
    }
    out = out.withColumns(more).drop("top")
    if gap is None:
        return out
    under = points.filter(up).select(*CELL, "z_raw").join(out.select(*CELL, "dsm"), CELL).filter(F.col("z_raw") <= F.col("dsm") - gap)
    return out.join(under.groupBy(*CELL).agg(F.max("z_raw").alias("subsurface")), CELL, "left")


def chm(surface: DataFrame, terrain: DataFrame) -> DataFrame:
    """Adds ``chm``: surface less terrain; without terrain, less the cell's own ground mean if that is not above the surface."""
    both = surface.join(terrain.select(*CELL, F.col("z").alias("dtm")), CELL, "left")
    own = F.when(F.col("dsm") >= F.col("ground_mean"), F.col("dsm") - F.col("ground_mean"))
    return both.withColumn("chm", F.when(F.col("dtm").isNotNull(), F.col("dsm") - F.col("dtm")).otherwise(own))


def scan_metrics(points: DataFrame) -> DataFrame:
    """How a cell was scanned. Withheld and noise points are counted, all else is over the valid ones."""
    ok, angle = valid(), F.col("scan_angle_raw").cast("long")
    n = F.count_if(ok)
    return points.groupBy(*CELL).agg(
        n.alias("accepted"), (ratio(F.sum(F.when(ok, F.abs(angle))), n) * 0.006).alias("angle_mean_abs"), (F.min(F.when(ok, angle)) * 0.006).alias("angle_min"), (F.max(F.when(ok, angle)) * 0.006).alias("angle_max"),
        ratio(F.count_if(ok & F.col("scan_direction")), n).alias("direction_mean"), F.count_if(~ok).alias("noise_or_withheld"), F.count_if(ok & F.col("edge")).alias("edge_points"), F.count_if(ok & F.col("overlap")).alias("overlap_points"),
        F.min(F.when(ok, F.col("gps_time"))).alias("gps_min"), ratio(F.sum(F.when(ok, F.col("gps_time"))), n).alias("gps_mean"), F.max(F.when(ok, F.col("gps_time"))).alias("gps_max"),
    )


def orthoimage(points: DataFrame, bands: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """Colours and intensity of first returns, intensity of second ones; means are whole numbers, without points null."""
    rn = F.col("return_number")
    first, second = valid() & (rn == 1), valid() & (rn == 2)
    whole = lambda c, on: F.expr("null") if c is None else F.floor(ratio(F.sum(F.when(on, F.col(c).cast("long"))), F.count_if(on))).cast("long")
    return points.filter(rn <= 2).groupBy(*CELL).agg(
        *(whole(b, first).alias(b) for b in bands), whole("intensity", first).alias("intensity1"), whole("intensity", second).alias("intensity2"),
        F.count_if(first).alias("n_first"), F.count_if(second).alias("n_second"), (ratio(
            F.sum(F.when(first | second, F.abs(F.col("scan_angle_raw").cast("long")))), F.count_if(first | second)
        ) * 0.006).alias("angle_mean_abs"),
    )


def intensity_slice(points_on_terrain: DataFrame, low: float, high: float) -> DataFrame:
    """Whole mean intensity of the points whose height over ``dtm`` is from ``low`` to ``high``, both included."""
    inside = valid() & (F.col("z_raw") - F.col("dtm")).between(low, high)
    return points_on_terrain.filter(inside).groupBy(*CELL).agg(
        F.expr("sum(cast(intensity as bigint)) div count(*)").alias("intensity"), F.count("*").alias("n")
    )


# Names of the class counters; all other classes are counted together.
CLASS_COUNTERS = {0: "never_classified", 1: "unclassified", 2: "ground", 3: "low_vegetation", 4: "medium_vegetation", 5: "high_vegetation"}


def class_counts(points: DataFrame, by: str = "tile") -> DataFrame:
    """Points by class; of the invalid ones noise counts under its class, others as withheld."""
    cls, ok = F.col("classification"), valid()
    noise = {LOW_NOISE: "low_noise", HIGH_NOISE: "high_noise"}
    named = [F.count_if(ok & (cls == k)).alias(v) for k, v in CLASS_COUNTERS.items()]
    others = F.count_if(ok & ~cls.isin(*CLASS_COUNTERS)).alias("other")
    return points.groupBy(by).agg(
        *named, *(F.count_if(cls == k).alias(v) for k, v in noise.items()), F.count_if(~ok & ~cls.isin(*noise)).alias("withheld_points"), others,
        F.count("*").alias("total")
    )


def bounding_boxes(points: DataFrame, by: str = "tile") -> DataFrame:
    return points.groupBy(by).agg(*(f(c).alias(f"{c[0]}_{n}") for c in ("x_raw", "y_raw", "z_raw") for n, f in (("min", F.min), ("max", F.max))))


def band_statistics(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Cells, missing cells, least, greatest, mean and population deviation of a band."""
    v = F.col(value).cast("double")
    return rows.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count_if(v.isNull()).alias("no_data"), F.min(v).alias("minimum"), F.avg(v).alias("mean"), F.max(v).alias("maximum"), F.stddev_pop(v).alias("sd")
    )


def merge_statistics(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics of a union from statistics of its parts."""
    n = F.col("cells") - F.col("no_data")
    total, squares = F.sum(n * F.col("mean")), F.sum(n * (F.col("sd") ** 2 + F.col("mean") ** 2))
    mean = ratio(total, F.sum(n))
    return parts.groupBy(*by).agg(
        F.sum("cells").alias("cells"), F.sum("no_data").alias("no_data"), F.min("minimum").alias("minimum"), mean.alias("mean"), F.max("maximum").alias("maximum"),
        F.sqrt(F.greatest(F.lit(0.0), ratio(squares, F.sum(n)) - mean * mean)).alias("sd"),
    )


#: Most bins of a histogram.
MOST_BINS = 1_000_000


def histogram(rows: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """Counts of bins of one width; values outside are in bin -1."""
    if not 0 < bins <= MOST_BINS:
        raise ValueError(f"a histogram has 1 to {MOST_BINS} bins, not {bins}")
    at = F.floor((F.col(value) - low) / width)
    return rows.filter(F.col(value).isNotNull()).groupBy(F.when((at >= 0) & (at < bins), at).otherwise(-1).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def smallest_integer_type(rows: DataFrame, value: str) -> DataFrame:
    """Narrowest unsigned type that holds a band and leaves its greatest value for missing data."""
    top = F.max(value)
    return rows.agg(
        top.alias("maximum"),
        F.when(top < 255, "uint8").when(top < 65535, "uint16").when(top < 4294967295, "uint32").otherwise("uint64").alias("type")
    )


def percent_ground(points: DataFrame) -> DataFrame:
    return points.filter(valid()).groupBy(*CELL).agg(ratio(F.count_if(F.col("classification") == GROUND), F.count("*")).alias("p_ground"))


# Least and greatest of each integer type, and the value that stands for missing data.
_RANGES = {f"{'u' if u else ''}int{b}": (
    0 if u else -(1 << b - 1), (1 << b) - 1 if u else (1 << b - 1) - 1
) for u in (True, False) for b in (8, 16, 32, 64)}


def saturating_cast(value: Column, kind: str) -> Column:
    """Values as ``kind`` (``uint8`` to ``int64``), rounded half to even and held to its range less the value for missing data, which nulls become.

    That value is the most positive of an unsigned type and the most negative of a signed one.
    """
    least, most = _RANGES[kind]
    missing = most if least == 0 else least
    low, high = (least, most - 1) if least == 0 else (least + 1, most)
    wide = "decimal(20,0)"
    held = F.greatest(F.least(F.bround(value.cast("decimal(38,6)"), 0), F.lit(high).cast("decimal(38,0)")), F.lit(low).cast("decimal(38,0)"))
    return F.when(value.isNotNull(), held.cast(wide)).otherwise(F.lit(missing).cast(wide))


def restore_missing(value: Column, kind: str) -> Column:
    """Null where ``value`` is the one that stands for missing data in ``kind``."""
    least, most = _RANGES[kind]
    return F.nullif(value.cast("decimal(20,0)"), F.lit(most if least == 0 else least).cast("decimal(20,0)"))
