"""Point transforms: registration, repairs, bounds, linearised change of coordinate system."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _toward_zero(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)).cast("int")


def rotate_shift(points: DataFrame, params: DataFrame, key: str = "tile") -> DataFrame:
    """Shift raw coordinates by less ``tx, ty`` (and ``tz``), then rotate by ``angle`` (radians), as given for the point's file; a half is added, then truncated."""
    both = points.join(params.select(key, "tx", "ty", "angle", *(c for c in ("tz",) if c in params.columns)), key)
    dx, dy, cos, sin = F.col("x_raw") - F.col("tx"), F.col("y_raw") - F.col("ty"), F.cos("angle"), F.sin("angle")
    moved = {"x_raw": _toward_zero(dx * cos - dy * sin + 0.5), "y_raw": _toward_zero(dx * sin + dy * cos + 0.5)}
    if "tz" in params.columns:
        moved["z_raw"] = _toward_zero(F.col("z_raw") - F.col("tz") + 0.5)
    return both.withColumns(moved).drop("tx", "ty", "tz", "angle")


def repair_returns(points: DataFrame) -> DataFrame:
    """Return numbers and numbers of returns of 0 become 1."""
    return points.withColumns({c: F.when(F.col(c) == 0, 1).otherwise(F.col(c)) for c in ("return_number", "number_of_returns") if c in points.columns})


def repair_classes(points: DataFrame) -> DataFrame:
    """One step of 0 to 1, 1 to 2, 5 to 3."""
    c = F.col("classification")
    return points.withColumn("classification", F.when(c == 0, 1).when(c == 1, 2).when(c == 5, 3).otherwise(c))


def set_source(points: DataFrame, source_id: int) -> DataFrame:
    return points.withColumn("source_id", F.lit(source_id))


def register(points: DataFrame, params: DataFrame, key: str = "tile", fix_classes: bool = False) -> DataFrame:
    """Place files: rotation and shift, return numbers and optionally classes repaired, source id of the file if given."""
    out = repair_returns(rotate_shift(points, params, key))
    if "new_source_id" in params.columns:
        out = out.join(params.select(key, "new_source_id"), key).withColumn("source_id", F.coalesce("new_source_id", "source_id")).drop("new_source_id")
    return repair_classes(out) if fix_classes else out


def raw_bounds(points: DataFrame, key: str = "tile") -> DataFrame:
    return points.groupBy(key).agg(*(f(c).alias(f"{n}_{c}") for c in ("x_raw", "y_raw", "z_raw") for n, f in (("min", F.min), ("max", F.max))))


def rotated_extent(extents: DataFrame) -> DataFrame:
    """Extents after rotation by ``angle`` about the origin and a shift by ``tx, ty``: bounds of the four corners."""
    corner = lambda x, y: (
        F.col(x) * F.cos("angle") - F.col(y) * F.sin("angle") + F.col("tx"), F.col(x) * F.sin("angle") + F.col(y) * F.cos("angle") + F.col("ty")
    )
    xs, ys = zip(*(corner(x, y) for x in ("xmin", "xmax") for y in ("ymin", "ymax")), strict=True)
    return extents.select(
        "*", F.least(*xs).alias("new_xmin"), F.greatest(*xs).alias("new_xmax"), F.least(*ys).alias("new_ymin"), F.greatest(*ys).alias("new_ymax")
    )


def snapped_grid(extents: DataFrame, cell: float) -> DataFrame:
    """Extents widened to whole cells, with the number of columns and rows."""
    lo = lambda c: F.floor(F.col(c) / cell) * cell
    hi = lambda c: F.ceil(F.col(c) / cell) * cell
    out = extents.withColumns({"gx0": lo("xmin"), "gx1": hi("xmax"), "gy0": lo("ymin"), "gy1": hi("ymax")})
    return out.withColumns({
        "size_x": ((F.col("gx1") - F.col("gx0")) / cell).cast("int"), "size_y": ((F.col("gy1") - F.col("gy0")) / cell).cast("int")
    })


@dataclass(frozen=True)
class Anchor:
    """Where a scanner stood: ``x, y`` in the system of the cloud, or ``latitude, longitude`` with ``project``, which takes these and ``z``."""

    x: float | None = None
    y: float | None = None
    z: float = 0.0
    latitude: float | None = None
    longitude: float | None = None
    project: Callable[[float, float, float], tuple[float, float, float]] | None = None

    def place(self) -> tuple[float, float, float]:
        by_degrees, by_metres = (all(v is not None for v in pair) for pair in ((self.latitude, self.longitude), (self.x, self.y)))
        if by_degrees == by_metres:
            raise ValueError("an anchor has either a latitude and a longitude or an x and a y")
        if by_metres:
            return self.x, self.y, self.z
        if self.project is None:
            raise ValueError("a latitude and a longitude need a projection")
        return self.project(self.latitude, self.longitude, self.z)


def _for_each(values: float | list[float], n: int, name: str) -> list[float]:
    own = values if isinstance(values, list) else [values]
    if len(own) not in (1, n):
        raise ValueError(f"{name} has {len(own)} values for {n} files: give one, or one for each")
    return own * n if len(own) == 1 else own


def registration(
    spark: SparkSession, tiles: list[str], anchor: Anchor, rotation: float | list[float] | None = None, declination: float | list[float] | None = None, nudge_x: float | list[float] = 0.0, nudge_y: float | list[float] = 0.0,
    scanner_unit: float = 1.0, horizontal_unit: float = 1.0, vertical_unit: float = 1.0, first_source_id: int = 1,
) -> DataFrame:
    """How each file is placed: ``tile, tx, ty, angle, new_source_id`` for its points, and ``x_offset, y_offset, z_offset, xy_scale_change, z_scale_change`` for its header.

    Degrees turn counterclockwise; a declination turns the other way and excludes a rotation. Angles and nudges are one for all files or
    one for each. Units are metres in one unit; source ids count up from file to file.
    """
    if rotation is not None and declination is not None:
        raise ValueError("give a rotation or a declination, not both")
    n, (x, y, z) = len(tiles), anchor.place()
    degrees = _for_each(rotation if rotation is not None else 0.0, n, "rotation") if declination is None else [-d for d in _for_each(declination, n, "declination")]
    xs, ys = _for_each(nudge_x, n, "nudge_x"), _for_each(nudge_y, n, "nudge_y")
    rows = [
        (t, 0.0, 0.0, math.radians(d), first_source_id + k, x + dx, y + dy, z, scanner_unit / horizontal_unit, scanner_unit / vertical_unit) for k,
        (t, d, dx, dy) in enumerate(zip(tiles, degrees, xs, ys, strict=True))
    ]
    return spark.createDataFrame(
        rows,
        "tile string, tx double, ty double, angle double, new_source_id int, x_offset double, y_offset double, z_offset double, xy_scale_change double, z_scale_change double"
    )


def registered_headers(headers: DataFrame, params: DataFrame) -> DataFrame:
    """``tile`` with the scales and offsets that registered files get."""
    both = headers.select("tile", "x_scale", "y_scale", "z_scale").join(params, "tile")
    return both.select(
        "tile", (F.col("x_scale") * F.col("xy_scale_change")).alias("x_scale"), (F.col("y_scale") * F.col("xy_scale_change")).alias("y_scale"), (F.col("z_scale") * F.col("z_scale_change")).alias("z_scale"), "x_offset", "y_offset", "z_offset"
    )


def linear_crs(south_west: tuple[float, float], north_west: tuple[float, float]) -> float:
    """The angle by which a cloud turns when its west corners are projected there: less that by which north turns."""
    return -(math.pi / 2 - math.atan2(north_west[1] - south_west[1], north_west[0] - south_west[0]))


def crs_conversion(
    headers: DataFrame, project: Callable[[float, float, float], tuple[float, float, float]], input_scale: float = 1.0, horizontal_unit: tuple[float, float] = (1.0, 1.0), vertical_unit: tuple[float, float] = (1.0, 1.0),
    maintain_origin: bool = False, nudge: tuple[float, float, float] = (0.0, 0.0, 0.0),
) -> DataFrame:
    """How each file of ``headers`` goes to another system, linearised at its origin: ``tile, tx, ty, tz, angle`` and its new scales and offsets.

    ``project`` takes a place of the old system to the new one; it is asked for the origin, which is moved to the middle of the
    file's bounds unless it is maintained, and for the two west corners, by which north turns. Units are metres in one unit, old
    and new; ``input_scale`` corrects coordinates that are in another unit than their system says.
    """
    across, up = (input_scale * old / new for old, new in (horizontal_unit, vertical_unit))
    names = ["tile", "tx", "ty", "tz", "angle", "x_scale", "y_scale", "z_scale", "x_offset", "y_offset", "z_offset"]

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for h in pdf.to_dict("records"):
                now = [input_scale * h[f"{a}_offset"] for a in "xyz"]
                low, high = ([input_scale * h[f"{a}_{m}"] for a in "xyz"] for m in ("min", "max"))
                origin = now if maintain_origin else [(a + b) / 2 for a, b in zip(low, high, strict=True)]
                corners = [project(low[0], low[1], low[2])[:2], project(low[0], high[1], high[2])[:2]]
                shift = [(o - c) / (input_scale * h[f"{a}_scale"]) for o, c, a in zip(origin, now, "xyz", strict=True)]
                at = [p + n for p, n in zip(project(*origin), nudge, strict=True)]
                rows.append((h["tile"], *shift, linear_crs(*corners), h["x_scale"] * across, h["y_scale"] * across, h["z_scale"] * up, *at))
            yield pd.DataFrame(rows, columns=names)

    needed = [f"{a}_{m}" for m in ("scale", "offset", "min", "max") for a in "xyz"]
    return headers.select("tile", *needed).mapInPandas(convert, ", ".join(f"{c} {'string' if c == 'tile' else 'double'}" for c in names))
