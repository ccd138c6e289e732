"""Grid metrics: distribution of heights, intensities and returns in a cell.

One shuffle deals the valid points to cells. Windows over the cell number its points by height and by
intensity and give each point the figures of its cell, and one aggregate on the same partitioning makes all bands
of them. No cell is ever gathered into an array, so a cell may hold any number of points; bands that are not selected
are pruned from the windows and the aggregate. Heights are raw integers; moments are taken about the cell's own mean.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.functions.points import ratio, valid

CELL = ["cx", "cy"]
MOMENTS = ("mean", "sd", "skew", "kurtosis")
RETURNS = ("first", "second", "third", "fourth", "fifth")
#: Steps of the height quantiles (twentieths) up to which intensities are summed.
_SUMMED = (2, 6, 10, 14, 18)


def quantile_place(n: Column, k: int, steps: int) -> Column:
    """Place, from 1, of a lower order statistic among ``n``; there is no interpolation."""
    few = F.greatest(F.floor(F.lit(k) * n / steps + 0.5), F.lit(1))
    return F.when(n < steps, few).otherwise(F.floor(F.lit(k) * n / steps)).cast("long")


def _moments(value: Column, mean: Column, n: Column, prefix: str) -> dict[str, Column]:
    """Population deviation with sample corrections."""
    d = value - mean
    count, s2, s3, s4 = F.max(n).cast("double"), F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)
    var = s2 / count
    spread = F.when(var > 0, var)
    return {
        f"{prefix}_mean": F.max(mean),
        f"{prefix}_sd": F.sqrt(var),
        f"{prefix}_skew": F.when(count > 2, F.try_divide(F.try_divide(s3, F.pow(spread, F.lit(1.5))) * count, (count - 1) * (count - 2))),
        f"{prefix}_kurtosis": F.when(
            count > 3, F.try_divide(F.try_divide(s4, spread * spread) * count * (count + 1), (count - 1) * (count - 2) * (count - 3))
        ),
    }


def grid_metrics(points: DataFrame, ground: DataFrame | None = None, step: int = 1000, threshold: int = 2000) -> DataFrame:
    """All bands by cell: ``n``, heights (``z_``, ``zq``, ``zpcum``, ``p_above_``), returns (``p_``) and intensities (``i_``, ``iq``, ``ipcumzq``).

    ``ground`` has the mean terrain ``z_ground_mean`` under each cell; without it ``p_above_threshold`` counts from 0. ``step`` is the
    height of a class of the entropy, ``threshold`` the height above ground that counts as above; both in raw units.
    """
    cell = Window.partitionBy(*CELL)
    rows = points.filter(valid()).select(*CELL, F.col("z_raw").alias("z"), F.col("intensity").alias("i"), "return_number", "classification")
    rows = rows.withColumn("i_at", F.row_number().over(cell.orderBy("i"))).withColumn("z_at", F.row_number().over(cell.orderBy("z")))
    z, i, n = F.col("z"), F.col("i"), F.col("n")
    total = lambda c: F.sum(c.cast("long")).over(cell)
    rows = rows.withColumns({
        "n": F.count("*").over(cell), "z_low": F.min("z").over(cell), "z_top": F.max("z").over(cell), "z_sum": total(z), "i_sum": total(i)
    })
    at = {k: F.max(F.when(F.col("z_at") == quantile_place(n, k, 20), z)).over(cell) for k in _SUMMED}
    rows = rows.withColumns({f"z_at{k}": v for k, v in at.items()})
    rows = rows.withColumn("k", F.floor((z - F.col("z_low")) / step + 0.5)).withColumn("alike", F.count("*").over(Window.partitionBy(*CELL, "k")))
    if ground is None:
        rows = rows.withColumn("z_ground_mean", F.lit(None).cast("double"))
    else:
        rows = rows.join(ground.select(*CELL, "z_ground_mean"), CELL, "left")

    low, span = F.col("z_low"), F.col("z_top") - F.col("z_low")
    rn, cls, whole = F.col("return_number"), F.col("classification"), F.max("n")
    share = lambda on: F.count_if(on) / whole
    summed = lambda on: F.coalesce(F.sum(F.when(on, i.cast("long"))), F.lit(0))
    median = quantile_place(whole, 10, 20) - 1
    classes = F.max(F.ceil(span / step + 0.5) + 1)
    bands = {"n": whole, "z_max": F.max("z"), **_moments(z, F.col("z_sum") / n, n, "z")}
    bands |= {f"zq{5 * k:02d}": F.max(F.when(F.col("z_at") == quantile_place(n, k, 20), z)) for k in range(1, 20)}
    bands |= {f"zpcum{10 * q}": share((z - low) * 10 < q * span) for q in range(1, 10)}
    bands["z_entropy"] = F.sum(F.log(F.col("alike") / n)) / whole / F.log(1 / classes)
    bands["z_ground_mean"] = F.max("z_ground_mean")
    bands["p_above_mean"] = share(z * n > F.col("z_sum"))
    bands["p_above_threshold"] = share(z > threshold + F.coalesce("z_ground_mean", F.lit(0.0)))
    bands |= {f"p_{name}": share(rn == k) for k, name in enumerate(RETURNS, 1)}
    bands["p_ground"] = share(cls == 2)
    bands |= {"i_max": F.max("i"), **_moments(i, F.col("i_sum") / n, n, "i")}
    bands |= {f"iq{10 * k}": F.max(F.when(F.col("i_at") == quantile_place(n, k, 10), i)) for k in range(1, 10)}
    bands["i_first"] = ratio(F.sum(F.when(rn == 1, i.cast("long"))), F.count_if(rn == 1))
    bands["i_above_median"] = ratio(summed(z >= F.col("z_at10")), whole - median)
    bands["i_below_median"] = ratio(summed(z < F.col("z_at10")), median)
    bands |= {f"ipcumzq{5 * k}": ratio(summed(z < F.col(f"z_at{k}")), F.max("i_sum")) for k in _SUMMED}
    bands["i_total"] = F.max("i_sum")
    bands["i_pground"] = ratio(summed(cls == 2), F.max("i_sum"))
    return rows.groupBy(*CELL).agg(*(v.alias(k) for k, v in bands.items()))


def ground_under(terrain: DataFrame, times: int) -> DataFrame:
    """Mean terrain of the fine cells whose centres are inside a cell ``times`` as wide."""
    key = {"bx": F.floor(F.col("cx") / times).cast("int"), "by": F.floor(F.col("cy") / times).cast("int")}
    return terrain.withColumns(key).groupBy("bx", "by").agg(F.avg("z").alias("z_ground_mean")).select(
        F.col("bx").alias("cx"), F.col("by").alias("cy"), "z_ground_mean"
    )
