"""Running numbers and sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratagrid.staging import stage


def running(df: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Adds running sums, each row's own value included, in the given order; ``{"i": lit(1)}`` numbers rows from 1.

    Rows are dealt to ranges and sorted there; each range's totals are summed up over the table of ranges, which has a row
    for each partition, and added to the sums within the range. Rows that are equal in the order may stand either way.
    """
    names = [f"_order{k}" for k in range(len(order))]
    keyed = df.withColumns(dict(zip(names, order, strict=True)))
    ranged = stage(
        keyed.repartitionByRange(*names).sortWithinPartitions(*names).withColumns({
            "_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()
        }),
        "ordered"
    )
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_{n}") for n, v in sums.items()))
    before = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(upto), F.lit(0)).alias(f"_{n}") for n in sums))
    within = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = ranged.withColumns({n: F.sum(v).over(within) for n, v in sums.items()})
    return local.join(F.broadcast(before), "_part").withColumns({n: F.col(n) + F.col(f"_{n}") for n in sums}).select(*df.columns, *sums)
