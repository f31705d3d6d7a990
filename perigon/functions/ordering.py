"""Numbers of rows in an order, for groups of any size.

A window over a group would bring the group into one task. So rows are numbered in cells of the order (2^shift values of a
whole-number column), the cells are counted, and what comes before each cell is a running sum over the counts of its group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A cell spans 65,536 values of the order: no more rows of a group, where the values tell rows apart.
SHIFT = 16


def _cells(rows: DataFrame, groups: list[str]) -> DataFrame:
    return rows.groupBy(*groups, "cell__").agg(F.count(F.lit(1)).alias("c__"))


def _before(order: Column, *groups: str) -> Column:
    window = (Window.partitionBy(*groups) if groups else Window).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum("c__").over(window), F.lit(0))


def numbered(rows: DataFrame, groups: list[str], order: str, place: str = "place", shift: int = SHIFT) -> DataFrame:
    """rows with `place`: 1 for the row with the smallest value of `order` (bigint) in its group, and so on. Groups are not null."""
    dealt = rows.withColumn("cell__", F.shiftright(F.col(order), shift))
    inside = F.row_number().over(Window.partitionBy(*groups, "cell__").orderBy(order))
    cells = _cells(dealt, groups).withColumn("before__", _before(F.col("cell__"), *groups)).drop("c__")
    found = dealt.withColumn("row__", inside).join(cells, [*groups, "cell__"], "left")
    return found.withColumn(place, (F.col("before__") + F.col("row__")).cast("bigint")).drop("cell__", "row__", "before__")


def ranked(rows: DataFrame, size: str, order: str, place: str = "rank", shift: int = SHIFT) -> DataFrame:
    """rows with `place`: 1 for the largest `size`; of equal sizes the row with the larger value of `order` (both bigint, not null) comes first.

    The tables that are summed up have a row for each size, and for each size and cell; neither is a pass of its own over what
    the rows are made from, since all of them begin with the same exchange.
    """
    dealt = rows.withColumn("cell__", F.shiftright(F.col(order), shift))
    inside = F.row_number().over(Window.partitionBy(size, "cell__").orderBy(F.desc(order)))
    cells = _cells(dealt, [size])
    sizes = cells.groupBy(size).agg(F.sum("c__").alias("c__")).withColumn("larger__", _before(F.desc(size))).drop("c__")
    cells = cells.withColumn("before__", _before(F.desc("cell__"), size)).drop("c__").join(sizes, size)
    found = dealt.withColumn("row__", inside).join(cells, [size, "cell__"])
    return found.withColumn(place, (F.col("larger__") + F.col("before__") + F.col("row__")).cast("bigint")).drop("cell__", "row__", "before__", "larger__")
