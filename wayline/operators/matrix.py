"""Dense matrices of two dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.operators.shape import sum_by
from wayline.schema import MEASURE
from wayline.session import settle

# Fixed value: longest axis.
AXIS = 15


def cells(routes: DataFrame, row: str, col: str) -> DataFrame:
    """Sum per pair of values."""
    return sum_by(routes, row, col).select(
        F.col(row).alias("row"), F.col(col).alias("col"), F.col(MEASURE).alias("value")
    )


def _top(found: DataFrame, axis: str, n: int) -> DataFrame:
    totals = found.groupBy(axis).agg(F.sum("value").alias("_total"))
    return totals.orderBy(F.desc("_total"), axis).limit(n).select(axis)


def heatmap(routes: DataFrame, row: str, col: str, n: int = AXIS) -> DataFrame:
    """The top values of each axis against each other, 0 where nothing is.

    Each axis is cut on its own totals over all cells.  Ranks then follow the
    totals of the cells that are left, and a value without any cell left is not
    shown.  All steps after the cut see at most n × n cells.
    """
    found = settle(cells(routes, row, col), "cells")
    left = found.join(F.broadcast(_top(found, "row", n)), "row", "left_semi").join(
        F.broadcast(_top(found, "col", n)), "col", "left_semi"
    )
    axes = left.agg(F.collect_set("row").alias("rows"), F.collect_set("col").alias("cols"))
    grid = axes.select(F.explode("rows").alias("row"), "cols").select(
        "row", F.explode("cols").alias("col")
    )
    dense = grid.join(F.broadcast(left), ["row", "col"], "left").select(
        "row", "col", F.coalesce("value", F.lit(0)).cast("long").alias("value")
    )
    for axis in ("row", "col"):
        dense = dense.withColumn(
            f"_{axis}_total", F.sum("value").over(Window.partitionBy(axis))
        ).withColumn(
            f"{axis}_rank",
            F.dense_rank().over(Window.orderBy(F.desc(f"_{axis}_total"), axis)).cast("long"),
        )
    return dense.select("row", "col", "value", "row_rank", "col_rank")


def pivoted(matrix: DataFrame) -> DataFrame:
    """A heatmap with one column per column value, both axes in rank order.

    The column names, at most one axis long, are read to lay out the result.
    """
    names = [r["col"] for r in matrix.select("col", "col_rank").distinct()
             .orderBy("col_rank").collect()]
    return (
        matrix.groupBy("row_rank", "row").pivot("col", names).agg(F.first("value"))
        .orderBy("row_rank").drop("row_rank")
    )
