"""Global row numbers and running totals without one big sort partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import settle


def prefix_scan(df: DataFrame, order: Sequence[Column], ordinal: str,
                totals: dict[str, str] | None = None) -> DataFrame:
    """Number the rows from 0 in the given order and sum what lies before each.

    ``totals`` maps a new column to the numeric column whose sum over all
    *earlier* rows it gets.  ``order`` must be a total order.

    The frame is range partitioned and written; each slice is then numbered on
    its own and shifted by the number of rows (and the sums) of the slices
    before it.
    """
    totals = totals or {}
    sliced = settle(
        df.repartitionByRange(*order).withColumn("_slice", F.spark_partition_id()), "slices"
    )
    # One row per range partition, so both the window and the broadcast are
    # bounded by the number of shuffle partitions.
    sizes = sliced.groupBy("_slice").agg(
        F.count("*").alias("_rows"),
        *[F.coalesce(F.sum(src), F.lit(0)).alias(f"_sum_{new}") for new, src in totals.items()],
    )
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        "_slice",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_shift"),
        *[F.coalesce(F.sum(f"_sum_{new}").over(before), F.lit(0)).alias(f"_shift_{new}")
          for new in totals],
    )
    scanned = _scan(sliced, Window.partitionBy("_slice").orderBy(*order), ordinal, totals)
    shifted = scanned.join(F.broadcast(shifts), "_slice")
    return shifted.select(
        *[F.col(c) for c in df.columns],
        (F.col(ordinal) + F.col("_shift")).alias(ordinal),
        *[(F.col(new) + F.col(f"_shift_{new}")).alias(new) for new in totals],
    )


def _scan(df, window, ordinal, totals):
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    return df.select(
        *[F.col(c) for c in df.columns],
        (F.row_number().over(window) - 1).cast("long").alias(ordinal),
        *[F.coalesce(F.sum(src).over(before), F.lit(0)).alias(new)
          for new, src in totals.items()],
    )
