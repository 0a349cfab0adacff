"""Stacked bars: the top categories of a dimension, split by access mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.direction import is_write
from wayline.schema import HEADINGS, MEASURE

# Fixed value: categories shown unless asked otherwise.
TOP_CATEGORIES = 10


def top_categories(routes: DataFrame, column: str, top_n: int = TOP_CATEGORIES) -> DataFrame:
    """``category, total`` and per mode its sum and number of routes.

    One aggregation carries both modes, so the top categories need no join back
    to their rows.
    """
    write = is_write(F.col("DIRECTION"))
    # A NULL direction is not a write direction and so reads.
    write = F.coalesce(write, F.lit(False))

    def per_mode(mode, cond):
        return [
            F.sum(F.when(cond, F.col(MEASURE)).otherwise(0)).cast("long").alias(f"{mode}_sum"),
            F.count(F.when(cond, 1)).alias(f"{mode}_rows"),
        ]

    return (
        routes.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("category"))
        .agg(F.sum(MEASURE).cast("long").alias("total"),
             *per_mode("Read", ~write), *per_mode("Write", write))
        .orderBy(F.desc("total"), "category").limit(top_n)
    )


def _by_mode(top: DataFrame, *kept: str) -> DataFrame:
    modes = F.array(*[
        F.struct(F.lit(m).alias("direction"), F.col(f"{m}_sum").alias("access_count"),
                 F.col(f"{m}_rows").alias("routes"))
        for m in ("Read", "Write")
    ])
    return top.select("category", *kept, F.inline(modes))


def bars(routes: DataFrame, column: str, top_n: int = TOP_CATEGORIES) -> DataFrame:
    """Sums per category and mode, for the modes a category has."""
    return _by_mode(top_categories(routes, column, top_n)).filter("routes > 0").drop("routes")


def chart_table(bar_rows: DataFrame, column: str) -> DataFrame:
    """Bars under the headings of a chart table."""
    return bar_rows.withColumnsRenamed({
        "category": HEADINGS[column], "direction": HEADINGS["DIRECTION"],
        "access_count": HEADINGS[MEASURE],
    })


def dense_bars(routes: DataFrame, column: str, top_n: int = TOP_CATEGORIES) -> DataFrame:
    """Every shown category with every mode that occurs among them, 0 where missing.

    ``rank`` runs upwards from the smallest total, the order bars are drawn in.
    The windows run over the top categories only.
    """
    top = top_categories(routes, column, top_n)
    ranked = top.withColumn("rank", F.row_number().over(
        Window.orderBy(F.asc("total"), F.desc("category"))).cast("long"))
    rows = _by_mode(ranked, "rank")
    present = F.sum("routes").over(Window.partitionBy("direction"))
    return rows.withColumn("_present", present).filter("_present > 0").select(
        "category", "direction", "access_count", "rank"
    )
