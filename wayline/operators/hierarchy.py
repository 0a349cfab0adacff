"""The client > database > schema > direction hierarchy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.names import short_schema
from wayline.operators.shape import sum_by
from wayline.schema import MEASURE
from wayline.session import settle


def hierarchy_levels(routes: DataFrame) -> DataFrame:
    """Sums of every level, the root included as level 0.

    Without a schema column the hierarchy has three levels.
    """
    keys = [k for k in ("CLIENT", "DATABASE", "SCHEMA_NAME", "DIRECTION") if k in routes.columns]
    rolled = sum_by(routes, *keys).rollup(*keys).agg(
        F.grouping_id().alias("_gid"), F.sum(MEASURE).cast("long").alias("value")
    )
    level = F.lit(len(keys)) - F.length(F.regexp_replace(F.bin("_gid"), "0", ""))
    return rolled.select(level.cast("long").alias("level"), *keys, "value")


def treemap(routes: DataFrame) -> DataFrame:
    """``level, id, parent, label, value, share`` without the root.

    An id is the path of names joined with ``/``; names that contain the slash
    can make two ids alike.  The share is taken of the parent's own total, and
    the parent is found by its key columns, not by its id.
    """
    keys = [k for k in ("CLIENT", "DATABASE", "SCHEMA_NAME", "DIRECTION") if k in routes.columns]
    levels = settle(hierarchy_levels(routes), "levels")
    parents = levels.filter(F.col("level") < len(keys)).select(
        F.col("level").alias("_plevel"), *[F.col(k).alias(f"_p_{k}") for k in keys[:-1]],
        F.col("value").alias("_ptotal"),
    )
    # The deepest key of a child is absent from its parent.
    above = [F.when(F.col("level") > i + 1, F.col(k)) for i, k in enumerate(keys[:-1])]
    children = levels.filter(F.col("level") > 0).select(
        "*", (F.col("level") - 1).alias("_up"),
        *[c.alias(f"_c_{k}") for c, k in zip(above, keys[:-1])],
    )
    on = F.col("_up") == F.col("_plevel")
    for k in keys[:-1]:
        on = on & F.col(f"_c_{k}").eqNullSafe(F.col(f"_p_{k}"))
    joined = children.join(parents, on)

    path = F.concat_ws("/", *keys)
    parent = F.concat_ws("/", *[F.col(f"_c_{k}") for k in keys[:-1]])
    label = F.when(F.col("level") == len(keys), F.upper("DIRECTION"))
    if "SCHEMA_NAME" in keys:
        label = label.when(F.col("level") == 3, short_schema(F.col("SCHEMA_NAME")))
    label = label.when(F.col("level") == 2, F.col("DATABASE")).otherwise(F.col("CLIENT"))
    return joined.select(
        "level", path.alias("id"), parent.alias("parent"), label.alias("label"), "value",
        F.round(F.col("value") / F.col("_ptotal"), 6).alias("share"),
    )


def drawing_columns() -> list[Column]:
    """Clients by weight first, then the deeper levels by id."""
    weight = F.when(F.col("level") == 1, -F.col("value"))
    return [F.asc("level"), weight.asc(), F.asc("id")]


def drawing_order(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy(*drawing_columns())
