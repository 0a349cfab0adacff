"""Flow diagrams: client → warehouse → database → schema in columns."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.names import short_schema
from wayline.operators.prefix import prefix_scan
from wayline.operators.shape import sum_by
from wayline.schema import MEASURE
from wayline.session import settle

# Where the columns stand and how a column's height is shared out.
COLUMN_X = {4: (0.001, 0.333, 0.666, 0.999), 3: (0.001, 0.5, 0.999)}
TOP_MARGIN = 0.01
USABLE = 0.98
BAR_SHARE = 0.85
GAP_SHARE = 0.15
LOWEST = 0.99


@dataclass(frozen=True)
class Flow:
    """Nodes and links of one diagram; both are empty if nothing flows."""

    nodes: DataFrame
    links: DataFrame


def flow_paths(routes: DataFrame, direction: str) -> DataFrame:
    """Sums of whole paths in one literal direction (DDL is not "write" here)."""
    keys = [k for k in ("CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME") if k in routes.columns]
    return sum_by(routes.filter(F.col("DIRECTION") == direction), *keys)


def _stages(paths: DataFrame) -> list[str]:
    return [c for c in paths.columns if c != MEASURE]


def flow_nodes(paths: DataFrame) -> DataFrame:
    """``idx, col_no, name, label, x, y, value``.

    Nodes are numbered through all columns, heaviest first within a column.
    ``paths`` is read more than once and should be settled.
    """
    stages = _stages(paths)
    totals = paths.select(
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("col_no"), F.col(s).alias("name")) for i, s in enumerate(stages)
        ])), MEASURE,
    ).groupBy("col_no", "name").agg(F.sum(MEASURE).cast("long").alias("value"))
    totals = settle(totals, "flow-totals")
    scanned = prefix_scan(totals, [F.asc("col_no"), F.desc("value"), F.asc("name")], "idx",
                          {"before": "value"})
    # One row per column: how many nodes it has, where they start, what it carries.
    earlier_columns = Window.orderBy("col_no").rowsBetween(Window.unboundedPreceding, -1)
    columns = totals.groupBy("col_no").agg(
        F.count("*").alias("n"), F.sum("value").alias("flow")
    ).withColumn("start", F.coalesce(F.sum("n").over(earlier_columns), F.lit(0)))
    nodes = scanned.join(F.broadcast(columns), "col_no")

    col_no, n, flow = F.col("col_no"), F.col("n"), F.col("flow")
    rank = F.col("idx") - F.col("start")
    # Every column carries the same flow, and earlier columns come first.
    earlier = F.col("before") - col_no * flow
    height = F.when(flow == 0, 0.0).otherwise(F.col("value") / flow * BAR_SHARE * USABLE)
    above = F.when(flow == 0, 0.0).otherwise(earlier / flow * BAR_SHARE * USABLE)
    gaps = rank * (F.lit(GAP_SHARE) / (n - 1)) * USABLE
    centre = F.when(n == 1, 0.5).otherwise(
        F.least(F.lit(TOP_MARGIN) + above + gaps + height / 2, F.lit(LOWEST))
    )
    x = F.element_at(F.array(*[F.lit(v) for v in COLUMN_X[len(stages)]]), col_no + 1)
    label = F.when(col_no == 3, short_schema(F.col("name"))).otherwise(F.col("name"))
    return nodes.select(
        "idx", col_no.cast("long").alias("col_no"), "name", label.alias("label"),
        x.alias("x"), F.round(centre, 6).alias("y"), "value",
    )


def flow_links(paths: DataFrame, nodes: DataFrame) -> DataFrame:
    """``src_idx, dst_idx, value`` between neighbouring columns.

    All column pairs are summed in one pass.  The nodes are joined without a
    hint; their size decides how.
    """
    stages = _stages(paths)
    pairs = F.array(*[
        F.struct(F.lit(i).cast("long").alias("col_no"), F.col(a).alias("src"), F.col(b).alias("dst"))
        for i, (a, b) in enumerate(zip(stages, stages[1:]))
    ])
    sums = paths.select(F.inline(pairs), MEASURE).groupBy("col_no", "src", "dst").agg(
        F.sum(MEASURE).cast("long").alias("value")
    )
    src = nodes.select("col_no", F.col("name").alias("src"), F.col("idx").alias("src_idx"))
    dst = nodes.select((F.col("col_no") - 1).alias("col_no"), F.col("name").alias("dst"),
                       F.col("idx").alias("dst_idx"))
    return sums.join(src, ["col_no", "src"]).join(dst, ["col_no", "dst"]).select(
        "src_idx", "dst_idx", "value"
    )


def sankey(routes: DataFrame, direction: str) -> Flow:
    """The flow diagram of one direction."""
    paths = settle(flow_paths(routes, direction), "flows")
    nodes = flow_nodes(paths)
    return Flow(nodes, flow_links(paths, nodes))
