"""Log scaling of weights to sizes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Smallest and largest drawn size of a node.
NODE_SIZES = (80, 200)
SCHEMA_SIZES = (60, 160)


def log_scale(value: Column, low: Column, high: Column, out_low, out_high) -> Column:
    """Map ``[low, high]`` to ``[out_low, out_high]`` on a log scale.

    ``out_low`` where the range is empty or the value is not positive.  Values
    outside the range are extrapolated, not clamped.
    """
    out_low, out_high = (F.lit(v).cast("double") if not isinstance(v, Column) else v
                         for v in (out_low, out_high))
    share = (F.log1p(value) - F.log1p(low)) / (F.log1p(high) - F.log1p(low))
    return F.when((high <= low) | (value <= 0), out_low).otherwise(
        out_low + share * (out_high - out_low)
    )


def node_size(total: Column, low: Column, high: Column, node_type: Column) -> Column:
    """Whole-number node size; schemas are drawn smaller than other nodes.

    The scaled value is rounded to nine digits before it is cut, so that the
    last bit of a logarithm cannot move a size by one.
    """
    is_schema = node_type == "schema"
    out_low = F.when(is_schema, float(SCHEMA_SIZES[0])).otherwise(float(NODE_SIZES[0]))
    out_high = F.when(is_schema, float(SCHEMA_SIZES[1])).otherwise(float(NODE_SIZES[1]))
    return F.floor(F.round(log_scale(total, low, high, out_low, out_high), 9)).cast("int")
