"""Size checks before anything is broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rule tables up to this size are broadcast whole, larger ones in parts.
BROADCAST_BYTES = 32 * 1024 * 1024


def text_bytes(df: DataFrame) -> int:
    """Upper estimate of the bytes ``df`` takes, from the length of its values."""
    width: Column = F.lit(16 * len(df.columns)).cast("long")
    for name in df.columns:
        width = width + F.coalesce(F.octet_length(F.col(name).cast("string")), F.lit(0))
    return df.agg(F.coalesce(F.sum(width), F.lit(0)).alias("b")).first()["b"]
