"""Session settings and the shared scratch folder."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Settings that keep the plans of this package safe from hot keys.  The forced
#: skew join lets Spark split a hot query id although the step after the join
#: would have liked to keep the join's partitioning.
SKEW_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
}


def allow_skew_split(spark: SparkSession) -> None:
    """Turn on the settings above.  An application calls this once for its
    session; nothing in the package does so by itself."""
    for key, value in SKEW_SETTINGS.items():
        spark.conf.set(key, value)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings for what is planned or started inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    for key, value in values.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


@contextmanager
def runtime_filter(spark: SparkSession, items: int = 4_000_000, least_scan: str = "64MB") -> Iterator[None]:
    """Let what is planned inside hold large scans against a Bloom filter of their join's other side.

    Spark makes one where a side is filtered, as queries are by their start, and the scan
    of the other side is larger than ``least_scan``; rows without a partner are then left
    out before they are shuffled.  The filter has ten bits for each of up to ``items`` ids
    and is broadcast, 5 MB with four million.  With many times as many ids it lets more and
    more rows through, and nothing is lost.  Of use where the access log has no date column.
    """
    values = {f"spark.sql.optimizer.runtime.bloomFilter.{key}": value for key, value in {
        "enabled": "true", "applicationSideScanSizeThreshold": least_scan,
        "creationSideThreshold": "1TB", "expectedNumItems": str(items), "maxNumItems": str(items),
        "numBits": str(10 * items), "maxNumBits": str(10 * items),
    }.items()}
    with settings(spark, values):
        yield


def _named_scratch(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def scratch_root(spark: SparkSession) -> str:
    """Folder shared by all executors, as named in ``spark.checkpoint.dir``."""
    named = _named_scratch(spark)
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    return named.rstrip("/")


def local_scratch(spark: SparkSession) -> None:
    """Name a temporary folder as scratch folder where none is set: for tests and
    trials in one process.  On a cluster the setting has to be there already."""
    if _named_scratch(spark):
        return
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder all executors can reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayline-"))


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/wayline/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back.

    Used where several branches of a plan need the same intermediate result:
    it is then computed once, later scans read only the columns they use, file
    sizes tell the optimizer what it may broadcast, and a lost executor costs
    no more than a re-read.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
