"""Folders on the shared file system, listed and removed through Hadoop's interface."""

from __future__ import annotations

import time
from collections.abc import Collection

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """A path and the file system it is on."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    place, files = at(spark, path)
    return files.exists(place)


def listed(spark: SparkSession, root: str, prefix: str) -> list:
    """Status of what a folder has of a prefix; of no folder, nothing."""
    place, files = at(spark, root)
    if not files.exists(place):
        return []
    return [f for f in files.listStatus(place) if f.getPath().getName().startswith(prefix)]


def make(spark: SparkSession, path: str) -> None:
    place, files = at(spark, path)
    files.mkdirs(place)


def delete(spark: SparkSession, path: str) -> None:
    place, files = at(spark, path)
    files.delete(place, True)


def remove_unused(spark: SparkSession, root: str, prefix: str, used: Collection[str],
                  keep_days: float) -> list[str]:
    """Delete folders of a prefix that are not in use and older than ``keep_days``."""
    before, gone = time.time() * 1000 - keep_days * 86_400_000, []
    for f in listed(spark, root, prefix):
        if f.getPath().getName() not in used and f.getModificationTime() <= before:
            delete(spark, f.getPath().toString())
            gone.append(f.getPath().getName())
    return gone
