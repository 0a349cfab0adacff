"""Connected components of a table of links, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import settle


def _least(links: DataFrame) -> DataFrame:
    """Each node's smallest neighbour or itself, whichever is less."""
    return settle(links.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least")), "least")


def _large_star(links: DataFrame) -> DataFrame:
    """Hang every larger neighbour of a node on the node's smallest neighbour."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (both.join(_least(both), "a").where(F.col("b") > F.col("a"))
            .select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())


def _small_star(links: DataFrame) -> DataFrame:
    """Hang a node and its smaller neighbours on the smallest of these."""
    least = settle(links.groupBy("a").agg(F.min("b").alias("least")), "least")
    lower = links.join(least, "a").where(F.col("b") != F.col("least")).select(
        F.col("b").alias("a"), F.col("least").alias("b"))
    return lower.union(least.select("a", F.col("least").alias("b"))).distinct()


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``root``, the smallest node it is connected with, from links ``a``, ``b``.

    Large and small stars take turns until nothing changes, which takes about
    as many rounds as the logarithm of the longest path.  Only linked nodes
    come out, roots not among them.  Links to a node itself are ignored; a
    node with very many links is summed up before it moves, and as the sums
    are written, its join can be split.  Every round is written, so a lost
    executor costs one round.
    """
    links = settle(links.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while True:
        links = settle(_small_star(_large_star(links)), "links")
        found = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark:
            return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
        mark = tuple(found)
