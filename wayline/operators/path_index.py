"""Paths by the nodes on them, written so that a look at one node reads little.

Every path is posted under each of its nodes, four at most, together with its
nodes and links.  Postings lie in a folder per bucket of nodes, sorted by node:
a click reads one folder, and of that the blocks that may hold the node.  A node
that a third of all paths run through is spread over several files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.operators.graph import FULL_VIEW, View, _edge_key, _links, _path_nodes

#: Folders the nodes are spread over.
BUCKETS = 64

POSTING = ("node string, path_idx long, nodes array<string>, "
           "links array<struct<src: string, dst: string, is_write: boolean>>, bucket int")


def _bucket(node: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(node), F.lit(buckets)).cast("int")


def write_index(numbered: DataFrame, folder: str, view: View = FULL_VIEW, buckets: int = BUCKETS) -> None:
    """Write the postings of numbered paths; the folder's old index is replaced."""
    paths = numbered.select("path_idx", _path_nodes(view).alias("nodes"), _links(view).alias("links"))
    posted = paths.select(F.explode("nodes").alias("node"), "path_idx", "nodes", "links").withColumn(
        "bucket", _bucket(F.col("node"), buckets))
    order = ["bucket", "node", "path_idx"]
    posted.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite") \
        .partitionBy("bucket").parquet(folder)


def postings(spark: SparkSession, folder: str, node: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``node, path_idx, nodes, links`` of one node, or of all."""
    found = spark.read.schema(POSTING).parquet(folder)
    if node is not None:
        found = found.filter((F.col("bucket") == _bucket(F.lit(node), buckets)) & (F.col("node") == node))
    return found.drop("bucket")


def neighbours(spark: SparkSession, folder: str, node: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """``node, connected``: nodes that share a path, of one node or of all."""
    found = postings(spark, folder, node, buckets)
    return found.select("node", F.explode("nodes").alias("connected")).distinct()


def edges(spark: SparkSession, folder: str, combine: bool = False, node: str | None = None,
          buckets: int = BUCKETS) -> DataFrame:
    """``node, src, dst, mode``: edges on any path through a node."""
    found = postings(spark, folder, node, buckets)
    return found.select("node", F.inline("links")).select("node", *_edge_key(combine)).distinct()
