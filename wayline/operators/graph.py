"""The access graph: weighted nodes, edges between them, and the paths behind both."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayline.functions.direction import is_write
from wayline.functions.layers import DEFAULT_LAYERS, LayerRules, layer_of
from wayline.functions.names import short_schema
from wayline.functions.scale import node_size
from wayline.functions.text import edge_text, neighbour_line, node_text
from wayline.operators.prefix import prefix_scan
from wayline.schema import MEASURE
from wayline.session import settle

EDGE_KEYS = ["CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME", "DIRECTION"]

#: Node types in the order of the chain, and the column each comes from.
CHAIN = {"client": "CLIENT", "warehouse": "WAREHOUSE", "database": "DATABASE",
         "schema": "SCHEMA_NAME"}
#: The order in which one route introduces its nodes.
INTRODUCTION = ["database", "schema", "warehouse", "client"]
#: Which node lists which as a neighbour.  Not symmetric: a client lists
#: databases only, and a database does not list warehouses.
NEIGHBOURS = [
    ("DATABASE", "CLIENT"), ("CLIENT", "DATABASE"), ("WAREHOUSE", "CLIENT"),
    ("WAREHOUSE", "DATABASE"), ("SCHEMA_NAME", "DATABASE"), ("DATABASE", "SCHEMA_NAME"),
    ("SCHEMA_NAME", "CLIENT"),
]
TOP_NEIGHBOURS = 3


@dataclass(frozen=True)
class View:
    """Which node types are drawn; at least two of the four stay visible."""

    hide_clients: bool = False
    hide_warehouses: bool = False
    hide_databases: bool = False
    hide_schemas: bool = False

    def __post_init__(self):
        if len(self.visible) < 2:
            raise ValueError("at least two node types must stay visible")

    @property
    def visible(self) -> list[str]:
        hidden = {"client": self.hide_clients, "warehouse": self.hide_warehouses,
                  "database": self.hide_databases, "schema": self.hide_schemas}
        return [t for t in CHAIN if not hidden[t]]


def legal_views() -> list[View]:
    """Every choice of hidden types that leaves two or more."""
    choices = product((False, True), repeat=4)
    return [View(*hidden) for hidden in choices if sum(hidden) <= 2]


FULL_VIEW = View()
#: What a page shows at first.
STARTING_VIEW = View(hide_warehouses=True)


def _present(column: str) -> Column:
    """Schemas may be missing from a route; other nodes are always there."""
    if column != "SCHEMA_NAME":
        return F.lit(True)
    return F.col(column).isNotNull() & (F.col(column) != "")


def edge_rollup(routes: DataFrame) -> DataFrame:
    """One row per route, with the organisation and account of its biggest part.

    A missing schema is the empty string from here on.
    """
    biggest = F.min(F.struct((-F.col(MEASURE)).alias("w"), "ORGANIZATION_NAME", "ACCOUNT_NAME"))
    return (
        routes.dropna("any", subset=EDGE_KEYS).groupBy(*EDGE_KEYS)
        .agg(F.sum(MEASURE).cast("long").alias(MEASURE), biggest.alias("_b"))
        .select(*EDGE_KEYS, MEASURE, "_b.ORGANIZATION_NAME", "_b.ACCOUNT_NAME")
    )


def with_path_idx(rollup: DataFrame) -> DataFrame:
    """Number the paths from 0, heaviest first.  ``rollup`` should be settled."""
    return prefix_scan(rollup, [F.desc(MEASURE), *EDGE_KEYS], "path_idx")


# --- nodes -----------------------------------------------------------------


def _occurrences(rollup: DataFrame, view: View) -> DataFrame:
    """Each route once per node name it holds.

    The empty name counts as a node of weight 0, unless it is a schema's.
    """
    rows = []
    for order, kind in enumerate(INTRODUCTION):
        name = F.col(CHAIN[kind])
        rows.append(F.struct(
            F.lit(order).alias("intro"), F.lit(kind).alias("type"), name.alias("node"),
            F.lit(kind in view.visible).alias("visible"),
            F.when(name == "", F.lit(0)).otherwise(F.col(MEASURE)).cast("long").alias("weight"),
        ))
    exploded = rollup.select("*", F.inline(F.array(*rows)))
    return exploded.filter((F.col("type") != "schema") | (F.col("node") != ""))


def node_stats(rollup: DataFrame, view: View = FULL_VIEW) -> DataFrame:
    """``node, total, read, write, first`` by bare name.

    Equal names of different types share one row.  ``first`` tells where a
    visible node is seen first when routes are gone through by weight; it is
    NULL for hidden nodes.  It is a minimum over an ordering key, so no order
    of all routes is needed.
    """
    write = is_write(F.col("DIRECTION"))
    weight = F.col("weight")
    seen = F.struct((-F.col(MEASURE)).alias("w"), *EDGE_KEYS, "intro", "type",
                    "ORGANIZATION_NAME")
    return _occurrences(rollup, view).groupBy("node").agg(
        F.sum(weight).cast("long").alias("total"),
        F.sum(F.when(~write, weight).otherwise(0)).cast("long").alias("read"),
        F.sum(F.when(write, weight).otherwise(0)).cast("long").alias("write"),
        F.min(F.when(F.col("visible"), seen)).alias("first"),
    )


def node_links(rollup: DataFrame) -> DataFrame:
    """``node, neighbour, cnt`` over the seven directed relations."""
    pairs = [
        F.when(_present(a) & _present(b),
               F.struct(F.col(a).alias("node"), F.col(b).alias("neighbour")))
        for a, b in NEIGHBOURS
    ]
    return (
        rollup.select(F.inline(F.array_compact(F.array(*pairs))), MEASURE)
        .groupBy("node", "neighbour").agg(F.sum(MEASURE).cast("long").alias("cnt"))
    )


def top_links(links: DataFrame, n: int = TOP_NEIGHBOURS) -> DataFrame:
    """The heaviest neighbours of each node.

    The rank filter cuts each node's neighbours before they are shuffled.
    """
    order = Window.partitionBy("node").orderBy(F.desc("cnt"), F.asc("neighbour"))
    return links.withColumn("rk", F.row_number().over(order)).filter(F.col("rk") <= n)


def network_nodes(rollup: DataFrame, view: View = FULL_VIEW,
                  layers: LayerRules = DEFAULT_LAYERS) -> DataFrame:
    """``id, type, label, size, layer, org, total, read, write`` of visible nodes.

    Sizes are scaled over all nodes, hidden ones included; the statistics are
    settled, since their bounds are needed before any size is.
    """
    stats = settle(node_stats(rollup, view), "stats")
    bounds = stats.agg(F.struct(F.min("total").alias("low"), F.max("total").alias("high"))
                       .alias("bounds")).scalar()
    kind, node = F.col("first.type"), F.col("node")
    label = F.when((kind == "schema") & F.lit("database" in view.visible), short_schema(node))
    layer = F.when(kind == "database", layer_of(node, layers)).otherwise("")
    return stats.filter(F.col("first").isNotNull()).select(
        node.alias("id"), kind.alias("type"), label.otherwise(node).alias("label"),
        node_size(F.col("total"), bounds["low"], bounds["high"], kind).alias("size"),
        layer.alias("layer"), F.col("first.ORGANIZATION_NAME").alias("org"),
        "total", "read", "write",
    )


def with_text(nodes: DataFrame, links: DataFrame, account: str) -> DataFrame:
    """Add each node's summary with its three heaviest neighbours."""
    line = neighbour_line(F.col("neighbour"), F.col("cnt"))
    lines = top_links(links).groupBy(F.col("node").alias("id")).agg(*[
        F.max(F.when(F.col("rk") == i, line)).alias(f"_line{i}")
        for i in range(1, TOP_NEIGHBOURS + 1)
    ])
    text = node_text(
        F.initcap("type"), F.col("id"), F.col("org"), F.lit(account), F.col("total"),
        F.col("read"), F.col("write"),
        *[F.col(f"_line{i}") for i in range(1, TOP_NEIGHBOURS + 1)],
    )
    return nodes.join(lines, "id", "left").select(*nodes.columns, text.alias("text"))


def layer_members(nodes: DataFrame) -> DataFrame:
    """``label, member``: the databases of each layer that has any.

    One row per member: a list per layer would gather an unbounded group.
    """
    return nodes.filter((F.col("type") == "database") & (F.col("layer") != "")).select(
        F.col("layer").alias("label"), F.col("id").alias("member")
    )


# --- edges -----------------------------------------------------------------


def _links(view: View) -> Column:
    """The links of a route between neighbouring visible nodes, as an array.

    A write runs down the chain, a read runs up.
    """
    write = is_write(F.col("DIRECTION"))
    columns = [CHAIN[t] for t in view.visible]
    return F.array_compact(F.array(*[
        F.when(_present(down), F.struct(
            F.when(write, F.col(up)).otherwise(F.col(down)).alias("src"),
            F.when(write, F.col(down)).otherwise(F.col(up)).alias("dst"),
            write.alias("is_write"),
        ))
        for up, down in zip(columns, columns[1:])
    ]))


def _edge_key(combine: bool) -> list[Column]:
    """What makes two links one edge."""
    if combine:
        return [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"),
                F.lit("ALL").alias("mode")]
    return [F.col("src"), F.col("dst"),
            F.when(F.col("is_write"), "WRITE").otherwise("READ").alias("mode")]


def edge_paths(numbered: DataFrame, view: View = FULL_VIEW, combine: bool = False) -> DataFrame:
    """``src, dst, mode, path_idx``: which paths run over an edge.

    One row each: a list per edge would gather an unbounded group.
    """
    return numbered.select("path_idx", F.inline(_links(view))).select(
        *_edge_key(combine), "path_idx"
    )


def edges(rollup: DataFrame, view: View = FULL_VIEW, combine: bool = False) -> DataFrame:
    """``src, dst, mode, value, n_paths``, one row per pair and mode.

    Combined edges merge both directions of a pair under its smaller name.
    """
    return (
        rollup.select(MEASURE, F.inline(_links(view))).select(*_edge_key(combine), MEASURE)
        .groupBy("src", "dst", "mode")
        .agg(F.sum(MEASURE).cast("long").alias("value"), F.count("*").alias("n_paths"))
    )


def with_edge_text(found: DataFrame) -> DataFrame:
    return found.withColumn(
        "text", edge_text(F.col("src"), F.col("dst"), F.col("mode"), F.col("value"))
    )


def contracted(found: DataFrame, members: DataFrame, combine: bool = False) -> DataFrame:
    """Edges with the databases of a layer replaced by one node for the layer.

    Edges inside a layer vanish; edges that become alike are summed.
    """
    def lookup(end):
        return members.select(F.col("member").alias(end), F.col("label").alias(f"_{end}_layer"))

    def mapped(end):
        cluster = F.concat(F.lit("cluster:"), F.col(f"_{end}_layer"))
        return F.coalesce(cluster, F.col(end)).alias(end)

    moved = found.join(lookup("src"), "src", "left").join(lookup("dst"), "dst", "left")
    inside = F.col("_src_layer") == F.col("_dst_layer")
    moved = moved.filter(~F.coalesce(inside, F.lit(False))).select(
        mapped("src"), mapped("dst"), "mode", "value", "n_paths"
    )
    if combine:
        moved = moved.select(F.least("src", "dst").alias("src"),
                             F.greatest("src", "dst").alias("dst"), "mode", "value", "n_paths")
    return moved.groupBy("src", "dst", "mode").agg(
        F.sum("value").cast("long").alias("value"), F.sum("n_paths").cast("long").alias("n_paths")
    )


def layer_nodes(members: DataFrame) -> DataFrame:
    """The nodes that stand for whole layers, labelled with their size."""
    return members.groupBy("label").agg(F.count("*").alias("members")).select(
        F.concat(F.lit("cluster:"), F.col("label")).alias("id"),
        F.concat(F.col("label"), F.lit(" ("), F.col("members").cast("string"), F.lit(")"))
        .alias("label"),
        "members",
    )


# --- paths -----------------------------------------------------------------


def _path(view: View) -> list[Column]:
    """Client, warehouse, database and schema of a path, hidden ones filled in.

    A hidden client or warehouse takes the first visible node, a hidden database
    and a hidden or missing schema the last.
    """
    shown = [CHAIN[t] for t in view.visible]
    fixed = [c for c in shown if c != "SCHEMA_NAME"]
    first, last = F.col(fixed[0]), F.col(fixed[-1])
    if "SCHEMA_NAME" in shown:
        last = F.when(_present("SCHEMA_NAME"), F.col("SCHEMA_NAME")).otherwise(last)
    fill = {"CLIENT": first, "WAREHOUSE": first, "DATABASE": last, "SCHEMA_NAME": last}
    # A visible schema equals ``last`` wherever it is present.
    return [F.col(c) if c in fixed else fill[c] for c in CHAIN.values()]


def path_vectors(numbered: DataFrame, view: View = FULL_VIEW) -> DataFrame:
    """``path_idx, p0, p1, p2, p3`` of every path, edges or not."""
    return numbered.select(
        "path_idx", *[c.alias(f"p{i}") for i, c in enumerate(_path(view))]
    )


def _path_nodes(view: View) -> Column:
    """Distinct nodes of a path, at most four; a missing schema is none."""
    return F.array_distinct(F.filter(
        F.array(*_path(view)), lambda n: n.isNotNull()
    ))


def path_neighbours(rollup: DataFrame, view: View = FULL_VIEW,
                    node: str | None = None) -> DataFrame:
    """``node, connected``: nodes that share a path, of one node or of all.

    A path has at most four nodes, so a row fans out to sixteen at most, and
    pairs are made distinct before they are shuffled.
    """
    paths = rollup.select(_path_nodes(view).alias("_nodes"))
    if node is not None:
        paths = paths.filter(F.array_contains("_nodes", node))
    pairs = paths.select("_nodes", F.explode("_nodes").alias("node"))
    if node is not None:
        pairs = pairs.filter(F.col("node") == node)
    return pairs.select("node", F.explode("_nodes").alias("connected")).distinct()


def path_edges(rollup: DataFrame, view: View = FULL_VIEW, combine: bool = False,
               node: str | None = None) -> DataFrame:
    """``node, src, dst, mode``: edges on any path through a node."""
    paths = rollup.select(_path_nodes(view).alias("_nodes"), _links(view).alias("_links"))
    if node is not None:
        paths = paths.filter(F.array_contains("_nodes", node))
    pairs = paths.select("_links", F.explode("_nodes").alias("node"))
    if node is not None:
        pairs = pairs.filter(F.col("node") == node)
    return pairs.select("node", F.inline("_links")).select("node", *_edge_key(combine)).distinct()
