"""The whole graph of a route frame."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from wayline.functions.layers import DEFAULT_LAYERS, LayerRules
from wayline.operators import graph
from wayline.operators.graph import FULL_VIEW, View
from wayline.session import settle


@dataclass
class Network:
    """Nodes, edges, paths and layers, each worked out when asked for.

    The routes are rolled up and settled once; all parts read that.
    """

    routes: DataFrame
    account: str
    view: View = FULL_VIEW
    combine: bool = False
    layers: LayerRules = DEFAULT_LAYERS

    @cached_property
    def rollup(self) -> DataFrame:
        return settle(graph.edge_rollup(self.routes), "rollup")

    @cached_property
    def numbered(self) -> DataFrame:
        return graph.with_path_idx(self.rollup)

    @cached_property
    def nodes(self) -> DataFrame:
        return graph.network_nodes(self.rollup, self.view, self.layers)

    @property
    def node_texts(self) -> DataFrame:
        return graph.with_text(self.nodes, graph.node_links(self.rollup), self.account)

    @property
    def node_types(self) -> DataFrame:
        return self.nodes.select("id", "type")

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges(self.rollup, self.view, self.combine)

    @property
    def edge_texts(self) -> DataFrame:
        return graph.with_edge_text(self.edges)

    @property
    def edge_paths(self) -> DataFrame:
        return graph.edge_paths(self.numbered, self.view, self.combine)

    @property
    def paths(self) -> DataFrame:
        return graph.path_vectors(self.numbered, self.view)

    @cached_property
    def members(self) -> DataFrame:
        return settle(graph.layer_members(self.nodes), "members")

    @property
    def contracted_edges(self) -> DataFrame:
        return graph.contracted(self.edges, self.members, self.combine)

    def neighbours(self, node: str | None = None) -> DataFrame:
        return graph.path_neighbours(self.rollup, self.view, node)

    def neighbour_edges(self, node: str | None = None) -> DataFrame:
        return graph.path_edges(self.rollup, self.view, self.combine, node)
