import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from conftest import rows

from wayline.operators import graph
from wayline.operators.graph import View
from wayline.plans.network import Network
from wayline.session import settle

COLUMNS = {"client": "CLIENT", "warehouse": "WAREHOUSE", "database": "DATABASE",
           "schema": "SCHEMA_NAME"}
FLAGS = ["hide_clients", "hide_warehouses", "hide_databases", "hide_schemas"]
VIEWS = [View(**dict(zip(FLAGS, bits))) for bits in product([False, True], repeat=4)
         if sum(bits) <= 2]


@pytest.fixture(scope="module")
def rollup(make_routes):
    """Random routes with empty schemas and one name used for two types."""
    rng = random.Random(5)
    found = []
    for _ in range(150):
        db = rng.choice(["RAW_A", "CLEANED_B", "X_MART_DB", "INTEGRATED_DB", "LAB", "same"])
        schema = "" if rng.random() < 0.2 else f"{db}.S{rng.randrange(3)}"
        client = rng.choice(["hot", "hot", "dbt", "same", "Tableau"])
        found.append((db, schema, f"W{rng.randrange(3)}", client,
                      rng.choice(["read", "write", "DDL", "metadata"]), rng.randrange(1, 9),
                      rng.choice(["O1", "O2"])))
    return settle(graph.edge_rollup(make_routes(*found)), "test")


@pytest.fixture(scope="module")
def paths(rollup):
    """The routes in path order, as dictionaries."""
    found = [r.asDict() for r in rollup.collect()]
    return sorted(found, key=lambda r: (-r["ACCESS_COUNT"], *[r[c] for c in graph.EDGE_KEYS]))


def chain_of(route, view):
    return [route[COLUMNS[t]] for t in view.visible if t != "schema" or route["SCHEMA_NAME"]]


def links_of(route, view):
    chain = chain_of(route, view)
    pairs = list(zip(chain, chain[1:]))
    write = route["DIRECTION"] in ("write", "DDL")
    return [(a, b, True) for a, b in pairs] if write else [(b, a, False) for a, b in pairs]


def test_rollup(make_routes):
    got = graph.edge_rollup(make_routes(
        ("D", "D.S", "W", "C", "read", 5, "small"), ("D", "D.S", "W", "C", "read", 7, "big"),
        ("D", None, "W", "C", "read", 7), ("D", "D.S", "W", "C", "write", 1)))
    assert rows(got) == [("C", "W", "D", "D.S", "read", 12, "big", "ACCT"),
                         ("C", "W", "D", "D.S", "write", 1, "ORG", "ACCT")]


def test_sample_sums(sample):
    got = {(r["CLIENT"], r["DIRECTION"]): r["ACCESS_COUNT"]
           for r in graph.edge_rollup(sample).collect()}
    assert got["Tableau", "read"] == 180 and len(got) == 5


def test_node_stats(rollup, paths):
    want = defaultdict(Counter)
    for r in paths:
        for c in COLUMNS.values():
            if r[c]:
                mode = "write" if r["DIRECTION"] in ("write", "DDL") else "read"
                want[r[c]].update({"total": r["ACCESS_COUNT"], mode: r["ACCESS_COUNT"]})
    got = {r["node"]: (r["total"], r["read"], r["write"]) for r in graph.node_stats(rollup).collect()}
    assert got == {n: (s["total"], s["read"], s["write"]) for n, s in want.items()}


def test_node_links(rollup, paths):
    want = Counter()
    for r in paths:
        for a, b in graph.NEIGHBOURS:
            if r[a] and r[b]:
                want[r[a], r[b]] += r["ACCESS_COUNT"]
    found = graph.node_links(rollup)
    assert {(r.node, r.neighbour): r.cnt for r in found.collect()} == dict(want)
    assert not any(n == "W0" for _, n in want)
    top = defaultdict(list)
    for r in graph.top_links(found).orderBy("node", "rk").collect():
        top[r.node].append(r.neighbour)
    for node, names in top.items():
        order = sorted((b for a, b in want if a == node), key=lambda b: (-want[node, b], b))
        assert names == order[:3]


@pytest.mark.parametrize("view", VIEWS, ids=lambda v: "+".join(v.visible))
def test_views(rollup, paths, view):
    order = {"database": 0, "schema": 1, "warehouse": 2, "client": 3}
    first, vectors, edges, combined, uses = {}, [], Counter(), Counter(), Counter()
    near = defaultdict(set)
    for i, r in enumerate(paths):
        for t in sorted(view.visible, key=order.get):
            if r[COLUMNS[t]]:
                first.setdefault(r[COLUMNS[t]], (t, r["ORGANIZATION_NAME"]))
        chain = chain_of(r, view)
        own = {t: r[COLUMNS[t]] for t in COLUMNS}
        seen = [own["client"] if "client" in view.visible else chain[0],
                own["warehouse"] if "warehouse" in view.visible else chain[0],
                own["database"] if "database" in view.visible else chain[-1],
                own["schema"] if "schema" in view.visible and own["schema"] else chain[-1]]
        vectors.append((i, *seen))
        for a in seen:
            near[a].update(seen)
        for a, b, w in links_of(r, view):
            mode = "WRITE" if w else "READ"
            edges[a, b, mode] += r["ACCESS_COUNT"]
            uses[a, b, mode] += 1
            combined[min(a, b), max(a, b), "ALL"] += r["ACCESS_COUNT"]

    nodes = {r["id"]: r for r in graph.network_nodes(rollup, view).collect()}
    assert {n: (r["type"], r["org"]) for n, r in nodes.items()} == first
    for n, r in nodes.items():
        short = r["type"] == "schema" and "database" in view.visible
        assert r["label"] == (n.split(".")[-1] if short else n)
    numbered = graph.with_path_idx(rollup)
    assert rows(graph.path_vectors(numbered, view)) == sorted(
        vectors, key=lambda r: tuple(map(repr, r)))
    got = graph.edges(rollup, view).collect()
    assert {(r.src, r.dst, r.mode): r.value for r in got} == dict(edges)
    assert {(r.src, r.dst, r.mode): r.n_paths for r in got} == dict(uses)
    both = graph.edges(rollup, view, True).collect()
    assert {(r.src, r.dst, r.mode): r.value for r in both} == dict(combined)
    assert sum(edges.values()) == sum(combined.values()) == sum(
        (len(chain_of(r, view)) - 1) * r["ACCESS_COUNT"] for r in paths)
    got = defaultdict(set)
    for r in graph.path_neighbours(rollup, view).collect():
        got[r.node].add(r.connected)
    assert got == near


def test_edges_through_a_node(rollup, paths):
    view = View(hide_warehouses=True)
    links = defaultdict(set)
    for r in paths:
        for node in set(chain_of(r, view)):
            links[node].update((a, b, "WRITE" if w else "READ") for a, b, w in links_of(r, view))
    got = defaultdict(set)
    for r in graph.path_edges(rollup, view).collect():
        got[r.node].add((r.src, r.dst, r.mode))
    assert got == links
    one = {(r.src, r.dst, r.mode) for r in graph.path_edges(rollup, view, node="dbt").collect()}
    assert one == links["dbt"]
    near = graph.path_neighbours(rollup, view, "dbt").collect()
    assert {r.connected for r in near} == {
        n for r in paths if "dbt" in chain_of(r, view) for n in chain_of(r, view)}


def test_edge_paths(rollup, paths):
    want = [(a, b, "WRITE" if w else "READ", i) for i, r in enumerate(paths)
            for a, b, w in links_of(r, View())]
    assert rows(graph.edge_paths(graph.with_path_idx(rollup))) == sorted(
        want, key=lambda r: tuple(map(repr, r)))


def test_at_least_two_types_stay(make_routes):
    with pytest.raises(ValueError):
        View(hide_clients=True, hide_databases=True, hide_schemas=True)
    assert len(VIEWS) == 11


def test_one_node_in_the_chain(make_routes):
    view = View(hide_clients=True, hide_warehouses=True)
    got = settle(graph.edge_rollup(make_routes(("D", "", "W", "C", "read", 4))), "t")
    assert graph.edges(got, view).count() == 0
    assert rows(graph.path_vectors(graph.with_path_idx(got), view)) == [(0, "D", "D", "D", "D")]


def test_empty_warehouse_is_a_node_of_no_weight(make_routes):
    got = settle(graph.edge_rollup(make_routes(("D", "D.S", "", "C", "read", 4))), "t")
    nodes = {r["id"]: (r["type"], r["total"]) for r in graph.network_nodes(got).collect()}
    assert nodes == {"D": ("database", 4), "D.S": ("schema", 4), "": ("warehouse", 0),
                     "C": ("client", 4)}


def test_network(sample, nothing):
    net = Network(sample, "ACCT", View(hide_warehouses=True), combine=True)
    text = {r["id"]: r["text"] for r in net.node_texts.collect()}["SALES"]
    assert text.startswith("Database: SALES\nOrganization: ORG\nAccount: ACCT\n")
    assert "Total Access: 380\n  Read:  180\n  Write: 200\n" in text
    assert text.endswith("Top Connections:\n  SALES.A: 380\n  dbt: 200\n  Tableau: 180")
    assert {r["mode"] for r in net.edge_texts.collect()} == {"ALL"}
    empty = Network(nothing, "ACCT")
    for part in (empty.nodes, empty.edges, empty.paths, empty.members, empty.edge_paths):
        assert part.count() == 0


def test_layers(rollup):
    view = View(hide_warehouses=True, hide_schemas=True)
    nodes = graph.network_nodes(rollup, view)
    members = graph.layer_members(nodes)
    assert rows(members) == [("Clean Layer", "CLEANED_B"), ("Clean Layer", "INTEGRATED_DB"),
                             ("Gold Layer", "X_MART_DB"), ("Raw Layer", "RAW_A")]
    assert rows(graph.layer_nodes(members)) == [
        ("cluster:Clean Layer", "Clean Layer (2)", 2), ("cluster:Gold Layer", "Gold Layer (1)", 1),
        ("cluster:Raw Layer", "Raw Layer (1)", 1)]
    found = graph.edges(rollup, view, True)
    layer = {m: f"cluster:{label}" for label, m in rows(members)}
    want = Counter()
    for r in found.collect():
        a, b = layer.get(r.src, r.src), layer.get(r.dst, r.dst)
        want[min(a, b), max(a, b)] += r.value
    got = {(r.src, r.dst): r.value for r in graph.contracted(found, members, True).collect()}
    assert got == dict(want)


def test_links_inside_a_layer_vanish(spark):
    found = spark.createDataFrame([("a", "b", "READ", 5, 1), ("a", "c", "READ", 2, 1),
                                   ("b", "c", "READ", 3, 1), ("c", "c", "READ", 1, 1)],
                                  "src string, dst string, mode string, value long, n_paths long")
    members = spark.createDataFrame([("L", "a"), ("L", "b")], "label string, member string")
    assert rows(graph.contracted(found, members)) == [
        ("c", "c", "READ", 1, 1), ("cluster:L", "c", "READ", 5, 2)]


def test_index_of_paths(spark, sample, tmp_path):
    """One node or all, from the index and from the routes; a look reads one folder."""
    from wayline.operators import path_index

    rollup = graph.edge_rollup(sample)
    for k, view in enumerate((graph.FULL_VIEW, graph.STARTING_VIEW)):
        folder = f"{tmp_path}/{k}"
        path_index.write_index(graph.with_path_idx(rollup), folder, view, buckets=8)
        for node in (None, "dbt", "SALES", "W1", "no such node"):
            got = path_index.neighbours(spark, folder, node, 8)
            assert rows(got) == rows(graph.path_neighbours(rollup, view, node))
            for combine in (False, True):
                got = path_index.edges(spark, folder, combine, node, 8)
                assert rows(got) == rows(graph.path_edges(rollup, view, combine, node))
    one = path_index.postings(spark, folder, "dbt", 8)
    assert len(one.inputFiles()) and one.select("path_idx").distinct().count() == 2
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan and "EqualTo(node,dbt)" in plan


def test_index_of_no_paths(spark, nothing, tmp_path):
    from wayline.operators import path_index

    path_index.write_index(graph.with_path_idx(graph.edge_rollup(nothing)), f"{tmp_path}/i")
    assert path_index.neighbours(spark, f"{tmp_path}/i", "dbt").count() == 0
