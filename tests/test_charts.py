import random
from collections import Counter, defaultdict

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayline.operators import bars, flow, hierarchy, matrix, shape


@pytest.fixture(scope="module")
def many(make_routes):
    """Random routes: few names, ties, one client with most of the rows."""
    rng = random.Random(11)
    found = []
    for _ in range(400):
        db = f"DB{rng.randrange(20)}"
        client = "hot" if rng.random() < 0.4 else f"client {rng.randrange(30)}"
        found.append((db, f"{db}.S{rng.randrange(3)}", f"W{rng.randrange(4)}", client,
                      rng.choice(["read", "write", "DDL", "metadata"]), rng.randrange(1, 6)))
    return make_routes(*found).cache()


def test_bars(sample, nothing):
    got = rows(bars.bars(sample, "CLIENT"))
    assert got == sorted([("dbt", "Write", 500), ("Tableau", "Read", 180),
                          ("Power BI", "Read", 150), ("Looker", "Read", 50)], key=repr)
    assert {r[0] for r in rows(bars.bars(sample, "CLIENT", 2))} == {"dbt", "Tableau"}
    assert bars.bars(nothing, "CLIENT").count() == 0


def test_bars_keep_the_top_only(many):
    totals = Counter()
    for r in many.collect():
        totals[r["CLIENT"]] += r["ACCESS_COUNT"]
    top = sorted(totals, key=lambda c: (-totals[c], c))[:10]
    got = bars.bars(many, "CLIENT").collect()
    assert {r["category"] for r in got} == set(top)
    assert sum(r["access_count"] for r in got) == sum(totals[c] for c in top)
    assert {r["direction"] for r in got} <= {"Read", "Write"}


def test_dense_bars(sample, make_routes):
    got = rows(bars.dense_bars(sample, "CLIENT"))
    assert len(got) == 8 and ("dbt", "Read", 0, 4) in got and ("Looker", "Write", 0, 1) in got
    reads = make_routes(("D", "D.S", "W", "C", "metadata", 5), ("D", "D.S", "W", "E", "read", 9))
    assert rows(bars.dense_bars(reads, "CLIENT")) == [("C", "Read", 5, 1), ("E", "Read", 9, 2)]


def test_chart_headings(sample):
    got = bars.chart_table(bars.bars(sample, "SCHEMA_NAME"), "SCHEMA_NAME")
    assert got.columns == ["Schema_Name", "Direction", "Access Count"]


def test_heatmap(many):
    cells = Counter()
    for r in many.collect():
        cells[r["DATABASE"], r["CLIENT"]] += r["ACCESS_COUNT"]

    def order(pairs, axis):
        totals = Counter()
        for key, n in pairs.items():
            totals[key[axis]] += n
        return sorted(totals, key=lambda v: (-totals[v], v))
    top = [set(order(cells, axis)[:15]) for axis in (0, 1)]
    left = {k: n for k, n in cells.items() if k[0] in top[0] and k[1] in top[1]}
    axes = [order(left, axis) for axis in (0, 1)]
    want = [(r, c, left.get((r, c), 0), i, j)
            for i, r in enumerate(axes[0], 1) for j, c in enumerate(axes[1], 1)]
    found = matrix.heatmap(many, "DATABASE", "CLIENT")
    assert rows(found) == sorted(want, key=lambda r: tuple(map(repr, r)))
    wide = matrix.pivoted(found)
    assert wide.columns == ["row", *axes[1]]
    assert [r["row"] for r in wide.collect()] == axes[0]


def test_heatmap_of_nothing(nothing):
    assert matrix.heatmap(nothing, "DATABASE", "CLIENT").count() == 0


@pytest.mark.parametrize("levels", [4, 3])
def test_treemap(many, levels):
    frame = many if levels == 4 else many.drop("SCHEMA_NAME")
    keys = [k for k in ("CLIENT", "DATABASE", "SCHEMA_NAME", "DIRECTION") if k in frame.columns]
    sums = Counter()
    for r in frame.collect():
        for i in range(levels + 1):
            sums[tuple(r[k] for k in keys[:i])] += r["ACCESS_COUNT"]
    got = {r["id"]: r for r in hierarchy.treemap(frame).collect()}
    assert len(got) == len(sums) - 1
    for path, value in sums.items():
        if not path:
            continue
        r = got["/".join(path)]
        assert r["value"] == value and r["level"] == len(path)
        assert r["parent"] == "/".join(path[:-1])
        assert r["share"] == pytest.approx(value / sums[path[:-1]], abs=1e-6)
        want = path[-1].split(".")[-1] if keys[len(path) - 1] == "SCHEMA_NAME" else path[-1]
        assert r["label"] == (want.upper() if len(path) == levels else want)


def test_treemap_with_slashes_in_names(make_routes):
    got = hierarchy.treemap(make_routes(("C", "C.S", "W", "A/B", "read", 6),
                                        ("B/C", "B/C.S", "W", "A", "read", 3)))
    twins = [r for r in got.collect() if r["id"] == "A/B/C"]
    assert sorted((r["value"], r["share"]) for r in twins) == [(3, 1.0), (6, 1.0)]


def test_treemap_order(sample):
    got = hierarchy.drawing_order(hierarchy.treemap(sample)).collect()
    assert [r["id"] for r in got[:4]] == ["dbt", "Tableau", "Power BI", "Looker"]


def brute_positions(values):
    if len(values) == 1:
        return [0.5]
    total, found, at = sum(values), [], 0.01
    for v in values:
        height = v / total * 0.85 * 0.98
        found.append(min(at + height / 2, 0.99))
        at += height + 0.15 / (len(values) - 1) * 0.98
    return found


@pytest.mark.parametrize("columns", [4, 3])
def test_sankey(many, columns):
    stages = ["CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME"][:columns]
    frame = many if columns == 4 else many.drop("SCHEMA_NAME")
    paths = flow.settle(flow.flow_paths(frame, "read"), "t")
    nodes = flow.flow_nodes(paths)
    data = [r for r in many.collect() if r["DIRECTION"] == "read"]
    want, index = [], {}
    for i, stage in enumerate(stages):
        totals = Counter()
        for r in data:
            totals[r[stage]] += r["ACCESS_COUNT"]
        order = sorted(totals, key=lambda v: (-totals[v], v))
        xs = (0.001, 0.333, 0.666, 0.999) if columns == 4 else (0.001, 0.5, 0.999)
        for name, y in zip(order, brute_positions([totals[v] for v in order])):
            index[i, name] = len(index)
            label = name.split(".")[-1] if i == 3 else name
            want.append((index[i, name], i, name, label, xs[i], pytest.approx(y, abs=2e-6),
                         totals[name]))
    assert [tuple(r) for r in nodes.orderBy("idx").collect()] == want
    links = Counter()
    for r in data:
        for i, (a, b) in enumerate(zip(stages, stages[1:])):
            links[index[i, r[a]], index[i + 1, r[b]]] += r["ACCESS_COUNT"]
    got = {(r.src_idx, r.dst_idx): r.value for r in flow.flow_links(paths, nodes).collect()}
    assert got == dict(links)


def test_sankey_keeps_flow(many):
    diagram = flow.sankey(many, "write")
    into, out = defaultdict(int), defaultdict(int)
    for r in diagram.links.collect():
        out[r.src_idx] += r.value
        into[r.dst_idx] += r.value
    for r in diagram.nodes.collect():
        if r.col_no < 3:
            assert out[r.idx] == r.value
        if r.col_no > 0:
            assert into[r.idx] == r.value


def test_sankey_takes_directions_literally(sample, nothing):
    got = flow.sankey(sample, "write")
    assert {r.name for r in got.nodes.filter("col_no = 2").collect()} == {"SALES"}
    empty = flow.sankey(sample.filter(F.col("DIRECTION") == "write"), "read")
    assert empty.nodes.count() == 0 and empty.links.count() == 0


def test_sums_agree(many):
    total = shape.grand_total(many).first()["total"]
    tree = hierarchy.treemap(many).groupBy("level").sum("value").collect()
    assert {r[1] for r in tree} == {total} and len(tree) == 4
