import pytest
from conftest import SAMPLE, rows
from pyspark.sql import functions as F

from wayline import schema
from wayline.operators import shape


def test_clean_merges_and_drops(make_routes, spark):
    got = shape.clean_routes(make_routes(
        ("D", "D.S", "W", "Web App (Sheets)", "read", 3),
        ("D", "D.S", "W", "Sheets", "read", 4),
        ("D", "D.S", "W", "Web App (", "read", 5),
        ("D", "D.S", "W", None, "read", 6),
        ("D", None, "W", "Sheets", "read", 7),
        ("D", "D.S", None, "Sheets", "read", 8),
    ))
    assert got.columns == schema.CLEAN_COLUMNS
    assert rows(got) == [("D", "D.S", "W", "Sheets", "read", "ORG", "ACCT", 7)]


def test_clean_prefix_is_a_parameter(make_routes):
    got = shape.clean_routes(make_routes(("D", "D.S", "W", "My Tool (X)", "read", 3)), "My Tool (")
    assert got.first()["CLIENT"] == "X"


@pytest.mark.parametrize("options, clients", [
    ({}, ["Looker", "Power BI", "Tableau", "Tableau", "dbt", "dbt"]),
    ({"databases": ["SALES"]}, ["Tableau", "Tableau", "dbt"]),
    ({"schemas": ["HR.B"]}, ["Looker", "Power BI", "dbt"]),
    ({"warehouses": ["W2"]}, ["Looker", "Power BI", "dbt"]),
    ({"clients": ["Tableau", "absent"]}, ["Tableau", "Tableau"]),
    ({"directions": ["write"]}, ["dbt"]),
    ({"org_pattern": "^O.G$"}, ["Looker", "Power BI", "Tableau", "Tableau", "dbt", "dbt"]),
    ({"org_pattern": "org"}, []),
    ({"more_than": 100}, ["Power BI", "dbt", "dbt"]),
    ({"databases": ["SALES"], "clients": ["Tableau"], "directions": ["read"], "more_than": 80},
     ["Tableau"]),
])
def test_filters(sample, options, clients):
    got = shape.filter_routes(sample, **{"more_than": 0, **options})
    assert sorted(r["CLIENT"] for r in got.collect()) == clients


def test_filters_pass_an_empty_frame(nothing):
    assert shape.filter_routes(nothing, databases=["X"], org_pattern="x").count() == 0


def test_null_organisation_fails_the_pattern(make_routes):
    got = make_routes(("D", "D.S", "W", "C", "read", 20, None), ("D", "D.S", "W", "C", "read", 20))
    assert shape.filter_routes(got, org_pattern=".").count() == 1


def test_threshold_is_strict(make_routes):
    got = make_routes(*[("D", "D.S", "W", "C", "read", n) for n in (9, 10, 11)])
    assert [r["ACCESS_COUNT"] for r in shape.filter_routes(got).collect()] == [11]


def test_top_routes(sample):
    assert [r["ACCESS_COUNT"] for r in shape.top_routes(sample, 3).collect()] == [300, 200, 150]


def test_distinct_values(sample):
    got = [r["value"] for r in shape.distinct_values(sample, "ACCESS_COUNT").collect()]
    assert got == ["100", "150", "200", "300", "50", "80"]


def test_filter_lists(spark):
    def arr(*v):
        return F.array(*[F.lit(x) for x in v])
    got = spark.range(1).select(
        shape.kept_values(arr("c", "a", "x"), arr("a", "b", "c")),
        shape.extended_values(arr("a", "b"), F.lit("c")),
        shape.extended_values(arr("a", "b"), F.lit("a")),
    ).first()
    assert tuple(got) == (["c", "a"], ["a", "b", "c"], ["a", "b"])


def test_group_by(sample):
    got = shape.group_by(sample, ["CLIENT", "DIRECTION"]).collect()
    assert [tuple(r) for r in got] == [
        ("dbt", "DDL", 300), ("dbt", "write", 200), ("Tableau", "read", 180),
        ("Power BI", "read", 150), ("Looker", "read", 50)]
    assert rows(shape.group_by(sample)) == rows(sample)
    with pytest.raises(ValueError):
        shape.group_by(sample, ["ACCESS_COUNT"])


def test_cube_equals_each_group_by(sample):
    from itertools import combinations
    got = shape.group_by_cube(sample).collect()
    seen = {}
    for r in got:
        seen.setdefault(r["grouped"], set()).add(
            (*[r[c] for c in r["grouped"].split(",")], r["ACCESS_COUNT"]))
    dims = schema.GROUP_COLUMNS
    wanted = [c for n in range(1, 6) for c in combinations(dims, n)]
    assert len(seen) == len(wanted) == 31
    for choice in wanted:
        assert seen[",".join(choice)] == {tuple(r) for r in shape.sum_by(sample, *choice).collect()}


def test_null_keys_form_no_group(make_routes):
    got = make_routes(("D", None, "W", "C", "read", 5), ("D", "D.S", "W", "C", "read", 6))
    assert rows(shape.group_by(got, ["SCHEMA_NAME"])) == [("D.S", 6)]


def test_totals(sample, nothing):
    assert tuple(shape.grand_total(sample).first()) == (6, sum(r[5] for r in SAMPLE))
    assert tuple(shape.grand_total(nothing).first()) == (0, 0)


def test_table_view(sample):
    assert shape.table_view(sample, ["DATABASE"]).columns == ["DATABASE", "ACCESS_COUNT"]
    assert shape.table_view(sample).columns == schema.TABLE_ORDER
    assert shape.table_view(sample, ["DIRECTION", "CLIENT"]).columns == [
        "ICON", "CLIENT", "DIRECTION", "ACCESS_COUNT"]


def test_cube_by_lattice(sample, nothing):
    from wayline.operators import shape

    for dims in (["CLIENT"], ["DIRECTION", "CLIENT"], ["CLIENT", "WAREHOUSE", "DATABASE"]):
        assert rows(shape.cube_by_lattice(sample, dims)) == rows(shape.group_by_cube(sample, dims))
    assert shape.cube_by_lattice(nothing, ["CLIENT", "DATABASE"]).count() == 0
