import hashlib
import math

import pytest
from pyspark.sql import functions as F

from wayline import functions as fn
from wayline.functions.direction import access_mode


def values(spark, expr, *inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v"))).collect()]


def test_object_names(spark):
    names = ["DB1", "DB1.", "A.B", "A.B.C", "A..C", ".X.Y", None]
    assert values(spark, fn.database_of, *names) == ["DB1", "DB1", "A", "A", "A", "", None]
    assert values(spark, fn.qualified_schema_of, *names) == [
        None, None, "A.B", "A.B", None, ".X", None]


def test_short_schema(spark):
    assert values(spark, fn.short_schema, "A.B", "A.B.C", "S", "", None) == ["B", "C", "S", "", None]


def test_feature_label(spark):
    found = values(spark, lambda c: fn.feature_label(c, "Web App ("),
                   "Web App (Sheets)", "Web App (", "Web App ()", "Other (X)", None)
    assert found == ["Sheets", None, None, "Other (X)", None]


@pytest.mark.parametrize("statement, direction", [
    ("CREATE_TABLE_AS_SELECT", "DDL"), ("ALTER_SESSION", "DDL"), ("UNDROP_TABLE", "DDL"),
    ("GRANT", "DDL"), ("RESTORE", "DDL"), ("DESCRIBE", "metadata"), ("SHOW_TABLES", "metadata"),
    ("DESC", "metadata"), ("EXPLAIN", "metadata"), ("UNLOAD", "read"), ("SELECT", "read"),
    ("GET_FILES", "read"), ("MERGE", "write"), ("REMOVE_FILES", "write"), ("select", "write"),
    ("GRANTS", "write"),
])
def test_direction(spark, statement, direction):
    assert values(spark, fn.statement_direction, statement) == [direction]


def test_access_mode(spark):
    assert values(spark, access_mode, "write", "DML", "DDL", "read", "metadata", None) == [
        "write", "write", "write", "read", "read", "read"]


def test_layers(spark):
    names = ["RAW_X", "CLEANED_X", "INTEGRATED_DB", "X_MART_DB", "SANDBOX_DB", "RAW_MART_DB"]
    assert values(spark, fn.layer_of, *names) == [
        "Raw Layer", "Clean Layer", "Clean Layer", "Gold Layer", "", "Raw Layer"]
    own = [("Lab", lambda n: n.contains("LAB"))]
    assert values(spark, lambda c: fn.layer_of(c, own), "MY_LAB", "RAW_X") == ["Lab", ""]


def scaled(spark, value, low, high, out=(10, 100)):
    lit = [F.lit(v) for v in (value, low, high)]
    return spark.range(1).select(fn.log_scale(*lit, *out)).first()[0]


def test_log_scale(spark):
    assert scaled(spark, 0, 1, 1000) == 10
    assert scaled(spark, 50, 100, 100) == 10
    assert scaled(spark, 50, 200, 100) == 10
    assert scaled(spark, 1000, 1, 1000) == 100
    want = 10 + 90 * (math.log1p(500) - math.log1p(1)) / (math.log1p(1000) - math.log1p(1))
    assert scaled(spark, 500, 1, 1000) == pytest.approx(want)
    assert scaled(spark, 5000, 1, 1000) > 100


def test_node_size(spark):
    def size(kind, total, low, high):
        return spark.range(1).select(
            fn.node_size(F.lit(total), F.lit(low), F.lit(high), F.lit(kind))).first()[0]
    assert (size("client", 9, 9, 99), size("client", 99, 9, 99)) == (80, 200)
    assert (size("schema", 9, 9, 99), size("schema", 99, 9, 99)) == (60, 160)
    assert size("client", 7, 7, 7) == 80


def test_hue(spark):
    names = ["Tableau", "dbt", "Größe", ""]
    want = [int(hashlib.md5(n.encode()).hexdigest()[:8], 16) % 360 for n in names]
    assert values(spark, fn.hue, *names) == want
    assert want[0] == 82


def test_abbreviation(spark):
    names = ["FooBar", "Abc3xyz", "xy", "foobar", "A/B", "Power BI", "a b c", ""]
    assert values(spark, fn.abbreviation, *names) == [
        "FB", "A3", "XY", "Fo", "AB", "PB", "Ab", ""]
    assert values(spark, lambda c: fn.abbreviation(c, F.lit("Zz")), "FooBar") == ["Zz"]


def test_badge(spark):
    import base64
    uri = values(spark, lambda c: fn.badge_uri(fn.hue(c), fn.abbreviation(c)), "Tableau")[0]
    assert uri.startswith("data:image/svg+xml;base64,") and "\n" not in uri and "\r" not in uri
    svg = base64.b64decode(uri.split(",", 1)[1]).decode()
    assert "hsl(82, 55%, 50%)" in svg and ">Ta</text>" in svg


def test_texts(spark):
    one = spark.range(1)
    text = one.select(fn.node_text(
        F.lit("Database"), F.lit("X"), F.lit("O"), F.lit("A"), F.lit(1000), F.lit(800), F.lit(200),
        F.lit("  W: 5"), F.lit(None).cast("string"))).first()[0]
    assert text.splitlines()[0] == "Database: X"
    assert "Total Access: 1,000" in text and text.endswith("Top Connections:\n  W: 5")
    edge = fn.edge_text(F.lit("a"), F.lit("b"), F.lit("ALL"), F.lit(1234567))
    assert one.select(edge).first()[0] == "a ↔ b\nDirection: ALL\nAccess Count: 1,234,567"
    edge = fn.edge_text(F.lit("a"), F.lit("b"), F.lit("READ"), F.lit(1))
    assert one.select(edge).first()[0].startswith("a → b\n")


def test_places_keep_database_and_schema(spark):
    """Going over a place loses nothing that the name said about both."""
    import itertools

    from wayline.operators.resolve import place_of, with_names
    names = ["".join(p) for n in range(6) for p in itertools.product("A.b", repeat=n)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    name = F.col("name")
    got = with_names(df.select(name, place_of(name).alias("place"),
                               fn.database_of(name).alias("d"), fn.qualified_schema_of(name).alias("s")))
    assert got.filter("NOT (database <=> d AND schema_name <=> s)").count() == 0
    # One place per database and schema.
    assert df.select(place_of(name)).distinct().count() == got.select("d", "s").distinct().count()
