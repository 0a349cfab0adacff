"""Schemas of the tables the package reads and writes."""

from pyspark.sql import types as T

SESSIONS = T.StructType([
    T.StructField("session_id", T.LongType()),
    T.StructField("client_application_id", T.StringType()),
    T.StructField("client_environment", T.StringType()),
])

QUERIES = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField("session_id", T.LongType()),
    T.StructField("warehouse_name", T.StringType()),
    T.StructField("query_type", T.StringType()),
    T.StructField("start_time", T.TimestampType()),
])

ACCESS = T.StructType([
    T.StructField("query_id", T.LongType()),
    T.StructField(
        "direct_objects_accessed",
        T.ArrayType(T.StructType([T.StructField("objectName", T.StringType())])),
    ),
])

#: Columns whose type is that of the source: whole numbers or text.
IDS = ("session_id", "query_id")


def with_text_ids(kind: T.StructType) -> T.StructType:
    return T.StructType([
        T.StructField(f.name, T.StringType() if f.name in IDS else f.dataType) for f in kind])


RULES = T.StructType([
    T.StructField("priority", T.LongType()),
    T.StructField("pattern", T.StringType()),
    T.StructField("source_field", T.StringType()),
    T.StructField("display_name", T.StringType()),
])

ROUTES = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in (
            "organization_name", "account_id", "client", "warehouse",
            "database", "schema_name", "direction",
        )
    ]
    + [T.StructField("access_count", T.LongType())]
)

#: Columns of a cleaned route frame, in the order they are written.
DIMENSIONS = ["DATABASE", "SCHEMA_NAME", "WAREHOUSE", "CLIENT", "DIRECTION"]
CONTEXT = ["ORGANIZATION_NAME", "ACCOUNT_NAME"]
MEASURE = "ACCESS_COUNT"
CLEAN_COLUMNS = DIMENSIONS + CONTEXT + [MEASURE]

CLEAN_ROUTES = T.StructType(
    [T.StructField(name, T.StringType()) for name in DIMENSIONS + CONTEXT]
    + [T.StructField(MEASURE, T.LongType())]
)

#: Columns offered for grouping and the order tables are shown in.
GROUP_COLUMNS = ["CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME", "DIRECTION"]
TABLE_ORDER = ["ICON"] + GROUP_COLUMNS + [MEASURE]

#: Headings of chart data.  Kept as text, since ``initcap`` would lower the
#: letter after an underscore.
HEADINGS = {
    "CLIENT": "Client",
    "WAREHOUSE": "Warehouse",
    "DATABASE": "Database",
    "SCHEMA_NAME": "Schema_Name",
    "DIRECTION": "Direction",
    "ACCESS_COUNT": "Access Count",
}
