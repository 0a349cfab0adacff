"""Reading audit logs as written by a warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline import schema
from wayline.plans.refresh import AuditLogs

#: Formats that carry their types, and text formats, whose types are given.
TYPED, TEXT = ("parquet", "orc"), ("json", "csv")


def _checked(log: DataFrame, kind: T.StructType, location: str) -> DataFrame:
    """Raise if a column has not the type it needs; ids may be text or whole numbers."""
    for field in kind:
        have = log.schema[field.name].dataType
        if field.name in schema.IDS:
            good = isinstance(have, (T.StringType, T.IntegralType))
        elif field.name == "start_time":
            good = isinstance(have, (T.TimestampType, T.TimestampNTZType))
        elif isinstance(field.dataType, T.ArrayType):
            good = (isinstance(have, T.ArrayType) and isinstance(have.elementType, T.StructType)
                    and "objectName" in have.elementType.names)
        else:
            good = isinstance(have, T.StringType)
        if not good:
            raise TypeError(f"{location}: {field.name} is {have.simpleString()}")
    return log


def read_log(spark: SparkSession, location: str, kind: T.StructType, fmt: str = "table",
             date_column: str | None = None) -> DataFrame:
    """A log from a catalog table or from files, cut down to the columns used.

    Ids keep the type of the source.  Text formats have none, so their ids are
    text; in CSV the accessed objects are JSON.  A value that does not fit its
    type is an error, not a NULL.
    """
    more = [date_column] if date_column else []
    if fmt == "table":
        return _checked(spark.table(location).select(*kind.names, *more), kind, location)
    if fmt in TYPED:
        found = spark.read.format(fmt).load(location)
        return _checked(found.select(*kind.names, *more), kind, location)
    if fmt not in TEXT:
        raise ValueError(f"unknown format {fmt!r}")
    wanted = schema.with_text_ids(kind)
    # A partition column in the folder names is added to the given schema.
    reader = spark.read.option("mode", "FAILFAST")
    if fmt == "json":
        return reader.schema(wanted).json(location).select(*wanted.names, *more)
    arrays = {f.name: f.dataType for f in wanted if isinstance(f.dataType, T.ArrayType)}
    flat = T.StructType([T.StructField(f.name, T.StringType() if f.name in arrays else f.dataType)
                         for f in wanted])
    found = reader.schema(flat).option("header", True).option("escape", '"').csv(location)
    return found.select(*[
        F.from_json(n, arrays[n], {"mode": "FAILFAST"}).alias(n) if n in arrays else n
        for n in wanted.names], *more)


def read_audit_logs(spark: SparkSession, sessions: str, queries: str, access: str,
                    fmt: str = "table", date_column: str | None = None) -> AuditLogs:
    """The three logs; ``date_column`` is the partition column of queries and access, if any."""
    return AuditLogs(
        read_log(spark, sessions, schema.SESSIONS, fmt),
        read_log(spark, queries, schema.QUERIES, fmt, date_column),
        read_log(spark, access, schema.ACCESS, fmt, date_column),
        date_column,
    )
