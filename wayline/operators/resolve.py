"""From audit logs to accesses: scans, noise filters, decomposition, joins."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.direction import statement_direction
from wayline.functions.names import database_of, qualified_schema_of

# What the audit logs hold besides data access.
NOISE_TYPES = ("CALL", "BEGIN_TRANSACTION", "COMMIT", "ROLLBACK", "SET", "UNSET", "USE")
SYSTEM_CLIENTS = "SYSTEM"
TEMPORARY_DATABASES = "USER$"
APP_FUNCTION_MARK = "!"


def started_after(queries: DataFrame, since: dt.datetime) -> Column:
    """Strict lower bound on the start time.

    The bound takes the type of the column, with or without a time zone, so
    that the comparison needs no cast on the column and reaches the scan.
    """
    kind = queries.schema["start_time"].dataType
    return F.col("start_time") > F.lit(since.isoformat(sep=" ")).cast(kind)


def pruned(log: DataFrame, since: dt.datetime | None, until: dt.datetime | None = None,
           date_column: str | None = None) -> DataFrame:
    """Leave out partitions of a log that lie outside the days asked for.

    ``date_column`` holds the day a query started, in whatever time zone the
    log was written; so a day of slack is kept at either end, and rows without
    a date stay.  It spares the access log, which has no start time, from being
    read as a whole.  Without a column named, the log stays as it is.
    """
    if date_column is None:
        return log
    day, kept = F.col(date_column), F.lit(True)
    if since is not None:
        kept = day >= F.lit(since.date() - dt.timedelta(days=1))
    if until is not None:
        kept = kept & (day <= F.lit(until.date() + dt.timedelta(days=1)))
    return log.filter(kept | day.isNull())


def query_rows(queries: DataFrame, since: dt.datetime | None = None,
               extra: Sequence[Column] = ()) -> DataFrame:
    """Queries that count, with their direction.  A NULL type drops the row."""
    kept = queries if since is None else queries.filter(started_after(queries, since))
    return kept.filter(~F.col("query_type").isin(*NOISE_TYPES)).select(
        "query_id", "session_id", F.col("warehouse_name").alias("warehouse"),
        statement_direction(F.col("query_type")).alias("direction"), *extra,
    )


def session_rows(sessions: DataFrame) -> DataFrame:
    """Sessions of real clients, with the application named in their environment."""
    client = F.col("client_application_id")
    return sessions.filter(~client.startswith(SYSTEM_CLIENTS)).select(
        "session_id", client.alias("client_app_id"),
        F.get_json_object("client_environment", "$.APPLICATION").alias("application"),
    )


def is_real_object(name: Column) -> Column:
    """Neither a function of an app nor an object of a temporary database."""
    return ~name.contains(APP_FUNCTION_MARK) & ~name.startswith(TEMPORARY_DATABASES)


def place_of(name: Column) -> Column:
    """The first two dot segments of a name, or the first if there is no second.

    One short string that stands for database and schema together; it is what
    gets shuffled and counted until the very end.
    """
    return F.rtrim(F.substring_index(name, ".", 2), F.lit("."))


def with_names(df: DataFrame) -> DataFrame:
    """Replace ``place`` by ``database`` and ``schema_name``."""
    kept = [c for c in df.columns if c != "place"]
    place = F.col("place")
    return df.select(*kept, database_of(place).alias("database"),
                     qualified_schema_of(place).alias("schema_name"))


def touched_places(access: DataFrame, *extra: str) -> DataFrame:
    """``query_id, places``: the distinct places named in each access record, with
    ``extra`` columns.

    The array is reduced inside its row, so that only short distinct strings
    are shuffled, not one entry per object.  Objects that are not real leave a
    NULL in it.
    """
    places = F.transform(
        F.col("direct_objects_accessed.objectName"),
        lambda name: F.when(is_real_object(name), place_of(name)),
    )
    return access.select("query_id", *extra, F.array_distinct(places).alias("places"))


def place_rows(queries: DataFrame, access: DataFrame) -> DataFrame:
    """One row per query, access record and place.

    ``queries`` comes from :func:`query_rows`.  An array that is NULL or empty
    leaves no row.  (The outer form of the explosion spares the size check, and
    with it a second evaluation of the array, that the optimizer adds to the
    inner form.)  A query with very many access records is split by the skew
    join if the session has the settings of ``session.allow_skew_split``.
    """
    kept = [c for c in queries.columns if c != "query_id"]
    joined = queries.join(touched_places(access), "query_id")
    exploded = joined.select("query_id", *kept, F.explode_outer("places").alias("place"))
    return exploded.filter(F.col("place").isNotNull())


def accesses(queries: DataFrame, access: DataFrame) -> DataFrame:
    """One row per query and place.

    Both sides are shuffled once, on the query id; the de-duplication finds its
    rows in place.
    """
    return place_rows(queries, access).distinct()


def session_counts(queries: DataFrame, access: DataFrame) -> DataFrame:
    """Distinct queries per session and route.

    Counting before the sessions are joined takes the weight out of a session
    that ran a large part of all queries: what is shuffled on the session id is
    one row per session and route, not one per query.
    """
    keys = [c for c in queries.columns if c != "query_id"] + ["place"]
    return accesses(queries, access).groupBy(*keys).agg(F.count("*").alias("access_count"))
