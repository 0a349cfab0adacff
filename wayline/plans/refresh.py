"""The route snapshot: distinct queries per route over a lookback window."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline import schema
from wayline.context import JobContext
from wayline.operators.classify import classify, with_clients
from wayline.operators.resolve import pruned, query_rows, session_counts, session_rows, with_names

ROUTE_KEYS = ["client", "warehouse", "database", "schema_name", "direction"]


@dataclass(frozen=True)
class AuditLogs:
    """The three logs a refresh reads.

    ``date_column`` names the day a query started in queries and access, if
    both have it as a partition column; only the days looked back on are then
    read.
    """

    sessions: DataFrame
    queries: DataFrame
    access: DataFrame
    date_column: str | None = None

    def within(self, since: dt.datetime | None, until: dt.datetime | None = None) -> AuditLogs:
        """The logs without partitions outside the days asked for."""
        queries, access = (pruned(log, since, until, self.date_column)
                           for log in (self.queries, self.access))
        return AuditLogs(self.sessions, queries, access)


def named_sessions(sessions: DataFrame, rules: DataFrame) -> DataFrame:
    """``session_id, client``: the distinct names each session goes by.

    Exports overlap, so a session may be logged repeatedly, and it may have
    several pairs of client id and application that come to the same name.
    """
    real = session_rows(sessions)
    return with_clients(real, classify(real, rules)).select("session_id", "client").distinct()


def route_counts(logs: AuditLogs, rules: DataFrame, since: dt.datetime | None = None,
                 extra: Sequence[Column] = (), until: dt.datetime | None = None) -> DataFrame:
    """Distinct queries per route and per ``extra`` expression over the queries.

    A query has one session, which makes distinct counts add up over sessions.
    The counts are therefore taken first, per session, and named last, when few
    rows are left; every name of a session counts each of its queries once.
    """
    logs = logs.within(since, until)
    per_session = session_counts(query_rows(logs.queries, since, extra), logs.access)
    return named_counts(per_session, logs.sessions, rules)


def named_counts(per_session: DataFrame, sessions: DataFrame, rules: DataFrame) -> DataFrame:
    """Counts per session and route, summed up under the names of the sessions."""
    keys = [c for c in per_session.columns if c not in ("session_id", "access_count")]
    named = per_session.join(named_sessions(sessions, rules), "session_id")
    return with_names(named.groupBy("client", *keys).agg(
        F.sum("access_count").alias("access_count")))


def stamped(routes: DataFrame, ctx: JobContext, *extra: str) -> DataFrame:
    """Put the constants of the job on every route, in snapshot column order."""
    return routes.select(
        *extra, F.lit(ctx.org).alias("organization_name"), F.lit(ctx.account).alias("account_id"),
        *[F.col(f.name) for f in schema.ROUTES.fields[2:]],
    )


def refresh_routes(logs: AuditLogs, rules: DataFrame, ctx: JobContext) -> DataFrame:
    """The route snapshot as of ``ctx``."""
    return stamped(route_counts(logs, rules, ctx.since), ctx)
