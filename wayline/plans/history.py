"""Weekly snapshots of the past: what each run of the refresh would have shown."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.context import JobContext
from wayline.functions.clock import wall_micros
from wayline.plans.refresh import AuditLogs, route_counts, stamped

_DAY = 86_400_000_000
_WEEK = 7 * _DAY
# The first Sunday after the epoch; runs are numbered in weeks from it.
_FIRST_RUN_DAY = dt.date(1970, 1, 4)


def _whole_up(number: Column, step: int) -> Column:
    """``number / step`` rounded up, in whole numbers."""
    n = -number
    return -((n - F.pmod(n, F.lit(step))) / step).cast("long")


def run_window(start: Column, days: int, hour: int) -> tuple[Column, Column]:
    """First and last weekly run (by number) that look back on ``start``.

    A run on Sunday at ``hour`` sees what started up to that moment and after
    midnight ``days`` days before its day.  Both ends follow from the start time
    alone, so no join with a calendar is needed.
    """
    base = (_FIRST_RUN_DAY - dt.date(1970, 1, 1)).days * _DAY
    at = wall_micros(start)
    first = _whole_up(at - base - hour * 3_600_000_000, _WEEK)
    last = _whole_up(at + days * _DAY - base, _WEEK) - 1
    return first, last


def _run_number(day: dt.date) -> int:
    """Number of the last run day on or before ``day``."""
    return (day - _FIRST_RUN_DAY).days // 7


def snapshot_history(logs: AuditLogs, rules: DataFrame, ctx: JobContext,
                     from_day: dt.date, to_day: dt.date, hour: int = 6) -> DataFrame:
    """``run_date`` and the route snapshot as of each Sunday from … to.

    Queries are counted once per route and pair of end runs, of which a week
    has a few; only these counts are then repeated for the runs that see them.
    """
    low, high = _run_number(from_day - dt.timedelta(days=1)) + 1, _run_number(to_day)
    first, last = run_window(F.col("start_time"), ctx.days, hour)
    queries = logs.queries.select("*", F.greatest(first, F.lit(low)).alias("first_run"),
                                  F.least(last, F.lit(high)).alias("last_run"))
    kind = logs.queries.schema["start_time"].dataType
    opens = dt.datetime.combine(from_day - dt.timedelta(days=ctx.days), dt.time())
    closes = dt.datetime.combine(to_day + dt.timedelta(days=1), dt.time())
    seen = queries.filter(
        (F.col("start_time") < F.lit(closes.isoformat(sep=" ")).cast(kind))
        & (F.col("first_run") <= F.col("last_run"))
    )
    counts = route_counts(AuditLogs(logs.sessions, seen, logs.access, logs.date_column), rules,
                          opens, [F.col("first_run"), F.col("last_run")], closes)
    keys = [c for c in counts.columns if c not in ("first_run", "last_run", "access_count")]
    per_run = counts.select(
        F.explode(F.sequence("first_run", "last_run")).alias("run"), *keys, "access_count"
    ).groupBy("run", *keys).agg(F.sum("access_count").alias("access_count"))
    day = F.date_add(F.lit(_FIRST_RUN_DAY), (F.col("run") * 7).cast("int"))
    return stamped(per_run.withColumn("run_date", day), ctx, "run_date")
