"""The route snapshot from counts kept per day.

A query starts on one day, so its distinct counts per day add up exactly.  Each
day's counts, per session and route, are worked out once and kept; a refresh
sums up the days of its window and names them with the sessions and rules of
the moment.  A weekly run so reads the logs of the days that are new, and of the
few last ones that may still have grown.

Days are written in *parts*, a folder per run with a folder per day, and a small
table says which part has a day's counts.  Writing a day again replaces its part
in that table, with a claim that notices other writers; a run that fails leaves
the table as it was.
"""

from __future__ import annotations

import datetime as dt
import logging
import uuid
from collections import defaultdict
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.context import JobContext
from wayline.functions.clock import wall_clock, wall_date
from wayline.operators.resolve import query_rows, session_counts
from wayline.plans.refresh import AuditLogs, named_counts, stamped
from wayline.sources import files, tables

log = logging.getLogger(__name__)

#: Which part has a day's counts, and the day of the run that wrote it.
DAYS = T.StructType([
    T.StructField("day", T.DateType()),
    T.StructField("part", T.StringType()),
    T.StructField("written", T.DateType()),
])
ROUTE = ["warehouse", "direction", "place"]


@dataclass(frozen=True)
class Partials:
    """A store of daily counts: the table of its days, and the folder of its parts.

    A day counts as settled once a run more than ``late_days`` after it has
    written it; until then every run writes it again.
    """

    name: str
    root: str
    late_days: int = 1
    keep_days: float = 7.0

    @property
    def days(self) -> tables.Table:
        return tables.Table(self.name, f"{self.root.rstrip('/')}/days", DAYS, self.keep_days)

    @property
    def parts(self) -> str:
        return f"{self.root.rstrip('/')}/parts"


def _at(day: dt.date, kind: T.DataType):
    return F.lit(dt.datetime.combine(day, dt.time()).isoformat(sep=" ")).cast(kind)


def day_counts(logs: AuditLogs, first: dt.date, last: dt.date) -> DataFrame:
    """Distinct queries per day, session and route for the days from … to.

    ``opens`` marks queries of the very first moment of a day, which a window
    that begins with that day leaves out.
    """
    midnight = dt.datetime.combine(first, dt.time())
    logs = logs.within(midnight, dt.datetime.combine(last, dt.time()))
    start, kind = F.col("start_time"), logs.queries.schema["start_time"].dataType
    within = logs.queries.filter((start >= _at(first, kind)) & (start < _at(last + dt.timedelta(days=1), kind)))
    clock = wall_clock(start)
    day = wall_date(clock)
    opens = F.unix_micros(clock) == F.unix_date(day).cast("long") * F.lit(86_400_000_000)
    return session_counts(query_rows(within, extra=[day.alias("day"), opens.alias("opens")]), logs.access)


def _all_days(first: dt.date, last: dt.date) -> list[dt.date]:
    return [first + dt.timedelta(days=k) for k in range((last - first).days + 1)]


def write_days(store: Partials, logs: AuditLogs, days: list[dt.date], written: dt.date) -> None:
    """Work out these days anew and let them take the place of what is kept of them.

    Days without any query are kept as such.  Adjoining days are read at once.
    """
    if not days:
        return
    spark, part = logs.queries.sparkSession, uuid.uuid4().hex
    tables.ensure_table(spark, store.days)
    runs: list[list[dt.date]] = []
    for day in sorted(set(days)):
        if runs and day - runs[-1][-1] == dt.timedelta(days=1):
            runs[-1].append(day)
        else:
            runs.append([day])
    counts = reduce(DataFrame.unionByName, [day_counts(logs, run[0], run[-1]) for run in runs])
    counts.repartition("day").write.partitionBy("day").parquet(f"{store.parts}/part={part}")
    new = spark.createDataFrame([(day, part, written) for run in runs for day in run], DAYS)
    while True:
        version, known = tables.contents(spark, store.days)
        kept = known.join(F.broadcast(new.select("day")), "day", "left_anti")  # days of one run
        try:
            tables.replace_contents(store.days, kept.unionByName(new), version)
            return
        except tables.VersionConflict:
            log.info("other days of %s were written meanwhile", store.name)


def open_days(spark: SparkSession, store: Partials, first: dt.date, last: dt.date) -> list[dt.date]:
    """Days from … to that are missing or may have grown since they were written."""
    tables.ensure_table(spark, store.days)
    _, known = tables.contents(spark, store.days)
    settled = known.filter(F.col("day").between(first, last)
                           & (F.datediff("written", "day") > store.late_days))
    done = {r["day"] for r in settled.select("day").collect()}  # days of one window
    return [day for day in _all_days(first, last) if day not in done]


def forget(spark: SparkSession, store: Partials, before: dt.date) -> None:
    """Drop the days before, and the parts that no day is in any more, by age."""
    while True:
        version, known = tables.contents(spark, store.days)
        try:
            tables.replace_contents(store.days, known.filter(F.col("day") >= before), version)
            break
        except tables.VersionConflict:
            log.info("days of %s were written meanwhile", store.name)
    _, known = tables.contents(spark, store.days)
    used = {r["part"] for r in known.select("part").distinct().collect()}
    files.remove_unused(spark, store.parts, "part=", {f"part={p}" for p in used}, store.keep_days)


def kept_counts(spark: SparkSession, store: Partials, first: dt.date, id_type: str = "bigint") -> DataFrame:
    """Counts of the days from ``first`` on, by day and session.

    Which part has which day comes to the driver, a row per day of the window;
    only the folders of these days are read.
    """
    columns = (f"opens boolean, session_id {id_type}, warehouse string, direction string, place string, "
               "access_count long, part string, day date")
    _, known = tables.contents(spark, store.days)
    days_of = defaultdict(list)
    for r in known.filter(F.col("day") >= F.lit(first)).collect():
        days_of[r["part"]].append(r["day"])
    if not days_of:
        return spark.createDataFrame([], columns).drop("part")
    folders = [f"{store.parts}/part={part}" for part in sorted(days_of)]
    wanted = reduce(lambda a, b: a | b, [
        (F.col("part") == part) & F.col("day").isin(days) for part, days in sorted(days_of.items())])
    found = spark.read.schema(columns).option("basePath", store.parts).parquet(*folders)
    return found.filter(wanted).drop("part")


def refresh_kept(store: Partials, sessions: DataFrame, rules: DataFrame, ctx: JobContext) -> DataFrame:
    """The route snapshot as of ``ctx`` from the days that are kept."""
    spark, first = sessions.sparkSession, ctx.since.date()
    counts = kept_counts(spark, store, first, sessions.schema["session_id"].dataType.simpleString())
    inside = counts.filter((F.col("day") > F.lit(first)) | ~F.col("opens"))
    per_session = inside.groupBy("session_id", *ROUTE).agg(F.sum("access_count").alias("access_count"))
    return stamped(named_counts(per_session, sessions, rules), ctx)


def refresh_by_days(store: Partials, logs: AuditLogs, rules: DataFrame, ctx: JobContext) -> DataFrame:
    """Bring the kept days up to date with the logs, and give the snapshot as of ``ctx``."""
    spark, first = logs.queries.sparkSession, ctx.since.date()
    today = ctx.as_of or dt.date.today()
    write_days(store, logs, open_days(spark, store, first, today), today)
    return refresh_kept(store, logs.sessions, rules, ctx)
