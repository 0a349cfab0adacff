"""Distinct queries per route and day, kept up to date over streams of audit records.

Records may come in any order and however late.  Those within a bound of the
newest time so far are made distinct in the state store, whose size the
watermark bounds.  Later ones wait in a side table; a batch job holds them
against what has been counted in their months, and adds what is new.  Nothing is
dropped, and nothing counts twice.  What a run reads doesn't grow with the runs
before it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.context import JobContext
from wayline.functions.clock import wall_clock, wall_date
from wayline.operators.resolve import accesses, query_rows, touched_places, with_names
from wayline.plans.refresh import ROUTE_KEYS, AuditLogs, named_sessions
from wayline.session import settings, settle
from wayline.streaming.late import Gate, handed_over, pass_gate, work_off
from wayline.streaming.runs import Runs, all_rows, month_of, of_months

ACCESS_COLUMNS = ["query_id", "start_time", *ROUTE_KEYS]
#: An access counts once, however often it arrives.
ACCESS_KEY = ["query_id", "client", "database", "schema_name"]
DAY_KEYS = ["day", *ROUTE_KEYS]
COUNTS = "day date, " + ", ".join(f"{k} string" for k in ROUTE_KEYS) + ", added long"
#: Bound of the streams, and how far the times in both logs may differ, in seconds.
DELAY, SLACK = 2 * 86_400, 3_600
#: Runs after which what they wrote is folded together.
FOLD_EVERY = 24

#: For the query over both logs.  What its watermark gives up goes with the next run's batch, not
#: in one of its own, and its stores don't look each key up just to report how many there are.
LEAN = {"spark.sql.streaming.noDataMicroBatches.enabled": "false",
        "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false"}

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep the state of streams in RocksDB, on local disks with a copy in the checkpoint,
    instead of the executors' heap.  An application calls this once for its session.

    Every run is a query of its own, which loads the state: the copy is therefore of its
    files, since a log of changes would have to be made again row by row.
    """
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "false")
    spark.conf.set("spark.sql.streaming.join.stateFormatVersion", "3")  # one store a task, not four


def resolved_accesses(logs: AuditLogs, rules: DataFrame, ctx: JobContext) -> DataFrame:
    """One row per query and schema with the client's name."""
    logs = logs.within(ctx.since)
    queries = query_rows(logs.queries, ctx.since, [F.col("start_time")])
    found = accesses(queries, logs.access)
    named = named_sessions(logs.sessions, rules)
    return with_names(found.join(named, "session_id")).select(*ACCESS_COLUMNS)


def with_day(found: DataFrame) -> DataFrame:
    day = wall_date(wall_clock(F.col("start_time")))
    return found.withColumn("day", day)


def daily_counts(found: DataFrame) -> DataFrame:
    """Distinct queries per day and route of resolved accesses."""
    once = with_day(found).dropDuplicates(ACCESS_KEY)
    return once.groupBy(*DAY_KEYS).agg(F.count("*").alias("access_count"))


def file_stream(spark: SparkSession, folder: str, like: DataFrame,
                files: int | None = None) -> DataFrame:
    """Stream of the Parquet files in a folder, with the columns of ``like``.

    ``files`` is the number of files a micro-batch takes at most.
    """
    reader = spark.readStream.schema(like.schema)
    if files:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.parquet(folder)


# --- what has been counted ---------------------------------------------------


class Counted:
    """Accesses that have been counted, by month, and what they added to the counts."""

    def __init__(self, folder: str, id_type: str):
        columns = f"query_id {id_type}, client string, `database` string, schema_name string, month int"
        self.accesses, self.late_accesses = (
            Runs(f"{folder}/counted-{x}", columns, ("month",)) for x in ("in-time", "late"))
        self.changes, self.late_changes = (Runs(f"{folder}/changes-{x}", COUNTS) for x in ("in-time", "late"))

    def enter(self, new: DataFrame, number: int, late: bool = False) -> None:
        """Write one run's new accesses, and what they add per day and route."""
        new = settle(new, "new")
        (self.late_accesses if late else self.accesses).write(
            new.select(*ACCESS_KEY, month_of(F.col("day"))), number)
        (self.late_changes if late else self.changes).write(
            new.groupBy(*DAY_KEYS).agg(F.count("*").alias("added")), number)

    def merge(self, spark: SparkSession, late: DataFrame, number: int) -> None:
        """Enter late accesses that had not been counted.

        What is read of the accesses counted before are the months of the late ones.
        A run counts once its changes are written; what a failed one left doesn't.
        """
        late, done = settle(late.dropDuplicates(ACCESS_KEY), "late"), self.late_changes.last(spark)
        known = all_rows(self.accesses.read(spark), self.late_accesses.read(spark, below=done + 1))
        known = of_months(known, late.select(month_of(F.col("day")))).unionByName(
            known.filter(F.col("month").isNull())).select(
            *[F.col(c).alias(f"_{c}") for c in ACCESS_KEY])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ACCESS_KEY])
        self.enter(late.join(known, same, "left_anti"), number, late=True)

    def fold(self, spark: SparkSession) -> None:
        """Fold what the runs wrote, once there are many."""
        for runs in (self.accesses, self.late_accesses, self.changes, self.late_changes):
            if len(runs.live(spark)) > FOLD_EVERY:
                summed = "added" in runs.columns
                runs.fold(spark, (lambda rows: rows.groupBy(*DAY_KEYS).agg(
                    F.sum("added").alias("added"))) if summed else (lambda rows: rows))

    def latest(self, spark: SparkSession) -> DataFrame:
        added = all_rows(self.changes.read(spark), self.late_changes.read(spark))
        return added.groupBy(*DAY_KEYS).agg(F.sum("added").alias("access_count"))


def _count(found: DataFrame, counted: Counted, checkpoint: str) -> list[dict]:
    """Count what a stream of accesses with a watermark on ``at`` holds now."""
    once = found.dropDuplicatesWithinWatermark(ACCESS_KEY)
    return work_off(once, checkpoint, lambda new, number: counted.enter(with_day(new), number))


def _fold_gate(spark: SparkSession, gate: Gate) -> None:
    for runs in (gate.late, gate.kept):
        if len(runs.live(spark)) > FOLD_EVERY:
            runs.fold(spark)


def run_daily_counts(stream: DataFrame, folder: str, delay: int = DELAY) -> list[dict]:
    """Work off what a stream of resolved accesses holds now; progress of the counting query.

    ``folder`` keeps the place in the stream, the state and what was counted.
    ``delay`` is how many seconds behind the newest one a record may be to be
    told from its repeats in the state store.  Calls follow each other.
    """
    spark = stream.sparkSession
    gate = Gate(f"{folder}/gate", stream.select(*ACCESS_COLUMNS).schema, delay)
    counted = Counted(folder, stream.schema["query_id"].dataType.simpleString())
    pass_gate(stream, F.col("start_time"), gate, once=ACCESS_KEY)
    progress = _count(handed_over(spark, gate), counted, f"{folder}/place")
    # Only now: a late copy of a record that was handed over has to find it counted.
    done, last = counted.late_changes.last(spark), gate.late.last(spark)
    if last > done:
        counted.merge(spark, with_day(gate.late.read(spark, done).drop("day", "month", "at")), last)
        _fold_gate(spark, gate)
    counted.fold(spark)
    return progress


# --- both logs ---------------------------------------------------------------


def _named(found: DataFrame, named: DataFrame, *more: str) -> DataFrame:
    """Accesses from rows of a query and the ``places`` it touched."""
    rows = found.join(named, "session_id").withColumn("place", F.explode_outer("places"))
    return with_names(rows.drop("places").filter(F.col("place").isNotNull())).select(*ACCESS_COLUMNS, *more)


def _per_query(rows: DataFrame) -> DataFrame:
    """One row for the access records of a query and time, with the distinct places they touched.

    What it holds is bounded by the number of schemas, not by that of records.
    """
    found = rows.withColumn("place", F.explode_outer("places"))
    return found.groupBy("query_id", "at").agg(F.collect_set("place").alias("places"))


def _met(q: DataFrame, a: DataFrame, slack: int) -> Column:
    """A query and an access record of it; times that are there differ by ``slack`` at most."""
    apart = F.unix_micros(q["at"]) - F.unix_micros(a["at_a"])
    return (q["query_id"] == a["id"]) & F.coalesce(F.abs(apart) <= slack * 1_000_000, F.lit(True))


def _months_around(rows: DataFrame) -> DataFrame:
    days = rows.select("day").distinct()
    return days.select(F.explode(F.array(*[F.date_add("day", k) for k in (-1, 0, 1)])).alias("day")).select(
        month_of(F.col("day")))


def _late_pairs(spark: SparkSession, q: Gate, a: Gate, done: tuple[int, int], slack: int) -> DataFrame:
    """Pairs of a query and an access record of which one, or both, came late.

    Of the other log the months around are read; all, if a late row has no time.
    """
    new_q, new_a = q.late.read(spark, done[0]), a.late.read(spark, done[1])
    all_q = all_rows(q.kept.read(spark), q.late.read(spark))
    all_a = all_rows(a.kept.read(spark), a.late.read(spark))

    def other(rows: DataFrame, late: DataFrame) -> DataFrame:
        if late.filter(F.col("day").isNull()).isEmpty():
            return of_months(rows, _months_around(late)).unionByName(rows.filter(F.col("month").isNull()))
        return rows

    def pairs(queries: DataFrame, records: DataFrame) -> DataFrame:
        records = records.select(F.col("query_id").alias("id"), "places", F.col("at").alias("at_a"))
        return queries.join(records, _met(queries, records, slack)).drop("id", "at_a", "at", "day", "month")

    return pairs(new_q, other(all_a, new_q)).unionByName(pairs(other(all_q, new_a), new_a))


def run_query_log(queries: DataFrame, access: DataFrame, named: DataFrame, folder: str,
                  delay: int = DELAY, slack: int = SLACK) -> list[dict]:
    """The same from streams of both logs, of which either may be ahead of the other.

    Access records carry ``query_start_time``, when their query started.  Rows
    meet in a stream-stream join that waits no longer than the bound, so a run
    reads what is new and not the logs before.  Rows that are later than the
    bound, or without a time, are joined in batch with the months around them.
    ``named`` is what is known of the sessions, see ``named_sessions``.  Progress
    has no number of the rows in state.
    """
    if slack > delay:
        raise ValueError("slack must not be longer than the delay")
    spark = queries.sparkSession
    q_rows = query_rows(queries, extra=[F.col("start_time")])
    a_rows = touched_places(access, "query_start_time")
    q = Gate(f"{folder}/queries", q_rows.schema, delay)
    a = Gate(f"{folder}/access", a_rows.drop("query_start_time").schema, delay)
    counted = Counted(folder, q_rows.schema["query_id"].dataType.simpleString())
    pass_gate(q_rows, F.col("start_time"), q, keep=True)
    pass_gate(a_rows, F.col("query_start_time"), a, keep=True, combined=_per_query)

    q_new = handed_over(spark, q)
    a_new = handed_over(spark, a).withColumnsRenamed({"query_id": "id", "at": "at_a"})
    wait = F.expr(f"INTERVAL {slack} SECONDS")
    both = q_new.join(a_new, (q_new["query_id"] == a_new["id"])
                      & (a_new["at_a"] >= q_new["at"] - wait) & (a_new["at_a"] <= q_new["at"] + wait))
    with settings(spark, LEAN):
        progress = _count(_named(both.drop("id", "at_a"), named, "at"), counted, f"{folder}/place")

    merged, last = Runs(f"{folder}/merged", "q long, a long"), (q.late.last(spark), a.late.last(spark))
    done = merged.read(spark).agg(F.max("q"), F.max("a")).first()
    done = tuple(-1 if n is None else n for n in done)
    if last != done:
        pairs = _late_pairs(spark, q, a, done, slack)
        counted.merge(spark, with_day(_named(pairs, named)), counted.late_changes.last(spark) + 1)
        merged.write(spark.createDataFrame([last], merged.columns), merged.last(spark) + 1)
        for gate in (q, a):
            _fold_gate(spark, gate)
    counted.fold(spark)
    return progress


def latest_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The current count of every day and route; none if no batch has come yet."""
    return Counted(folder, "long").latest(spark)
