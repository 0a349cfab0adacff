"""A gate that parts a stream's late rows from the others.

State of an event-time query is given up as the watermark passes, and Spark
drops a row that comes later than that.  The gate holds every row against the
newest time of the batches *before*.  Rows inside the bound are handed over, in
the order of their batches, so that the watermark of a query with the same bound
never passes one of them; the others go to a side table, for a batch job to
merge.  All the gate remembers is one time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline.functions.clock import wall_clock, wall_date
from wayline.session import settle
from wayline.sources import files
from wayline.streaming.runs import Runs, month_of

NEWEST = "newest long"
#: How long the query behind the gate may lag behind it.
LAG = "90d"


@dataclass(frozen=True)
class Gate:
    """Folders of a gate: rows with the columns of ``schema`` and a time ``at``."""

    folder: str
    schema: T.StructType
    seconds: int

    @property
    def columns(self) -> str:
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema)

    @property
    def rows(self) -> str:
        return f"{self.columns}, at timestamp"

    @property
    def late(self) -> Runs:
        """Rows later than the bound, or without a time, by month."""
        return Runs(f"{self.folder}/late", f"{self.rows}, day date, month int", ("month",))

    @property
    def kept(self) -> Runs:
        """All rows handed over, by month, if the gate keeps them."""
        return Runs(f"{self.folder}/kept", f"{self.rows}, day date, month int", ("month",))

    @property
    def seen(self) -> Runs:
        return Runs(f"{self.folder}/seen", NEWEST)

    @property
    def handed(self) -> str:
        return f"{self.folder}/handed"


def work_off(stream: DataFrame, checkpoint: str, batch) -> list[dict]:
    """Run a stream's ``batch`` function until it has taken all there is now; its progress.

    A query that dropped rows for their time is an error: the gate is there to
    keep such rows from it.
    """
    query = (stream.writeStream.option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(batch).start())
    query.awaitTermination()
    progress = [json.loads(p.json) for p in query.recentProgress]
    dropped = sum(s.get("numRowsDroppedByWatermark", 0) for p in progress for s in p["stateOperators"])
    if dropped:
        raise RuntimeError(f"{dropped} rows were dropped by the watermark of {checkpoint}")
    return progress


def pass_gate(stream: DataFrame, at: Column, gate: Gate, keep: bool = False,
              once: Sequence[str] = (), combined: Callable[[DataFrame], DataFrame] | None = None) -> list[dict]:
    """Part what a stream holds now.  ``once`` names columns rows are made distinct by, ``combined``
    makes fewer rows of a batch's, of the same columns, and ``keep`` asks for an archive by
    month of what is handed over."""
    names = [f.name for f in gate.schema]

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession
        rows = rows.select(*names, at.cast("timestamp").alias("at"))
        rows = rows.dropDuplicates(list(once)) if once else rows
        rows = settle(combined(rows) if combined else rows, "batch")
        before = gate.seen.read(spark, number - 2, number).first()
        before = before["newest"] if before else None
        in_time = F.col("at").isNotNull()
        if before is not None:  # Spark gives up what is at the watermark as well
            in_time &= F.unix_micros("at") > before - gate.seconds * 1_000_000
        in_time = F.coalesce(in_time, F.lit(False))
        newest, n_late = rows.agg(F.max(F.unix_micros("at")), F.count(F.when(~in_time, 1))).first()
        rows = rows.withColumn("day", wall_date(wall_clock(F.col("at"))))
        if n_late:
            gate.late.write(rows.filter(~in_time).select("*", month_of(F.col("day"))), number)
        if keep:
            gate.kept.write(rows.filter(in_time).select("*", month_of(F.col("day"))), number)
        found = [t for t in (before, newest) if t is not None]
        gate.seen.write(spark.createDataFrame([(max(found, default=None),)], NEWEST), number)
        # Last, since a batch that fails earlier is repeated; rows handed over twice do no harm.
        rows.filter(in_time).drop("day").write.mode("append").parquet(gate.handed)

    progress = work_off(stream, f"{gate.folder}/place", batch)
    gate.seen.fold(stream.sparkSession, lambda rows: rows.agg(F.max("newest").alias("newest")))
    return progress


def handed_over(spark: SparkSession, gate: Gate) -> DataFrame:
    """What has passed the gate, as a stream with a watermark on ``at``.

    A batch takes all there is, so batches follow the gate's order; files that
    were worked off are removed.
    """
    files.make(spark, gate.handed)
    found = spark.readStream.schema(gate.rows).option("cleanSource", "delete").option(
        "maxFileAge", LAG).parquet(gate.handed)
    return found.withWatermark("at", f"{gate.seconds} seconds")


def late_rows(spark: SparkSession, gate: Gate) -> DataFrame:
    """How many rows came later than the bound, per day."""
    return gate.late.read(spark).groupBy("day").agg(F.count("*").alias("late"))
