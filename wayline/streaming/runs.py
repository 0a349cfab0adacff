"""Results of numbered micro-batches on the shared disk, folded together now and then.

Each run writes a folder of its number; a run that is repeated after a failure
replaces its folder.  Folding writes what all runs so far come to as one folder,
which from then on stands for them, so that neither the listing nor the reading
grows with the number of runs.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.sources import files

RUN, FOLD = "run=", "f"


@dataclass(frozen=True)
class Runs:
    """Folders of runs under a root, with rows of these columns."""

    root: str
    columns: str
    partition: tuple[str, ...] = ()

    def _folder(self, number: int, folded: bool = False) -> str:
        return f"{self.root}/{RUN}{number:012d}{FOLD if folded else ''}"

    def _complete(self, spark: SparkSession) -> list[tuple[int, bool]]:
        """Numbers of the folders that were written to the end, and whether they are folded."""
        names = [f.getPath().getName().removeprefix(RUN) for f in files.listed(spark, self.root, RUN)]
        found = [(int(n.removesuffix(FOLD)), n.endswith(FOLD)) for n in names]
        return sorted(x for x in found if files.exists(spark, f"{self._folder(*x)}/_SUCCESS"))

    def live(self, spark: SparkSession) -> list[tuple[int, bool]]:
        """The newest fold and the runs after it."""
        found = self._complete(spark)
        fold = max((n for n, folded in found if folded), default=-1)
        return [(n, folded) for n, folded in found if n > fold or (n == fold and folded)]

    def last(self, spark: SparkSession) -> int:
        """The number of the last complete run, or -1."""
        return max((n for n, _ in self._complete(spark)), default=-1)

    def read(self, spark: SparkSession, above: int = -1, below: int | None = None) -> DataFrame:
        """Rows of the runs between two numbers (both excluded); folds count as their last run."""
        chosen = [x for x in self.live(spark) if x[0] > above and (below is None or x[0] < below)]
        if not chosen:
            return spark.createDataFrame([], self.columns)
        return spark.read.schema(f"{self.columns}, run string").option("basePath", self.root).parquet(
            *[self._folder(*x) for x in chosen]).drop("run")

    def write(self, rows: DataFrame, number: int) -> None:
        if self.partition:
            rows = rows.repartition(*self.partition)
        rows.write.mode("overwrite").partitionBy(*self.partition).parquet(self._folder(number))

    def fold(self, spark: SparkSession, combined: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> None:
        """Write all runs as one.  What the fold before stood for is then removed; what
        this one stands for stays for readers under way."""
        found = self._complete(spark)
        if sum(not folded for _, folded in self.live(spark)) < 2:
            return
        last = max(n for n, _ in found)
        rows = combined(self.read(spark))
        if self.partition:
            rows = rows.repartition(*self.partition)
        rows.write.mode("overwrite").partitionBy(*self.partition).parquet(self._folder(last, True))
        before = max((n for n, folded in found if folded), default=-1)
        for n, folded in found:
            if n < before or (n == before and not folded):
                files.delete(spark, self._folder(n, folded))


def all_rows(one: DataFrame, *more: DataFrame) -> DataFrame:
    for rows in more:
        one = one.unionByName(rows)
    return one


def month_of(day: Column) -> Column:
    """The partition of a day: its month as a number, like 202401."""
    return (F.year(day) * 100 + F.month(day)).cast("int").alias("month")


def of_months(rows: DataFrame, months: DataFrame) -> DataFrame:
    """Rows whose partition is among ``months``, of which the calendar bounds the number."""
    return rows.join(F.broadcast(months.select("month").distinct()), "month", "left_semi")
