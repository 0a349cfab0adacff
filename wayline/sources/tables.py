"""The two tables the package keeps: route snapshot and rules.

Each is an external Parquet table.  New contents are written to a fresh folder
under the table's root, claimed as its next version, and the table is then
pointed at it.  A reader sees the old contents or the new, a failed write changes
nothing, and a writer can have its write refused if another came between.
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayline import schema
from wayline.context import JobContext
from wayline.operators.rules import ordered_rules, rule_violations, missing_rules, upserted_rules
from wayline.operators.shape import by_weight, loaded_routes
from wayline.plans.refresh import AuditLogs, refresh_routes
from wayline.sources import versions
from wayline.sources.versions import Version, VersionConflict

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Table:
    """A table name, the folder its versions live under, and its columns.

    Versions that nothing points at any more are kept for ``keep_days``.
    """

    name: str
    root: str
    columns: T.StructType
    keep_days: float = 7.0


@dataclass(frozen=True)
class WriteResult:
    rows: int
    version: int = 0

    @property
    def message(self) -> str:
        return f"Route snapshot refreshed. Rows: {self.rows}"


def routes_table(name: str, root: str, **options) -> Table:
    return Table(name, root, schema.ROUTES, **options)


def rules_table(name: str, root: str, **options) -> Table:
    return Table(name, root, schema.RULES, **options)


def ensure_table(spark: SparkSession, table: Table) -> None:
    """Create the table if it is not there; add columns it lacks."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.columns)
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table.name} ({columns}) USING parquet "
              f"LOCATION '{versions.new_folder(table.root)}'")
    add_missing_columns(spark, table)


def add_missing_columns(spark: SparkSession, table: Table) -> list[str]:
    """Add the columns an older table lacks; its rows read NULL there."""
    have = {c.lower() for c in spark.table(table.name).columns}
    lacking = [f for f in table.columns if f.name.lower() not in have]
    if lacking:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lacking)
        spark.sql(f"ALTER TABLE {table.name} ADD COLUMNS ({added})")
    return [f.name for f in lacking]


def aligned(df: DataFrame, columns: T.StructType) -> DataFrame:
    """``df`` with exactly these columns, matched by name; absent ones are NULL."""
    have = {c.lower() for c in df.columns}
    return df.select(*[
        (F.col(f.name) if f.name.lower() in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in columns
    ])


def location(spark: SparkSession, table: Table) -> str:
    """The folder the catalog says the table is in."""
    found = spark.sql(f"DESCRIBE TABLE EXTENDED {table.name}").filter("col_name = 'Location'")
    return found.first()["data_type"]


def point(spark: SparkSession, table: Table) -> Version:
    """Point the table at its newest version, until no newer one has come meanwhile."""
    while True:
        now = versions.newest(spark, table.root)
        if now.folder:
            spark.sql(f"ALTER TABLE {table.name} SET LOCATION '{now.folder}'")
            spark.catalog.refreshTable(table.name)
        if versions.newest(spark, table.root) == now:
            return now


def contents(spark: SparkSession, table: Table) -> tuple[int, DataFrame]:
    """The version that counts and its rows, which stay the same while the table moves on."""
    now = versions.newest(spark, table.root)
    if now.folder is None:
        return 0, aligned(spark.table(table.name), table.columns)
    return now.number, spark.read.schema(table.columns).parquet(now.folder)


def replace_contents(table: Table, rows: DataFrame, expected: int | None = None) -> WriteResult:
    """Replace the whole table; the rows are counted while they are written.

    With ``expected``, the version the rows were made from, nothing changes and
    ``VersionConflict`` is raised if another writer has replaced that.  Without
    it the contents come after those of any other writer.
    """
    spark, counted = rows.sparkSession, Observation()
    folder = versions.new_folder(table.root)
    aligned(rows, table.columns).observe(counted, F.count(F.lit(1)).alias("rows")) \
        .write.parquet(folder)
    claimed = versions.claim(spark, table.root, folder, expected)
    point(spark, table)
    versions.remove_old(spark, table.root, table.keep_days, location(spark, table))
    return WriteResult(counted.get["rows"], claimed.number)


def run_refresh(table: Table, logs: AuditLogs, rules: DataFrame, ctx: JobContext) -> WriteResult:
    """The refresh job: compute the snapshot, replace the table, report the rows."""
    return replace_contents(table, refresh_routes(logs, rules, ctx))


def load_routes(spark: SparkSession, name: str, fallback: DataFrame,
                root: str | None = None) -> DataFrame:
    """The snapshot, heaviest routes first, or ``fallback`` if it can't be had.

    With a ``root`` the table is made, or brought up to date, before it is read.
    """
    table = routes_table(name, root) if root else None
    try:
        if table:
            ensure_table(spark, table)
        found = aligned(spark.table(name), schema.ROUTES)
        if found.isEmpty():
            return fallback
    except Exception as error:  # noqa: BLE001 - a page is shown whatever is wrong with the table
        log.warning("snapshot %s can't be read, the fallback is shown: %s", name, error)
        return fallback
    return loaded_routes(found).orderBy(*by_weight())


def load_rules(spark: SparkSession, name: str) -> DataFrame:
    """Rules in the order they are tried."""
    return ordered_rules(spark.table(name))


def save_rules(table: Table, rules: DataFrame, expected: int | None = None) -> int:
    """Replace all rules and return how many there are now.

    Nothing is written if any rule is faulty, or if ``expected``, the version the
    rules were edited from (see :func:`contents`), has been replaced.  An empty
    frame empties the table.
    """
    faults = rule_violations(rules)
    if not faults.isEmpty():
        raise ValueError(f"faulty rule: {faults.first().asDict()}")
    return replace_contents(table, rules, expected).rows


def seed_rules(table: Table, seed: DataFrame) -> int:
    """Add seed rules the table lacks and return how many; edits stay as they are.

    If the rules are edited meanwhile, the edited ones are looked at again.
    """
    while True:
        version, present = contents(seed.sparkSession, table)
        lacking = missing_rules(seed, present).count()
        try:
            if lacking:
                replace_contents(table, upserted_rules(seed, present), version)
            return lacking
        except VersionConflict:
            log.info("rules of %s were edited while they were seeded", table.name)
