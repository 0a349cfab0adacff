"""The refresh from daily counts, held to the full refresh."""

import dataclasses
import datetime as dt
import uuid

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayline.context import JobContext
from wayline.operators.rules import numbered_rules
from wayline.plans import partials
from wayline.plans.refresh import AuditLogs, refresh_routes
from wayline.sources import derived, tables

SMALL = "/root/testdata/sf0.001"
TODAY = dt.date(2001, 7, 25)
CTX = JobContext("O", "A", TODAY, 30)


@pytest.fixture()
def store(spark, tmp_path):
    found = partials.Partials("t_" + uuid.uuid4().hex, str(tmp_path))
    yield found
    spark.sql(f"DROP TABLE IF EXISTS {found.name}")


@pytest.fixture(scope="module")
def logs(spark):
    """Logs whose queries start at all hours, some of them at midnight."""
    found = derived.audit_logs(spark, SMALL)
    hours = F.make_dt_interval(hours=F.pmod("query_id", F.lit(24)))
    queries = found.queries.withColumn("start_time", F.col("start_time").cast("timestamp") + hours)
    queries = queries.filter(F.to_date("start_time") <= F.lit(TODAY))
    return AuditLogs(found.sessions, queries.cache(), found.access.cache())


def on(day, weeks=0):
    return dataclasses.replace(CTX, as_of=day + dt.timedelta(days=7 * weeks))


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_weekly_runs_equal_full_ones(spark, conf, store, logs, zone):
    conf(spark__sql__session__timeZone=zone)
    rules = derived.rule_table(spark)
    for weeks in (-2, -1, 0):
        ctx = on(TODAY, weeks)
        known = AuditLogs(logs.sessions, logs.queries.filter(
            F.to_date("start_time") <= F.lit(ctx.as_of)), logs.access)
        got = partials.refresh_by_days(store, known, rules, ctx)
        want = rows(refresh_routes(known, rules, ctx))
        assert rows(got) == want and want
    # A window that is shorter, and an edited rule, need no log.
    short = dataclasses.replace(CTX, days=9)
    other = numbered_rules(spark, [("%nimbus%", "client_app_id", "Cloud")])
    assert rows(partials.refresh_kept(store, logs.sessions, other, short)) == rows(refresh_routes(known, other, short))


def test_only_new_days_are_read(spark, store, logs):
    partials.refresh_by_days(store, logs, derived.rule_table(spark), on(TODAY, -1))
    first = CTX.since.date()
    want = [TODAY + dt.timedelta(days=k) for k in range(-8, 1)]  # two that were open, seven new ones
    assert partials.open_days(spark, store, first, TODAY) == want
    partials.write_days(store, logs, want, TODAY)
    assert partials.open_days(spark, store, first, TODAY) == want[-2:]
    # The last part has no other days.
    _, known = tables.contents(spark, store.days)
    parts = {r["part"]: r["n"] for r in known.groupBy("part").agg(F.count("*").alias("n")).collect()}
    assert sorted(parts.values()) == [9, 29]


def test_days_written_again_replace_their_part(spark, store, logs):
    """Repeated days count once; a day that has lost its queries is empty."""
    rules, days = derived.rule_table(spark), partials._all_days(CTX.since.date(), TODAY)
    partials.write_days(store, logs, days, TODAY)
    partials.write_days(store, logs, days[3:9] + days[12:14], TODAY)
    want = rows(refresh_routes(logs, rules, CTX))
    assert rows(partials.refresh_kept(store, logs.sessions, rules, CTX)) == want
    gone = partials.kept_counts(spark, store, days[2]).groupBy("day").count().orderBy(F.desc("count")).first()["day"]
    less = AuditLogs(logs.sessions, logs.queries.filter(F.to_date("start_time") != F.lit(gone)), logs.access)
    partials.write_days(store, less, [gone], TODAY)
    got = rows(partials.refresh_kept(store, logs.sessions, rules, CTX))
    assert got == rows(refresh_routes(less, rules, CTX)) != want


def test_pruned_to_the_days_of_the_window(spark, store, logs):
    partials.write_days(store, logs, partials._all_days(TODAY - dt.timedelta(days=60), TODAY), TODAY)
    found = partials.kept_counts(spark, store, TODAY - dt.timedelta(days=3))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "day#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert found.select("day").distinct().count() <= 4


def test_days_that_are_forgotten(spark, store, logs, tmp_path):
    quick = dataclasses.replace(store, keep_days=0)
    partials.write_days(quick, logs, partials._all_days(TODAY - dt.timedelta(days=9), TODAY - dt.timedelta(days=5)), TODAY)
    partials.write_days(quick, logs, partials._all_days(TODAY - dt.timedelta(days=4), TODAY), TODAY)
    partials.forget(spark, quick, TODAY - dt.timedelta(days=4))
    assert len(list((tmp_path / "parts").glob("part=*"))) == 1
    assert tables.contents(spark, quick.days)[1].count() == 5


def test_two_runs_at_once(spark, store, logs, monkeypatch):
    """Days another run writes meanwhile are kept."""
    rules, days = derived.rule_table(spark), partials._all_days(CTX.since.date(), TODAY)
    partials.write_days(store, logs, days[:10], TODAY)
    plain = tables.contents

    def other_first(spark_, table):
        found = plain(spark_, table)
        monkeypatch.setattr(tables, "contents", plain)
        partials.write_days(store, logs, days[20:], TODAY)
        return found

    monkeypatch.setattr(tables, "contents", other_first)
    partials.write_days(store, logs, days[8:20], TODAY)
    assert rows(partials.refresh_kept(store, logs.sessions, rules, CTX)) == rows(refresh_routes(logs, rules, CTX))


def test_nothing_kept(spark, store, logs):
    rules = derived.rule_table(spark)
    none = AuditLogs(logs.sessions, logs.queries.limit(0), logs.access)
    assert partials.refresh_by_days(store, none, rules, CTX).count() == 0
    assert partials.open_days(spark, store, TODAY, TODAY + dt.timedelta(days=1)) == [TODAY, TODAY + dt.timedelta(days=1)]
    empty = dataclasses.replace(store, name=store.name + "_b", root=store.root + "/b")
    tables.ensure_table(spark, empty.days)
    assert partials.refresh_kept(empty, logs.sessions, rules, CTX).count() == 0


def test_text_ids(spark, store, logs):
    text, rules = derived.with_text_ids(logs), derived.rule_table(spark)
    assert rows(partials.refresh_by_days(store, text, rules, CTX)) == rows(refresh_routes(logs, rules, CTX))
