import datetime as dt

import pytest
from pyspark.sql import functions as F
from test_refresh import ENV, logs, rules

from wayline.context import JobContext
from wayline.plans.history import run_window, snapshot_history
from wayline.plans.refresh import refresh_routes
from wayline.sources import derived

SUNDAY = dt.date(2024, 3, 31)


def runs_seeing(moment, days=30, hour=6):
    """Sundays whose run looks back on ``moment``, by trying each."""
    found = []
    for week in range(-2, 9):
        day = SUNDAY + dt.timedelta(weeks=week)
        midnight = dt.datetime.combine(day, dt.time())
        if midnight - dt.timedelta(days=days) < moment <= midnight + dt.timedelta(hours=hour):
            found.append(day)
    return found


MOMENTS = [dt.datetime(2024, 3, 31) + dt.timedelta(hours=h, microseconds=us)
           for h in (-30 * 24, -1, 0, 6, 12, 24, 100, 13 * 24 + 5) for us in (-1, 0, 1)]


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago", "Asia/Kolkata"])
@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_run_window(spark, conf, zone, kind):
    conf(spark__sql__session__timeZone=zone)
    df = spark.createDataFrame([(i, m.isoformat(sep=" ")) for i, m in enumerate(MOMENTS)],
                               "i int, at string").select("i", F.col("at").cast(kind).alias("at"))
    first, last = run_window(F.col("at"), 30, 6)
    for r in df.select("i", first.alias("a"), last.alias("b")).collect():
        got = [dt.date(1970, 1, 4) + dt.timedelta(weeks=k) for k in range(r.a, r.b + 1)]
        want = runs_seeing(MOMENTS[r.i])
        assert [d for d in got if d >= SUNDAY - dt.timedelta(weeks=2)] == want, MOMENTS[r.i]


def test_each_run_equals_a_refresh(spark):
    source = derived.audit_logs(spark, "/root/testdata/sf0.001")
    seed = derived.rule_table(spark)
    ctx = JobContext("O", "A", None, 30)
    start, end = dt.date(1999, 5, 2), dt.date(1999, 5, 16)
    history = snapshot_history(source, seed, ctx, start, end)
    by_run = {}
    for r in history.collect():
        by_run.setdefault(r.run_date, set()).add(tuple(r)[1:])
    assert sorted(by_run) == [start + dt.timedelta(weeks=i) for i in range(3)]
    for day, found in by_run.items():
        seen = source.queries.filter(F.col("start_time") <= dt.datetime.combine(day, dt.time(6)))
        as_of = refresh_routes(type(source)(source.sessions, seen, source.access), seed,
                               JobContext("O", "A", day, 30))
        assert found == {tuple(r) for r in as_of.collect()}


def test_range_ends(spark):
    found = logs(spark, [(1, "x", ENV % "acme")],
                 [(1, 1, "W", "SELECT", dt.datetime(2024, 3, 31, 6))], [(1, ["D.S.T"])])
    seed = rules(spark, (0, "%zzz%", "application", "Z"))

    def days(a, b):
        got = snapshot_history(found, seed, JobContext(), a, b).collect()
        return sorted(r.run_date for r in got)
    week = dt.timedelta(weeks=1)
    assert days(SUNDAY, SUNDAY) == [SUNDAY]
    assert days(SUNDAY + dt.timedelta(days=1), SUNDAY + week) == [SUNDAY + week]
    assert days(SUNDAY - week, SUNDAY - dt.timedelta(days=1)) == []
    assert len(days(SUNDAY - week, SUNDAY + 9 * week)) == 5
