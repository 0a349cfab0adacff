import datetime as dt
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayline import schema
from wayline.sources import files
from wayline.streaming import counts, late
from wayline.streaming.runs import Runs

COLUMNS = ("query_id long, start_time timestamp_ntz, client string, warehouse string, "
           "database string, schema_name string, direction string")
LOGGED = "query_id long, query_start_time timestamp, direct_objects_accessed array<struct<objectName: string>>"


def access(query, day, hour=1, schema_name="D.S"):
    at = None if day is None else dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day - 1)
    return (query, at, "C", "W", "D", schema_name, "read")


@pytest.fixture(autouse=True)
def state_on_disk(spark):
    counts.use_rocksdb(spark)


@pytest.fixture()
def arrive(spark, tmp_path):
    """Let records arrive in one more batch; progress of the counting, and the counts by day."""
    def run(*found, **options):
        df = spark.createDataFrame(list(found), COLUMNS)
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        progress = counts.run_daily_counts(
            counts.file_stream(spark, f"{tmp_path}/in", df), str(tmp_path / "out"), **options)
        latest = counts.latest_counts(spark, str(tmp_path / "out")).collect()
        return progress, {(r.day and (r.day - dt.date(2023, 12, 31)).days, r.schema_name): r.access_count
                          for r in latest}
    return run


@pytest.mark.parametrize("zone", ["UTC", "America/Chicago"])
def test_runs_continue_where_the_last_one_stopped(spark, conf, tmp_path, arrive, zone):
    conf(spark__sql__session__timeZone=zone)
    assert counts.latest_counts(spark, str(tmp_path / "out")).count() == 0
    assert arrive(access(1, 9, 23), access(1, 9, 23), access(2, 9, 0))[1] == {(9, "D.S"): 2}
    # Repeats do not count again, other schemas and queries do.
    assert arrive(access(1, 9, 23), access(3, 9, 5), access(3, 9, 5, None))[1] == {(9, "D.S"): 3, (9, None): 1}
    # Days that lie far back count as well, however late they come, and so does no day at all.
    want = {(9, "D.S"): 3, (9, None): 1, (1, "D.S"): 1, (None, "D.S"): 1}
    assert arrive(access(4, 1, 0), access(5, None))[1] == want
    assert arrive(access(4, 1, 0), access(5, None), access(1, 9, 23))[1] == want


def test_many_batches_in_any_order(arrive):
    """Repeats, late rows and late repeats over many batches, against all rows at once."""
    rng, sent = random.Random(3), []
    for turn in range(6):
        new = [access(rng.randrange(400), None, schema_name=rng.choice(["A", "B"])) for _ in range(40)]
        new = [r[:1] + access(1, r[0] % 5 + turn if rng.random() < 0.7 else r[0] % 9 + 1)[1:2] + r[2:] for r in new]
        new = [r[:1] + (dt.datetime(2024, 1, r[0] % 28 + 1, 1),) + r[2:] for r in new]  # one time for a query
        new += rng.sample(sent, min(len(sent), 10))
        sent += new
        got = arrive(*new)[1]
    want = {}
    for r in set(sent):
        key = ((r[1].date() - dt.date(2023, 12, 31)).days, r[5])
        want[key] = want.get(key, 0) + 1
    assert got == want


def test_state_and_reads_are_bounded(spark, tmp_path, arrive):
    """A run holds the accesses inside the bound and reads those that are new."""
    held, read = [], []
    for day in range(1, 10):
        progress, latest = arrive(*[access(100 * day + k, day) for k in range(50)], access(day, 1))
        held.append(max(s["numRowsTotal"] for p in progress for s in p["stateOperators"]))
        read.append(sum(p["numInputRows"] for p in progress))
        assert not any(s["numRowsDroppedByWatermark"] for p in progress for s in p["stateOperators"])
    assert latest[(9, "D.S")] == 50 and latest[(1, "D.S")] == 59
    assert max(held) <= 5 * 51 and max(read) <= 51
    gate = late.Gate(f"{tmp_path}/out/gate", spark.createDataFrame([], COLUMNS).schema, counts.DELAY)
    assert rows(late.late_rows(spark, gate)) == [(dt.date(2024, 1, 1), 6)]
    left = [f for f in (tmp_path / "out" / "gate" / "handed").iterdir() if f.suffix == ".parquet"]
    assert len(left) < 9  # files that were worked off go


def test_a_failed_run_counts_nothing_twice(spark, arrive, monkeypatch):
    """Whichever write of a run fails, running again gives the same as if it hadn't."""
    arrive(access(1, 20), access(2, 20))
    plain = Runs.write
    for kind in ("counted-in-time", "changes-in-time", "counted-late", "changes-late"):
        def broken(self, found, number, kind=kind):
            if self.root.endswith(kind):
                raise OSError("no space")
            plain(self, found, number)

        monkeypatch.setattr(Runs, "write", broken)
        with pytest.raises(Exception, match="no space"):
            arrive(access(3, 20), access(4, 1), access(1, 20))
        monkeypatch.setattr(Runs, "write", plain)
    assert arrive(access(3, 20), access(4, 1), access(5, 2))[1] == {(20, "D.S"): 3, (1, "D.S"): 1, (2, "D.S"): 1}


def test_the_gate(spark, tmp_path):
    """What is at the bound or beyond is late, and so is what has no time."""
    kind = spark.createDataFrame([], "k long").schema
    gate = late.Gate(f"{tmp_path}/gate", kind, 60)
    at = dt.datetime(2024, 1, 1)
    batches = [[(0, at), (1, at - dt.timedelta(hours=9)), (2, None)],
               [(3, at - dt.timedelta(seconds=60)), (4, at - dt.timedelta(seconds=59)), (5, at)],
               [(6, None)], [(7, at + dt.timedelta(days=1)), (8, at - dt.timedelta(seconds=61))]]
    for found in batches:
        df = spark.createDataFrame(found, "k long, t timestamp")
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        late.pass_gate(counts.file_stream(spark, f"{tmp_path}/in", df), F.col("t"), gate, keep=True)
    assert rows(gate.late.read(spark).select("k")) == [(2,), (3,), (6,), (8,)]
    assert rows(gate.kept.read(spark).select("k")) == [(0,), (1,), (4,), (5,), (7,)]
    assert sorted(r.k for r in spark.read.parquet(gate.handed).collect()) == [0, 1, 4, 5, 7]


def test_rows_the_watermark_drops_are_an_error(spark, tmp_path):
    """A query without a gate before it that loses rows says so."""
    def batch(day):
        df = spark.createDataFrame([access(day, day)], COLUMNS).withColumn("at", F.col("start_time").cast("timestamp"))
        df.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        found = counts.file_stream(spark, f"{tmp_path}/in", df).withWatermark("at", "1 day")
        return late.work_off(found.dropDuplicatesWithinWatermark(["query_id"]), f"{tmp_path}/place",
                             lambda rows, number: rows.count())

    batch(20)
    with pytest.raises(RuntimeError, match="dropped"):
        batch(1)


def test_folding(spark, tmp_path):
    """Folds stand for their runs; a run that wasn't written to the end is not there."""
    runs = Runs(f"{tmp_path}/r", "n long, day date", ("day",))
    assert runs.last(spark) == -1 and runs.read(spark).count() == 0
    days = [dt.date(2024, 1, 1), dt.date(2024, 1, 2), None]
    for k in range(7):
        runs.write(spark.createDataFrame([(k, days[k % 3])], "n long, day date"), k)
        if k in (2, 4):
            runs.fold(spark)
            assert sorted(r.n for r in runs.read(spark).collect()) == list(range(k + 1))
    assert runs.live(spark) == [(4, True), (5, False), (6, False)]
    assert sorted(r.n for r in runs.read(spark, 4).collect()) == [5, 6]
    assert {r.n: r.day for r in runs.read(spark).collect()} == {k: days[k % 3] for k in range(7)}
    assert not files.exists(spark, f"{runs.root}/run={0:012d}")
    (tmp_path / "r" / f"run={6:012d}" / "_SUCCESS").unlink()
    assert runs.last(spark) == 5


def test_folded_counts(spark, tmp_path, arrive, monkeypatch):
    monkeypatch.setattr(counts, "FOLD_EVERY", 2)
    for day in range(10, 15):
        got = arrive(access(day, day), access(100 + day, 1), access(9, 1))[1]
    assert got == {(1, "D.S"): 6} | {(day, "D.S"): 1 for day in range(10, 15)}
    counted = counts.Counted(str(tmp_path / "out"), "long")
    assert len(counted.changes.live(spark)) <= 3 and len(counted.late_accesses.live(spark)) <= 3


def test_either_log_may_be_late(spark, tmp_path):
    """Queries before their access records, and after them, inside the bound and beyond it."""
    named = spark.createDataFrame([(1, "C")], "session_id long, client string")
    folder, when = str(tmp_path / "out"), {q: dt.datetime(2024, 1, 3 * q) for q in range(1, 10)}
    none = {4, 5}  # queries whose access records have no time

    def run(q, a):
        new = spark.createDataFrame([(k, 1, "W", "SELECT", when[k]) for k in q], schema.QUERIES)
        new.write.mode("append").parquet(f"{tmp_path}/queries")
        found = spark.createDataFrame([(k, None if k in none else when[k], [("D.S.T",), ("D.S.U",)]) for k in a], LOGGED)
        found.write.mode("append").parquet(f"{tmp_path}/access")
        progress = counts.run_query_log(
            counts.file_stream(spark, f"{tmp_path}/queries", new),
            counts.file_stream(spark, f"{tmp_path}/access", found), named, folder)
        latest = counts.latest_counts(spark, folder).collect()
        assert all(r.access_count == 1 for r in latest)
        return progress, sorted((r.day - dt.date(2024, 1, 1)).days // 3 + 1 for r in latest)

    assert run([1], [2])[1] == []
    assert run([2], [1])[1] == [1, 2]          # either a batch ahead
    assert run([9], [9, 2])[1] == [1, 2, 9]    # a repeat
    assert run([3], [])[1] == [1, 2, 9]        # a query that is late
    assert run([4], [3])[1] == [1, 2, 3, 9]    # its record, late as well
    assert run([6], [4, 6])[1] == [1, 2, 3, 4, 6, 9]  # records without a time, and both in one batch
    assert run([], [5, 6])[1] == [1, 2, 3, 4, 6, 9]
    progress, days = run([5], [4, 1])
    assert days == [1, 2, 3, 4, 5, 6, 9]
    assert sum(p["numInputRows"] for p in progress) <= 3


def test_times_may_differ_a_little(spark, tmp_path):
    named = spark.createDataFrame([(1, "C")], "session_id long, client string")
    at = dt.datetime(2024, 1, 1, 12)
    queries = spark.createDataFrame([(k, 1, "W", "SELECT", at) for k in (1, 2)], schema.QUERIES)
    found = spark.createDataFrame([(1, at + dt.timedelta(minutes=59), [("D.S.T",)]),
                                   (2, at + dt.timedelta(minutes=61), [("D.S.T",)])], LOGGED)
    queries.write.parquet(f"{tmp_path}/queries")
    found.write.parquet(f"{tmp_path}/access")
    streams = [counts.file_stream(spark, f"{tmp_path}/{n}", df) for n, df in (("queries", queries), ("access", found))]
    counts.run_query_log(*streams, named, str(tmp_path / "out"))
    assert [r.access_count for r in counts.latest_counts(spark, str(tmp_path / "out")).collect()] == [1]
    with pytest.raises(ValueError):
        counts.run_query_log(*streams, named, str(tmp_path / "other"), delay=60, slack=61)


def test_records_of_a_query_are_held_once(spark, tmp_path):
    """However many access records a query has, in one run it takes one row of the state,
    and what it touches is counted as before."""
    named = spark.createDataFrame([(1, "C"), (1, "D"), (2, "C")], "session_id long, client string")
    at = [dt.datetime(2024, 1, 1, h) for h in range(3)]
    queries = spark.createDataFrame(
        [(k, s, "W", "SELECT", at[(k or 0) % 3]) for k, s in ((1, 1), (2, 2), (3, 3), (None, 1))], schema.QUERIES)
    touched = [["D.S.T", "D.S.U", None], ["D.S.T"], ["E.S.T", "USER$X.S.T"], None, [], ["D.R.T", "D"]] * 5
    found = [(k, at[k % 3] if k else at[0], n and [(x,) for x in n]) for k in (1, 2, 3, None) for n in touched]
    found += [(1, at[1] + dt.timedelta(minutes=9), [("F.S.T",)]), (1, None, [("G.S.T",)])]
    queries.write.parquet(f"{tmp_path}/queries")
    spark.createDataFrame(found, LOGGED).repartition(3).write.parquet(f"{tmp_path}/access")
    like = {"queries": queries, "access": spark.createDataFrame([], LOGGED)}
    counts.run_query_log(*[counts.file_stream(spark, f"{tmp_path}/{n}", df) for n, df in like.items()],
                         named, str(tmp_path / "out"))
    got = {(r.client, r.database, r.schema_name): r.access_count
           for r in counts.latest_counts(spark, str(tmp_path / "out")).collect()}
    places = [("D", "D.S"), ("E", "E.S"), ("D", "D.R"), ("D", None)]
    want = {("C", *p): 2 for p in places} | {("D", *p): 1 for p in places}
    assert {k: v for k, v in got.items() if k[1] not in "FG"} == want
    assert {k: v for k, v in got.items() if k[1] in "FG"} == {(c, x, f"{x}.S"): 1 for c in "CD" for x in "FG"}
    kept = spark.read.parquet(f"{tmp_path}/out/access/kept").groupBy("query_id", "at").count()
    assert kept.count() == 5 and kept.agg(F.max("count")).first()[0] == 1


def test_a_run_loads_the_files_of_the_state(spark, tmp_path):
    """Changes aren't made again row by row, and no batch runs without rows."""
    named = spark.createDataFrame([(1, "C")], "session_id long, client string")
    for day in (1, 9):
        at = dt.datetime(2024, 1, day)
        queries = spark.createDataFrame([(day, 1, "W", "SELECT", at)], schema.QUERIES)
        found = spark.createDataFrame([(day, at, [("D.S.T",)])], LOGGED)
        queries.write.mode("append").parquet(f"{tmp_path}/queries")
        found.write.mode("append").parquet(f"{tmp_path}/access")
        progress = counts.run_query_log(counts.file_stream(spark, f"{tmp_path}/queries", queries),
                                        counts.file_stream(spark, f"{tmp_path}/access", found),
                                        named, str(tmp_path / "out"))
        assert all(p["numInputRows"] for p in progress)
    kept = {f.suffix for f in (tmp_path / "out" / "place" / "state").rglob("*") if f.is_file()}
    assert ".zip" in kept and ".changelog" not in kept
    assert spark.conf.get("spark.sql.streaming.noDataMicroBatches.enabled") == "true"
