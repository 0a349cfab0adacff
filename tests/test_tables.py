import os
import time
import uuid
from concurrent.futures import ThreadPoolExecutor

import pytest
from conftest import rows

from wayline import schema
from wayline.context import JobContext
from wayline.operators import rules as rule_ops
from wayline.sources import audit, derived, tables, versions


@pytest.fixture()
def name():
    return "t_" + uuid.uuid4().hex


def rule_frame(spark, *found):
    return spark.createDataFrame(list(found), schema.RULES)


def test_bootstrap_is_idempotent(spark, name, tmp_path):
    table = tables.routes_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.replace_contents(table, derived.direct_routes(spark, "/root/testdata/sf0.001").limit(0))
    tables.ensure_table(spark, table)
    assert spark.table(name).columns == schema.ROUTES.names


def test_refresh_job(spark, name, tmp_path):
    table = tables.routes_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    logs = derived.audit_logs(spark, "/root/testdata/sf0.001")
    result = tables.run_refresh(table, logs, derived.rule_table(spark), derived.RECENT)
    assert result.rows == 114 == spark.table(name).count()
    assert result.message.endswith("Rows: 114")
    loaded = tables.load_routes(spark, name, None)
    counts = [r["ACCESS_COUNT"] for r in loaded.collect()]
    assert counts == sorted(counts, reverse=True) and sum(counts) > 114
    # A second run replaces, it does not add.
    later = JobContext("O", "A", derived.AS_OF, 3650)
    result = tables.run_refresh(table, logs, derived.rule_table(spark), later)
    assert spark.table(name).count() == result.rows > 2000


def test_failed_write_changes_nothing(spark, name, tmp_path):
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.replace_contents(table, rule_frame(spark, (0, "a", "application", "A")))
    broken = spark.range(3).selectExpr(
        "raise_error('no') AS pattern", "id AS priority", "'x' AS source_field", "'y' AS display_name")
    with pytest.raises(Exception):
        tables.replace_contents(table, broken)
    assert rows(spark.table(name)) == [(0, "a", "application", "A")]


def test_old_table_gets_the_new_column(spark, name, tmp_path):
    old = [c for c in schema.ROUTES.names if c != "schema_name"]
    columns = ", ".join(f"{c} {'bigint' if c == 'access_count' else 'string'}" for c in old)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet LOCATION '{tmp_path}/old'")
    spark.sql(f"INSERT INTO {name} VALUES ('O', 'A', 'C', 'W', 'D', 'read', 7)")
    table = tables.routes_table(name, str(tmp_path))
    assert tables.add_missing_columns(spark, table) == ["schema_name"]
    assert tables.add_missing_columns(spark, table) == []
    got = tables.load_routes(spark, name, None).first()
    assert (got["SCHEMA_NAME"], got["ACCESS_COUNT"]) == (None, 7)


def test_load_falls_back(spark, name, tmp_path, sample):
    assert tables.load_routes(spark, name, sample) is sample
    tables.ensure_table(spark, tables.routes_table(name, str(tmp_path)))
    assert tables.load_routes(spark, name, sample) is sample
    # A file that is damaged, and a table that the load itself sets up.
    spark.sql(f"CREATE TABLE {name}_bad (client string) USING parquet LOCATION '{tmp_path}/bad'")
    (tmp_path / "bad").mkdir(exist_ok=True)
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet at all")
    assert tables.load_routes(spark, f"{name}_bad", sample) is sample
    assert tables.load_routes(spark, f"{name}_new", sample, root=str(tmp_path / "new")) is sample
    assert spark.table(f"{name}_new").columns == schema.ROUTES.names


def test_old_versions_go(spark, name, tmp_path):
    """By age: without an age to keep, what counts and what it replaced stay."""
    table = tables.rules_table(name, str(tmp_path), keep_days=0)
    tables.ensure_table(spark, table)
    for k in range(5):
        tables.replace_contents(table, rule_frame(spark, (k, "a", "application", "A")))
    assert len(versions.folders(spark, table.root)) == 2
    assert rows(spark.table(name)) == [(4, "a", "application", "A")]
    assert versions.newest(spark, table.root).number == 5


def test_two_writers(spark, name, tmp_path):
    """One of two that edit the same version is refused; nothing of either is removed."""
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.save_rules(table, rule_frame(spark, (0, "a", "application", "A")))
    version, before = tables.contents(spark, table)
    first, second = rule_frame(spark, (1, "b", "application", "B")), rule_frame(spark, (2, "c", "application", "C"))
    assert tables.save_rules(table, first, expected=version) == 1
    with pytest.raises(tables.VersionConflict):
        tables.save_rules(table, second, expected=version)
    assert rows(spark.table(name)) == [(1, "b", "application", "B")]
    assert rows(before) == [(0, "a", "application", "A")]  # replaced, and still readable
    assert len(versions.folders(spark, table.root)) == 3  # that of the refused writer as well
    version, found = tables.contents(spark, table)
    tables.save_rules(table, found.union(second), expected=version)
    assert rows(spark.table(name)) == [(1, "b", "application", "B"), (2, "c", "application", "C")]


def test_a_folder_under_way_is_left_alone(spark, name, tmp_path):
    """Neither a failed write nor another writer's folder misleads a removal."""
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.replace_contents(table, rule_frame(spark, (0, "a", "application", "A")))
    _, before = tables.contents(spark, table)
    other = versions.new_folder(table.root)
    rule_frame(spark, (9, "z", "application", "Z")).write.parquet(other)
    tables.replace_contents(table, rule_frame(spark, (1, "b", "application", "B")))
    assert rows(before) == [(0, "a", "application", "A")]
    assert spark.read.parquet(other).count() == 1
    # Once it has an age, a folder that was never claimed goes; what counts doesn't.
    old = time.time() - 8 * 86_400
    for folder in tmp_path.glob("version-*"):
        os.utime(folder, (old, old))
    tables.replace_contents(table, rule_frame(spark, (2, "c", "application", "C")))
    left = {f.name for f in tmp_path.glob("version-*")}
    assert os.path.basename(other) not in left and len(left) == 2
    assert rows(spark.table(name)) == [(2, "c", "application", "C")]


def test_a_writer_that_dies(spark, name, tmp_path):
    """A claim without a folder counts for nothing; one the table was not yet pointed at counts."""
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.replace_contents(table, rule_frame(spark, (0, "a", "application", "A")))
    (tmp_path / "claim-000000000002").touch()
    assert versions.newest(spark, table.root).number == 1
    folder = versions.new_folder(table.root)
    rule_frame(spark, (1, "b", "application", "B")).write.parquet(folder)
    versions.claim(spark, table.root, folder)
    assert rows(spark.table(name)) == [(0, "a", "application", "A")]
    assert tables.point(spark, table).number == 3
    assert rows(spark.table(name)) == [(1, "b", "application", "B")]
    assert tables.save_rules(table, rule_frame(spark), expected=3) == 0


def test_writers_at_once(spark, name, tmp_path):
    """Of writers at the same moment each gets a number, and the table is at the largest."""
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    with ThreadPoolExecutor(4) as pool:
        results = list(pool.map(lambda k: tables.replace_contents(
            table, rule_frame(spark, (k, "a", "application", "A"))).version, range(4)))
    assert sorted(results) == [1, 2, 3, 4]
    assert rows(spark.table(name)) == [(results.index(4), "a", "application", "A")]


def test_seeding_while_rules_are_edited(spark, name, tmp_path, monkeypatch):
    """An edit that comes between is kept, and the seed added to it."""
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    edit, plain = rule_frame(spark, (0, "mine", "application", "Mine")), tables.missing_rules

    def edited_meanwhile(seed, present):
        monkeypatch.setattr(tables, "missing_rules", plain)
        tables.save_rules(table, edit)
        return plain(seed, present)

    monkeypatch.setattr(tables, "missing_rules", edited_meanwhile)
    assert tables.seed_rules(table, derived.rule_table(spark)) == len(derived.RULES)
    assert {"mine", "%nimbus%"} <= {r.pattern for r in spark.table(name).collect()}


def test_seed_keeps_edits(spark, name, tmp_path):
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    seed = derived.rule_table(spark)
    assert tables.seed_rules(table, seed) == len(derived.RULES)
    assert tables.seed_rules(table, seed) == 0
    twins = [r for r in tables.load_rules(spark, name).collect() if r.pattern == "%quillboard%"]
    assert [r.priority for r in twins] == [3, 6]
    edited = rule_frame(spark, (5, "Pi", "application", "My Pi"), (6, "%new%", "application", "N"))
    assert tables.save_rules(table, edited) == 2
    assert tables.seed_rules(table, seed) == len(derived.RULES) - 1
    kept = [r for r in spark.table(name).collect() if r.pattern == "Pi"]
    assert [r.display_name for r in kept] == ["My Pi"]


def test_save_is_all_or_nothing(spark, name, tmp_path):
    table = tables.rules_table(name, str(tmp_path))
    tables.ensure_table(spark, table)
    tables.save_rules(table, rule_frame(spark, (0, "a", "application", "A")))
    with pytest.raises(ValueError):
        tables.save_rules(table, rule_frame(spark, (0, "b", "application", "B"),
                                            (1, "", "application", "C")))
    assert rows(spark.table(name)) == [(0, "a", "application", "A")]
    assert tables.save_rules(table, rule_frame(spark)) == 0
    assert spark.table(name).count() == 0


@pytest.mark.parametrize("rule, reason", [
    ((0, None, "application", "A"), "pattern is empty"),
    ((0, "", "application", "A"), "pattern is empty"),
    ((0, "a", "application", None), "display_name is empty"),
    ((0, "a", "warehouse", "A"), "source_field is unknown"),
    ((0, "a", None, "A"), "source_field is unknown"),
    ((-1, "a", "application", "A"), "priority is out of range"),
    ((999, "a", "application", "A"), "priority is out of range"),
    ((None, "a", "application", "A"), "priority is out of range"),
    ((0, "a\\", "application", "A"), "pattern has a backslash"),
])
def test_violations(spark, rule, reason):
    assert [r.reason for r in rule_ops.rule_violations(rule_frame(spark, rule)).collect()] == [reason]


def test_good_rules(spark):
    found = rule_frame(spark, (0, "%a_b%", "client_app_id", "A"), (998, "x'y", "application", "O'B"))
    assert rule_ops.rule_violations(found).count() == 0
    assert rule_ops.rule_violations(derived.rule_table(spark)).count() == 0


def test_fractional_priority_is_faulty(spark):
    found = spark.createDataFrame([(1.5, "a", "application", "A")],
                                  "priority double, pattern string, source_field string, "
                                  "display_name string")
    assert rule_ops.rule_violations(found).first().reason == "priority is out of range"


def test_rules_come_in_order(spark):
    found = rule_frame(spark, (2, "b", "application", "B"), (0, "c", "application", "C"),
                       (2, "a", "application", "A"))
    assert [r.pattern for r in rule_ops.ordered_rules(found).collect()] == ["c", "a", "b"]


@pytest.mark.parametrize("text_ids", [False, True])
@pytest.mark.parametrize("fmt", ["parquet", "orc", "json", "csv", "table"])
def test_audit_logs_of_all_formats(spark, tmp_path, name, fmt, text_ids):
    from pyspark.sql import functions as F

    from wayline.plans.refresh import refresh_routes
    logs = derived.audit_logs(spark, "/root/testdata/sf0.001")
    want = refresh_routes(logs, derived.rule_table(spark), derived.RECENT)
    logs = derived.with_text_ids(logs) if text_ids else logs
    places = {}
    for part in ("sessions", "queries", "access"):
        frame = getattr(logs, part)
        if part == "queries":
            frame = frame.withColumn("start_time", frame.start_time.cast("timestamp"))
        if fmt == "csv" and part == "access":
            frame = frame.withColumn("direct_objects_accessed", F.to_json("direct_objects_accessed"))
        if fmt == "table":
            places[part] = f"{name}_{part}"
            frame.createOrReplaceTempView(places[part])
        else:
            places[part] = f"{tmp_path}/{part}"
            options = {"header": True, "escape": '"'} if fmt == "csv" else {}
            frame.write.format(fmt).options(**options).save(places[part])
    read = audit.read_audit_logs(spark, *places.values(), fmt=fmt)
    assert rows(refresh_routes(read, derived.rule_table(spark), derived.RECENT)) == rows(want)


def test_wrong_types_are_errors(spark, tmp_path):
    spark.range(3).selectExpr("id AS session_id", "id AS client_application_id",
                              "'x' AS client_environment").write.parquet(f"{tmp_path}/p")
    with pytest.raises(TypeError, match="client_application_id"):
        audit.read_log(spark, f"{tmp_path}/p", schema.SESSIONS, "parquet")
    spark.range(3).selectExpr("id AS query_id", "'s' AS session_id", "'w' AS warehouse_name",
                              "'t' AS query_type", "'no time' AS start_time").write.json(f"{tmp_path}/j")
    with pytest.raises(Exception):
        audit.read_log(spark, f"{tmp_path}/j", schema.QUERIES, "json").collect()
    with pytest.raises(ValueError):
        audit.read_log(spark, "x", schema.SESSIONS, "xml")


def test_only_object_names_are_read(spark, tmp_path):
    """Other fields of the accessed objects stay unread."""
    from wayline.operators.resolve import touched_places
    spark.range(3).selectExpr(
        "id AS query_id", "array(named_struct('objectName', 'A.B.C', 'columns', 'long'))"
        " AS direct_objects_accessed").write.parquet(str(tmp_path / "a"))
    plan = touched_places(spark.read.parquet(str(tmp_path / "a")))._jdf.queryExecution() \
        .executedPlan().toString()
    assert "array<struct<objectName:string>>" in plan.split("ReadSchema")[1]


def test_start_dates_prune_both_logs(spark, tmp_path):
    """Logs partitioned by day: the same routes, from the days looked back on."""
    from pyspark.sql import functions as F

    from wayline.plans.refresh import refresh_routes
    logs = derived.audit_logs(spark, "/root/testdata/sf0.001")
    queries = logs.queries.withColumn("start_time", F.col("start_time").cast("timestamp")) \
        .withColumn("start_date", F.to_date("start_time")).filter("start_date >= '2001-05-01'")
    days = queries.select("query_id", "start_date")
    for part, frame in (("sessions", logs.sessions), ("queries", queries),
                        ("access", logs.access.join(days, "query_id"))):
        keys = [c for c in frame.columns if c == "start_date"]
        frame.write.partitionBy(*keys).parquet(f"{tmp_path}/{part}")
    read = audit.read_audit_logs(
        spark, *[f"{tmp_path}/{p}" for p in ("sessions", "queries", "access")], fmt="parquet",
        date_column="start_date")
    out = refresh_routes(read, derived.rule_table(spark), derived.RECENT)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("start_date#") and plan.count(">= 2001-07-01)") == 2
    want = refresh_routes(logs, derived.rule_table(spark), derived.RECENT)
    assert rows(out) == rows(want)


def test_bucketed_logs_are_joined_in_place(spark, name, conf):
    """Logs bucketed by query id need no shuffle to be joined and made distinct."""
    from wayline.operators.resolve import accesses, query_rows
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    logs = derived.audit_logs(spark, "/root/testdata/sf0.001")
    for part in ("queries", "access"):
        getattr(logs, part).write.bucketBy(4, "query_id").sortBy("query_id").saveAsTable(
            f"{name}_{part}")
    found = accesses(query_rows(spark.table(f"{name}_queries")), spark.table(f"{name}_access"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    want = accesses(query_rows(logs.queries), logs.access)
    assert rows(found) == rows(want)
    for part in ("queries", "access"):
        spark.sql(f"DROP TABLE {name}_{part}")
