import datetime as dt

import pytest
from conftest import rows

from wayline import schema
from wayline.context import JobContext
from wayline.operators import classify, patterns
from wayline.operators.resolve import accesses, pruned, query_rows, session_rows, touched_places
from wayline.plans.refresh import AuditLogs, refresh_routes
from wayline.sources import derived
from wayline.session import SKEW_SETTINGS, runtime_filter
from wayline.streaming.counts import resolved_accesses

DAY = dt.datetime(2024, 3, 10)
CTX = JobContext("O", "A", dt.date(2024, 3, 31), 30)
ENV = '{"APPLICATION": "%s"}'


def logs(spark, sessions, queries, access):
    return AuditLogs(
        spark.createDataFrame(sessions, schema.SESSIONS),
        spark.createDataFrame(queries, schema.QUERIES),
        spark.createDataFrame(
            [(q, None if names is None else [(n,) for n in names]) for q, names in access],
            schema.ACCESS),
    )


def rules(spark, *found):
    return spark.createDataFrame(list(found), schema.RULES)


def refreshed(spark, sessions, queries, access, *found):
    out = refresh_routes(logs(spark, sessions, queries, access), rules(spark, *found), CTX)
    assert out.columns == schema.ROUTES.names
    return rows(out.select("client", "warehouse", "database", "schema_name", "direction",
                           "access_count"))


ONE_SESSION = [(1, "JDBC 3", ENV % "acme")]
TABLEAU = (0, "%tableau%", "application", "Tableau")


def one_query(kind="SELECT", at=DAY, q=1, s=1, wh="W"):
    return (q, s, wh, kind, at)


def test_counts_queries_once_per_schema(spark):
    got = refreshed(spark, ONE_SESSION, [one_query()],
                    [(1, ["D.S.T1", "D.S.T2", "D.S.T3"])], TABLEAU)
    assert got == [("acme", "W", "D", "D.S", "read", 1)]
    got = refreshed(spark, ONE_SESSION, [one_query()], [(1, ["D.S.T", "D.R.T", "E.S.T"])], TABLEAU)
    assert [r[5] for r in got] == [1, 1, 1] and {r[3] for r in got} == {"D.S", "D.R", "E.S"}


def test_access_records_of_one_query_are_merged(spark):
    got = refreshed(spark, ONE_SESSION, [one_query()],
                    [(1, ["D.S.T"]), (1, ["D.S.U", "D.R.T"]), (1, ["D.S.V"])], TABLEAU)
    assert [(r[3], r[5]) for r in got] == [("D.R", 1), ("D.S", 1)]


def test_noise_goes(spark):
    sessions = ONE_SESSION + [(2, "SYSTEM_TASK", None), (3, None, None)]
    kept = [(1, ["APP!FUNC", "USER$X.A.B", None, "D.S.T", "DB1"])]
    got = refreshed(spark, sessions, [one_query()], kept, TABLEAU)
    assert [(r[2], r[3]) for r in got] == [("D", "D.S"), ("DB1", None)]
    for kind in ("CALL", "BEGIN_TRANSACTION", "COMMIT", "ROLLBACK", "SET", "UNSET", "USE", None):
        assert refreshed(spark, sessions, [one_query(kind)], kept, TABLEAU) == []
    for session in (2, 3, 4):
        assert refreshed(spark, sessions, [one_query(s=session)], kept, TABLEAU) == []
    for names in ([], None, ["X!Y"]):
        assert refreshed(spark, sessions, [one_query()], [(1, names)], TABLEAU) == []


def test_lookback_is_strict(spark):
    edge = dt.datetime(2024, 3, 1)
    for at, n in ((edge, 0), (edge + dt.timedelta(microseconds=1), 1), (None, 0)):
        assert len(refreshed(spark, ONE_SESSION, [one_query(at=at)], [(1, ["D.S.T"])], TABLEAU)) == n


def test_lookback_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "queries")
    spark.createDataFrame([one_query()], schema.QUERIES).write.parquet(path)
    queries = query_rows(spark.read.parquet(path), CTX.since)
    plan = queries._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(start_time" in plan.split("PushedFilters")[1]


def test_null_warehouse_is_kept_and_bad_json_is_no_application(spark):
    got = refreshed(spark, [(1, "JDBC 3", "{not json")], [one_query(wh=None)],
                    [(1, ["D.S.T"])], TABLEAU)
    assert got == [("JDBC 3", None, "D", "D.S", "read", 1)]


def names_of(spark, client_app_id, application, *found, limit=None):
    pairs = spark.createDataFrame([(client_app_id, application)],
                                  "client_app_id string, application string")
    limits = {} if limit is None else {"limit": limit}
    out = classify.classify(pairs, rules(spark, *found), **limits).collect()
    assert len(out) == 1
    return out[0]["clients"]


def test_first_rule_wins_across_fields(spark):
    found = [(7, "%jdbc%", "client_app_id", "JDBC"), (3, "%acme%", "application", "Acme"),
             (5, "%me", "application", "Me")]
    assert names_of(spark, "JDBC 3", "acme", *found) == ["Acme"]
    assert names_of(spark, "JDBC 3", None, *found) == ["JDBC"]
    assert names_of(spark, "ODBC", "zzz", *found) == ["zzz"]
    assert names_of(spark, "ODBC", None, *found) == ["ODBC"]


def test_rule_fields_do_not_mix(spark):
    assert names_of(spark, "acme", "jdbc", (1, "%jdbc%", "client_app_id", "A"),
                    (2, "%acme%", "application", "B")) == ["jdbc"]


def test_wildcards_and_exact_patterns(spark):
    found = [(0, "Go", "application", "Go"), (1, "%etl_job%", "application", "Job"),
             (2, "%report%server%", "application", "Reports")]
    assert names_of(spark, "x", "GO", *found) == ["Go"]
    assert names_of(spark, "x", "Google", *found) == ["Google"]
    assert names_of(spark, "x", "my ETL-JOB 1", *found) == ["Job"]
    assert names_of(spark, "x", "etljob", *found) == ["etljob"]
    assert names_of(spark, "x", "the REPORTING web Server", *found) == ["Reports"]


def test_ties_go_to_the_smaller_name_and_to_the_client_id(spark):
    assert names_of(spark, "x", "ab", (1, "%a%", "application", "B"),
                    (1, "%b%", "application", "A")) == ["A"]
    assert names_of(spark, "ab", "ab", (1, "%a%", "application", "A"),
                    (1, "%b%", "client_app_id", "Z")) == ["Z"]


def test_priorities_from_999_on(spark):
    late, early = (999, "%a%", "application", "Late"), (1, "%b%", "application", "Early")
    assert names_of(spark, "x", "ab", late) == ["ab"]
    assert names_of(spark, "x", "ab", late, early) == ["Early", "ab"]
    assert names_of(spark, "ab", None, (999, "%a%", "client_app_id", "Id")) == ["Id"]
    assert names_of(spark, "ab", None, (1000, "%a%", "client_app_id", "Id")) == ["ab"]
    # With a match on either side neither is lost.
    assert names_of(spark, "ab", "ab", (1000, "%a%", "client_app_id", "Id"), late) == ["Late"]


def test_two_names_count_twice(spark):
    got = refreshed(spark, [(1, "x", ENV % "ab")], [one_query()], [(1, ["D.S.T"])],
                    (999, "%a%", "application", "Late"), (1, "%b%", "application", "Early"))
    assert [(r[0], r[5]) for r in got] == [("Early", 1), ("ab", 1)]


def test_rule_parts_find_the_same(spark):
    pairs = classify.distinct_pairs(session_rows(spark.createDataFrame(
        [(i, f"JDBC {i % 3}", ENV % name) for i, name in enumerate(
            ["tableau prep", "dbt", "x", "sparkline", "Go", "twin"] * 2)]
        + [(20, "JDBC 1", None), (21, "nothing", None)], schema.SESSIONS)))
    found = rules(spark, *[(i, f"%{p}%", f, p) for i, (p, f) in enumerate(
        (p, f) for p in ("tableau", "spark", "twin", "dbt", "jdbc", "twin") for f in classify.PAIR)])
    found = found.union(found.filter("display_name = 'twin'"))  # rules that are there twice
    assert len(patterns.in_slices(classify.prepared(found), limit=600)) > 4
    whole = rows(classify.match_rules(pairs, found))
    assert rows(classify.match_rules(pairs, found, limit=600)) == whole
    assert rows(classify.match_rules(pairs, found, looped=2)) == whole
    assert len([r for r in whole if r[5] == "twin"]) == 4
    assert [r[:2] for r in whole if r[2] is None] == [("nothing", None)]
    assert rows(classify.best_rules(pairs, found, limit=600)) == rows(classify.best_rules(pairs, found))
    assert rows(classify.best_rules(pairs, found, looped=2)) == rows(classify.best_rules(pairs, found))


def test_repeated_sessions_count_once(spark):
    queries, access = [one_query(), one_query(q=2)], [(1, ["D.S.T"]), (2, ["D.S.T"])]
    twice = ONE_SESSION * 2
    assert refreshed(spark, twice, queries, access, TABLEAU) == [("acme", "W", "D", "D.S", "read", 2)]
    # Two pairs of one name are one client, two names are two.
    pairs = [(1, "JDBC 3", ENV % "Tableau A"), (1, "JDBC 4", ENV % "tableau B"), (1, "JDBC 4", ENV % "acme")]
    got = refreshed(spark, pairs, queries, access, TABLEAU)
    assert [(r[0], r[5]) for r in got] == [("Tableau", 2), ("acme", 2)]


def test_dates_prune_only_where_asked_for(spark):
    log = spark.createDataFrame([(1, dt.date(2024, 3, 1)), (2, dt.date(2024, 2, 28)), (3, None),
                                 (4, dt.date(2024, 2, 29)), (5, dt.date(2024, 3, 9))],
                                "query_id long, start_date date")
    since, until = dt.datetime(2024, 3, 1), dt.datetime(2024, 3, 7)
    assert rows(pruned(log, since)) == rows(log)
    kept = pruned(log, since, until, "start_date")
    assert [r.query_id for r in kept.orderBy("query_id").collect()] == [1, 3, 4]


def test_equals_counting_row_by_row(spark):
    """Compare with distinct counts over fully resolved rows."""
    import random
    rng = random.Random(7)
    sessions = [(i, rng.choice(["JDBC 1", "Go", "Console", "SYSTEM_X", None]),
                 rng.choice([None, ENV % "dbt", ENV % "acme", "{}", ENV % "Tableau"]))
                for i in range(30)]
    queries = [(q, rng.randrange(32), rng.choice(["W1", "W2", None]),
                rng.choice(["SELECT", "INSERT", "SHOW", "CALL", "DROP_X"]),
                DAY + dt.timedelta(days=rng.randrange(-20, 20))) for q in range(300)]
    access = [(rng.randrange(310), [rng.choice(["A.X.1", "A.X.2", "A.Y.1", "B", "B.", "C!D",
                                                "USER$T.X", "B.Z"]) for _ in range(rng.randrange(4))])
              for _ in range(600)]
    found = logs(spark, sessions, queries, access)
    seed = derived.rule_table(spark)
    want = {}
    for r in resolved_accesses(found, seed, CTX).collect():
        key = (r.client, r.warehouse, r.database, r.schema_name, r.direction)
        want.setdefault(key, set()).add(r.query_id)
    got = {tuple(r)[2:7]: r.access_count for r in refresh_routes(found, seed, CTX).collect()}
    assert got == {k: len(v) for k, v in want.items()} and len(got) > 20


def test_places_are_reduced_in_the_row(spark):
    found = logs(spark, [], [], [(1, ["A.B.C", "A.B.D", "A", "A.", "A..X", "!"])]).access
    places = touched_places(found).first()["places"]
    assert sorted(p for p in places if p) == ["A", "A.B"]


def test_hot_query_is_split(spark, conf, tmp_path):
    """A third of all access records belong to one query: the join splits it."""
    conf(**{k.replace(".", "__"): v for k, v in SKEW_SETTINGS.items()},
         spark__sql__autoBroadcastJoinThreshold="-1",
         spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes="40KB",
         spark__sql__adaptive__skewJoin__skewedPartitionFactor="2",
         spark__sql__adaptive__advisoryPartitionSizeInBytes="20KB",
         spark__sql__shuffle__partitions="16")
    spark.range(60_000).selectExpr(
        "if(id % 3 = 0, 7L, id % 5000) AS query_id",
        "array(named_struct('objectName', 'D' || id % 50 || '.S' || id % 7 || '.T' || id))"
        " AS direct_objects_accessed").repartition(8).write.parquet(str(tmp_path / "access"))
    access = spark.read.parquet(str(tmp_path / "access"))
    queries = spark.range(5000).selectExpr(
        "id AS query_id", "id % 100 AS session_id", "'W' AS warehouse_name",
        "'SELECT' AS query_type", "timestamp'2024-03-10' AS start_time")
    found = accesses(query_rows(queries), access)
    got = len(found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "skew=true" in plan.split("Initial Plan")[0]
    want = access.selectExpr("query_id", "substring_index(direct_objects_accessed[0].objectName,"
                             " '.', 2) AS p").distinct().count()
    assert got == want


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_no_product_of_whole_tables(spark, conf, threshold):
    conf(spark__sql__autoBroadcastJoinThreshold=threshold)
    found = logs(spark, ONE_SESSION, [one_query()], [(1, ["D.S.T"])])
    out = refresh_routes(found, rules(spark, TABLEAU), CTX)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    # Only the bounded rule table is joined without an equality, once for each field.
    assert plan.count("BroadcastNestedLoopJoin") == 2


def test_a_filter_reaches_the_access_scan(spark, conf, tmp_path):
    """Without a date column: accesses of other days go before they are shuffled."""
    conf(spark__sql__autoBroadcastJoinThreshold="-1")
    before = spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold")
    logs = derived.audit_logs(spark, "/root/testdata/sf0.001")
    for name in ("queries", "access"):
        getattr(logs, name).write.parquet(f"{tmp_path}/{name}")
    logs = AuditLogs(logs.sessions, *[spark.read.parquet(f"{tmp_path}/{n}") for n in ("queries", "access")])
    plain = refresh_routes(logs, derived.rule_table(spark), derived.RECENT)
    assert "might_contain" not in plain._jdf.queryExecution().executedPlan().toString()
    with runtime_filter(spark, least_scan="0"):
        found = refresh_routes(logs, derived.rule_table(spark), derived.RECENT)
        assert "might_contain" in found._jdf.queryExecution().executedPlan().toString()
        got = rows(found)
    assert got == rows(plain)
    assert spark.conf.get("spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold") == before
