"""Every query the package offers, over the test tables, by name."""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.functions.direction import statement_direction
from wayline.functions.names import short_schema
from wayline.operators import bars as bar
from wayline.operators import classify, clients, flow, graph, hierarchy, matrix, path_index, patterns, resolve, rules, shape
from wayline.operators.graph import STARTING_VIEW, View
from wayline.operators.prefix import prefix_scan
from wayline.plans import partials
from wayline.plans.history import snapshot_history
from wayline.plans.network import Network
from wayline.plans.refresh import AuditLogs, named_sessions, refresh_routes
from wayline.session import runtime_filter, scratch_path, settle
from wayline.sources import audit, derived, tables
from wayline.sources.derived import ALL_TIME, RECENT
from wayline.streaming import counts

Query = Callable[[SparkSession, str], DataFrame]

HISTORY = (dt.date(1995, 1, 1), derived.AS_OF)
LAYERED_VIEW = View(hide_warehouses=True, hide_schemas=True)


def snapshot(spark: SparkSession, sf_dir: str, ctx=ALL_TIME) -> DataFrame:
    return refresh_routes(derived.audit_logs(spark, sf_dir), derived.rule_table(spark), ctx)


def routes(spark: SparkSession, sf_dir: str, ctx=ALL_TIME) -> DataFrame:
    return shape.clean_routes(shape.loaded_routes(snapshot(spark, sf_dir, ctx)))


def direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.clean_routes(derived.direct_routes(spark, sf_dir))


def network(spark: SparkSession, sf_dir: str, **options) -> Network:
    return Network(routes(spark, sf_dir), "LOCAL_ACCOUNT", **options)


# --- refresh -----------------------------------------------------------------


def object_decompose(spark, sf_dir):
    logs = derived.audit_logs(spark, sf_dir)
    found = resolve.accesses(resolve.query_rows(logs.queries), logs.access)
    sessions = resolve.session_rows(logs.sessions).distinct()
    return resolve.with_names(found.join(sessions, "session_id")).select(
        "query_id", "database", "schema_name", "application"
    )


def noise_filter(spark, sf_dir):
    logs = derived.audit_logs(spark, sf_dir)
    kept = resolve.query_rows(logs.queries, RECENT.since, [F.col("query_type")])
    real = resolve.session_rows(logs.sessions).select("session_id").distinct()
    counted = resolve.session_counts(kept, logs.access).join(real, "session_id")
    return counted.groupBy("query_type").agg(F.sum("access_count").alias("n"))


def direction_counts(spark, sf_dir):
    queries = derived.audit_logs(spark, sf_dir).queries
    return queries.groupBy(
        "query_type", statement_direction(F.col("query_type")).alias("direction")
    ).agg(F.count("*").alias("n"))


def _pairs(spark, sf_dir):
    return classify.distinct_pairs(resolve.session_rows(derived.audit_logs(spark, sf_dir).sessions))


def rule_matches(spark, sf_dir):
    found = classify.match_rules(_pairs(spark, sf_dir), derived.rule_table(spark))
    return found.select("client_app_id", "application", "priority", "display_name")


def rules_indexed(spark, sf_dir):
    """Rules in large numbers, looked up by their letters."""
    values = derived.table(spark, sf_dir, "part").select(F.expr(derived.NAMED_PART).alias("value")).distinct()
    return patterns.indexed_matches(values, derived.many_rules(spark, sf_dir))


def client_resolution(spark, sf_dir):
    best = classify.best_rules(_pairs(spark, sf_dir), derived.rule_table(spark))
    return classify.resolve_clients(best).select(
        "client_app_id", "application", F.explode("clients").alias("client"))


def refresh_repeated_sessions(spark, sf_dir):
    """A session log with rows twice and with several pairs per session."""
    logs = derived.audit_logs(spark, sf_dir)
    log = derived.repeated_sessions(derived.table(spark, sf_dir, "customer"))
    return refresh_routes(AuditLogs(log, logs.queries, logs.access), derived.rule_table(spark), ALL_TIME)


def refresh_text_ids(spark, sf_dir):
    logs = derived.with_text_ids(derived.audit_logs(spark, sf_dir))
    return refresh_routes(logs, derived.rule_table(spark), RECENT)


def refresh_partitioned_logs(spark, sf_dir):
    """Both logs partitioned by day, older days filed under one; the refresh reads a few."""
    logs = derived.audit_logs(spark, sf_dir)
    oldest = F.lit(RECENT.since.date() - dt.timedelta(days=30))
    queries = logs.queries.withColumn("start_date", F.greatest(F.to_date("start_time"), oldest))
    days = queries.select("query_id", "start_date")
    root = scratch_path(spark, "logs")
    for name, log in (("queries", queries), ("access", logs.access.join(days, "query_id"))):
        log.repartition("start_date").write.partitionBy("start_date").parquet(f"{root}/{name}")
    logs.sessions.write.parquet(f"{root}/sessions")
    read = audit.read_audit_logs(spark, f"{root}/sessions", f"{root}/queries", f"{root}/access",
                                 "parquet", "start_date")
    return refresh_routes(read, derived.rule_table(spark), RECENT)


def refresh_filtered_scan(spark, sf_dir):
    """The refresh with a runtime filter on the access log, which has no date column."""
    logs, root = derived.audit_logs(spark, sf_dir), scratch_path(spark, "logs")
    logs.access.write.parquet(root)
    logs = AuditLogs(logs.sessions, logs.queries, spark.read.parquet(root))
    with runtime_filter(spark, least_scan="0"):
        return settle(refresh_routes(logs, derived.rule_table(spark), RECENT), "filtered")


def indexed_paths(spark, sf_dir):
    """Where an index of all paths was written."""
    folder = scratch_path(spark, "paths")
    path_index.write_index(network(spark, sf_dir).numbered, folder, STARTING_VIEW)
    return folder


def refresh_from_days(spark, sf_dir):
    """Two weekly refreshes from daily counts.

    The first is of the week before, when a fifth of the last two days' queries
    had not been logged yet; the second reads the days that are new or open.
    """
    logs, root = derived.audit_logs(spark, sf_dir), scratch_path(spark, "partials")
    store = partials.Partials("wayline_" + root.rsplit("-", 1)[1], root)
    week_ago = dataclasses.replace(RECENT, as_of=RECENT.as_of - dt.timedelta(days=7))
    late = (F.to_date("start_time") >= F.lit(week_ago.as_of - dt.timedelta(days=1))) & (
        F.pmod(F.xxhash64("query_id"), F.lit(5)) == 0)
    known = AuditLogs(logs.sessions, logs.queries.filter(~late), logs.access)
    rule_table = derived.rule_table(spark)
    partials.refresh_by_days(store, known, rule_table, week_ago).write.format("noop").mode("overwrite").save()
    found = partials.refresh_by_days(store, logs, rule_table, RECENT)
    return _read_and_dropped(spark, store, found)


def _new_table(spark, make):
    root = scratch_path(spark, "table")
    table = make("wayline_" + root.rsplit("-", 1)[1], root)
    tables.ensure_table(spark, table)
    return table


def _read_and_dropped(spark, table, rows):
    """What is read from a table, which then goes with its catalog entry."""
    found = settle(rows, "read")
    spark.sql(f"DROP TABLE {table.name}")
    return found


def snapshot_reload(spark, sf_dir):
    """Bootstrap a table, refresh it, read it back as a page would."""
    table = _new_table(spark, tables.routes_table)
    tables.run_refresh(table, derived.audit_logs(spark, sf_dir), derived.rule_table(spark), RECENT)
    return _read_and_dropped(spark, table, tables.load_routes(spark, table.name, direct(spark, sf_dir)))


def refresh_row_count(spark, sf_dir):
    """What the refresh job reports."""
    table = _new_table(spark, tables.routes_table)
    result = tables.run_refresh(
        table, derived.audit_logs(spark, sf_dir), derived.rule_table(spark), RECENT)
    spark.sql(f"DROP TABLE {table.name}")
    return spark.createDataFrame([(result.rows, result.message)], "rows long, message string")


def old_table_evolved(spark, sf_dir):
    """A snapshot table from before there were accounts, brought up to date and read."""
    root = scratch_path(spark, "old")
    table = tables.routes_table("wayline_" + root.rsplit("-", 1)[1], root)
    old = snapshot(spark, sf_dir, RECENT).drop("account_id")
    old.write.option("path", f"{root}/version-old").format("parquet").saveAsTable(table.name)
    tables.ensure_table(spark, table)
    found = tables.aligned(spark.table(table.name), table.columns)
    return _read_and_dropped(spark, table, found)


def rules_saved(spark, sf_dir):
    """Rules without faults, saved and loaded."""
    table = _new_table(spark, tables.rules_table)
    found = derived.part_rules(spark, sf_dir)
    faulty = rules.rule_violations(found).select(*found.columns).distinct()
    same = F.lit(True)
    for c in found.columns:
        same = same & found[c].eqNullSafe(faulty[c])
    tables.save_rules(table, found.join(faulty, same, "left_anti"))
    return _read_and_dropped(spark, table, tables.load_rules(spark, table.name))


def rules_ordered(spark, sf_dir):
    """Rules with their place in the order they are tried."""
    found = derived.part_rules(spark, sf_dir).withColumn("key", F.monotonically_increasing_id())
    order = [F.asc(c) for c in ("priority", "pattern", "source_field", "display_name", "key")]
    return prefix_scan(settle(found, "rules"), order, "place").drop("key")


# --- shape -------------------------------------------------------------------


def web_feature_relabel(spark, sf_dir):
    found = shape.relabelled(derived.direct_routes(spark, sf_dir).dropna("any"), "Web App (")
    return shape.sum_by(found, "CLIENT")


def filter_combined(spark, sf_dir):
    return shape.filter_routes(
        direct(spark, sf_dir), databases=["PROMO_DB", "SMALL_DB"], warehouses=["WH_1", "WH_2"],
        clients=["Worksheets", "Loom"], org_pattern="^ORG_(B|M)", directions=["read", "DDL"],
        more_than=2)


def filter_values_kept(spark, sf_dir):
    requested = derived.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").cast("long").alias("position"),
        F.concat(F.lit("WH_"), F.col("n_nationkey").cast("string")).alias("value"))
    return shape.existing_values(requested, routes(spark, sf_dir), "WAREHOUSE").select(
        "position", "value")


def filter_extension(spark, sf_dir):
    current = F.array(F.lit("SANDBOX_DB"), F.lit("RAW_ERP_DB"))
    found = shape.distinct_values(routes(spark, sf_dir), "DATABASE")
    available = F.array(F.col("value"), F.lit("RAW_ERP_DB"))
    return found.select(
        "value",
        F.concat_ws("|", shape.extended_values(current, F.col("value"))).alias("extended"),
        F.concat_ws("|", shape.kept_values(current, available)).alias("kept"),
    )


def group_by_ranked(spark, sf_dir):
    """Groups with their place, heaviest first."""
    found = settle(shape.group_by(routes(spark, sf_dir), ["CLIENT", "DATABASE"]), "groups")
    return prefix_scan(found, shape.by_weight("CLIENT", "DATABASE"), "place")


def treemap_order(spark, sf_dir):
    """Treemap nodes with their place in drawing order."""
    found = settle(hierarchy.treemap(routes(spark, sf_dir)).select("level", "id", "value"), "nodes")
    return prefix_scan(found, hierarchy.drawing_columns(), "place")


def short_schemas(spark, sf_dir):
    found = shape.sum_by(routes(spark, sf_dir), "SCHEMA_NAME")
    return found.select("SCHEMA_NAME", short_schema(F.col("SCHEMA_NAME")).alias("short"),
                        "ACCESS_COUNT")


# --- graph -------------------------------------------------------------------


def node_top3(spark, sf_dir):
    top = graph.top_links(graph.node_links(graph.edge_rollup(routes(spark, sf_dir))))
    return top.select("node", "neighbour", "cnt", F.col("rk").cast("long").alias("rk"))


def edges_all_views(spark, sf_dir):
    """The edges of every view that can be chosen."""
    rollup = settle(graph.edge_rollup(routes(spark, sf_dir)), "rollup")
    found = [graph.edges(rollup, view).select(F.lit("-".join(view.visible)).alias("view"), "*")
             for view in graph.legal_views()]
    return reduce(DataFrame.unionByName, found)


def layer_members(spark, sf_dir):
    return network(spark, sf_dir, view=LAYERED_VIEW).members


def layer_nodes(spark, sf_dir):
    return graph.layer_nodes(network(spark, sf_dir, view=LAYERED_VIEW).members)


# --- rules, clients ----------------------------------------------------------


def client_attributes(spark, sf_dir):
    names = routes(spark, sf_dir).select(F.col("CLIENT").alias("client"))
    listed = derived.listed_clients(spark, sf_dir)
    return clients.client_attributes(names, listed, "Web")


def client_attributes_features(spark, sf_dir):
    """Clients of labelled routes: features take the icon of their family."""
    labelled = derived.direct_routes(spark, sf_dir)
    names = direct(spark, sf_dir).select(F.col("CLIENT").alias("client"))
    return clients.client_attributes(names, derived.listed_clients(spark, sf_dir), "Web",
                                     clients.feature_names(labelled, "Web App ("))


def seed_rules_upsert(spark, sf_dir):
    found = derived.part_rules(spark, sf_dir)
    present = found.filter((F.col("priority") >= 0) & (F.col("source_field") == "application"))
    return rules.upserted_rules(found, present)


# --- history, stream ---------------------------------------------------------


def weekly_history(spark, sf_dir):
    return snapshot_history(derived.audit_logs(spark, sf_dir), derived.rule_table(spark),
                            RECENT, *HISTORY)


def _arrivals(start, parts: int, every: int, key):
    """Number of the batch a record arrives in: by its time, one in ``every`` in the batch after.

    Every other batch's stragglers are later than the bound, with those of the last
    batch in time.
    """
    year = F.year(start)
    turn = F.least(F.lit(parts - 2), F.floor((year - 1992) * (parts - 1) / 10)).cast("int")
    return turn + F.when(F.pmod(F.xxhash64(key), F.lit(every)) == 0, 1).otherwise(0)


def stream_route_counts(spark, sf_dir):
    """Accesses streamed in small batches; one in seven comes a batch, and years, late."""
    source, folder, parts = scratch_path(spark, "accesses"), scratch_path(spark, "stream"), 4
    counts.use_rocksdb(spark)
    found = counts.resolved_accesses(
        derived.audit_logs(spark, sf_dir), derived.rule_table(spark), ALL_TIME)
    found = settle(found.withColumn("part", _arrivals("start_time", parts, 7, "query_id")), "resolved")
    for part in range(parts):
        new = found.filter(F.col("part") == part).drop("part")
        new.write.mode("append").parquet(source)
        counts.run_daily_counts(counts.file_stream(spark, source, new), folder)
    return counts.latest_counts(spark, folder)


def stream_query_log(spark, sf_dir):
    """Both logs as streams; access records come before and after their queries, some of
    either long after."""
    logs, parts = derived.audit_logs(spark, sf_dir), 3
    root, folder = scratch_path(spark, "logs"), scratch_path(spark, "stream")
    counts.use_rocksdb(spark)
    named = settle(named_sessions(logs.sessions, derived.rule_table(spark)), "named")
    times = logs.queries.select("query_id", F.col("start_time").alias("query_start_time"))
    found = {
        "queries": logs.queries.withColumn("part", _arrivals("start_time", parts, 5, "query_id")),
        "access": logs.access.join(times, "query_id").withColumn(
            "part", _arrivals("query_start_time", parts, 3, "query_id")),
    }
    for name, log in found.items():
        log.write.partitionBy("part").parquet(f"{root}/parted-{name}")
    for part in range(parts):
        streams = []
        for name, log in found.items():
            parted = spark.read.schema(log.schema).parquet(f"{root}/parted-{name}")
            new = parted.filter(F.col("part") == part).drop("part")
            new.write.mode("append").parquet(f"{root}/{name}")
            streams.append(counts.file_stream(spark, f"{root}/{name}", new))
        counts.run_query_log(*streams, named, folder)
    return counts.latest_counts(spark, folder)


def queries() -> dict[str, Query]:
    """All queries; each takes the session and the folder of the test tables."""
    found: dict[str, Query] = {
        "object_decompose": object_decompose,
        "noise_filter": noise_filter,
        "direction_counts": direction_counts,
        "rule_matches": rule_matches,
        "rules_indexed": rules_indexed,
        "rules_shadowed": lambda s, d: patterns.shadowed_rules(derived.many_rules(s, d)),
        "client_resolution": client_resolution,
        "refresh_routes": lambda s, d: snapshot(s, d, RECENT),
        "refresh_routes_all": snapshot,
        "refresh_repeated_sessions": refresh_repeated_sessions,
        "refresh_text_ids": refresh_text_ids,
        "refresh_partitioned_logs": refresh_partitioned_logs,
        "refresh_from_days": refresh_from_days,
        "refresh_filtered_scan": refresh_filtered_scan,
        "refresh_row_count": refresh_row_count,
        "snapshot_reload": snapshot_reload,
        "old_table_evolved": old_table_evolved,
        "rules_saved": rules_saved,
        "rules_ordered": rules_ordered,
        "clean_routes": routes,
        "clean_direct_routes": direct,
        "web_feature_relabel": web_feature_relabel,
        "filter_dims": lambda s, d: shape.filter_routes(
            routes(s, d), clients=["Loom", "Pi", "Quillboard"], warehouses=["WH_1", "WH_3"],
            schemas=["SANDBOX_DB.S1", "RAW_ERP_DB.S2"], more_than=0),
        "filter_threshold": lambda s, d: shape.filter_routes(routes(s, d)),
        "filter_org_regex": lambda s, d: shape.filter_routes(
            direct(s, d), org_pattern="(BUILD|MACH)", more_than=0),
        "filter_combined": filter_combined,
        "filter_values_kept": filter_values_kept,
        "filter_extension": filter_extension,
        "top_routes": lambda s, d: shape.top_routes(routes(s, d)),
        "short_schemas": short_schemas,
        "group_by_client_direction": lambda s, d: shape.group_by(
            routes(s, d), ["CLIENT", "DIRECTION"]),
        "group_by_ranked": group_by_ranked,
        "group_by_cube": lambda s, d: shape.group_by_cube(routes(s, d)),
        "grand_total": lambda s, d: shape.grand_total(routes(s, d)),
        "table_view": lambda s, d: shape.table_view(routes(s, d), ["CLIENT", "WAREHOUSE"]),
        "edge_rollup": lambda s, d: graph.edge_rollup(direct(s, d)),
        "node_stats": lambda s, d: graph.node_stats(graph.edge_rollup(routes(s, d))).drop("first"),
        "node_links": lambda s, d: graph.node_links(graph.edge_rollup(routes(s, d))),
        "node_top3": node_top3,
        "node_sizes": lambda s, d: network(s, d).nodes.select("id", "type", "size"),
        "node_types": lambda s, d: network(s, d).node_types,
        "network_nodes": lambda s, d: network(s, d, view=STARTING_VIEW).nodes,
        "network_nodes_direct": lambda s, d: Network(
            direct(s, d), "LOCAL_ACCOUNT", view=View(hide_databases=True)).nodes,
        "node_text": lambda s, d: network(s, d).node_texts.select("id", "text"),
        "edges_directed": lambda s, d: graph.edges(graph.edge_rollup(routes(s, d))),
        "edges_combined": lambda s, d: graph.edges(graph.edge_rollup(routes(s, d)), combine=True),
        "edges_hidden_wh": lambda s, d: graph.with_edge_text(
            graph.edges(graph.edge_rollup(routes(s, d)), STARTING_VIEW, True)),
        "edges_all_views": edges_all_views,
        "edge_texts": lambda s, d: graph.with_edge_text(
            graph.edges(graph.edge_rollup(routes(s, d)))).select("src", "dst", "mode", "text"),
        "edge_paths": lambda s, d: network(s, d, view=STARTING_VIEW).edge_paths,
        "path_vectors": lambda s, d: network(s, d, view=STARTING_VIEW).paths,
        "layer_members": layer_members,
        "layer_nodes": layer_nodes,
        "layer_contraction": lambda s, d: network(s, d, view=LAYERED_VIEW,
                                                  combine=True).contracted_edges,
        "path_neighbourhood": lambda s, d: graph.path_neighbours(
            graph.edge_rollup(routes(s, d)), STARTING_VIEW),
        "path_edges": lambda s, d: graph.path_edges(
            graph.edge_rollup(routes(s, d)), STARTING_VIEW),
        "path_index_neighbourhood": lambda s, d: path_index.neighbours(s, indexed_paths(s, d)),
        "path_index_edges": lambda s, d: path_index.edges(s, indexed_paths(s, d)),
        "group_by_lattice": lambda s, d: shape.cube_by_lattice(routes(s, d)),
        "bars_dense": lambda s, d: bar.dense_bars(routes(s, d), "SCHEMA_NAME"),
        "chart_table": lambda s, d: bar.chart_table(
            bar.bars(routes(s, d), "SCHEMA_NAME"), "SCHEMA_NAME"),
        "sankey_three_columns": lambda s, d: flow.sankey(
            routes(s, d).drop("SCHEMA_NAME"), "read").nodes,
        "treemap": lambda s, d: hierarchy.treemap(routes(s, d)),
        "treemap_order": treemap_order,
        "heatmap_pivot": lambda s, d: matrix.pivoted(
            matrix.heatmap(routes(s, d), "CLIENT", "DIRECTION")),
        "treemap_three_levels": lambda s, d: hierarchy.treemap(routes(s, d).drop("SCHEMA_NAME")),
        "client_attributes": client_attributes,
        "client_attributes_features": client_attributes_features,
        "rule_violations": lambda s, d: rules.rule_violations(derived.part_rules(s, d)),
        "seed_rules_upsert": seed_rules_upsert,
        "snapshot_history": weekly_history,
        "stream_route_counts": stream_route_counts,
        "stream_query_log": stream_query_log,
    }
    for name, column in (("client", "CLIENT"), ("database", "DATABASE"),
                         ("schema", "SCHEMA_NAME"), ("warehouse", "WAREHOUSE"),
                         ("direction", "DIRECTION")):
        found[f"distinct_{name}s"] = (
            lambda s, d, c=column: shape.distinct_values(routes(s, d), c))
        if name != "direction":
            found[f"bars_{name}"] = lambda s, d, c=column: bar.bars(routes(s, d), c)
        if name in ("database", "schema", "warehouse"):
            found[f"heatmap_{name}_client"] = (
                lambda s, d, c=column: matrix.heatmap(routes(s, d), c, "CLIENT"))
    for way in ("read", "write"):
        found[f"sankey_nodes_{way}"] = lambda s, d, w=way: flow.sankey(routes(s, d), w).nodes
        found[f"sankey_links_{way}"] = lambda s, d, w=way: flow.sankey(routes(s, d), w).links
    return found
