"""Audit logs, routes and rules derived from the TPC-H-like test tables.

Customers stand for sessions, orders for queries and line items, with their
parts, for accessed objects.  The expressions are plain SQL that Spark and
DuckDB read alike, so a check can use the same text on both sides.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.context import JobContext
from wayline.operators.rules import numbered_rules
from wayline.plans.refresh import AuditLogs

AS_OF = dt.date(2001, 8, 1)
RECENT = JobContext("LOCAL_ORG", "LOCAL_ACCOUNT", AS_OF, 30)
ALL_TIME = JobContext("LOCAL_ORG", "LOCAL_ACCOUNT", AS_OF, 3650)

CLIENT_ID = """
CASE WHEN c_custkey % 53 = 0 THEN NULL ELSE CASE c_custkey % 10
  WHEN 0 THEN 'NimbusShell 1.20' WHEN 1 THEN 'Shuttle J 3.14.4' WHEN 2 THEN 'Wicker 1.9.0'
  WHEN 3 THEN 'Pi 1.7.1' WHEN 4 THEN 'Shuttle O 3.1.0' WHEN 5 THEN 'nimbus-link 3.6.0'
  WHEN 6 THEN 'Lantern UI 2.1' WHEN 7 THEN 'Shuttle J 3.13.30' WHEN 8 THEN 'SYSTEM_TASK 1.0'
  ELSE 'Thimble 2.1.0' END END
"""
ENVIRONMENT = """
CASE c_custkey % 7
  WHEN 0 THEN '{"APPLICATION":"Quillboard Desktop"}' WHEN 1 THEN '{"OS":"Linux"}'
  WHEN 2 THEN '{"APPLICATION":"night_loom_1.7"}' WHEN 3 THEN '{"APPLICATION":"nimbus-link"}'
  WHEN 4 THEN '{"APPLICATION":"BrassySheet"}' WHEN 5 THEN '{"APPLICATION":"acme_tool"}'
  ELSE '{"APPLICATION":"Pi"}' END
"""
#: Rules for the names above: one key twice, one rule in the shadow of a broader
#: one, an exact pattern, both wildcards inside a pattern, and both fields.
RULES: list[tuple[str, str, str]] = [
    ("%nimbus%", "client_app_id", "Nimbus"),
    ("%nimbus%", "application", "Nimbus"),
    ("%brass%sheet%", "application", "Brass Sheet"),
    ("%quillboard%", "application", "Quillboard"),
    ("%quillboard desk%", "application", "Quillboard Desktop"),
    ("night_loom%", "application", "Loom"),
    ("%quillboard%", "application", "Quillboard"),
    ("Pi", "application", "Pi"),
    ("%lantern%", "client_app_id", "Lantern"),
    ("%shuttle%j%", "client_app_id", "Shuttle for J"),
    ("wicker%", "client_app_id", "Wicker"),
]
WAREHOUSE = "'WH_' || substr(o_orderpriority, 1, 1)"
QUERY_WAREHOUSE = f"CASE WHEN o_orderkey % 37 = 0 THEN NULL ELSE {WAREHOUSE} END"
QUERY_TYPE = """
CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CASE o_orderkey % 16
  WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'SELECT'
  WHEN 3 THEN 'CREATE_TABLE_AS_SELECT' WHEN 4 THEN 'UNLOAD' WHEN 5 THEN 'MERGE'
  WHEN 6 THEN 'SHOW' WHEN 7 THEN 'CALL' WHEN 8 THEN 'SELECT' WHEN 9 THEN 'COMMIT'
  WHEN 10 THEN 'DESCRIBE' WHEN 11 THEN 'GRANT' WHEN 12 THEN 'COPY' WHEN 13 THEN 'ALTER'
  WHEN 14 THEN 'LIST_FILES' ELSE 'REMOVE_FILES' END END
"""
DATABASE = """
CASE p_type
  WHEN 'STANDARD' THEN 'RAW_ERP_DB' WHEN 'PROMO' THEN 'RAW_CRM_DB'
  WHEN 'SMALL' THEN 'CLEANED_ERP_DB' WHEN 'LARGE' THEN 'INTEGRATED_DB'
  WHEN 'ECONOMY' THEN 'FINANCE_MART_DB' ELSE 'SANDBOX_DB' END
"""
OBJECT = f"""
CASE WHEN l_partkey % 41 = 0 THEN 'USER$TMP.X.T'
  WHEN l_partkey % 43 = 0 THEN 'BENCH!GET_LOGS'
  WHEN l_partkey % 13 = 0 THEN {DATABASE}
  ELSE {DATABASE} || '.S' || CAST(p_size % 4 AS STRING) || '.T' || CAST(l_partkey AS STRING) END
"""
NEXT_OBJECT = f"{DATABASE} || '.S' || CAST((p_size + 1) % 4 AS STRING) || '.T0'"


def objects(array: str) -> str:
    """Names in an access record: none, one or several, some repeated, some NULL.

    ``array`` is the name of the function that makes an array.
    """
    return f"""
CASE WHEN l_partkey % 29 = 0 THEN NULL WHEN l_partkey % 31 = 0 THEN {array}()
  WHEN l_linenumber % 4 = 0 THEN {array}({NEXT_OBJECT}, CAST(NULL AS STRING), {OBJECT})
  WHEN l_linenumber % 4 = 1 THEN {array}({OBJECT})
  WHEN l_linenumber % 4 = 2 THEN {array}({OBJECT}, {NEXT_OBJECT})
  ELSE {array}({OBJECT}, {OBJECT}, {NEXT_OBJECT}) END
"""


#: Routes counted straight from the tables, with labels to clean up.
DIRECT = {
    "ORGANIZATION_NAME": "'ORG_' || c_mktsegment",
    "ACCOUNT_NAME": "'LOCAL_ACCOUNT'",
    "DATABASE": "p_type || '_DB'",
    "SCHEMA_NAME": "p_type || '_DB.S' || CAST(p_size % 4 AS STRING)",
    "WAREHOUSE": WAREHOUSE,
    "CLIENT": """
CASE o_custkey % 6 WHEN 0 THEN 'Web App (Worksheets)' WHEN 1 THEN 'Web App ('
  WHEN 2 THEN 'Quillboard' WHEN 3 THEN 'Worksheets' WHEN 4 THEN 'Loom' ELSE NULL END
""",
    "DIRECTION": "CASE l_returnflag WHEN 'A' THEN 'read' WHEN 'N' THEN 'write' ELSE 'DDL' END",
}

#: Rules derived from parts, one in seven of them faulty.
PART_RULE = {
    "priority": "CASE WHEN p_partkey % 7 = 0 THEN -p_partkey - 1 ELSE p_partkey % 900 END",
    "pattern": """
CASE WHEN p_partkey % 7 = 1 THEN '' WHEN p_partkey % 7 = 2 THEN NULL
  WHEN p_partkey % 7 = 3 THEN p_name || '%' || chr(92) ELSE '%' || p_name || '%' END
""",
    "source_field": """
CASE p_partkey % 5 WHEN 0 THEN 'client_app_id' WHEN 1 THEN 'warehouse' ELSE 'application' END
""",
    "display_name": "CASE WHEN p_partkey % 11 = 0 THEN '' ELSE p_brand END",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sessions(customer: DataFrame) -> DataFrame:
    return customer.select(
        F.col("c_custkey").alias("session_id"),
        F.expr(CLIENT_ID).alias("client_application_id"),
        F.expr(ENVIRONMENT).alias("client_environment"),
    )


def queries(orders: DataFrame) -> DataFrame:
    return orders.select(
        F.col("o_orderkey").alias("query_id"), F.col("o_custkey").alias("session_id"),
        F.expr(QUERY_WAREHOUSE).alias("warehouse_name"), F.expr(QUERY_TYPE).alias("query_type"),
        F.col("o_orderdate").alias("start_time"),
    )


def access(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """One access record per line item; a query has as many as it has lines.

    Gathering a query's objects into one array would put an unbounded group
    into one row if an order had very many lines.
    """
    lines = lineitem.select("l_orderkey", "l_partkey", "l_linenumber")
    named = lines.join(part, F.col("l_partkey") == F.col("p_partkey"))
    return named.select(
        F.col("l_orderkey").alias("query_id"),
        F.transform(F.expr(objects("array")), lambda name: F.struct(name.alias("objectName")))
        .alias("direct_objects_accessed"),
    )


def audit_logs(spark: SparkSession, sf_dir: str) -> AuditLogs:
    return AuditLogs(
        sessions(table(spark, sf_dir, "customer")),
        queries(table(spark, sf_dir, "orders")),
        access(table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part")),
    )


def repeated_sessions(customer: DataFrame) -> DataFrame:
    """A session log from exports that overlap: rows twice, and sessions with a second
    pair, of the same name or of another."""
    once = sessions(customer)
    key = F.col("session_id")
    second = once.filter(key % 3 == 0).withColumn("client_environment", F.when(
        key % 2 == 0, F.lit('{"APPLICATION":"Quillboard Server"}')).otherwise(
        F.lit('{"APPLICATION":"acme_tool"}')))
    return once.union(once.filter(key % 2 == 0)).union(second)


def with_text_ids(logs: AuditLogs) -> AuditLogs:
    """The same logs with ids as a warehouse writes them, as text."""
    def text(df, *names):
        return df.select(*[F.concat(F.lit(f"{c}-"), c).alias(c) if c in names else c for c in df.columns])

    return AuditLogs(text(logs.sessions, "session_id"), text(logs.queries, "session_id", "query_id"),
                     text(logs.access, "query_id"))


def rule_table(spark: SparkSession) -> DataFrame:
    return numbered_rules(spark, RULES)


def direct_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Route frame with NULL clients and feature labels, as a loaded snapshot has."""
    rows = (
        table(spark, sf_dir, "lineitem")
        .join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
        .select(*[F.expr(text).alias(name) for name, text in DIRECT.items()])
    )
    return rows.groupBy(*DIRECT).agg(F.count("*").alias("ACCESS_COUNT"))


def part_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule table that grows with ``part`` and needs checking."""
    return table(spark, sf_dir, "part").select(
        *[F.expr(text).alias(name) for name, text in PART_RULE.items()]
    )


#: Rules in numbers that grow with parts: broad and narrow ones, with both wildcards and
#: without, some of wildcards only.  ``lead`` and ``trail`` are what stands around the body.
MANY_RULES = {
    "priority": "p_partkey % 900",
    "lead": "CASE WHEN p_partkey % 5 < 2 THEN '' ELSE '%' END",
    "body": """
CASE WHEN p_partkey % 211 = 0 THEN '' WHEN p_partkey % 211 = 1 THEN '_' ELSE CASE p_partkey % 11
  WHEN 0 THEN substr(p_name, 1, 4) WHEN 1 THEN substr(p_name, 1, 2) || '_' || substr(p_name, 4)
  WHEN 2 THEN '_' || substr(p_name, 2, 3) WHEN 3 THEN upper(p_name) WHEN 4 THEN p_brand
  ELSE p_name || ' ' || p_brand END END
""",
    "trail": "CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '%' END",
    "source_field": "CASE p_partkey % 2 WHEN 0 THEN 'client_app_id' ELSE 'application' END",
    "display_name": "p_brand",
}
#: Values for them.
NAMED_PART = "p_name || ' ' || p_brand"


def many_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "part").select(
        *[F.expr(text).alias(name) for name, text in MANY_RULES.items()])
    return found.select(F.col("priority").cast("long"), F.concat("lead", "body", "trail").alias("pattern"),
                        "source_field", "display_name")


#: Listed client attributes derived from parts: a few real names among many others.
LISTED = {
    "client": """
CASE p_partkey WHEN 1 THEN 'Loom' WHEN 2 THEN 'Pi' WHEN 3 THEN 'Web' WHEN 4 THEN 'Quillboard'
  ELSE p_name || ' ' || CAST(p_partkey AS STRING) END
""",
    "abbreviation": "CASE p_partkey WHEN 4 THEN NULL ELSE 'P' || CAST(p_partkey % 10 AS STRING) END",
    "icon": "'icon-' || CAST(p_partkey AS STRING)",
}


def listed_clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lookup table of clients that grows with ``part``; names are unique."""
    return table(spark, sf_dir, "part").select(
        *[F.expr(text).alias(name) for name, text in LISTED.items()]
    )
