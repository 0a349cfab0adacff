"""The same queries as plain SQL, for checking results in another engine.

Written from the definitions, row by row where the Spark side counts early or
avoids a global order, so that the two sides can disagree.
"""

from __future__ import annotations

from itertools import combinations

from wayline.functions.badges import BADGE_SVG, URI_PREFIX
from wayline.functions.text import NODE_SUMMARY
from wayline.sources import derived as d

DIMS = ["DATABASE", "SCHEMA_NAME", "WAREHOUSE", "CLIENT", "DIRECTION"]
FIVE = '"CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME", "DIRECTION"'
WRITE = "\"DIRECTION\" IN ('write', 'DML', 'DDL')"


def _values(rows) -> str:
    def text(v):
        return str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join("(" + ", ".join(text(v) for v in row) + ")" for row in rows)


RULES = """rules AS (SELECT CAST(priority AS BIGINT) AS priority, pattern, source_field, display_name
  FROM (VALUES """ + _values([(i, *rule) for i, rule in enumerate(d.RULES)]) + """)
    v(priority, pattern, source_field, display_name))"""

# What each statement type does (see ``functions.direction``).
DIRECTION_CASE = """
CASE WHEN query_type LIKE 'CREATE%' OR query_type LIKE 'ALTER%' OR query_type LIKE 'DROP%'
       OR query_type LIKE 'TRUNCATE%' OR query_type LIKE 'RENAME%' OR query_type LIKE 'UNDROP%'
       OR query_type IN ('COMMENT', 'GRANT', 'REVOKE', 'RESTORE') THEN 'DDL'
     WHEN query_type LIKE 'SHOW%' OR query_type LIKE 'DESCRIBE%'
       OR query_type IN ('DESC', 'LIST_FILES', 'EXPLAIN') THEN 'metadata'
     WHEN query_type IN ('SELECT', 'UNLOAD', 'GET_FILES') THEN 'read' ELSE 'write' END
"""


SESSIONS = f"""
sessions AS (
  SELECT c_custkey AS session_id, {d.CLIENT_ID} AS client_app_id,
    json_extract_string({d.ENVIRONMENT}, '$.APPLICATION') AS application FROM customer)"""

#: Sessions twice, and a third of them with a second pair.
REPEATED = SESSIONS.replace("sessions AS", "once AS") + """,
sessions AS (
  SELECT * FROM once UNION ALL SELECT * FROM once WHERE session_id % 2 = 0
  UNION ALL SELECT session_id, client_app_id,
    CASE WHEN session_id % 2 = 0 THEN 'Quillboard Server' ELSE 'acme_tool' END
  FROM once WHERE session_id % 3 = 0)"""


def raw(since: str | None = None, sessions: str = SESSIONS) -> str:
    """Accessed objects after the noise filters, one row each."""
    when = f"AND start_time > TIMESTAMP '{since}'" if since else ""
    # Fixed values below: what the noise filters leave out (see ``operators.resolve``).
    return f"""{sessions},
history AS (
  SELECT o_orderkey AS query_id, o_custkey AS session_id, {d.QUERY_WAREHOUSE} AS warehouse,
    {d.QUERY_TYPE} AS query_type, o_orderdate AS start_time FROM orders),
objects AS (
  SELECT l_orderkey AS query_id, unnest({d.objects("list_value")}) AS name
  FROM lineitem JOIN part ON l_partkey = p_partkey),
raw AS MATERIALIZED (
  SELECT client_app_id, application, warehouse, query_type, history.query_id, start_time,
    split_part(name, '.', 1) AS database,
    CASE WHEN split_part(name, '.', 2) <> ''
      THEN split_part(name, '.', 1) || '.' || split_part(name, '.', 2) END AS schema_name
  FROM sessions JOIN history USING (session_id) JOIN objects ON objects.query_id = history.query_id
  WHERE query_type <> 'CALL'
    AND query_type NOT IN ('BEGIN_TRANSACTION', 'COMMIT', 'ROLLBACK', 'SET', 'UNSET', 'USE')
    AND client_app_id NOT LIKE 'SYSTEM%' AND split_part(name, '.', 1) NOT LIKE 'USER$%'
    AND name NOT LIKE '%!%' {when})"""


NAMED = f"""
{RULES},
pairs AS MATERIALIZED (SELECT DISTINCT client_app_id, application FROM sessions
  WHERE client_app_id NOT LIKE 'SYSTEM%'),
matched AS (
  SELECT p.*, a.priority AS p1, a.display_name AS d1, b.priority AS p2, b.display_name AS d2
  FROM pairs p
  LEFT JOIN rules a ON a.source_field = 'client_app_id' AND p.client_app_id ILIKE a.pattern
  LEFT JOIN rules b ON b.source_field = 'application' AND p.application ILIKE b.pattern),
chosen AS (
  SELECT *, CASE WHEN coalesce(p1, 999) <= coalesce(p2, 999) THEN d1 ELSE d2 END AS display_name
  FROM matched),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY client_app_id, application
    ORDER BY least(coalesce(p1, 999), coalesce(p2, 999)), display_name) AS rn FROM chosen),
named AS MATERIALIZED (
  SELECT client_app_id, application, coalesce(display_name, application, client_app_id) AS client
  FROM ranked WHERE rn = 1 OR display_name IS NULL)"""

RESOLVED = f"""
resolved AS (
  SELECT client, warehouse, database, schema_name, {DIRECTION_CASE} AS direction, query_id,
    start_time, query_type
  FROM raw JOIN named ON raw.client_app_id = named.client_app_id
    AND raw.application IS NOT DISTINCT FROM named.application)"""

SNAPSHOT = """
snapshot AS MATERIALIZED (
  SELECT 'LOCAL_ORG' AS organization_name, 'LOCAL_ACCOUNT' AS account_id, client, warehouse,
    database, schema_name, direction, count(DISTINCT query_id) AS access_count
  FROM resolved GROUP BY client, warehouse, database, schema_name, direction)"""

CLEAN = """
clean AS MATERIALIZED (
  SELECT database AS "DATABASE", schema_name AS "SCHEMA_NAME", warehouse AS "WAREHOUSE",
    client AS "CLIENT", direction AS "DIRECTION", organization_name AS "ORGANIZATION_NAME",
    account_id AS "ACCOUNT_NAME", CAST(sum(access_count) AS BIGINT) AS "ACCESS_COUNT"
  FROM snapshot
  WHERE database IS NOT NULL AND schema_name IS NOT NULL AND warehouse IS NOT NULL
    AND client IS NOT NULL AND direction IS NOT NULL
  GROUP BY ALL)"""

RECENT_SINCE, ALL_SINCE = (c.since.isoformat(sep=" ") for c in (d.RECENT, d.ALL_TIME))

LABELLED = f"""
labelled AS (
  SELECT {", ".join(f'{text} AS "{name}"' for name, text in d.DIRECT.items())}
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN part ON l_partkey = p_partkey),
relabelled AS MATERIALIZED (
  SELECT * REPLACE (CASE WHEN "CLIENT" LIKE 'Web App (%'
      THEN nullif(regexp_extract("CLIENT", '\\(([^)]+)\\)', 1), '') ELSE "CLIENT" END AS "CLIENT")
  FROM labelled WHERE "CLIENT" IS NOT NULL),
clean AS MATERIALIZED (
  SELECT "DATABASE", "SCHEMA_NAME", "WAREHOUSE", "CLIENT", "DIRECTION", "ORGANIZATION_NAME",
    "ACCOUNT_NAME", count(*) AS "ACCESS_COUNT"
  FROM relabelled WHERE "CLIENT" IS NOT NULL GROUP BY ALL)"""


def on_snapshot(body: str, since: str = ALL_SINCE, *more: str) -> str:
    return "WITH " + ",".join([raw(since), NAMED, RESOLVED, SNAPSHOT, *more]) + body


def on_routes(body: str, *more: str) -> str:
    return on_snapshot(body, ALL_SINCE, CLEAN, *more)


def on_direct(body: str, *more: str) -> str:
    return "WITH " + ",".join([LABELLED, *more]) + body


def _sum(alias: str = '"ACCESS_COUNT"', what: str = '"ACCESS_COUNT"') -> str:
    return f"CAST(sum({what}) AS BIGINT) AS {alias}"


# --- graph -------------------------------------------------------------------

ROLLUP = f"""
rollup_routes AS MATERIALIZED (
  SELECT {FIVE}, {_sum()},
    arg_min("ORGANIZATION_NAME", (-"ACCESS_COUNT", "ORGANIZATION_NAME", "ACCOUNT_NAME"))
      AS "ORGANIZATION_NAME",
    arg_min("ACCOUNT_NAME", (-"ACCESS_COUNT", "ORGANIZATION_NAME", "ACCOUNT_NAME"))
      AS "ACCOUNT_NAME"
  FROM clean GROUP BY {FIVE}),
path AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY "ACCESS_COUNT" DESC, {FIVE}) - 1 AS path_idx, {WRITE} AS w
  FROM rollup_routes)"""

STATS = """
seen AS (
  SELECT path_idx, 0 AS ord, 'database' AS type, "DATABASE" AS node, "ACCESS_COUNT" AS ac, w,
    "ORGANIZATION_NAME" AS org FROM path
  UNION ALL SELECT path_idx, 1, 'schema', "SCHEMA_NAME", "ACCESS_COUNT", w, "ORGANIZATION_NAME"
    FROM path
  UNION ALL SELECT path_idx, 2, 'warehouse', "WAREHOUSE", "ACCESS_COUNT", w, "ORGANIZATION_NAME"
    FROM path
  UNION ALL SELECT path_idx, 3, 'client', "CLIENT", "ACCESS_COUNT", w, "ORGANIZATION_NAME"
    FROM path),
stats AS MATERIALIZED (
  SELECT node, CAST(sum(ac) AS BIGINT) AS total,
    CAST(sum(CASE WHEN w THEN 0 ELSE ac END) AS BIGINT) AS read,
    CAST(sum(CASE WHEN w THEN ac ELSE 0 END) AS BIGINT) AS write
  FROM seen GROUP BY node)"""

LINKS = """
links AS MATERIALIZED (
  SELECT node, neighbour, CAST(sum(ac) AS BIGINT) AS cnt FROM (
    SELECT "DATABASE" AS node, "CLIENT" AS neighbour, "ACCESS_COUNT" AS ac FROM path
    UNION ALL SELECT "CLIENT", "DATABASE", "ACCESS_COUNT" FROM path
    UNION ALL SELECT "WAREHOUSE", "CLIENT", "ACCESS_COUNT" FROM path
    UNION ALL SELECT "WAREHOUSE", "DATABASE", "ACCESS_COUNT" FROM path
    UNION ALL SELECT "SCHEMA_NAME", "DATABASE", "ACCESS_COUNT" FROM path
    UNION ALL SELECT "DATABASE", "SCHEMA_NAME", "ACCESS_COUNT" FROM path
    UNION ALL SELECT "SCHEMA_NAME", "CLIENT", "ACCESS_COUNT" FROM path)
  GROUP BY node, neighbour),
top3 AS MATERIALIZED (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY cnt DESC, neighbour) AS rk
    FROM links) WHERE rk <= 3)"""


def nodes(hidden: tuple[str, ...] = ()) -> str:
    """Visible nodes, each as it is first met when paths are gone through in order."""
    shown = ", ".join(f"'{t}'" for t in ("database", "schema", "warehouse", "client")
                      if t not in hidden)
    label = "node" if "database" in hidden else \
        "CASE WHEN type = 'schema' THEN list_last(string_split(node, '.')) ELSE node END"
    return f"""
bounds AS (SELECT min(total) AS lo, max(total) AS hi FROM stats),
first_seen AS (
  SELECT node, type, org FROM (
    SELECT *, row_number() OVER (PARTITION BY node ORDER BY path_idx, ord) AS rn
    FROM seen WHERE type IN ({shown})) WHERE rn = 1),
nodes AS MATERIALIZED (
  SELECT node AS id, type, {label} AS label,
    CAST(floor(round(CASE WHEN hi <= lo OR total <= 0
        THEN CASE WHEN type = 'schema' THEN 60 ELSE 80 END
        ELSE CASE WHEN type = 'schema' THEN 60 ELSE 80 END
          + (ln(1 + total) - ln(1 + lo)) / (ln(1 + hi) - ln(1 + lo))
          * CASE WHEN type = 'schema' THEN 100 ELSE 120 END END, 9)) AS INTEGER) AS size,
    CASE WHEN type <> 'database' THEN '' WHEN node LIKE 'RAW\\_%' ESCAPE '\\' THEN 'Raw Layer'
      WHEN node LIKE 'CLEANED\\_%' ESCAPE '\\' OR node = 'INTEGRATED_DB' THEN 'Clean Layer'
      WHEN node LIKE '%\\_MART\\_DB' ESCAPE '\\' THEN 'Gold Layer' ELSE '' END AS layer,
    org, total, read, write
  FROM first_seen JOIN stats USING (node), bounds)"""


def edges(columns: list[str], combine: bool) -> str:
    """Edges between neighbouring columns, one row per path and link first."""
    links = " UNION ALL ".join(
        f'SELECT path_idx, "ACCESS_COUNT" AS ac, w, CASE WHEN w THEN "{a}" ELSE "{b}" END AS f, '
        f'CASE WHEN w THEN "{b}" ELSE "{a}" END AS t FROM path'
        for a, b in zip(columns, columns[1:]))
    key = ("least(f, t) AS src, greatest(f, t) AS dst, 'ALL' AS mode" if combine else
           "f AS src, t AS dst, CASE WHEN w THEN 'WRITE' ELSE 'READ' END AS mode")
    return f"""
edge_links AS MATERIALIZED (SELECT path_idx, ac, {key} FROM ({links})),
edges AS MATERIALIZED (
  SELECT src, dst, mode, CAST(sum(ac) AS BIGINT) AS value, count(*) AS n_paths
  FROM edge_links GROUP BY src, dst, mode)"""


CHAIN = ["CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME"]
NO_WAREHOUSE = ["CLIENT", "DATABASE", "SCHEMA_NAME"]
# With warehouses hidden the second place of a path is taken by the client.
NO_WAREHOUSE_PATHS = """
vectors AS MATERIALIZED (SELECT path_idx, "CLIENT" AS p0, "CLIENT" AS p1, "DATABASE" AS p2,
  "SCHEMA_NAME" AS p3 FROM path),
on_path AS (SELECT DISTINCT path_idx, node FROM (
  SELECT path_idx, unnest([p0, p1, p2, p3]) AS node FROM vectors))"""

def all_views() -> tuple[str, str]:
    """Common tables and body for the edges of all views of two to four columns."""
    types = dict(zip(CHAIN, ("client", "warehouse", "database", "schema"), strict=True))
    tables, bodies = [], []
    for n in (2, 3, 4):
        for i, columns in enumerate(combinations(CHAIN, n)):
            own = edges(list(columns), False)
            for name in ("edge_links", "edges"):
                own = own.replace(f"{name} ", f"{name}_{n}_{i} ").replace(f"{name}\n", f"{name}_{n}_{i}\n")
            tables.append(own)
            bodies.append(f"SELECT '{'-'.join(types[c] for c in columns)}' AS view, * FROM edges_{n}_{i}")
    return ",".join(tables), " " + " UNION ALL ".join(bodies)


EDGE_TEXT = """src || CASE WHEN mode = 'ALL' THEN ' ↔ ' ELSE ' → ' END || dst || chr(10)
  || 'Direction: ' || mode || chr(10) || 'Access Count: ' || format('{:,}', value)"""


def graph(body: str, *more: str, base=on_routes) -> str:
    return base(body, ROLLUP, *more)


# --- charts ------------------------------------------------------------------


def bars(column: str) -> str:
    return f"""
bar_rows AS MATERIALIZED (
  SELECT "{column}" AS category, CASE WHEN {WRITE} THEN 'Write' ELSE 'Read' END AS direction,
    {_sum("access_count")}
  FROM clean GROUP BY 1, 2),
top AS MATERIALIZED (SELECT category, sum(access_count) AS total FROM bar_rows GROUP BY 1
  ORDER BY total DESC, category LIMIT 10)"""


BARS_BODY = """ SELECT category, direction, access_count FROM bar_rows
WHERE category IN (SELECT category FROM top)"""

DENSE_BODY = """ SELECT t.category, m.direction, coalesce(b.access_count, 0) AS access_count,
  row_number() OVER (PARTITION BY m.direction ORDER BY t.total, t.category DESC) AS rank
FROM top t CROSS JOIN (SELECT DISTINCT direction FROM bar_rows JOIN top USING (category)) m
LEFT JOIN bar_rows b ON b.category = t.category AND b.direction = m.direction"""


def heatmap(row: str, col: str) -> str:
    return f"""
cells AS MATERIALIZED (
  SELECT "{row}" AS r, "{col}" AS c, {_sum("v")} FROM clean GROUP BY 1, 2),
kept AS MATERIALIZED (
  SELECT * FROM cells
  WHERE r IN (SELECT r FROM cells GROUP BY r ORDER BY sum(v) DESC, r LIMIT 15)
    AND c IN (SELECT c FROM cells GROUP BY c ORDER BY sum(v) DESC, c LIMIT 15)),
rows_ AS (SELECT r, row_number() OVER (ORDER BY sum(v) DESC, r) AS row_rank FROM kept GROUP BY r),
cols_ AS (SELECT c, row_number() OVER (ORDER BY sum(v) DESC, c) AS col_rank FROM kept GROUP BY c)
SELECT rows_.r AS "row", cols_.c AS "col", coalesce(kept.v, 0) AS value, row_rank, col_rank
FROM rows_ CROSS JOIN cols_ LEFT JOIN kept ON kept.r = rows_.r AND kept.c = cols_.c"""


def sankey(direction: str, columns: list[str]) -> str:
    xs = {4: (0.001, 0.333, 0.666, 0.999), 3: (0.001, 0.5, 0.999)}[len(columns)]
    nodes_sql = " UNION ALL ".join(
        f'SELECT {i} AS col_no, "{c}" AS name, "ACCESS_COUNT" AS ac FROM flow'
        for i, c in enumerate(columns))
    links_sql = " UNION ALL ".join(
        f'SELECT {i} AS col_no, "{a}" AS s, "{b}" AS t, "ACCESS_COUNT" AS ac FROM flow'
        for i, (a, b) in enumerate(zip(columns, columns[1:])))
    x = " ".join(f"WHEN {i} THEN CAST({v} AS DOUBLE)" for i, v in enumerate(xs))
    return f"""
flow AS MATERIALIZED (SELECT * FROM clean WHERE "DIRECTION" = '{direction}'),
totals AS (SELECT col_no, name, CAST(sum(ac) AS BIGINT) AS value FROM ({nodes_sql}) GROUP BY 1, 2),
placed AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY col_no, value DESC, name) - 1 AS idx,
    row_number() OVER (PARTITION BY col_no ORDER BY value DESC, name) - 1 AS i,
    count(*) OVER (PARTITION BY col_no) AS n,
    CAST(sum(value) OVER (PARTITION BY col_no) AS BIGINT) AS flow,
    CAST(coalesce(sum(value) OVER (PARTITION BY col_no ORDER BY value DESC, name
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM totals),
sankey_nodes AS (
  SELECT idx, CAST(col_no AS BIGINT) AS col_no, name,
    CASE WHEN col_no = 3 THEN list_last(string_split(name, '.')) ELSE name END AS label,
    CASE col_no {x} END AS x,
    round(CASE WHEN n = 1 THEN CAST(0.5 AS DOUBLE) ELSE least(
      CAST(0.01 AS DOUBLE) + before / flow * CAST(0.85 AS DOUBLE) * CAST(0.98 AS DOUBLE)
      + i * (CAST(0.15 AS DOUBLE) / (n - 1)) * CAST(0.98 AS DOUBLE)
      + value / flow * CAST(0.85 AS DOUBLE) * CAST(0.98 AS DOUBLE) / 2,
      CAST(0.99 AS DOUBLE)) END, 6) AS y, value
  FROM placed),
sankey_links AS (
  SELECT a.idx AS src_idx, b.idx AS dst_idx, CAST(sum(l.ac) AS BIGINT) AS value
  FROM ({links_sql}) l JOIN placed a ON a.col_no = l.col_no AND a.name = l.s
    JOIN placed b ON b.col_no = l.col_no + 1 AND b.name = l.t
  GROUP BY 1, 2)"""


def treemap(columns: list[str]) -> str:
    """Levels as separate group-bys, shares by window over the parent's keys."""
    parts = []
    for i in range(1, len(columns) + 1):
        keys = columns[:i]
        quoted = [f'"{k}"' for k in keys]
        label = {"DIRECTION": f'upper({quoted[-1]})',
                 "SCHEMA_NAME": f"list_last(string_split({quoted[-1]}, '.'))"}.get(
                     keys[-1], quoted[-1])
        above = quoted[:-1]
        parent = f"concat_ws('/', {', '.join(above)})" if above else "''"
        over = f"PARTITION BY {', '.join(above)}" if above else ""
        parts.append(
            f"SELECT CAST({i} AS BIGINT) AS level, concat_ws('/', {', '.join(quoted)}) AS id, "
            f"{parent} AS parent, {label} AS label, {_sum('value')}, "
            f'round(sum("ACCESS_COUNT") / sum(sum("ACCESS_COUNT")) OVER ({over}), 6) AS share '
            f"FROM clean GROUP BY {', '.join(quoted)}")
    return " " + " UNION ALL ".join(parts)


def cube() -> str:
    keys = ["CLIENT", "WAREHOUSE", "DATABASE", "SCHEMA_NAME", "DIRECTION"]
    grouped = ", ".join(f"CASE WHEN grouping(\"{k}\") = 0 THEN '{k}' END" for k in keys)
    return f""" SELECT concat_ws(',', {grouped}) AS grouped, {FIVE}, {_sum()}
FROM clean GROUP BY CUBE ({FIVE}) HAVING grouping({FIVE}) <> 31"""


# --- clients -----------------------------------------------------------------


def _hue(name: str) -> str:
    return f"CAST(CAST('0x' || substr(md5({name}), 1, 8) AS BIGINT) % 360 AS INTEGER)"


def _letters(name: str) -> str:
    clean = f"replace(replace({name}, '/', ''), ' ', '')"
    mark = f"regexp_extract(substr({clean}, 2), '[\\p{{Lu}}\\p{{Nd}}]')"
    return (f"CASE WHEN length({clean}) <= 2 THEN upper({clean}) ELSE "
            f"upper(substr({clean}, 1, 1)) || CASE WHEN {mark} <> '' THEN {mark} "
            f"ELSE lower(substr({clean}, 2, 1)) END END")


def _badge(hue: str, letters: str) -> str:
    head, rest = BADGE_SVG.split("{hue}")
    middle, tail = rest.split("{letters}")
    return (f"'{URI_PREFIX}' || to_base64(encode('{head}' || CAST({hue} AS VARCHAR) || "
            f"'{middle}' || {letters} || '{tail}'))")


NO_FEATURES = "features AS (SELECT NULL AS client WHERE false),"
FEATURES = """features AS (
  SELECT DISTINCT regexp_extract("CLIENT", '\\(([^)]+)\\)', 1) AS client FROM labelled
  WHERE "CLIENT" LIKE 'Web App (%'),"""
CLIENTS = f"""
names AS (SELECT DISTINCT "CLIENT" AS client FROM clean),
listed AS (SELECT {", ".join(f"{t} AS {n}" for n, t in d.LISTED.items())} FROM part),
marked AS (
  SELECT names.client, coalesce(listed.abbreviation, {_letters("names.client")}) AS abbreviation,
    {_hue("names.client")} AS hue,
    coalesce(listed.icon, CASE WHEN names.client LIKE 'Web%'
      OR names.client IN (SELECT client FROM features) THEN (SELECT icon FROM listed WHERE client = 'Web') END) AS icon
  FROM names LEFT JOIN listed ON listed.client = names.client)
SELECT client, abbreviation, hue, icon, {_badge("hue", "abbreviation")} AS badge FROM marked"""

PART_RULES = "part_rules AS (SELECT " + ", ".join(
    f"{t} AS {n}" for n, t in d.PART_RULE.items()) + " FROM part)"


# --- all ---------------------------------------------------------------------


MANY_RULES = "many AS (SELECT row_number() OVER () AS id, *, lead || body || trail AS pattern FROM (SELECT " + \
    ", ".join(f"{text} AS {name}" for name, text in d.MANY_RULES.items()) + " FROM part))"

#: Every rule's values with none to two strange characters for a ``%`` and one for a ``_``,
#: tried on every other rule.
SHADOWED = "WITH " + MANY_RULES + """,
tried AS (
  SELECT DISTINCT id, CASE WHEN lead = '' THEN '' ELSE repeat('^', i) END || replace(body, '_', '^')
    || CASE WHEN trail = '' THEN '' ELSE repeat('^', j) END AS value
  FROM many, range(3) AS a(i), range(3) AS b(j)),
sizes AS (SELECT id, count(*) AS n FROM tried GROUP BY id),
covered AS (
  SELECT t.id, a.id AS by_id FROM tried t JOIN many a ON t.value ILIKE a.pattern
  GROUP BY t.id, a.id HAVING count(*) = (SELECT n FROM sizes WHERE sizes.id = t.id)),
ranked AS (
  SELECT r.*, a.pattern AS by_pattern, a.display_name AS by_name, row_number() OVER (
    PARTITION BY r.id ORDER BY a.priority, a.display_name, a.pattern) AS place
  FROM covered c JOIN many r ON r.id = c.id JOIN many a ON a.id = c.by_id
  WHERE a.source_field = r.source_field
    AND (a.priority < r.priority OR (a.priority = r.priority AND a.display_name < r.display_name)))
SELECT CAST(priority AS BIGINT) AS priority, pattern, source_field, display_name, by_pattern, by_name
FROM ranked WHERE place = 1"""


def oracle_sql() -> dict[str, str]:
    """Query name → SQL over the test tables."""
    snapshot_columns = """ SELECT organization_name, account_id, client, warehouse, database,
  schema_name, direction, access_count FROM snapshot"""
    top3_text = """ SELECT id, upper(substr(type, 1, 1)) || substr(type, 2) || ': ' || id || chr(10)
  || 'Organization: ' || org || chr(10) || 'Account: LOCAL_ACCOUNT' || chr(10)
  || '{rule}' || chr(10) || 'Total Access: ' || format('{n}', total) || chr(10)
  || '  Read:  ' || format('{n}', read) || chr(10) || '  Write: ' || format('{n}', write)
  || chr(10) || '{rule}' || chr(10) || 'Top Connections:' || coalesce((
    SELECT string_agg(chr(10) || '  ' || neighbour || ': ' || format('{n}', cnt), '' ORDER BY rk)
    FROM top3 WHERE top3.node = nodes.id), '') AS text FROM nodes""".replace(
        "{rule}", NODE_SUMMARY.splitlines()[3]).replace("{n}", "{:,}")

    found = {
        "object_decompose": "WITH " + raw() + """
SELECT DISTINCT query_id, database, schema_name, application FROM raw""",
        "noise_filter": "WITH " + raw(RECENT_SINCE) + """
SELECT query_type, count(*) AS n FROM (
  SELECT DISTINCT query_type, query_id, database, schema_name FROM raw) GROUP BY 1""",
        "direction_counts": f"""
WITH q AS (SELECT {d.QUERY_TYPE} AS query_type FROM orders)
SELECT query_type, {DIRECTION_CASE} AS direction, count(*) AS n FROM q GROUP BY 1, 2""",
        "rule_matches": "WITH " + raw() + "," + NAMED + """
SELECT p.client_app_id, p.application, r.priority, r.display_name FROM pairs p LEFT JOIN rules r
  ON CASE r.source_field WHEN 'client_app_id' THEN p.client_app_id ELSE p.application END
    ILIKE r.pattern""",
        "rules_indexed": "WITH " + MANY_RULES + f"""
SELECT value, CAST(priority AS BIGINT) AS priority, pattern, source_field, display_name
FROM (SELECT DISTINCT {d.NAMED_PART} AS value FROM part) JOIN many ON value ILIKE pattern""",
        "rules_shadowed": SHADOWED,
        "client_resolution": "WITH " + raw() + "," + NAMED + """
SELECT client_app_id, application, client FROM named""",
        "refresh_routes": on_snapshot(snapshot_columns, RECENT_SINCE),
        "refresh_routes_all": on_snapshot(snapshot_columns),
        "refresh_repeated_sessions": "WITH " + ",".join(
            [raw(ALL_SINCE, REPEATED), NAMED, RESOLVED, SNAPSHOT]) + snapshot_columns,
        "refresh_text_ids": on_snapshot(snapshot_columns, RECENT_SINCE),
        "refresh_partitioned_logs": on_snapshot(snapshot_columns, RECENT_SINCE),
        "refresh_filtered_scan": on_snapshot(snapshot_columns, RECENT_SINCE),
        "refresh_from_days": on_snapshot(snapshot_columns, RECENT_SINCE),
        "refresh_row_count": on_snapshot("""
SELECT count(*) AS rows, 'Route snapshot refreshed. Rows: ' || CAST(count(*) AS VARCHAR) AS message
FROM snapshot""", RECENT_SINCE),
        "old_table_evolved": on_snapshot("""
SELECT organization_name, CAST(NULL AS VARCHAR) AS account_id, client, warehouse, database,
  schema_name, direction, access_count FROM snapshot""", RECENT_SINCE),
        "rules_saved": f"""
WITH {PART_RULES} SELECT * FROM part_rules WHERE pattern <> '' AND display_name <> ''
  AND source_field IN ('client_app_id', 'application') AND priority BETWEEN 0 AND 998
  AND NOT contains(pattern, chr(92))""",
        "rules_ordered": f"""
WITH {PART_RULES} SELECT *, row_number() OVER (ORDER BY priority, pattern NULLS FIRST, source_field,
  display_name) - 1 AS place FROM part_rules""",
        "group_by_ranked": on_routes(f"""
SELECT *, row_number() OVER (ORDER BY "ACCESS_COUNT" DESC, "CLIENT", "DATABASE") - 1 AS place FROM (
  SELECT "CLIENT", "DATABASE", {_sum()} FROM clean GROUP BY 1, 2)"""),
        "treemap_order": on_routes(f"""
SELECT level, id, value, row_number() OVER (ORDER BY level, CASE WHEN level = 1 THEN -value END, id)
  - 1 AS place FROM ({treemap(["CLIENT", "DATABASE", "SCHEMA_NAME", "DIRECTION"])})"""),
        "heatmap_pivot": on_routes("""
SELECT "row", CAST(coalesce(sum(value) FILTER (col = 'read'), 0) AS BIGINT) AS "read",
  CAST(coalesce(sum(value) FILTER (col = 'write'), 0) AS BIGINT) AS "write",
  CAST(coalesce(sum(value) FILTER (col = 'DDL'), 0) AS BIGINT) AS "DDL",
  CAST(coalesce(sum(value) FILTER (col = 'metadata'), 0) AS BIGINT) AS "metadata"
FROM matrix GROUP BY "row" """, "cells AS" + heatmap("CLIENT", "DIRECTION").split("cells AS", 1)[1]
            .replace('SELECT rows_.r AS "row"', ', matrix AS (SELECT rows_.r AS "row"', 1) + ")"),
        "snapshot_reload": on_snapshot("""
SELECT database AS "DATABASE", schema_name AS "SCHEMA_NAME", warehouse AS "WAREHOUSE",
  client AS "CLIENT", direction AS "DIRECTION", organization_name AS "ORGANIZATION_NAME",
  account_id AS "ACCOUNT_NAME", access_count AS "ACCESS_COUNT" FROM snapshot""", RECENT_SINCE),
        "clean_routes": on_routes(" SELECT * FROM clean"),
        "clean_direct_routes": on_direct(" SELECT * FROM clean"),
        "web_feature_relabel": on_direct(f"""
SELECT "CLIENT", {_sum()} FROM clean GROUP BY 1"""),
        "filter_dims": on_routes("""
SELECT * FROM clean WHERE "ACCESS_COUNT" > 0 AND "CLIENT" IN ('Loom', 'Pi', 'Quillboard')
  AND "WAREHOUSE" IN ('WH_1', 'WH_3') AND "SCHEMA_NAME" IN ('SANDBOX_DB.S1', 'RAW_ERP_DB.S2')"""),
        "filter_threshold": on_routes(' SELECT * FROM clean WHERE "ACCESS_COUNT" > 10'),
        "filter_org_regex": on_direct("""
SELECT * FROM clean WHERE regexp_matches("ORGANIZATION_NAME", '(BUILD|MACH)')"""),
        "filter_combined": on_direct("""
SELECT * FROM clean WHERE "ACCESS_COUNT" > 2 AND "DATABASE" IN ('PROMO_DB', 'SMALL_DB')
  AND "WAREHOUSE" IN ('WH_1', 'WH_2') AND "CLIENT" IN ('Worksheets', 'Loom')
  AND regexp_matches("ORGANIZATION_NAME", '^ORG_(B|M)') AND "DIRECTION" IN ('read', 'DDL')"""),
        "filter_values_kept": on_routes("""
SELECT CAST(n_nationkey AS BIGINT) AS position, 'WH_' || CAST(n_nationkey AS STRING) AS value
FROM nation WHERE 'WH_' || CAST(n_nationkey AS STRING) IN (SELECT "WAREHOUSE" FROM clean)"""),
        "filter_extension": on_routes("""
SELECT value, CASE WHEN value IN ('SANDBOX_DB', 'RAW_ERP_DB') THEN 'SANDBOX_DB|RAW_ERP_DB'
    ELSE 'SANDBOX_DB|RAW_ERP_DB|' || value END AS extended,
  CASE WHEN value = 'SANDBOX_DB' THEN 'SANDBOX_DB|RAW_ERP_DB' ELSE 'RAW_ERP_DB' END AS kept
FROM (SELECT DISTINCT "DATABASE" AS value FROM clean)"""),
        "top_routes": on_routes(f"""
SELECT * FROM clean ORDER BY "ACCESS_COUNT" DESC, {", ".join(f'"{c}"' for c in DIMS)},
  "ORGANIZATION_NAME", "ACCOUNT_NAME" LIMIT 500"""),
        "short_schemas": on_routes(f"""
SELECT "SCHEMA_NAME", list_last(string_split("SCHEMA_NAME", '.')) AS short, {_sum()}
FROM clean GROUP BY 1, 2"""),
        "group_by_client_direction": on_routes(f"""
SELECT "CLIENT", "DIRECTION", {_sum()} FROM clean GROUP BY 1, 2"""),
        "group_by_cube": on_routes(cube()),
        "grand_total": on_routes(f' SELECT count(*) AS rows, {_sum("total")} FROM clean'),
        "table_view": on_routes(f"""
SELECT {_badge(_hue('"CLIENT"'), _letters('"CLIENT"'))} AS "ICON", "CLIENT", "WAREHOUSE", {_sum()}
FROM clean GROUP BY "CLIENT", "WAREHOUSE" """),
        "edge_rollup": graph(" SELECT * FROM rollup_routes", base=on_direct),
        "node_stats": graph(" SELECT * FROM stats", STATS),
        "node_links": graph(" SELECT * FROM links", LINKS),
        "node_top3": graph(" SELECT node, neighbour, cnt, rk FROM top3", LINKS),
        "node_sizes": graph(" SELECT id, type, size FROM nodes", STATS, nodes()),
        "node_types": graph(" SELECT id, type FROM nodes", STATS, nodes()),
        "network_nodes": graph(" SELECT * FROM nodes", STATS, nodes(("warehouse",))),
        "network_nodes_direct": graph(" SELECT * FROM nodes", STATS, nodes(("database",)),
                                      base=on_direct),
        "node_text": graph(top3_text, STATS, LINKS, nodes()),
        "edges_directed": graph(" SELECT * FROM edges", edges(CHAIN, False)),
        "edges_combined": graph(" SELECT * FROM edges", edges(CHAIN, True)),
        "edges_hidden_wh": graph(f" SELECT *, {EDGE_TEXT} AS text FROM edges",
                                 edges(NO_WAREHOUSE, True)),
        "edges_all_views": graph(all_views()[1], all_views()[0]),
        "edge_texts": graph(f" SELECT src, dst, mode, {EDGE_TEXT} AS text FROM edges",
                            edges(CHAIN, False)),
        "edge_paths": graph(" SELECT src, dst, mode, path_idx FROM edge_links",
                            edges(NO_WAREHOUSE, False)),
        "path_vectors": graph(" SELECT * FROM vectors", NO_WAREHOUSE_PATHS),
        "layer_members": graph("""
SELECT layer AS label, id AS member FROM nodes WHERE layer <> ''""",
                               STATS, nodes(("warehouse", "schema"))),
        "layer_nodes": graph("""
SELECT 'cluster:' || layer AS id, layer || ' (' || CAST(count(*) AS VARCHAR) || ')' AS label,
  count(*) AS members FROM nodes WHERE layer <> '' GROUP BY layer""",
                             STATS, nodes(("warehouse", "schema"))),
        "layer_contraction": graph("""
SELECT least(s, t) AS src, greatest(s, t) AS dst, mode, CAST(sum(value) AS BIGINT) AS value,
  CAST(sum(n_paths) AS BIGINT) AS n_paths
FROM (SELECT coalesce('cluster:' || nullif(a.layer, ''), e.src) AS s,
    coalesce('cluster:' || nullif(b.layer, ''), e.dst) AS t, mode, value, n_paths
  FROM edges e LEFT JOIN nodes a ON a.id = e.src LEFT JOIN nodes b ON b.id = e.dst)
WHERE s <> t GROUP BY 1, 2, 3""", STATS, nodes(("warehouse", "schema")),
                                   edges(["CLIENT", "DATABASE"], True)),
        "path_neighbourhood": graph("""
SELECT DISTINCT a.node, b.node AS connected FROM on_path a JOIN on_path b USING (path_idx)""",
                                    NO_WAREHOUSE_PATHS),
        "path_edges": graph("""
SELECT DISTINCT node, src, dst, mode FROM on_path JOIN edge_links USING (path_idx)""",
                            NO_WAREHOUSE_PATHS, edges(NO_WAREHOUSE, False)),
        "bars_dense": on_routes(DENSE_BODY, bars("SCHEMA_NAME")),
        "chart_table": on_routes("""
SELECT category AS "Schema_Name", direction AS "Direction", access_count AS "Access Count"
FROM bar_rows WHERE category IN (SELECT category FROM top)""", bars("SCHEMA_NAME")),
        "sankey_three_columns": on_routes(" SELECT * FROM sankey_nodes",
                                          sankey("read", CHAIN[:3])),
        "treemap": on_routes(treemap(["CLIENT", "DATABASE", "SCHEMA_NAME", "DIRECTION"])),
        "treemap_three_levels": on_routes(treemap(["CLIENT", "DATABASE", "DIRECTION"])),
        "client_attributes": on_routes("", NO_FEATURES + CLIENTS),
        "client_attributes_features": on_direct("", FEATURES + CLIENTS),
        "rule_violations": f"""
WITH {PART_RULES}
SELECT *, 'pattern is empty' AS reason FROM part_rules WHERE pattern IS NULL OR pattern = ''
UNION ALL SELECT *, 'display_name is empty' FROM part_rules WHERE display_name = ''
UNION ALL SELECT *, 'source_field is unknown' FROM part_rules
  WHERE source_field NOT IN ('client_app_id', 'application')
UNION ALL SELECT *, 'priority is out of range' FROM part_rules
  WHERE priority < 0 OR priority >= 999
UNION ALL SELECT *, 'pattern has a backslash' FROM part_rules WHERE contains(pattern, chr(92))""",
        "seed_rules_upsert": f"""
WITH {PART_RULES},
present AS (SELECT * FROM part_rules WHERE priority >= 0 AND source_field = 'application')
SELECT * FROM present UNION ALL SELECT * FROM part_rules s WHERE NOT EXISTS (
  SELECT 1 FROM present p WHERE p.pattern = s.pattern AND p.source_field = s.source_field)""",
        "snapshot_history": "WITH " + raw() + "," + NAMED + "," + RESOLVED + """,
runs AS (
  SELECT CAST(unnest(generate_series(TIMESTAMP '1995-01-01', TIMESTAMP '2001-07-29',
    INTERVAL 7 DAY)) AS DATE) AS run_date)
SELECT run_date, 'LOCAL_ORG' AS organization_name, 'LOCAL_ACCOUNT' AS account_id, client,
  warehouse, database, schema_name, direction, count(DISTINCT query_id) AS access_count
FROM resolved JOIN runs ON start_time > run_date - INTERVAL 30 DAY
  AND start_time <= run_date + INTERVAL 6 HOUR
GROUP BY ALL""",
        "stream_route_counts": "WITH " + raw(ALL_SINCE) + "," + NAMED + "," + RESOLVED + """
SELECT CAST(start_time AS DATE) AS day, client, warehouse, database, schema_name, direction,
  count(DISTINCT query_id) AS access_count FROM resolved GROUP BY ALL""",
    }
    found["stream_query_log"] = found["stream_route_counts"]
    found["path_index_neighbourhood"] = found["path_neighbourhood"]
    found["path_index_edges"] = found["path_edges"]
    found["group_by_lattice"] = found["group_by_cube"]
    for name, column in (("client", "CLIENT"), ("database", "DATABASE"),
                         ("schema", "SCHEMA_NAME"), ("warehouse", "WAREHOUSE"),
                         ("direction", "DIRECTION")):
        found[f"distinct_{name}s"] = on_routes(f' SELECT DISTINCT "{column}" AS value FROM clean')
        if name != "direction":
            found[f"bars_{name}"] = on_routes(BARS_BODY, bars(column))
        if name in ("database", "schema", "warehouse"):
            found[f"heatmap_{name}_client"] = on_routes("", heatmap(column, "CLIENT"))
    for way in ("read", "write"):
        for part in ("nodes", "links"):
            found[f"sankey_{part}_{way}"] = on_routes(
                f" SELECT * FROM sankey_{part}", sankey(way, CHAIN))
    return found
