"""Cleaning, filtering and grouping route frames."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.functions.badges import abbreviation, badge_uri, hue
from wayline.functions.names import feature_label
from wayline.schema import CLEAN_COLUMNS, CONTEXT, DIMENSIONS, GROUP_COLUMNS, MEASURE, TABLE_ORDER
from wayline.session import settle

# Fixed value: routes with fewer accesses than this are hidden unless asked for.
DEFAULT_THRESHOLD = 10
DEFAULT_ROWS = 500


def by_weight(*names: str) -> list[Column]:
    """Largest measure first; ties in the order of ``names``."""
    return [F.desc(MEASURE), *[F.asc(n) for n in names]]


def sum_by(routes: DataFrame, *keys: str) -> DataFrame:
    """Sum of the measure per key; rows with a NULL key belong to no group."""
    return (
        routes.dropna("any", subset=list(keys))
        .groupBy(*keys).agg(F.sum(MEASURE).cast("long").alias(MEASURE))
    )


def loaded_routes(snapshot: DataFrame) -> DataFrame:
    """A snapshot under the column names the products use."""
    return snapshot.select(
        *[F.col(c.lower()).alias(c) for c in DIMENSIONS],
        F.col("organization_name").alias("ORGANIZATION_NAME"),
        F.col("account_id").alias("ACCOUNT_NAME"),
        F.col("access_count").alias(MEASURE),
    )


def relabelled(routes: DataFrame, feature_prefix: str) -> DataFrame:
    """Show features of a client under their own name.

    A label with the prefix but without a name becomes NULL and goes.
    """
    return routes.withColumn("CLIENT", feature_label(F.col("CLIENT"), feature_prefix)).filter(
        F.col("CLIENT").isNotNull()
    )


def clean_routes(routes: DataFrame, feature_prefix: str = "Web App (") -> DataFrame:
    """Complete rows only, features relabelled, one row per route.

    Not sorted: order a result with :func:`by_weight` where it is shown.
    """
    whole = relabelled(routes.dropna("any"), feature_prefix)
    return sum_by(whole, *DIMENSIONS, *CONTEXT).select(*CLEAN_COLUMNS)


def filter_routes(routes: DataFrame, databases: Sequence[str] = (), schemas: Sequence[str] = (),
                  warehouses: Sequence[str] = (), clients: Sequence[str] = (),
                  org_pattern: str = "", directions: Sequence[str] = (),
                  more_than: int = DEFAULT_THRESHOLD) -> DataFrame:
    """Routes above a threshold that pass every list; an empty list passes all.

    The organisation is matched with a regular expression, case-sensitively.
    """
    wanted = {"DATABASE": databases, "SCHEMA_NAME": schemas, "WAREHOUSE": warehouses,
              "CLIENT": clients, "DIRECTION": directions}
    tests = [F.col(MEASURE) > more_than]
    tests += [F.col(c).isin(*values) for c, values in wanted.items() if values]
    if org_pattern:
        tests.append(F.coalesce(F.col("ORGANIZATION_NAME").rlike(org_pattern), F.lit(False)))
    return routes.filter(reduce(and_, tests))


def top_routes(routes: DataFrame, rows: int = DEFAULT_ROWS) -> DataFrame:
    """The heaviest routes; the row limit is what the caller asks for."""
    return routes.orderBy(*by_weight(*DIMENSIONS, *CONTEXT)).limit(rows)


def distinct_values(routes: DataFrame, column: str) -> DataFrame:
    """Distinct non-NULL values of a column as text, sorted."""
    value = F.col(column).cast("string").alias("value")
    return routes.select(value).filter(F.col("value").isNotNull()).distinct().orderBy("value")


def kept_values(requested: Column, available: Column) -> Column:
    """Requested filter values that still exist, in the order requested."""
    return F.array_intersect(requested, available)


def extended_values(current: Column, clicked: Column) -> Column:
    """A filter list with one more value, unless it has it already."""
    return F.array_union(current, F.array(clicked))


def existing_values(requested: DataFrame, routes: DataFrame, column: str) -> DataFrame:
    """Rows of ``requested`` (position, value) whose value occurs in ``column``."""
    return requested.join(distinct_values(routes, column), "value", "left_semi")


def group_by(routes: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """Sum per combination of the chosen dimensions, largest first.

    With no dimension chosen the rows come back as they are.
    """
    unknown = set(dims) - set(GROUP_COLUMNS)
    if unknown:
        raise ValueError(f"cannot group by {sorted(unknown)}")
    return sum_by(routes, *dims).orderBy(*by_weight(*dims)) if dims else routes


def group_by_cube(routes: DataFrame, dims: Sequence[str] = tuple(GROUP_COLUMNS)) -> DataFrame:
    """Every non-empty choice of dimensions at once.

    ``grouped`` names the chosen dimensions; the others are NULL.  The routes
    are brought down to one row per full combination first, so the copies the
    cube makes are copies of few rows.
    """
    base = sum_by(routes, *dims)
    cube = base.cube(*dims).agg(
        F.grouping_id().alias("_gid"), F.sum(MEASURE).cast("long").alias(MEASURE)
    )
    n = len(dims)
    chosen = F.concat_ws(",", *[
        F.when(F.col("_gid").bitwiseAND(1 << (n - 1 - i)) == 0, F.lit(d))
        for i, d in enumerate(dims)
    ])
    return cube.filter(F.col("_gid") != (1 << n) - 1).select(
        chosen.alias("grouped"), *dims, MEASURE
    )


def cube_by_lattice(routes: DataFrame, dims: Sequence[str] = tuple(GROUP_COLUMNS)) -> DataFrame:
    """The rows of :func:`group_by_cube`, each grouping from its smallest parent.

    A grouping is summed up from the one with one more dimension that has the
    fewest rows, not from a copy of all routes; those that others start from are
    written.  That takes a job per grouping, and moves far fewer rows where some
    dimensions bring the rows down a lot.
    """
    known = {frozenset(dims): settle(sum_by(routes, *dims), "grouping")}
    sizes = {key: rows.count() for key, rows in known.items()}
    for k in range(len(dims) - 1, 0, -1):
        for chosen in combinations(dims, k):
            key = frozenset(chosen)
            parent = min((p for p in sizes if len(p) == k + 1 and key < p), key=lambda p: sizes[p])
            known[key] = sum_by(known[parent], *chosen)
            if k > 1:
                known[key] = settle(known[key], "grouping")
                sizes[key] = known[key].count()
    return reduce(DataFrame.unionByName, [rows.select(
        F.lit(",".join(d for d in dims if d in key)).alias("grouped"),
        *[F.col(d) if d in key else F.lit(None).cast("string").alias(d) for d in dims], MEASURE,
    ) for key, rows in known.items()])


def grand_total(rows: DataFrame) -> DataFrame:
    """How many rows there are and what they sum to."""
    return rows.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.sum(MEASURE), F.lit(0)).cast("long").alias("total"),
    )


def table_view(routes: DataFrame, dims: Sequence[str] = ()) -> DataFrame:
    """The rows of a table: grouped, with client badges, in display order.

    Columns that are not there are left out.
    """
    rows = group_by(routes, dims)
    if "CLIENT" in rows.columns:
        client = F.col("CLIENT")
        rows = rows.withColumn("ICON", badge_uri(hue(client), abbreviation(client)))
    return rows.select(*[c for c in TABLE_ORDER if c in rows.columns])
