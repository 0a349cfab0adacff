"""Naming client applications with a table of prioritised patterns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.operators.bounded import BROADCAST_BYTES
from wayline.operators.patterns import in_slices, indexed_matches, looped_matches
from wayline.session import settle

PAIR = ["client_app_id", "application"]

# Fixed value: priority taken by a side without a match.
NO_MATCH = 999
#: Rules of a field that are tried one by one; more are looked up.
LOOPED = 1000


def distinct_pairs(sessions: DataFrame) -> DataFrame:
    """Distinct (client id, application) pairs.

    Rules look at nothing else, so each pair needs to be matched only once
    however many sessions and queries share it.
    """
    return sessions.select(*PAIR).distinct()


def prepared(rules: DataFrame) -> DataFrame:
    """Rules with whole priorities, those without one at the end."""
    return rules.select(
        F.coalesce(F.col("priority"), F.lit(NO_MATCH)).cast("long").alias("priority"),
        "pattern", "source_field", "display_name",
    )


def field_matches(pairs: DataFrame, rules: DataFrame, field: str, limit: int = BROADCAST_BYTES,
                  looped: int = LOOPED) -> DataFrame:
    """Distinct values of one field with every rule for it that matches.

    Up to ``looped`` rules are tried on every value, broadcast after their size is
    measured; more are looked up in an index.  The rows are the same.
    """
    values = pairs.select(F.col(field).alias("value")).filter(F.col(field).isNotNull()).distinct()
    own = prepared(rules).filter(F.col("source_field") == field)
    if own.limit(looped + 1).count() > looped:
        found = indexed_matches(values, own, limit)
    else:
        found = looped_matches(values, in_slices(own, limit))
    return found.withColumnRenamed("value", field)


def match_rules(pairs: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES,
                looped: int = LOOPED) -> DataFrame:
    """Each pair with every rule that matches it, or once with NULLs if none does.

    A rule names the field it looks at, so ids and applications are compared
    apart, each value once, and the matches joined to the pairs.  NULL never
    matches.  The rows are the same however many rules there are.
    """
    pairs = settle(pairs, "pairs")
    matches = reduce(DataFrame.unionByName, [
        pairs.join(field_matches(pairs, rules, field, limit, looped), field) for field in PAIR])
    matches = settle(matches.select(*PAIR, "priority", "pattern", "source_field", "display_name"),
                     "matches")
    known = matches.select(*[F.col(c).alias(f"_{c}") for c in PAIR]).distinct()
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in PAIR])
    without = pairs.join(known, on, "left_anti")
    return matches.unionByName(without, allowMissingColumns=True)


def best_rules(pairs: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES,
               looped: int = LOOPED) -> DataFrame:
    """Per pair the first rule of each field, and how far its matches reach.

    Both are found per value of a field and then joined to the pairs.
    """
    for field, name in zip(PAIR, ("id", "app"), strict=True):
        best = field_matches(pairs, rules, field, limit, looped).groupBy(field).agg(
            F.min(F.struct("priority", "display_name")).alias(f"by_{name}"),
            F.max("priority").alias(f"last_by_{name}"))
        pairs = pairs.join(best, field, "left")
    return pairs


def resolve_clients(best: DataFrame) -> DataFrame:
    """``client_app_id, application, clients``: the names a pair goes by.

    The rule with the lower priority names the client, the client id's rule on
    a tie.  Without a rule the application does, and without that the client id.
    A side without a match stands at priority 999; a match on the other side
    that does not beat this leaves the pair without a rule name, and such a
    match keeps its row beside a named one.  So a pair can have two names, but
    only with priorities of 999 and more, which validated rules do not have.
    """
    id_priority = F.coalesce(F.col("by_id.priority"), F.lit(NO_MATCH))
    app_priority = F.coalesce(F.col("by_app.priority"), F.lit(NO_MATCH))
    named = F.when(id_priority <= app_priority, F.col("by_id.display_name")).otherwise(
        F.col("by_app.display_name")
    )
    fallback = F.coalesce(F.col("application"), F.col("client_app_id"))
    unnamed = named.isNull() | (
        F.col("by_id").isNull() & (F.col("last_by_app") >= NO_MATCH)
    ) | (F.col("by_app").isNull() & (F.col("last_by_id") > NO_MATCH))
    names = F.array_distinct(F.array_compact(F.array(named, F.when(unnamed, fallback))))
    return best.select(*PAIR, names.alias("clients"))


def classify(sessions: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Names for every pair found in ``sessions`` (see :func:`resolve_clients`)."""
    return resolve_clients(best_rules(distinct_pairs(sessions), rules, limit))


def with_clients(df: DataFrame, clients: DataFrame) -> DataFrame:
    """Replace the pair in ``df`` by the client's name.

    No broadcast is asked for: the number of pairs follows from the data, so the
    choice between a broadcast and a (skew-split) shuffle join is left to the
    sizes measured at run time.
    """
    named = clients.select(*[F.col(c).alias(f"_{c}") for c in PAIR], "clients")
    on = (F.col("client_app_id") == F.col("_client_app_id")) & F.col("application").eqNullSafe(
        F.col("_application")
    )
    kept = [c for c in df.columns if c not in PAIR]
    return df.join(named, on).select(F.explode("clients").alias("client"), *kept)
