"""Keeping the rule table: numbering, seeding, checking, ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline import schema
from wayline.operators.classify import NO_MATCH

KEY = ["pattern", "source_field"]
SOURCE_FIELDS = ("client_app_id", "application")


def numbered_rules(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """A list of (pattern, source field, name) as a rule table; first match wins."""
    rows = [(i, *rule) for i, rule in enumerate(rules)]
    return spark.createDataFrame(rows, schema.RULES)


def missing_rules(seed: DataFrame, rules: DataFrame) -> DataFrame:
    """Seed rules whose key the table does not have yet.

    Duplicates inside the seed are all missing the first time and none after.
    """
    return seed.join(rules.select(*KEY), KEY, "left_anti").select(*schema.RULES.names)


def upserted_rules(seed: DataFrame, rules: DataFrame) -> DataFrame:
    """The table with the missing seed rules added; nothing is changed or removed."""
    return rules.select(*schema.RULES.names).unionByName(missing_rules(seed, rules))


def rule_violations(rules: DataFrame) -> DataFrame:
    """Rules that must not be saved, one row per rule and reason.

    Priorities stay below 999, the value that stands for "no match", and
    patterns free of backslashes, which would escape what follows.
    """
    def when(bad, reason):
        return F.when(bad, reason)

    blank = {c: F.col(c).isNull() | (F.col(c) == "") for c in ("pattern", "display_name")}
    priority = F.col("priority")
    reasons = F.array_compact(F.array(
        when(blank["pattern"], "pattern is empty"),
        when(blank["display_name"], "display_name is empty"),
        when(F.col("source_field").isNull() | ~F.col("source_field").isin(*SOURCE_FIELDS),
             "source_field is unknown"),
        when(priority.isNull() | (priority < 0) | (priority >= NO_MATCH)
             | (priority != F.floor(priority)), "priority is out of range"),
        when(F.col("pattern").contains("\\"), "pattern has a backslash"),
    ))
    return rules.select(*schema.RULES.names, F.explode(reasons).alias("reason"))


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules in the order they are tried; names break ties."""
    return rules.orderBy("priority", "pattern", "source_field", "display_name")
