"""Dotted object names and client labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def database_of(name: Column) -> Column:
    """First dot segment of an object name."""
    return F.split_part(name, F.lit("."), F.lit(1))


def qualified_schema_of(name: Column) -> Column:
    """``database.schema``, or NULL for a name without a second segment."""
    second = F.split_part(name, F.lit("."), F.lit(2))
    return F.when(second != "", F.concat_ws(".", database_of(name), second))


def short_schema(name: Column) -> Column:
    """Last dot segment; NULL and the empty string pass through."""
    return F.substring_index(name, ".", -1)


def feature_label(client: Column, prefix: str) -> Column:
    """Replace ``<prefix>feature)`` by ``feature``; NULL where no feature is named.

    Labels that do not start with ``prefix`` are left alone.
    """
    inside = F.regexp_extract(client, r"\(([^)]+)\)", 1)
    return F.when(client.startswith(prefix), F.nullif(inside, F.lit(""))).otherwise(client)
