"""What a statement did to the objects it touched."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# The statement types of the query log.
DDL_PREFIXES = ("CREATE", "ALTER", "DROP", "TRUNCATE", "RENAME", "UNDROP")
DDL_TYPES = ("COMMENT", "GRANT", "REVOKE", "RESTORE")
METADATA_PREFIXES = ("SHOW", "DESCRIBE")
METADATA_TYPES = ("DESC", "LIST_FILES", "EXPLAIN")
READ_TYPES = ("SELECT", "UNLOAD", "GET_FILES")

# Directions that count as writing where only two modes are told apart.
WRITE_DIRECTIONS = ("write", "DML", "DDL")


def _one_of(query_type: Column, types=(), prefixes=()) -> Column:
    return reduce(or_, [query_type.startswith(p) for p in prefixes] + [query_type.isin(*types)])


def statement_direction(query_type: Column) -> Column:
    """``DDL``, ``metadata``, ``read`` or ``write``; the first that applies."""
    return (
        F.when(_one_of(query_type, DDL_TYPES, DDL_PREFIXES), "DDL")
        .when(_one_of(query_type, METADATA_TYPES, METADATA_PREFIXES), "metadata")
        .when(_one_of(query_type, READ_TYPES), "read")
        .otherwise("write")
    )


def is_write(direction: Column) -> Column:
    return direction.isin(*WRITE_DIRECTIONS)


def access_mode(direction: Column, read: str = "read", write: str = "write") -> Column:
    """Fold four directions into two; metadata counts as reading."""
    return F.when(is_write(direction), write).otherwise(read)
