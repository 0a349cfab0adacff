"""What the text operators share: tables, words, and rows that keep an identity."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayline.session import settle

#: A word is a run of anything but space, tab, newline and the like.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words of a text, in order; of a null text, none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once, also inside lambdas."""
    return F.transform(F.array(value), body)[0]


def packed(df: DataFrame) -> Column:
    """All columns of a row as one struct, out of reach of the names used here."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def anchored(docs: DataFrame, name: str, **extra: Column) -> DataFrame:
    """Rows written with a number of their own: ``row``, ``rid`` and ``extra``.

    Ids may be null or repeated, and a row number is only good once it is
    written: a lost executor may deal rows out differently when it repeats them.
    """
    return settle(docs.select(
        packed(docs).alias("row"), F.monotonically_increasing_id().alias("rid"),
        *[c.alias(n) for n, c in extra.items()]), name)


def unpacked(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
