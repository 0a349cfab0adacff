"""Vectors compressed to short codes: product quantisation by member-resident Lloyd.

Every vector is cut into parts, and each position has a codebook.  The parts
live with the *owners* of their position, entry and salt, as rows of a written
table: a round sums the members up where they are, gets the new codebooks from
the sums, and assigns every member again.  Members that keep their entry stay
where they are; only those that change it go through a shuffle to their new
owner.  The salt splits an entry that very many parts share.  All numbers are
integers, so the result doesn't depend on the order of rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.base import partitions
from wayline.session import scratch_path, settle

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Scaled components are held within this, so that distances fit into 64 bits.
LARGEST = 2**24

OWNER = ["part", "entry", "salt"]
MEMBER = "rid long, part int, entry int, salt int, x array<long>, moved boolean, error long"


def _usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(embeddings: DataFrame, parts: int = PARTS, scale: int = SCALE) -> DataFrame:
    """``rid, vec_id, label, v``: vectors as integers, written with a number of their own.

    All are brought to one length, a multiple of ``parts``, by zeros at the end.
    """
    vector = F.col("embedding").cast("array<double>")
    kept = embeddings.filter(_usable(vector)).select("vec_id", "label", F.transform(
        vector, lambda x: F.greatest(F.lit(-LARGEST), F.least(F.lit(LARGEST), F.floor(
            F.greatest(F.lit(-2.0**60), F.least(F.lit(2.0**60), x * scale)))))).alias("v"))
    kept = settle(kept.withColumn("rid", F.monotonically_increasing_id()), "vectors")
    longest = kept.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    length = -(-longest // parts) * parts
    zeros = F.array_repeat(F.lit(0).cast("long"), F.lit(length) - F.size("v"))
    return kept.withColumn("v", F.concat("v", zeros))


def first_codebooks(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> np.ndarray:
    """Codebooks by position, from the vectors of the smallest ids; a few rows on the driver."""
    rows = vectors.select("v").orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    return np.array([r["v"] for r in rows], np.int64).reshape(len(rows), parts, -1).swapaxes(0, 1)


def _nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest entry, the lower index on a tie."""
    entry, error = np.empty(len(x), np.int32), np.empty(len(x), np.int64)
    step = max(1, 2**22 // max(book.size, 1))
    for lo in range(0, len(x), step):
        apart = x[lo:lo + step, None, :] - book[None]
        far = np.einsum("nek,nek->ne", apart, apart)
        entry[lo:lo + step] = far.argmin(axis=1)
        error[lo:lo + step] = far.min(axis=1)
    return entry, error


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


def _rows(rid, part, entry, salt, x, moved, error) -> pa.RecordBatch:
    width = x.shape[1]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * width, pa.int32()),
                                     pa.array(x.ravel()))
    return pa.RecordBatch.from_arrays(
        [pa.array(rid), pa.array(part, pa.int32()), pa.array(entry, pa.int32()),
         pa.array(salt, pa.int32()), lists, pa.array(moved), pa.array(error)],
        names=["rid", "part", "entry", "salt", "x", "moved", "error"])


def cut(vectors: DataFrame, books: np.ndarray, salts: int) -> DataFrame:
    """Parts of all vectors with the nearest entry of their position."""
    parts = len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid = batch.column(0).to_numpy()
            v = _matrix(batch.column(1), len(rid)).reshape(len(rid), parts, -1)
            for p in range(parts):
                entry, error = _nearest(v[:, p], books[p])
                yield _rows(rid, np.full(len(rid), p), entry, rid % salts,
                            np.ascontiguousarray(v[:, p]), np.ones(len(rid), bool), error)

    return vectors.select("rid", "v").mapInArrow(run, MEMBER)


def assigned(members: DataFrame, books: np.ndarray) -> DataFrame:
    """Members with their nearest entry now, and whether that is another one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, part, entry, salt = (batch.column(k).to_numpy() for k in range(4))
            x = _matrix(batch.column(4), len(rid))
            now, error = np.empty(len(rid), np.int32), np.empty(len(rid), np.int64)
            for p in np.unique(part):
                own = part == p
                now[own], error[own] = _nearest(x[own], books[p])
            yield _rows(rid, part, now, salt, x, now != entry, error)

    return members.select("rid", *OWNER, "x").mapInArrow(run, MEMBER)


def _moved_in(movers: DataFrame) -> DataFrame:
    """Movers, written by their new owners."""
    n = partitions(movers.sparkSession)
    return settle(movers.select("rid", *OWNER, "x").repartition(n, *OWNER), "members")


def updated(members: DataFrame, books: np.ndarray) -> np.ndarray:
    """New codebooks: the floor of each entry's mean; entries without members stay.

    Owners sum up their members, and a row per entry comes to the driver.
    """
    parts, entries, width = books.shape
    sums = members.groupBy("part", "entry").agg(
        F.count("*").alias("n"), *[F.sum(F.col("x")[k]).alias(f"s{k}") for k in range(width)])
    books = books.copy()
    for r in sums.collect():
        books[r["part"], r["entry"]] = [r[f"s{k}"] // r["n"] for k in range(width)]
    return books


def trained(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
            rounds: int = ROUNDS) -> tuple[np.ndarray, DataFrame]:
    """Codebooks after some rounds, and every part with its entry and error in the end."""
    spark = vectors.sparkSession
    books = first_codebooks(vectors, parts, entries)
    members = _moved_in(cut(vectors, books, partitions(spark)))
    for k in range(rounds):
        books = updated(members, books)
        if k + 1 < rounds:
            path = scratch_path(spark, "assigned")
            assigned(members, books).write.partitionBy("moved").parquet(path)
            found = spark.read.schema(MEMBER).parquet(path)
            members = found.filter(~F.col("moved")).select("rid", *OWNER, "x").unionByName(
                _moved_in(found.filter("moved")))
    return books, assigned(members, books)


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by position, entry and place."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def codes(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES,
          rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """Code and error of every vector, the error per label, and a digest of the codebooks.

    Rows whose vector is null, or holds a null, NaN or infinite component, are
    left out.  Vectors of different lengths are filled up with zeros, also to a
    multiple of ``parts``; scaled components beyond 2^24 count as that.  Null
    ids are the largest; repeated rows each give a row.  Codebooks of fewer
    vectors than ``entries`` have an entry for each.  No vectors, no rows.
    """
    vectors = scaled(embeddings, parts, scale)
    if vectors.isEmpty():
        none = F.lit(None)
        return vectors.select("vec_id", none.cast("string").alias("code"), none.cast("long").alias("error"),
                              none.cast("long").alias("label_error"),
                              none.cast("string").alias("codebooks_sha256"))
    books, found = trained(vectors, parts, entries, rounds)
    entry = [F.max(F.when(F.col("part") == p, F.col("entry"))) for p in range(parts)]
    coded = settle(found.groupBy("rid").agg(
        F.concat(*[F.lower(F.lpad(F.hex(e), 2, "0")) for e in entry]).alias("code"),
        F.sum("error").alias("error"),
    ).join(vectors.select("rid", "vec_id", "label"), "rid"), "codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def _round_sql(k: int) -> str:
    """Assignment by codebook ``k - 1`` and codebook ``k``."""
    return f"""
a{k} AS (SELECT rid, p, any_value(x) AS x, min(d * 64 + e) AS best FROM (
  SELECT rid, parts.p, x, e, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM parts JOIN b{k - 1} USING (p)) GROUP BY rid, p),
s{k} AS (SELECT p, e, i, sum(y)::BIGINT AS s, count(*) AS n FROM (
  SELECT p, best % 64 AS e, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY p, e, i),
m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY p, e),
b{k} AS (SELECT p, e, coalesce(m{k}.c, b{k - 1}.c) AS c FROM b{k - 1} LEFT JOIN m{k} USING (p, e))"""


#: For vectors of one length that sixteen divides.
ORACLE = f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
parts AS (
  SELECT rid, p, list_slice(v, p * len(v) // 16 + 1, (p + 1) * len(v) // 16) AS x
  FROM kept, range(16) AS r(p)),
b0 AS (SELECT p, rid - 1 AS e, x AS c FROM parts WHERE rid <= 64),
{_round_sql(1)}, {_round_sql(2)}, {_round_sql(3)},
coded AS (
  SELECT rid, string_agg(lpad(lower(to_hex(best % 64)), 2, '0'), '' ORDER BY p) AS code,
    sum(best // 64)::BIGINT AS error FROM a3 GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(y, ',' ORDER BY p, e, i)) FROM (
    SELECT p, e, unnest(c)::VARCHAR AS y, generate_subscripts(c, 1) AS i FROM b2)) AS codebooks_sha256
FROM coded JOIN kept USING (rid)
"""
