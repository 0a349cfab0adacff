"""Exact duplicates by a tree merge of sorted digest runs.

Every partition turns its texts into one sorted run, a row per digest with the
largest id and the number of rows seen.  Slots then exchange runs in rounds:
in round ``r`` the eight slots that differ in digit ``r`` only deal their rows
among themselves by digit ``r`` of the digest, and each merges what it got.
After the last round a slot owns a range of digests.  A text that makes up a
third of all rows is one row per run from the start, and no slot ever gets
more than eight runs of one digest.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.base import anchored, partitions, unpacked
from wayline.session import settle

#: Slots that merge their runs in one round.
FAN_IN = 8
#: Rows gathered before a run is merged within its partition.
RUN_ROWS = 200_000

RUN = ("text_sha256 string, n_bytes long, mark long, keep_id long, keep_rid long, n long")


def digests(text: Column) -> dict[str, Column]:
    """SHA-256, length and a second hash of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return {"text_sha256": F.sha2(text, 256), "n_bytes": F.octet_length(text).cast("long"),
            "mark": F.xxhash64(text)}


def _merged(rows: pa.Table) -> pa.Table:
    """One row per digest, sorted: the largest id, the last of its rows, their number."""
    rows = rows.sort_by([(c, "ascending") for c in
                         ("text_sha256", "n_bytes", "mark", "keep_id", "keep_rid")])
    n = rows.num_rows
    same = np.ones(n - 1, bool)
    for name in ("text_sha256", "n_bytes", "mark"):
        column = rows[name].combine_chunks()
        same &= pa.compute.equal(column[:-1], column[1:]).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[starts[1:], n] - 1
    counts = np.add.reduceat(rows["n"].to_numpy(), starts)
    return rows.take(last).set_column(5, "n", pa.array(counts, pa.int64()))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[pa.Table] = []
    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        if sum(t.num_rows for t in held) >= RUN_ROWS:
            held = [_merged(pa.concat_tables(held))]
            if held[0].num_rows > RUN_ROWS // 2:  # mostly different texts: pass the run on
                yield from held.pop().to_batches()
    held = [t for t in held if t.num_rows]
    if held:
        yield from _merged(pa.concat_tables(held)).to_batches()


def merged_runs(rows: DataFrame) -> DataFrame:
    """Groups of equal texts, from rows with ``doc_id``, ``rid`` and the digests.

    Texts are one group if SHA-256, length and second hash all agree.  An id
    that is null is smaller than any other; of repeated rows one is chosen.
    """
    # -2^63 stands for a null id while runs are sorted.
    runs = rows.select(
        "text_sha256", "n_bytes", "mark",
        F.coalesce("doc_id", F.lit(-2**63)).alias("keep_id"),
        F.col("rid").alias("keep_rid"), F.lit(1).cast("long").alias("n"),
    ).mapInArrow(_run, RUN)

    levels = 1
    while FAN_IN ** levels < partitions(rows.sparkSession):
        levels += 1
    slots = FAN_IN ** levels
    # A level's digit of the digest, from its first 48 bits.
    owner = F.conv(F.substring("text_sha256", 1, 12), 16, 10).cast("long") % slots
    runs = runs.withColumn("slot", (F.spark_partition_id() % slots).cast("int"))
    for level in range(levels):
        mask = (FAN_IN - 1) * FAN_IN ** level
        target = F.col("slot").bitwiseAND(~mask).bitwiseOR(owner.cast("int").bitwiseAND(mask))
        # The maximum of a struct makes Spark merge sorted rows, not hash them.
        runs = (
            runs.withColumn("slot", target.cast("int"))
            .repartitionById(slots, F.col("slot"))
            .groupBy("slot", "text_sha256", "n_bytes", "mark")
            .agg(F.max(F.struct("keep_id", "keep_rid")).alias("keep"), F.sum("n").alias("n"))
            .select("slot", "text_sha256", "n_bytes", "mark", "keep.keep_id", "keep.keep_rid", "n")
        )
    return runs.select(
        "text_sha256", "n_bytes", "mark",
        F.when(F.col("keep_id") != -2**63, F.col("keep_id")).alias("keep_id"), "keep_rid",
        F.col("n").alias("group_size"))


def _with_groups(rows: DataFrame) -> DataFrame:
    keys = ["text_sha256", "n_bytes", "mark"]
    return rows.join(merged_runs(rows), keys).withColumn("kept", F.col("rid") == F.col("keep_rid"))


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row with the row of its group that stays, the group's size and the digest.

    Null texts count as empty.  The largest id stays; with repeated rows of
    that id, one of them does.  A group of null ids has a null ``keep_id``.
    """
    rows = settle(docs.select(
        F.col(doc_id).alias("doc_id"), F.monotonically_increasing_id().alias("rid"),
        *[c.alias(n) for n, c in digests(F.col(text)).items()]), "digests")
    return _with_groups(rows).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def distinct_texts(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    rows = anchored(docs, "distinct", **digests(F.col(text)))
    kept = merged_runs(rows.select(F.col("row").getField(doc_id).alias("doc_id"), "rid",
                                   "text_sha256", "n_bytes", "mark"))
    return unpacked(rows.join(kept.select(F.col("keep_rid").alias("rid")), "rid", "left_semi"),
                    docs.columns)


ORACLE = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
