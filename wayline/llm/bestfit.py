"""Documents packed into few sequences of one length by best fit, in bulk rounds.

A document longer than a sequence is cut, its first piece being the shorter
one.  Sizes are then placed in bands, from the largest down to half of it.  In
every round the band's pieces and the *gaps*, which are sequences with room
left, are range-sorted together by size, a gap before a piece it just holds.
The sweep over that order is a walk that goes up at a gap and down at a piece:
a piece takes the gap that last rose to its level, the smallest one large
enough that no piece before it took.  The walk's height is a prefix sum over
the range partitions, and who is next to whom on a level is a window per level,
so the whole sweep is two shuffles of small rows.  Pieces that compete for a
gap thereby get it by rank; the others try again with the gaps as they are now,
and open new sequences when none of them fits any more.

Where pieces are small, a gap offers several equal slots at once.  A gap that
takes pieces loses about half its room or more, so the number of rounds grows
with the logarithm of the length, not with the documents.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache, reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.llm.packing import END_ID, _byte_letters
from wayline.operators.prefix import prefix_scan
from wayline.session import settle

SEQUENCE = 1024

PIECE = "doc_id long, piece int, start long, length long, ids binary"
PLACE = "rid long, size long, seq long"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- tokens ------------------------------------------------------------------


class ByteEncoder:
    """Text to the ids the ``tokenizers`` library gives for a byte-level vocabulary.

    The vocabulary's ids follow its merges, so the quicker merging by rank of
    ``tiktoken`` comes to the same ids; a test holds it to the library.  Names
    of special tokens are ordinary text.
    """

    #: White space in a row from which on the library splits the text instead.
    LONG = 10_000

    def __init__(self, path: str):
        import regex
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as lines:
            vocab = json.load(lines)["model"]["vocab"]
        letters = {letter: byte for byte, letter in _byte_letters().items()}
        special = {t.content for t in self.tokenizer.get_added_tokens_decoder().values()}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        self.fast = tiktoken.Encoding("words", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.blank = regex.compile(r"\s{%d}" % self.LONG)

    def __call__(self, text: str) -> list[int]:
        if len(text) > self.LONG and self.blank.search(text):
            return self.tokenizer.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


@cache
def _encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def pieces(docs: DataFrame, path: str | None = None, length: int = SEQUENCE,
           end_id: int = END_ID) -> DataFrame:
    """Each document's token ids (little-endian, 32 bits) in pieces, written once.

    A null text has its end token alone.  ``rid`` numbers the pieces of all
    rows, also of repeated ones and of those without an id.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                out: list[list] = [[] for _ in range(5)]
                for doc_id, text in zip(batch.column(0)[lo:lo + 256], batch.column(1)[lo:lo + 256],
                                        strict=True):
                    ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                    ends = range((len(ids) - 1) % length + 1, len(ids) + 1, length)
                    for k, end in enumerate(ends):
                        start = ends[k - 1] if k else 0
                        for column, value in zip(
                                out, (doc_id.as_py(), k, start, end - start, ids[start:end].tobytes()),
                                strict=True):
                            column.append(value)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(
                        out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), "text")
    return settle(texts.mapInArrow(run, PIECE).withColumn("rid", F.monotonically_increasing_id()),
                  "pieces")


# --- rounds ------------------------------------------------------------------


def _sweep(waiting: DataFrame, gaps: DataFrame, top: int, slots: int) -> DataFrame:
    """Waiting pieces with the gap they get, or null, written.

    A gap offers as many slots as pieces of size ``top`` fit, ``slots`` at most
    and one at least, and parts its room evenly among them.
    """
    n = F.greatest(F.lit(1), F.least(F.lit(slots), F.expr(f"int(room div {top})")))
    offered = gaps.select("seq", "room", n.alias("n")).select(
        F.expr("room div n").alias("size"), F.lit(1).alias("up"), F.col("seq").alias("id"),
        F.explode(F.sequence(F.lit(1), "n")).alias("slot"))
    walk = offered.unionByName(waiting.select(
        "size", F.lit(-1).alias("up"), F.col("rid").alias("id"), F.lit(0).alias("slot")))
    walk = prefix_scan(walk, [F.desc("size"), F.desc("up"), F.asc("id"), F.asc("slot")], "at",
                       {"height": "up"})
    # A level is entered by a gap and left by a piece, in turns: at most two rows per
    # distinct size of either stand on one.
    level = Window.partitionBy(F.when(F.col("up") == 1, F.col("height") + 1).otherwise(
        F.col("height"))).orderBy("at")
    met = walk.select("size", "up", "id", F.lag("up").over(level).alias("last"),
                      F.lag("id").over(level).alias("seq"))
    return settle(met.filter("up = -1").select(
        F.col("id").alias("rid"), "size", F.when(F.col("last") == 1, F.col("seq")).alias("seq")), "sweep")


def _bands(sizes: dict[int, int], length: int) -> list[tuple[int, int]]:
    """Sizes up to half the length in bands ``(over, top)``, each down to half its largest size."""
    found, left = [], sorted(s for s in sizes if 2 * s <= length)
    while left:
        top = left[-1]
        found.append((top // 2, top))
        left = [s for s in left if s <= top // 2]
    return found


def _empty(spark: SparkSession, columns: str) -> DataFrame:
    return spark.createDataFrame([], columns)


def places(sizes: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """``rid``, ``size`` and ``seq`` for rows ``rid``, ``size`` of 1 to ``length`` tokens.

    A sequence that a piece opened has that piece's number, others have
    negative ones.  Every round is written, so a lost executor costs one round.
    """
    spark = sizes.sparkSession
    sizes = settle(sizes.select(F.col("rid").cast("long"), F.col("size").cast("long")), "sizes")
    # At most `length` different sizes come to the driver.
    known = {r["size"]: r["n"] for r in sizes.groupBy("size").agg(F.count("*").alias("n")).collect()}
    # No two pieces over half the length share a sequence: each opens its own.
    own = sizes.filter(F.col("size") * 2 > length).withColumn("seq", F.col("rid"))
    gaps = own.filter(F.col("size") < length).select("seq", (F.lit(length) - F.col("size")).alias("room"))
    placed, opened = [own], 0
    least = min(known, default=0)
    for over, top in _bands(known, length):
        waiting = sizes.filter((F.col("size") > over) & (F.col("size") <= top))
        left, fresh = sum(n for s, n in known.items() if over < s <= top), False
        while left:
            fit = gaps.filter(F.col("room") > over)
            n_gaps = fit.count()
            if n_gaps:
                swept = _sweep(waiting, fit, top, ceil(2 * left / n_gaps))
                got = swept.filter(F.col("seq").isNotNull())
                placed.append(got)
                used = got.groupBy("seq").agg(F.sum("size").alias("used"))
                gaps = settle(gaps.join(used, "seq", "left").select(
                    "seq", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room")
                ).filter(F.col("room") >= least), "gaps")
                waiting, before = swept.filter(F.col("seq").isNull()).select("rid", "size"), left
                left = waiting.count()
            if left and (not n_gaps or left == before):
                each = length // top
                new = ceil(left / each)
                gaps = gaps.unionByName(spark.range(opened, opened + new).select(
                    (-1 - F.col("id")).alias("seq"), F.lit(length).cast("long").alias("room")))
                opened += new
    return reduce(DataFrame.unionByName, placed)


def placed(found: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pieces (``rid``, ``length`` and any other columns) with ``sequence_id`` and ``offset``."""
    where = settle(places(found.select("rid", F.col("length").alias("size")), length), "places")
    before = Window.partitionBy("seq").orderBy(F.desc("size"), "rid").rowsBetween(
        Window.unboundedPreceding, -1)
    where = where.select("rid", F.col("seq").alias("sequence_id"),
                         F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("offset"))
    return found.join(where, "rid").drop("rid")


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Every document's pieces with their ids, and their place in a sequence.

    Empty and null texts are packed as their end token alone; repeated rows and
    rows without an id like any other; other columns of ``docs`` don't matter.
    No rows give no pieces.
    """
    return placed(pieces(docs, path, length), length)


def packed_digests(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """The same with a checksum in place of the ids, which then aren't shuffled."""
    found = pieces(docs, path, length)
    return placed(found.withColumn("ids_crc32", F.crc32("ids")).drop("ids"), length)
