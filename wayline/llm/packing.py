"""Documents packed into sequences of one length: concatenate and cut.

All documents form one stream of tokens that is cut into windows.  The place
of a document in the stream takes two passes: the first turns texts into
tokens, writes them with their running start inside their partition, and sums
the partitions; prefix sums over those totals (a row per partition) shift
every document to its global place.  The second pass cuts each document at the
window borders.  Only the last window is padded.  No tokens are shuffled.
"""

from __future__ import annotations

import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayline.session import settle

SEQUENCE = 4096
END_ID = 2
#: Words whose tokens a Python worker remembers, and how long such a word may be.
CACHED_WORDS, CACHED_CHARS = 400_000, 64

TOKENS = "doc_id long, part long, start_in_part long, n long, ids binary"
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Letters, then ASCII marks other than the apostrophe: each part is one piece to the tokenizer.
SIMPLE = re.compile(r"([^\W\d_]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Letters that stand for bytes in this kind of vocabulary: printable ones for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder:
    """Text to token ids, word by word.

    This vocabulary drops white space and never joins what it separates, so a
    text's tokens are those of its words in turn; ``test_words_alone_give_the_tokens``
    holds that to the library.  Simple words go to the merges at once; words
    met first, which are the frequent ones, are remembered.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known: dict[bytes, bytes] = {}

    def _lower(self, word: str) -> str | None:
        """Small letters as the vocabulary writes them; None if that takes the library."""
        if word.isascii():
            return word.lower()
        lower = "".join(map(str.lower, word))
        if not (lower.isalpha() and unicodedata.is_normalized("NFC", word)):
            return None
        return lower.encode().decode("latin-1").translate(self.letters)

    def learn(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        match = SIMPLE.fullmatch(text)
        lower = self._lower(match[1]) if match else None
        if lower is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = [t.id for t in self.merge(lower)] if lower else []
            if match[2]:
                ids += [t.id for t in self.merge(match[2])]
        return struct.pack(f"<{len(ids)}I", *ids)

    def __call__(self, text: bytes) -> bytes:
        words = text.split()  # splits at space and \x09-\x0D
        known = self.known
        new = set(words).difference(known)
        if not new:
            return b"".join(map(known.__getitem__, words))
        learnt = {w: self.learn(w) for w in new}
        if len(known) < CACHED_WORDS:
            known.update((w, ids) for w, ids in learnt.items() if len(w) <= CACHED_CHARS)
        return b"".join([learnt[w] if w in learnt else known[w] for w in words])


@cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def tokenized(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Token ids (little-endian, 32 bits) of each text with an end token, written once.

    ``part`` is the partition that wrote a row and ``start_in_part`` the number
    of tokens it wrote before.
    """
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, start = _encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for lo in range(0, batch.num_rows, 256):
                ids = [encode(t.as_py() or b"") + end for t in texts[lo:lo + 256]]
                n = np.array([len(x) // 4 for x in ids], np.int64)
                starts = start + np.r_[0, np.cumsum(n)[:-1]]
                start += int(n.sum())
                yield pa.RecordBatch.from_arrays(
                    [doc_ids[lo:lo + 256], pa.array(np.full(len(n), part)), pa.array(starts),
                     pa.array(n), pa.array(ids, pa.binary())],
                    names=["doc_id", "part", "start_in_part", "n", "ids"])

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    return settle(texts.mapInArrow(run, TOKENS), "tokens")


def with_places(tokens: DataFrame) -> DataFrame:
    """Add ``place``, the number of tokens before each document in the whole stream."""
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per partition written, so the window and the broadcast are bounded by their number.
    shifts = totals.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("shift"))
    return tokens.join(F.broadcast(shifts), "part").withColumn(
        "place", F.col("shift") + F.col("start_in_part"))


def cut(tokens: DataFrame, length: int = SEQUENCE) -> DataFrame:
    """Pieces of documents between the borders of the windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc_id, place, n, ids in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(place + start, length)
                    size = min(length - offset, n - start)
                    crc = zlib.crc32(ids[4 * start:4 * (start + size)])
                    for column, value in zip(out, (doc_id, start, size, crc, n, sequence, offset),
                                             strict=True):
                        column.append(value)
                    start += size
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return tokens.select("doc_id", "place", "n", "ids").mapInArrow(run, PIECES)


def pack(docs: DataFrame, path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """Every document's pieces with their sequence and offset in it.

    A null text is packed as its end token alone; repeated rows and rows
    without an id are packed like any other.  No rows give no pieces.
    """
    return cut(with_places(tokenized(docs, path or tokenizer_path())), length)
