"""Repeated passages, found by sliding spans of short sentences.

A text is cut into *units*: at the ends of sentences and lines, and inside of
sentences after one word in ``ONE_IN``, told by the word's hash.  Where that
leaves more than ``LONG`` words without a cut, every window of so many words is
cut after its word of the least hash, every one of them if several have it.  So
cuts depend on the words next to them and not on how long the sentence is or
where a passage starts, and runs of one word are cut too.

From every unit a span runs over the units that follow until it has ``WORDS``
words.  A cut is never more than ``LONG`` words away, so 51 words that two texts
share hold a common span, wherever they start; only cuts that a window across
the passage's end adds can spoil that.

Each text is cut and hashed once, and the hashes are written.  They are joined
over all documents; units covered by a span that came earlier, in the same text
or in a document of a smaller id, are removed.  Only texts of which something
goes are cut again for that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import settle

#: Words of a span at least; one word in so many ends a unit; words without a cut at most.
WORDS, ONE_IN, LONG = 27, 12, 12
SENTENCE_END = (".", "!", "?")
WORD = re.compile(r"\S+\s*")
NO_ID = -2**63
#: Words a worker remembers the hash of, and how long such a word may be.
CACHED, CACHED_CHARS = 500_000, 40

HASHED = "id long, mark long, hashes array<long>, repeats boolean"
DONE = "id long, text string, n_units long, n_words long"


class _Words(dict):
    """Hashes of words, of which the lowest bit tells whether a unit ends with the word."""

    def __missing__(self, word: str) -> int:
        import xxhash

        own = xxhash.xxh64_intdigest(word)
        ends = word.endswith(SENTENCE_END) or (own >> 32) % ONE_IN == 0
        own = own & ~1 | ends
        if len(self) < CACHED and len(word) <= CACHED_CHARS:
            self[word] = own
        return own


@cache
def _words() -> _Words:
    return _Words()


@cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    one = 0x9E3779B97F4A7C15
    with np.errstate(over="ignore"):
        return tuple(np.r_[np.uint64(1), np.cumprod(np.full(size, x, np.uint64))]
                     for x in (one, pow(one, -1, 2**64)))


def _in_a_row(values: np.ndarray, pick) -> np.ndarray:
    """``pick`` of every ``LONG`` values in a row, from twos to fours and so on."""
    wide = 1
    while wide < LONG:
        step = min(wide, LONG - wide)
        values = pick(values[:-step], values[step:])
        wide += step
    return values


def _least(own: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Which words have the least hash of a window of ``LONG`` words without a cut before its last word."""
    if len(own) < LONG:
        return np.zeros(len(own), bool)
    cuts = np.cumsum(np.r_[0, cut])
    inside = cuts[LONG - 1:-1] == cuts[:len(own) - LONG + 1]
    windows = np.where(inside, _in_a_row(own, np.minimum), np.uint64(0))
    none = np.zeros(LONG - 1, np.uint64)
    return (own == _in_a_row(np.r_[none, windows, none], np.maximum)) & (own > 0)


def _units(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts put one after the other: hashes of their lower-case words, the number of
    words up to the end of each unit, and up to the end of each text."""
    words: list[str] = []
    lines, ends_of_texts = [], []
    for text in texts:
        for line in text.lower().split("\n"):
            words += line.split()
            lines.append(len(words))
        ends_of_texts.append(len(words))
    own = np.fromiter(map(_words().__getitem__, words), np.uint64, len(words))
    cut = (own & np.uint64(1)).astype(bool)
    lines = np.array(lines)
    cut[lines[lines > 0] - 1] = True
    ends = np.flatnonzero(cut) + 1
    sizes = np.diff(np.r_[0, ends])
    cut |= _least(own, cut) & np.repeat(sizes > LONG, sizes)
    return own, np.flatnonzero(cut) + 1, np.array(ends_of_texts)


def _spans(own: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First unit, unit behind the last, and hash of every span that lies in one text."""
    starts = np.r_[0, ends[:-1]] if len(ends) else ends
    behind = np.searchsorted(ends, starts + WORDS) + 1
    inside = behind <= len(ends)
    inside[inside] = ends[behind[inside] - 1] <= texts[np.searchsorted(texts, starts[inside], "right")]
    first = np.flatnonzero(inside)
    behind = behind[first]
    up, down = _powers(1 << max(len(own), 1024).bit_length())
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(own * up[:len(own)], dtype=np.uint64)]
        a, b = starts[first], ends[behind - 1]
        h = (sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)
        h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return first, behind, (h ^ h >> np.uint64(32)).view(np.int64)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with ``mark``, which tells different texts of one id apart."""
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), "text")


def span_hashes(docs: DataFrame) -> DataFrame:
    """The different ``hashes`` of every text's spans, and if it ``repeats`` one; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                own, ends, texts = _units([t.as_py() or "" for t in part.column(2)])
                first, _, hashes = _spans(own, ends, texts)
                of = np.searchsorted(texts, ends[first] - 1, "right")
                order = np.lexsort((hashes, of))
                of, hashes = of[order], hashes[order]
                new = np.r_[True, (of[1:] != of[:-1]) | (hashes[1:] != hashes[:-1])][:len(of)]
                sizes = np.bincount(of[new], minlength=len(texts))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()),
                                                 pa.array(hashes[new]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), lists, pa.array(sizes < np.bincount(of, minlength=len(texts)))],
                    names=["id", "mark", "hashes", "repeats"])

    return settle(_keyed(docs).mapInArrow(run, HASHED), "spans")


def seen_before(hashed: DataFrame) -> DataFrame:
    """``id, mark, seen``: of texts that lose something, the hashes a smaller id has as well."""
    spans = hashed.select("id", "mark", F.explode("hashes").alias("h"))
    firsts = spans.groupBy("h").agg(F.min("id").alias("first"), F.max("id").alias("last"))
    # Written: the join can only split a hot passage if neither side is grouped on the way into it.
    firsts = settle(firsts.where(F.col("first") < F.col("last")).select("h", "first"), "firsts")
    again = spans.join(firsts, "h").where(F.col("id") > F.col("first")).select("id", "mark", "h")
    own = hashed.where("repeats").select("id", "mark", F.lit(None).cast("long").alias("h"))
    # A set of one text's hashes, whatever the number of equal rows; nulls don't get into it.
    return again.unionByName(own).groupBy("id", "mark").agg(F.collect_set("h").alias("seen"))


def _without(text: str, seen: np.ndarray) -> tuple[str, int, int]:
    """A text without its repeated units, how many these are, and their words."""
    own, ends, texts = _units([text])
    first, behind, hashes = _spans(own, ends, texts)
    again = np.ones(len(hashes), bool)
    again[np.unique(hashes, return_index=True)[1]] = False  # the first of equal ones in this text
    again |= np.isin(hashes, seen)
    gone = np.zeros(len(ends) + 1, np.int64)
    np.add.at(gone, first[again], 1)
    np.add.at(gone, behind[again], -1)
    away = np.cumsum(gone)[:-1] > 0
    of_words = np.repeat(away, np.diff(np.r_[0, ends]))
    parts = WORD.findall(text)
    if parts:
        parts[0] = text[:len(text) - len(text.lstrip())] + parts[0]
    left = "".join(p for p, x in zip(parts, of_words, strict=True) if not x)
    return left, int(away.sum()), int(of_words.sum())


def without_repeats(docs: DataFrame) -> DataFrame:
    """Every row's text without repeated passages, how many units went, and how many words.

    A null text is empty and gives an empty text.  Rows of one id are one
    document: what they share with each other is not removed.  Rows without an
    id are taken for one document that comes before all others.
    """
    rows = _keyed(docs).join(seen_before(span_hashes(docs)), ["id", "mark"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = []
                for text, seen in zip(part.column(1), part.column(2), strict=True):
                    text, known = text.as_py() or "", seen.values
                    found.append((text, 0, 0) if known is None else _without(
                        text, known.to_numpy(zero_copy_only=False)))
                texts, units, words = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(texts, pa.string()), pa.array(units, pa.int64()),
                     pa.array(words, pa.int64())], names=["id", "text", "n_units", "n_words"])

    done = rows.select("id", "text", "seen").mapInArrow(run, DONE)
    return done.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text",
                       F.col("n_units").alias("removed_sentences"), F.col("n_words").alias("removed_words"))
