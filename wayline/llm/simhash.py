"""Near duplicates by SimHash and a hierarchical index over fingerprints in Gray order.

Fingerprints of texts that differ in a few words differ in a few bits.  All
pairs within ``BITS`` bits are found without comparing all pairs:

1. Bits are dealt to six groups.  Two fingerprints at most four bits apart
   agree in two whole groups at least, so every fingerprint is filed under its
   bits in each of the 15 pairs of groups; these masked bits are the top nodes
   of the index.  Top nodes with a single fingerprint are dropped at once.
2. Below a top node fingerprints are sorted by Gray rank, so that neighbours
   differ in few bits, and gathered in nodes of sixteen, these again in nodes
   of sixteen, and so on.  A node holds the bits that all below it share.
3. Two nodes are compared by the bits that both share and their parents did
   not: the differences add up from level to level, and once there are more
   than ``BITS``, all pairs below are pruned at one blow.  So are nodes that
   are already connected.

A top node with very many fingerprints is dealt in blocks, and each pair of
blocks is a piece of work of its own.  What comes out are links that connect
what is close, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.llm.base import anchored, unpacked
from wayline.llm.components import components
from wayline.session import settle

WORDS, BITS, GROUPS = 4, 4, 6
#: Children of a node; node pairs looked at together; fingerprints of a block.
FAN_OUT, PAIRS_AT_ONCE, BLOCK = 16, 1 << 18, 1 << 15
#: Shingles hashed at once.
SHINGLES = 1 << 16


def masks(bits: int = BITS, groups: int = GROUPS) -> list[int]:
    """Masks of the top nodes: all choices of ``groups - bits`` groups of bits."""
    borders = [round(64 * k / groups) for k in range(groups + 1)]
    parts = [(1 << hi) - (1 << lo) for lo, hi in zip(borders, borders[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(parts, groups - bits)]


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """SimHash of the shingles of ``words`` words; 0 for a text without words."""
    import xxhash

    found = text.lower().split()  # A-Z only, and at space and \x09-\x0D
    if not found:
        return 0
    n = max(len(found) - words + 1, 1)
    votes = np.zeros(64, np.int64)
    for lo in range(0, n, SHINGLES):
        part = found[lo:lo + SHINGLES + words - 1]
        count = min(SHINGLES, n - lo)
        columns = [part[k:] for k in range(words)] if len(found) >= words else [[b" ".join(found)]]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(b" ".join, zip(*columns, strict=False)),
                                 repeat(42)), np.uint64, count)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(count, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * votes > n, bitorder="little")
    return int.from_bytes(ones.tobytes(), "little")


def with_fingerprint(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """Rows of ``doc_id``, ``rid`` and ``text`` (bytes) with ``fp``, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or b"", words) for t in batch.column(2)], np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(found.view(np.int64))],
                names=["doc_id", "rid", "fp"])

    return rows.select("doc_id", "rid", "text").mapInArrow(run, "doc_id long, rid long, fp long")


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Place of each code in the order of the reflected Gray code."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Index over groups of fingerprints; ``group`` is sorted and codes differ within a group."""

    def __init__(self, group: np.ndarray, codes: np.ndarray):
        order = np.lexsort((gray_rank(codes), group))
        self.codes, group = codes[order], group[order]
        #: Levels from the codes up to one node per group: shared bits, pattern, first child, group.
        self.ones, self.zeros = [self.codes], [~self.codes]
        self.first: list[np.ndarray] = []
        while True:
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            within = np.arange(len(group)) - np.repeat(starts, np.diff(np.r_[starts, len(group)]))
            heads = np.flatnonzero(within % FAN_OUT == 0)
            self.first.append(np.r_[heads, len(group)])
            self.ones.append(np.bitwise_and.reduceat(self.ones[-1], heads))
            self.zeros.append(np.bitwise_and.reduceat(self.zeros[-1], heads))
            group = group[heads]
            if len(heads) == len(starts):
                break
        self.label = np.arange(len(self.codes))

    def _connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Give linked codes the same label, the smallest of them."""
        label = self.label
        while True:
            la, lb = label[a], label[b]
            apart = la != lb
            if not apart.any():
                return
            a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
            np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
            while True:
                further = label[label]
                if np.array_equal(further, label):
                    break
                label[:] = further

    def _joined(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest label below every node of a level."""
        low = high = self.label
        for k in range(level):
            low = np.minimum.reduceat(low, self.first[k][:-1])
            high = np.maximum.reduceat(high, self.first[k][:-1])
        return low, high

    def link(self, bits: int = BITS) -> np.ndarray:
        """Label of every code; codes connected by steps of up to ``bits`` bits share one."""
        top = len(self.first)
        roots = np.arange(len(self.ones[top]))
        work = [(top, roots, roots, np.zeros(len(roots), np.uint8))]
        while work:
            level, a, b, differences = work.pop()
            if len(a) > PAIRS_AT_ONCE:
                half = len(a) // 2
                work += [(level, a[:half], b[:half], differences[:half]),
                         (level, a[half:], b[half:], differences[half:])]
                continue
            low, high = self._joined(level)
            open_ = ~((low[a] == high[a]) & (low[b] == high[b]) & (low[a] == low[b]))
            a, b, differences = a[open_], b[open_], differences[open_]
            if not len(a):
                continue
            below, first = level - 1, self.first[level - 1]
            na, nb = first[a + 1] - first[a], first[b + 1] - first[b]
            # All children of a with all of b, in portions that fit the memory.
            sizes = na * nb
            if sizes.sum() > 4 * PAIRS_AT_ONCE and len(a) > 1:
                half = len(a) // 2
                work += [(level, a[:half], b[:half], differences[:half]),
                         (level, a[half:], b[half:], differences[half:])]
                continue
            pair = np.repeat(np.arange(len(a)), sizes)
            at = np.arange(len(pair)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            x, y = first[a][pair] + at // nb[pair], first[b][pair] + at % nb[pair]
            once = (a[pair] != b[pair]) | (x <= y)
            if below == 0:
                once &= x != y
            pair, x, y = pair[once], x[once], y[once]
            pa_, pb = a[pair], b[pair]
            ones, zeros, up1, up0 = self.ones[below], self.zeros[below], self.ones[level], self.zeros[level]
            # A bit differs for all pairs below if one side has it in all codes and the other in none.
            now = (ones[x] & zeros[y]) | (zeros[x] & ones[y])
            before = (up1[pa_] & up0[pb]) | (up0[pa_] & up1[pb])
            total = differences[pair] + np.bitwise_count(now & ~before)
            near = total <= bits
            x, y, total = x[near], y[near], total[near].astype(np.uint8)
            if below:
                work.append((below, x, y, total))
            else:
                self._connect(x, y)
        return self.label


def _links(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links among fingerprints of the same group; rows come sorted by group."""

    def found(group: np.ndarray, codes: np.ndarray):
        if len(codes) < 2:
            return
        index = GrayIndex(group, codes)
        label = index.link(bits)
        moved = np.flatnonzero(label != np.arange(len(label)))
        if len(moved):
            yield pa.RecordBatch.from_arrays(
                [pa.array(index.codes[moved].view(np.int64)),
                 pa.array(index.codes[label[moved]].view(np.int64))], names=["a", "b"])

    keys, codes, last = [], [], 0  # groups are numbered as they come
    previous = None
    held = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)]
        new = np.zeros(batch.num_rows, bool)
        new[0] = previous is not None and tuple(c[0] for c in columns[:4]) != previous
        for c in columns[:4]:
            new[1:] |= c[1:] != c[:-1]
        previous = tuple(c[-1] for c in columns[:4])
        number = last + np.cumsum(new)
        last = int(number[-1])
        keys.append(number)
        codes.append(columns[4].astype(np.int64).view(np.uint64))
        held += batch.num_rows
        if held >= BLOCK:  # all groups but the last are complete
            group, code = np.concatenate(keys), np.concatenate(codes)
            border = int(np.searchsorted(group, last))
            yield from found(group[:border], code[:border])
            keys, codes, held = [group[border:]], [code[border:]], 0
    if keys:
        yield from found(np.concatenate(keys), np.concatenate(codes))


def fingerprint_links(fps: DataFrame, bits: int = BITS, groups: int = GROUPS,
                      block: int = BLOCK) -> DataFrame:
    """Links ``a``, ``b`` that connect all distinct ``fp`` within ``bits`` bits of each other."""
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(m - (m >> 63 << 64))).alias("top"))
        for k, m in enumerate(masks(bits, groups))])
    filed = fps.select("fp", F.explode(tables).alias("x")).select("x.t", "x.top", "fp")
    crowds = filed.groupBy("t", "top").agg(F.count("*").alias("n")).where("n > 1")
    crowds = crowds.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    filed = filed.join(crowds, ["t", "top"])
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(
        F.least(own, k).alias("i"), F.greatest(own, k).alias("j")))
    dealt = filed.select("t", "top", F.explode(pairs).alias("p"), "fp").select("t", "top", "p.i", "p.j", "fp")
    dealt = dealt.repartition("t", "top", "i", "j").sortWithinPartitions("t", "top", "i", "j")
    return dealt.mapInArrow(lambda batches: _links(batches, bits), "a long, b long").distinct()


def fingerprint_classes(fps: DataFrame, bits: int = BITS) -> DataFrame:
    """``fp`` and ``root`` for fingerprints that are linked with a smaller one."""
    found = components(fingerprint_links(fps, bits))
    return found.select(F.col("node").alias("fp"), "root")


def _with_class(rows: DataFrame, bits: int) -> DataFrame:
    """Add ``class_fp``, the fingerprint that stands for a row's component."""
    classes = fingerprint_classes(rows.select("fp").distinct(), bits)
    return rows.join(classes, "fp", "left").withColumn("class_fp", F.coalesce("root", "fp")).drop("root")


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """Every row with its fingerprint and its component's smallest id.

    Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows give repeated rows; a component whose ids are all null has a
    null id.
    """
    source = docs.select(F.col("doc_id").cast("long"), F.lit(0).cast("long").alias("rid"),
                         F.col("text").cast("binary").alias("text"))
    rows = settle(with_fingerprint(source, words).drop("rid"), "fingerprints")
    rows = settle(_with_class(rows, bits), "classes")
    # Written: a join can only split a hot class if neither side is grouped on the way into it.
    ids = settle(rows.groupBy("class_fp").agg(F.min("doc_id").alias("component_id")), "components")
    return rows.join(ids, "class_fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component: that with the smallest id."""
    held = anchored(docs, "near")
    source = held.select(F.col("row").getField("doc_id").cast("long").alias("doc_id"), "rid",
                         F.col("row").getField("text").cast("binary").alias("text"))
    rows = settle(with_fingerprint(source, words), "fingerprints")
    rows = _with_class(rows, bits)
    first = rows.groupBy("class_fp").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "rid")).alias("first"))
    return unpacked(held.join(first.select(F.col("first.rid").alias("rid")), "rid", "left_semi"),
                    docs.columns)
