"""Trie of conversations by shared first turns, screened by a count-min sketch.

A prefix is known by a 128-bit digest: the XOR of a hash of every turn together
with its depth.  As that can be put together from pieces, a conversation of any
length is digested in the slices a range sort cuts it into, and a turn's row
knows the digest of the prefix before it as well.

Each task counts its prefixes in a count-min sketch, of which only the buckets
in use are sent on.  A bucket that was hit once proves that the prefix in it
belongs to one conversation, and with it all longer ones: such tails are nodes
as they stand.  The buckets hit more often are a bitmap of bounded size, which
every task gets.  Only prefixes it can't tell are shuffled and grouped exactly,
so a false alarm costs a row on the way and never changes the result.

Sums over subtrees need no walk from depth to depth.  A node belongs to its
smallest member, and a conversation owns the nodes of its path from some depth
on.  So a subtree's sum is one over the node's members: what each of them owns
below the node, which is a running total.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayline.operators.prefix import prefix_scan
from wayline.session import settle

#: Rows of the sketch, buckets of a row per prefix, and at most (all rows: 2^26 * 3 bits, 24 MB).
ROWS, ROOM, WIDEST = 3, 8, 26
#: Buckets of a block in which parts of the sketch are merged, and prefixes a task counts at a time.
BLOCK, COUNTED = 2**16, 2_000_000
#: Characters of the decimal ids that are hashed at a time.
CHUNK = 1_000_000
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

NODE = ["k1", "k2", "depth"]
PARENT = ["p1", "p2"]
PREFIX = ["conv_id", "depth", "k1", "k2", "p1", "p2", "chars", "last"]


def _hashes(turn: Column, depth: Column) -> tuple[Column, Column]:
    depth = depth.cast("long")
    return F.xxhash64(turn, depth), F.xxhash64(depth, turn, F.lit("second"))


def turns(conversations: DataFrame) -> DataFrame:
    """Turns in order, in written slices: ``conv_id, turn, t, chars, n, slice``.

    ``t`` is a digest of role and text.  A null role or text counts as empty,
    a null turn comes first, turns of one number are in the order of ``t``.
    Rows without a ``conv_id`` belong to no conversation.
    """
    role, text = (F.coalesce(c, F.lit("")) for c in ("role", "text"))
    found = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"),
        F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text),
                                   256), 1, 32)).alias("t"),
        F.char_length(text).cast("long").alias("chars"),
        F.monotonically_increasing_id().alias("n"))
    return settle(found.repartitionByRange("conv_id", F.asc_nulls_first("turn"), "t", "n")
                  .withColumn("slice", F.spark_partition_id()), "turns")


def _xor(lanes: Column) -> Column:
    return F.aggregate(lanes, F.lit(0).cast("long"), lambda x, y: x.bitwiseXOR(y))


def _prefixes(found: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per prefix but the empty one, from ``turns`` and how conversations are rebuilt.

    ``convs`` has, per conversation, ``head``: the few turns ``(t, chars)`` it
    starts with, ``skipped``: how many of its own it leaves out, ``n_turns``.
    """
    convs = convs.withColumn("k", F.size("head"))
    lanes = (F.transform("head", lambda x, i: _hashes(x["t"], i + 1)[0]),
             F.transform("head", lambda x, i: _hashes(x["t"], i + 1)[1]))
    convs = convs.select("conv_id", "head", "skipped", "k", "n_turns", lanes[0].alias("l1"), lanes[1].alias("l2"))
    depth = F.col("depth")
    heads = convs.filter("k > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("k"))).alias("depth"))
    heads = heads.select(
        "conv_id", depth.cast("long").alias("depth"),
        *[_xor(F.slice(lane, F.lit(1), depth)).alias(k) for lane, k in (("l1", "k1"), ("l2", "k2"))],
        *[_xor(F.slice(lane, F.lit(1), depth - 1)).alias(k) for lane, k in (("l1", "p1"), ("l2", "p2"))],
        F.element_at("head", depth)["chars"].alias("chars"), (depth == F.col("n_turns")).alias("last"))

    # Where a conversation's turns go on from the slice before; a row per slice and conversation.
    at = ["slice", "conv_id"]
    earlier = Window.partitionBy("conv_id").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    known = found.groupBy(*at).agg(F.count("*").alias("n")).select(
        *at, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    known = known.join(convs.select("conv_id", "skipped", "k", "n_turns", _xor(F.col("l1")).alias("h1"),
                                    _xor(F.col("l2")).alias("h2")), "conv_id")
    here = Window.partitionBy(*at)
    place = F.col("before") + F.row_number().over(here.orderBy(F.asc_nulls_first("turn"), "t", "n"))
    own = found.join(known, at).withColumn("place", place).filter(F.col("place") > F.col("skipped"))
    own = own.withColumn("depth", F.col("k") + F.col("place") - F.col("skipped"))
    one, two = _hashes(F.col("t"), depth)
    own = settle(own.select(*at, "depth", "chars", (depth == F.col("n_turns")).alias("last"),
                            "h1", "h2", one.alias("l1"), two.alias("l2")), "own")
    sums = own.groupBy(*at).agg(F.bit_xor("l1").alias("l1"), F.bit_xor("l2").alias("l2"))
    zero = F.lit(0).cast("long")
    sums = sums.select(*at, *[F.coalesce(F.bit_xor(x).over(earlier), zero).alias(b)
                              for x, b in (("l1", "b1"), ("l2", "b2"))])
    run = here.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    key = [F.col(f"h{x}").bitwiseXOR(F.col(f"b{x}")).bitwiseXOR(F.bit_xor(f"l{x}").over(run)) for x in (1, 2)]
    own = own.join(sums, at).withColumns({"k1": key[0], "k2": key[1]})
    own = own.withColumns({"p1": F.col("k1").bitwiseXOR(F.col("l1")), "p2": F.col("k2").bitwiseXOR(F.col("l2"))})
    return heads.select(*PREFIX).unionByName(own.select(*PREFIX))


def as_they_are(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes, and ``conv_id, n_turns``, of conversations with all their turns and no others."""
    found = turns(conversations)
    convs = found.groupBy("conv_id").agg(F.count("*").alias("n_turns")).select(
        "conv_id", F.array().cast("array<struct<t:binary,chars:bigint>>").alias("head"),
        F.lit(0).cast("long").alias("skipped"), "n_turns")
    return _prefixes(found, convs), convs.select("conv_id", "n_turns")


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """The same of conversations that take over the start of another.

    Conversation ``c`` begins with the first ``h`` turns of ``c - c % every``
    (of none, if that is absent) in place of its own first ``h``, where ``h`` is
    the CRC-32 of its decimal id, modulo ``most + 1``.
    """
    found = turns(conversations)
    first = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "t", "n")
    heads = found.filter(F.col("conv_id") % every == 0).withColumn(
        "i", F.row_number().over(first)).filter(F.col("i") <= most)
    heads = heads.groupBy(F.col("conv_id").alias("base")).agg(F.transform(  # `most` turns at the most
        F.sort_array(F.collect_list(F.struct("i", "t", "chars"))),
        lambda x: F.struct(x["t"].alias("t"), x["chars"].alias("chars"))).alias("first"))
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (most + 1)
    convs = found.groupBy("conv_id").agg(F.count("*").alias("n")).select(
        "conv_id", "n", h.alias("skipped"), (F.col("conv_id") - F.col("conv_id") % every).alias("base"))
    none = F.array().cast("array<struct<t:binary,chars:bigint>>")
    convs = convs.join(heads, "base", "left").select("conv_id", "skipped", "n", F.slice(
        F.coalesce("first", none), F.lit(1), F.col("skipped").cast("int")).alias("head"))
    convs = settle(convs.withColumn("n_turns", F.size("head") + F.greatest(
        F.col("n") - F.col("skipped"), F.lit(0))), "conversations")
    return _prefixes(found, convs), convs.select("conv_id", "n_turns")


# --- sketch ------------------------------------------------------------------


def buckets(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """Numbers of a prefix's bucket in every row of a sketch of ``2 ** bits`` a row."""
    one, two = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    with np.errstate(over="ignore"):
        return np.stack([((one + np.uint64(j) * two) >> np.uint64(64 - bits)).astype(np.int64) + (j << bits)
                         for j in range(ROWS)])


def _counted(keys: list[np.ndarray], bits: int) -> pa.RecordBatch:
    """Buckets hit once and more often, as places in their blocks."""
    k1, k2 = (np.concatenate([k[x] for k in keys]) for x in (0, 1))
    hit, times = np.unique(buckets(k1, k2, bits), return_counts=True)
    block, starts = np.unique(hit // BLOCK, return_index=True)
    place, often = (hit % BLOCK).astype("<u2"), times > 1
    once, more = [], []
    for lo, hi in zip(starts, [*starts[1:], len(hit)], strict=True):
        once.append(place[lo:hi][~often[lo:hi]].tobytes())
        more.append(place[lo:hi][often[lo:hi]].tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array(block), pa.array(once, pa.binary()), pa.array(more, pa.binary())],
        names=["block", "once", "more"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bitmaps of the buckets hit more than once, from rows sorted by block."""
    now, count = None, np.zeros(BLOCK, np.uint8)

    def done() -> Iterator[pa.RecordBatch]:
        if now is not None and (count > 1).any():
            yield pa.RecordBatch.from_arrays(
                [pa.array([now], pa.int64()), pa.array([np.packbits(count > 1).tobytes()])],
                names=["block", "bits"])

    for batch in batches:
        for block, once, more in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if block != now:
                yield from done()
                now, count[:] = block, 0
            count[np.frombuffer(once, "<u2")] += 1
            count[np.frombuffer(more, "<u2")] = 2
            np.minimum(count, 2, out=count)
    yield from done()


def sketch_bits(n: int) -> int:
    """Buckets of a row, as a power of two: several per prefix, up to the bound."""
    return min(WIDEST, max(17, (ROOM * n - 1).bit_length()))


def sketch(prefixes: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the buckets that more than one prefix or conversation hit."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= COUNTED:
                yield _counted(held, bits)
                held, n = [], 0
        if n:
            yield _counted(held, bits)

    parts = prefixes.select("k1", "k2").mapInArrow(count, "block long, once binary, more binary")
    merged = parts.repartition("block").sortWithinPartitions("block").mapInArrow(
        _merged, "block long, bits binary")
    found = np.zeros((ROWS << bits) // 8, np.uint8)
    for r in merged.collect():  # 8 KB a block, of which the bound allows 3072
        at = r["block"] * BLOCK // 8
        found[at:at + BLOCK // 8] = np.frombuffer(r["bits"], np.uint8)
    return found


def _maybe_shared(bitmap: np.ndarray, bits: int, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
    at = buckets(k1, k2, bits)
    return ((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1).all(axis=0)


def screened(prefixes: DataFrame, shared: Broadcast, bits: int) -> DataFrame:
    """Prefixes with ``f``: it may be shared, and ``pf``: the prefix before it may be."""
    schema = prefixes.schema.simpleString().removeprefix("struct<").removesuffix(">")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2, p1, p2 = (batch.column(batch.schema.get_field_index(c)).to_numpy()
                              for c in ("k1", "k2", "p1", "p2"))
            top = batch.column(batch.schema.get_field_index("depth")).to_numpy() == 1
            f = _maybe_shared(shared.value, bits, k1, k2)
            pf = top | _maybe_shared(shared.value, bits, p1, p2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(f), pa.array(pf)],
                                             names=[*batch.schema.names, "f", "pf"])

    return prefixes.mapInArrow(run, f"{schema}, f boolean, pf boolean")


# --- digests of who ends where -----------------------------------------------


def _ends_in_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of every group of sorted ids; texts of those that may go on in another slice."""
    part, out = TaskContext.get().partitionId(), []
    key, text, size, number, open_before = None, [], 0, 0, True

    def put(whole: bool) -> None:
        nonlocal text, size, number
        data = ",".join(text)
        out.append((*key, part, number, whole, hashlib.sha256(data.encode()).hexdigest() if whole else data))
        text, size, number = [], 0, number + 1

    def batch_out() -> pa.RecordBatch:
        columns = [list(c) for c in zip(*out, strict=True)]
        out.clear()
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)],
                                          names=[*NODE, "part", "number", "whole", "data"])

    for batch in batches:
        for *at, conv_id in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if at != key:
                if key is not None:
                    put(whole=not open_before and not number)
                    open_before = False
                key, number = at, 0
            text.append(str(conv_id))
            size += len(text[-1])
            if size >= CHUNK:
                put(whole=False)
        if len(out) >= 1000:
            yield batch_out()
    if key is not None:
        if text:
            put(whole=False)
        yield batch_out()


def _ends_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digest of the texts of each group, as they follow each other."""
    key, state = None, None

    def done() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [*[pa.array([x], pa.int64()) for x in key], pa.array([state.hexdigest()])], names=[*NODE, "data"])

    for batch in batches:
        for *at, data in zip(*[batch.column(c).to_pylist() for c in (*NODE, "data")], strict=True):
            if at != key:
                if key is not None:
                    yield done()
                key, state = at, hashlib.sha256(data.encode())
            else:
                state.update(b"," + data.encode())
    if key is not None:
        yield done()


def ends(members: DataFrame) -> DataFrame:
    """SHA-256 per node of the ids of rows ``k1, k2, depth, conv_id``, ascending, with commas.

    Ids are sorted over all tasks.  Where a group goes on from one slice of the
    order to the next, its text follows in large blocks to the one task that
    hashes it, for a SHA-256 is worked out from front to back; that task holds a
    block at a time.
    """
    order = [*NODE, "conv_id"]
    parts = settle(members.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        _ends_in_slices, "k1 long, k2 long, depth long, part int, number long, whole boolean, data string"),
        "ends")
    joined = parts.filter(~F.col("whole")).repartition(*NODE).sortWithinPartitions(
        *NODE, "part", "number").select(*NODE, "data").mapInArrow(
        _ends_joined, "k1 long, k2 long, depth long, data string")
    return parts.filter("whole").select(*NODE, F.col("data").alias("ends")).unionByName(
        joined.withColumnRenamed("data", "ends"))


# --- nodes -------------------------------------------------------------------


def _owned(nodes: DataFrame) -> DataFrame:
    """Nodes with ``below``: what their owner owns from there on."""
    nodes = nodes.withColumn("weight", (F.col("n_convs") - 1) * F.col("chars"))
    # Running totals over all owners, so that a very long path needs no task of its own.
    nodes = prefix_scan(nodes, [F.asc("conv"), F.desc("depth"), F.asc("k1"), F.asc("k2")], "at",
                        {"before": "weight"}).drop("at")
    starts = nodes.groupBy("conv").agg(F.min("before").alias("start"))
    return settle(nodes.join(starts, "conv").withColumn(
        "below", F.col("before") + F.col("weight") - F.col("start")).drop("before", "start"), "owned")


def trie(found: tuple[DataFrame, DataFrame]) -> DataFrame:
    """A row per distinct prefix, the empty one included.

    ``found`` is what ``as_they_are`` or ``rebuilt`` gives.  ``conv_id`` is the
    smallest member; ``parent_conv_id`` the parent's; ``n_convs``, ``n_children``
    and ``n_leaves`` (childless nodes of the subtree) count; ``saved_tokens``
    sums each node's further members times the code points of its last text over
    the subtree; ``ends_sha256`` is of the ids of the members that end there.
    Repeated rows are turns of their own.  No conversations, no nodes.
    """
    prefixes, convs = found
    spark: SparkSession = prefixes.sparkSession
    prefixes = settle(prefixes, "prefixes")
    bits = sketch_bits(prefixes.count())
    shared = spark.sparkContext.broadcast(sketch(prefixes, bits))
    seen = settle(screened(prefixes, shared, bits), "screened")
    root_conv = convs.agg(F.min("conv_id").alias("c")).first()["c"]
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")

    # Exact groups of what may be shared, the empty prefix of every conversation included.
    roots = convs.select("conv_id", zero.alias("depth"), *[zero.alias(k) for k in ("k1", "k2", *PARENT, "chars")],
                         (F.col("n_turns") == 0).alias("last"), F.lit(False).alias("pf"))
    members = seen.filter("f").select(*PREFIX, "pf").unionByName(roots)
    nodes = members.groupBy(*NODE).agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv"), F.max("chars").alias("chars"),
        *[F.max(c).alias(c) for c in (*PARENT, "pf")])
    nodes = _owned(nodes)

    # Single nodes, those right below a node that may be shared among them.
    single = seen.filter(~F.col("f"))
    kids = nodes.filter("pf").select(*PARENT, "depth").unionByName(
        single.filter("pf").select(*PARENT, "depth"))
    kids = kids.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2"), (F.col("depth") - 1).alias("depth")).agg(
        F.count("*").alias("n_children"))
    nodes = settle(nodes.join(kids, NODE, "left").withColumn(
        "n_children", F.coalesce("n_children", zero)), "nodes")

    # What conversations bring to the nodes they pass but don't own, and to those they own.
    own = nodes.groupBy("conv").agg(F.sum("weight").alias("total"), F.min("depth").alias("owned_from"))
    leaf = single.filter("last").select(F.col("conv_id").alias("conv")).unionByName(
        nodes.filter("n_children = 0").select("conv"))
    brings = own.select("conv", "total", "owned_from", zero.alias("leaf")).unionByName(
        leaf.select("conv", zero.alias("total"), none.alias("owned_from"), F.lit(1).cast("long").alias("leaf")))
    brings = settle(brings.groupBy("conv").agg(
        F.sum("total").alias("total"), F.min("owned_from").alias("owned_from"), F.sum("leaf").alias("leaf")), "brings")
    passing = members.select(*NODE, F.col("conv_id").alias("conv")).join(brings, "conv").filter(
        F.col("owned_from").isNull() | (F.col("depth") < F.col("owned_from")))
    owning = nodes.join(brings.select("conv", "leaf"), "conv")
    sums = passing.select(*NODE, "leaf", F.col("total").alias("saved")).unionByName(
        owning.select(*NODE, "leaf", F.col("below").alias("saved")))
    sums = sums.groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))

    above = nodes.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"),
                         (F.col("depth") + 1).alias("depth"), F.col("conv").alias("parent"))
    root = F.lit(root_conv).cast("long")
    grouped = nodes.join(sums, NODE).join(ends(members.filter("last")), NODE, "left")
    deep = grouped.filter("depth > 1 AND pf").join(above, [*PARENT, "depth"]).unionByName(
        grouped.filter("depth <= 1 OR NOT pf").withColumn(
            "parent", F.when(F.col("depth") == 0, none).when(F.col("depth") == 1, root).otherwise(F.col("conv"))))
    deep = deep.select(
        F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        "n_leaves", "saved_tokens", F.coalesce("ends", F.lit(EMPTY_SHA)).alias("ends_sha256"))

    below = single.filter("pf AND depth > 1").join(above, [*PARENT, "depth"]).unionByName(
        single.filter("depth = 1 OR NOT pf").withColumn(
            "parent", F.when(F.col("depth") == 1, root).otherwise(F.col("conv_id"))))
    one, id_sha = F.lit(1).cast("long"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)
    tails = below.select(
        "conv_id", "depth", F.col("parent").alias("parent_conv_id"), one.alias("n_convs"),
        F.when(F.col("last"), zero).otherwise(one).alias("n_children"), one.alias("n_leaves"),
        zero.alias("saved_tokens"), F.when(F.col("last"), id_sha).otherwise(F.lit(EMPTY_SHA)).alias("ends_sha256"))
    return deep.unionByName(tails)


#: Contents of the rebuilt conversations grouped by whole prefixes.
ORACLE = """
WITH own AS (
  SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS t,
    length(coalesce(text, '')) AS chars,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda x, y: xor(x >> 1, (x & 1) * 3988292384)))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM own)),
rebuilt AS (
  SELECT ids.conv_id, i, t, chars, 0 AS part FROM ids JOIN own ON own.conv_id = base AND i <= h
  UNION ALL SELECT conv_id, i, t, chars, 1 FROM ids JOIN own USING (conv_id) WHERE i > h),
paths AS (
  SELECT ids.conv_id, coalesce(list(t ORDER BY part, i) FILTER (t IS NOT NULL), []) AS ts,
    coalesce(list(chars ORDER BY part, i) FILTER (t IS NOT NULL), []) AS cs
  FROM ids LEFT JOIN rebuilt USING (conv_id) GROUP BY ids.conv_id),
members AS (
  SELECT conv_id, d, len(ts) AS n, sha256(list_aggregate(list_slice(ts, 1, d), 'string_agg', ',')) AS key,
    sha256(list_aggregate(list_slice(ts, 1, d - 1), 'string_agg', ',')) AS above,
    CASE WHEN d = 0 THEN 0 ELSE cs[d] END AS chars
  FROM (SELECT *, unnest(range(len(ts) + 1)) AS d FROM paths)),
nodes AS (
  SELECT coalesce(key, '') AS key, CASE WHEN d > 1 THEN any_value(above) WHEN d = 1 THEN '' END AS above, d,
    min(conv_id) AS conv_id, count(*) AS n, (count(*) - 1) * any_value(chars) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = members.n), '')) AS ends
  FROM members GROUP BY coalesce(key, ''), d),
kids AS (SELECT above AS key, count(*) AS n FROM nodes WHERE d > 0 GROUP BY above),
subtrees AS (
  SELECT coalesce(m.key, '') AS key, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS leaves, sum(u.saved) AS saved
  FROM nodes u LEFT JOIN kids k ON k.key = u.key JOIN members m ON m.conv_id = u.conv_id AND m.d <= u.d
  GROUP BY coalesce(m.key, ''))
SELECT v.conv_id, v.d::BIGINT AS depth, p.conv_id AS parent_conv_id, v.n AS n_convs,
  coalesce(k.n, 0) AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens,
  v.ends AS ends_sha256
FROM nodes v JOIN subtrees s ON s.key = v.key LEFT JOIN kids k ON k.key = v.key
  LEFT JOIN nodes p ON p.key = v.above
"""
