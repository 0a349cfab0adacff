"""Log-bilinear language model, trained with noise-contrastive estimation.

The score of a class ``w`` after classes ``u``, ``v`` is

    s(w | u, v) = (A[u] + B[v]) . R[w] + b[w]

with A and B the two context vectors of a class and R its target vector.
Classes are the most frequent words one by one, the end of a text, and all
other words by how they end.  Inside such a group a word has its smoothed
share of the group's count, so the model gives every text a probability.

Scores of all classes after all contexts are products of small matrices, and
so are the sums that make them probabilities: the product of exp(A R') and
exp(B R' + b)' holds the normaliser of every pair of context classes.

Training is data parallel.  Every partition of the training texts starts from
the same vectors, runs through its own tokens, and hands in its vectors, which
are averaged by the number of tokens.  Counts of words come from a grouping
over all training texts; words too rare for the table that every task holds
are looked up by a join.

Texts are cut into words twice: to count them, and to write every text as
numbers, from which the rounds of training and the scoring start.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayline.session import settle

END = b""  # no word is empty
#: Words that are classes of their own, groups of other words, words every task knows the count of.
CLASSES, GROUPS, TABLE = 1536, 510, 1 << 17
SUFFIX = 2
DIMENSIONS, NOISE, BATCH, RATE, ROUNDS = 24, 32, 2048, 0.12, 2
SEED = 7
#: Distinct words a task counts before it passes counts on (twice as many rows before it sums them), and their bytes;
#: bytes of text cut at a time.
COUNTED, COUNTED_BYTES, CUT = 250_000, 1 << 24, 1 << 23

#: A text as numbers of its words (kind 0), or a word of it that the table lacks (kind 1).
CODED = pa.schema([
    ("kind", pa.int32()), ("rid", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()),
    ("codes", pa.binary()), ("token", pa.binary()), ("n", pa.int64())])
SCORED = ("rid long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, model double")


def held_out(doc_id: str = "doc_id"):
    """One fifth of the ids; rows without an id are for training."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


def cut(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """The same for some texts at a time: the first one's place, all tokens in order, how many each text has."""
    texts = column.cast(pa.large_binary()).fill_null(b"").view(pa.large_string())
    sizes, lo = np.cumsum(pc.binary_length(texts).to_numpy()), 0
    none, space = (pa.scalar(x, pa.large_string()) for x in ("", " "))
    while lo < len(texts):
        hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CUT, "right")))
        part = pc.ascii_trim_whitespace(pc.ascii_lower(texts.slice(lo, hi - lo)))
        # Nothing follows the last space, which is the end.
        part = pc.if_else(pc.equal(part, none), none, pc.binary_join_element_wise(part, none, space))
        found = pc.ascii_split_whitespace(part)
        yield lo, found.flatten().view(pa.large_binary()), pc.list_value_length(found).to_numpy()
        lo = hi


# --- counts ------------------------------------------------------------------


def word_counts(texts: DataFrame) -> DataFrame:
    """``token`` and its count ``c`` over all rows of ``text`` (bytes)."""
    schema = pa.schema([("token", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[pa.Table] = []

        def merged() -> pa.Table:
            if len(counts) == 1:
                return counts[0]
            found = pa.concat_tables(counts).group_by("token", use_threads=False).aggregate([("n", "sum")])
            return found.rename_columns({"n_sum": "n"})

        def full(tables: list[pa.Table], times: int) -> bool:
            return (sum(map(len, tables)) > times * COUNTED
                    or sum(t.nbytes for t in tables) > times * COUNTED_BYTES)

        def out():
            if counts:
                yield from merged().select(schema.names).cast(schema).to_batches(max_chunksize=50_000)
                counts.clear()

        for batch in batches:
            for _, flat, _ in cut(batch.column(0)):
                found = pc.value_counts(flat)
                counts.append(pa.table({"token": found.field("values"), "n": found.field("counts")}))
                if full(counts, 2):
                    counts[:] = [merged()]
                    if full(counts, 1):
                        yield from out()
        yield from out()

    return texts.select("text").mapInArrow(run, "token binary, n long").groupBy("token").agg(
        F.sum("n").alias("c"))


def frequent(counts: DataFrame, most: int) -> list[tuple[bytes, int]]:
    """Up to ``most`` of the most frequent tokens, more frequent ones first.

    Tokens are taken in bands of equal frequency, a band as a whole, so what
    comes to the driver is bounded whatever the corpus holds.
    """
    band = F.floor(F.log2("c") * 16)
    sizes = {r["band"]: r["n"] for r in counts.groupBy(band.alias("band")).agg(F.count("*").alias("n")).collect()}
    lowest, total = None, 0
    for key in sorted(sizes, reverse=True):
        total += sizes[key]
        if total > most:
            break
        lowest = key
    if lowest is None:
        return []
    rows = counts.where(band >= lowest).collect()
    return sorted(((bytes(r["token"]), r["c"]) for r in rows), key=lambda x: (-x[1], x[0]))


# --- model -------------------------------------------------------------------


class Classes:
    """Class of every word: its own, the end, or the group of its ending."""

    def __init__(self, head: list[tuple[bytes, int]], classes: int = CLASSES, groups: int = GROUPS):
        if classes + groups > 65_000:
            raise ValueError("classes are numbered in 16 bits")
        words = [w for w, _ in head if w != END][:classes]
        self.own = {w: i for i, w in enumerate([END, *words])}
        endings: Counter = Counter()
        for w, c in head:
            if w not in self.own:
                endings[w[-SUFFIX:]] += c
        first = len(self.own)
        chosen = sorted(endings, key=lambda e: (-endings[e], e))[:groups]
        self.groups = {e: first + i for i, e in enumerate(chosen)}
        self.other = first + len(chosen)
        self.start = self.other + 1  # only ever a context
        self.size = self.other + 1
        self.first_group = first

    def group_of(self, word: bytes) -> int:
        return self.groups.get(word[-SUFFIX:], self.other)

    def class_of(self, word: bytes) -> int:
        i = self.own.get(word)
        return self.group_of(word) if i is None else i


class Model:
    """Context vectors A, B, target vectors R and biases b, rows of one table.

    ``table`` has A, B and R one after the other and the biases beside R; a
    column of zeros makes its width even.
    """

    def __init__(self, table: np.ndarray, dimensions: int):
        self.table, self.dimensions = table, dimensions
        n = (len(table) - 2) // 3
        self.second, self.target = n + 1, 2 * n + 2  # first rows of B and R

    @property
    def a(self) -> np.ndarray:
        return self.table[:self.second, :self.dimensions]

    @property
    def b(self) -> np.ndarray:
        return self.table[self.second:self.target, :self.dimensions]

    @property
    def r(self) -> np.ndarray:
        return self.table[self.target:, :self.dimensions]

    @property
    def bias(self) -> np.ndarray:
        return self.table[self.target:, self.dimensions]

    @classmethod
    def start(cls, share: np.ndarray, dimensions: int = DIMENSIONS) -> Model:
        """Small random vectors; biases that give every class its share."""
        n, rng = len(share), np.random.default_rng(SEED)
        a, b, r = (rng.normal(0, 0.1, (n + 1, dimensions)).astype(np.float32) for _ in range(3))
        biases = np.r_[np.zeros(2 * n + 2), np.log(share)]
        return cls.from_rows(np.c_[np.concatenate([a, b, r[:n]]), biases])

    def rows(self) -> np.ndarray:
        """All parameters, a row per vector, biases in the last column."""
        return self.table[:, :self.dimensions + 1].astype(np.float64)

    @classmethod
    def from_rows(cls, rows: np.ndarray) -> Model:
        height, width = rows.shape
        table = np.zeros((height, width + width % 2), np.float32)
        table[:, :width] = rows
        return cls(table, width - 1)

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Scores by first and by second context class, and the normaliser of their pairs."""
        one, two = self.a @ self.r.T, self.b @ self.r.T + self.bias
        top1, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        sums = np.exp(one - top1).astype(np.float64) @ np.exp(two - top2).astype(np.float64).T
        return one, two, (np.log(sums) + top1 + top2.T).astype(np.float32)


def _sums(index: np.ndarray, values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows, of ``most``, that occur in ``index`` and the sum of the values of each."""
    order = np.argsort(index.astype(np.min_scalar_type(most)), kind="stable")  # short numbers are sorted by radix
    rows = index[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    pairs = values.take(order, axis=0).view(np.complex64)  # two columns are added at a time
    return rows[starts], np.add.reduceat(pairs, starts, axis=0).view(np.float32)


class Trainer:
    """Stochastic steps of noise-contrastive estimation with step sizes by parameter."""

    def __init__(self, model: Model, share: np.ndarray, seed: int):
        self.m, self.rng = model, np.random.default_rng(seed)
        self.noise = np.log(NOISE * share).astype(np.float32)
        self.steps = np.cumsum(share)
        self.squares = np.full(model.table.shape, 0.1, np.float32)

    def step(self, u: np.ndarray, v: np.ndarray, w: np.ndarray) -> None:
        table, bias, n = self.m.table, self.m.dimensions, len(w)
        z = np.minimum(np.searchsorted(self.steps, self.rng.random(NOISE)), len(self.steps) - 1)
        at = np.concatenate([u, v + self.m.second, w + self.m.target, z + self.m.target])
        h, rw, rz = (table.take(x, axis=0) for x in (at[:n], at[2 * n:3 * n], at[3 * n:]))
        h += table.take(at[n:2 * n], axis=0)
        h[:, bias] = 1  # meets the bias beside a target vector
        data = np.einsum("nd,nd->n", h, rw) - self.noise[w]
        noise = h @ rz.T
        noise -= self.noise[z]
        up = 1 / (1 + np.exp(np.clip(data, -30, 30)))  # towards the data
        down = np.clip(noise, -30, 30, out=noise)  # away from the noise
        np.exp(np.negative(down, out=down), out=down)
        down += 1
        np.divide(-1, down, out=down)
        change = np.empty((len(at), table.shape[1]), np.float32)
        np.matmul(down, rz, out=change[:n])
        rw *= up[:, None]
        change[:n] += rw
        change[:n, bias] = 0  # contexts have none
        change[n:2 * n] = change[:n]
        np.multiply(h, up[:, None], out=change[2 * n:3 * n])
        np.matmul(down.T, h, out=change[3 * n:])
        # Only vectors that took part have moved.
        rows, g = _sums(at, change, len(table))
        g *= np.float32(100 / n)
        square = self.squares.take(rows, axis=0)
        square += g * g
        self.squares[rows] = square
        g *= np.float32(RATE)
        g /= np.sqrt(square, out=square)
        table[rows] += g


def contexts(ids: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The two classes before every token of texts put one after the other."""
    u, v = np.r_[start, start, ids[:-2]][:len(ids)], np.r_[start, ids[:-1]][:len(ids)]
    firsts = np.cumsum(lengths) - lengths
    u[firsts], v[firsts] = start, start
    seconds = firsts[lengths > 1] + 1
    u[seconds] = start
    return u, v


def coded(rows: DataFrame, classes: Classes, words: list[bytes]) -> DataFrame:
    """Texts as numbers, written once: a word's place among ``words``, or -1 less its class.

    Words without a place come as rows of their own, with how often the text has them.
    """
    held = rows.sparkSession.sparkContext.broadcast((classes, words))
    fields = ", ".join(f"{f.name} {t}" for f, t in zip(
        CODED, ("int", "long", "long", "boolean", "binary", "binary", "long"), strict=True))

    def batch_of(**columns) -> pa.RecordBatch:
        n = len(columns["rid"])
        return pa.RecordBatch.from_arrays(
            [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in CODED],
            schema=CODED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, table = held.value
        places, rid = pa.array(table, pa.large_binary()), TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, flat, lengths in cut(batch.column(2)):
                part = batch.slice(lo, len(lengths))
                codes = pc.index_in(flat, value_set=places).fill_null(-1).to_numpy().astype("<i4")
                rids = rid + np.arange(len(lengths))
                rid += len(lengths)
                rare = np.flatnonzero(codes < 0)
                if len(rare):
                    found = flat.take(pa.array(rare)).dictionary_encode()
                    names, which = found.dictionary, found.indices.to_numpy()
                    codes[rare] = np.array([-1 - known.class_of(w) for w in names.to_pylist()])[which]
                    # A number for every text and word that meet, and how often they do.
                    meet, n = np.unique(np.repeat(np.arange(len(rids)), lengths)[rare] * len(names) + which,
                                        return_counts=True)
                    yield batch_of(kind=np.ones(len(n), np.int32), rid=rids[meet // len(names)],
                                   token=names.take(pa.array(meet % len(names))).to_pylist(), n=n)
                ends, data = 4 * np.cumsum(lengths), codes.tobytes()
                yield batch_of(kind=np.zeros(len(rids), np.int32), rid=rids, doc_id=part.column(0).to_pylist(),
                               held_out=part.column(1).to_pylist(),
                               codes=[data[e - 4 * n:e] for e, n in zip(ends.tolist(), lengths.tolist(), strict=True)])

    return settle(rows.select("doc_id", "held_out", "text").mapInArrow(run, fields), "coded")


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of some texts one after the other, and how many each has."""
    data = [c.as_py() for c in column]
    return np.frombuffer(b"".join(data), "<i4"), np.array([len(x) // 4 for x in data])


def _classes_of(codes: np.ndarray, class_of: np.ndarray) -> np.ndarray:
    return np.where(codes >= 0, class_of[np.maximum(codes, 0)], -1 - codes).astype(np.int64)


def trained(texts: DataFrame, class_of: np.ndarray, start: int, share: np.ndarray,
            rounds: int = ROUNDS) -> Model:
    """Train on every row of ``codes``; each round averages what the partitions learnt.

    ``class_of`` has the class of every place, ``start`` is that before a text.
    """
    model = Model.start(share)
    spark = texts.sparkSession
    width = DIMENSIONS + 1
    schema = "slot int, weight double, " + ", ".join(f"v{k} double" for k in range(width))
    for number in range(rounds):
        held = spark.sparkContext.broadcast((class_of, model.rows(), share))

        def run(batches: Iterator[pa.RecordBatch], held=held, number=number) -> Iterator[pa.RecordBatch]:
            class_of_, rows, shares = held.value
            own = Model.from_rows(rows)
            trainer = Trainer(own, shares, SEED + 1_000_003 * number + TaskContext.get().partitionId())
            seen, left = 0, [np.zeros(0, np.int64)] * 3

            def steps(last: bool):
                nonlocal left
                order = trainer.rng.permutation(len(left[0]))
                full = len(order) if last else len(order) // BATCH * BATCH
                for lo in range(0, full, BATCH):
                    at = order[lo:lo + BATCH]
                    trainer.step(*(x[at] for x in left))
                left = [x[order[full:]] for x in left]

            for batch in batches:
                column = batch.column(0)
                for lo in range(0, len(column), 128):
                    codes, lengths = _codes(column[lo:lo + 128])
                    ids = _classes_of(codes, class_of_)
                    u, v = contexts(ids, lengths, start)
                    left = [np.r_[x, y] for x, y in zip(left, (u, v, ids), strict=True)]
                    seen += len(ids)
                    if len(left[0]) >= 32 * BATCH:
                        steps(False)
            if seen:
                steps(True)
                out = own.rows() * seen
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(out), dtype=np.int32)), pa.array(np.full(len(out), float(seen))),
                     *[pa.array(out[:, k]) for k in range(width)]],
                    names=["slot", "weight", *[f"v{k}" for k in range(width)]])

        found = texts.select("codes").mapInArrow(run, schema).groupBy("slot").agg(
            *[(F.sum(f"v{k}") / F.sum("weight")).alias(f"v{k}") for k in range(width)])
        rows = found.collect()  # a row per vector, however large the corpus
        if rows:
            model = Model.from_rows(np.array([list(r)[1:] for r in sorted(rows, key=lambda r: r["slot"])]))
    return model


# --- scores ------------------------------------------------------------------


class Scores:
    """Tables of a model, worked out once in every worker that is sent it."""

    def __init__(self, model: Model):
        self.model = model

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.model.tables()


def _group_mass(counts: DataFrame, classes: Classes) -> dict[bytes | None, float]:
    """Sum of c + 0.5 over the words of each group of endings, and of all other endings (None)."""
    ending = F.expr(f"substring(token, greatest(length(token) - {SUFFIX - 1}, 1), {SUFFIX})")
    own = counts.sparkSession.createDataFrame([(bytearray(w),) for w in classes.own], "token binary")
    ends = counts.sparkSession.createDataFrame([(bytearray(e),) for e in classes.groups] or [(bytearray(b"\n"),)],
                                               "ending binary")
    mass = (counts.join(F.broadcast(own), "token", "left_anti")
            .groupBy(ending.alias("ending")).agg(F.sum(F.col("c") + 0.5).alias("mass")))
    named = mass.join(F.broadcast(ends.withColumn("named", F.lit(True))), "ending", "left")
    rows = named.groupBy(F.when(F.col("named"), F.col("ending")).alias("ending")).agg(
        F.sum("mass").alias("mass")).collect()
    return {None if r["ending"] is None else bytes(r["ending"]): r["mass"] for r in rows}


def scored(docs: DataFrame, classes: int = CLASSES, groups: int = GROUPS, table: int = TABLE,
           rounds: int = ROUNDS) -> DataFrame:
    """Score every text by smoothed word counts and by the model, learnt from the training part.

    A null text is empty: its end is its only token.  Repeated rows each get
    their scores.  With nothing to learn from, every word is unknown and the
    model knows the end and one group only.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"),
                       F.col("text").cast("binary").alias("text"))
    learn = rows.where(~F.col("held_out"))
    counts = settle(word_counts(learn), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    head = frequent(counts, table)
    known = Classes(head, classes, groups)

    # What a class has of all tokens; each group and the end get half a token more for unknown words.
    mass = _group_mass(counts, known)
    class_mass = np.full(known.size, 0.5)
    for word, c in head:
        if word in known.own:
            class_mass[known.own[word]] += c
    for ending, value in mass.items():
        class_mass[known.groups.get(ending, known.other) if ending is not None else known.other] += value
    share = class_mass / class_mass.sum()
    words = [w for w, _ in head]
    class_of = np.array([known.class_of(w) for w in words] or [0], np.int64)
    texts = coded(rows, known, words)
    model = trained(texts.where("kind = 0 AND NOT held_out"), class_of, known.start, share, rounds)

    spark = docs.sparkSession
    logs = np.log10(np.array([c for _, c in head] or [0]) + 0.5)
    held = spark.sparkContext.broadcast((class_of, Scores(model), np.log10(class_mass), logs))
    zero, first, start = math.log10(total + 0.5 * (distinct + 1)), known.first_group, known.start

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        class_of_, scores, within, logs_ = held.value
        one, two, norm = scores.tables
        for batch in batches:
            for lo in range(0, batch.num_rows, 128):
                part = batch.slice(lo, 128)
                codes, lengths = _codes(part.column(3))
                ids, hit = _classes_of(codes, class_of_), codes >= 0
                u, v = contexts(ids, lengths, start)
                share_ = np.where(hit, logs_[np.maximum(codes, 0)], 0.0)
                model_ = (one[u, ids] + two[v, ids] - norm[u, v]) / math.log(10)
                model_ += np.where(ids >= first, share_ - within[ids], 0.0)
                starts = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(lengths), pa.array(np.add.reduceat(hit.astype(np.int64), starts)),
                     pa.array(np.add.reduceat(share_, starts) - zero * lengths),
                     pa.array(np.add.reduceat(model_.astype(np.float64), starts))],
                    names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base", "model"])

    found = texts.where("kind = 0").select("rid", "doc_id", "held_out", "codes").mapInArrow(run, SCORED)
    # Words outside the table: rare ones by a join, each at most as often as the table's rarest.
    rare = texts.where("kind = 1").select("rid", "token", "n").join(counts, "token", "left")
    log, in_group = F.col("n") * F.log10(F.coalesce("c", F.lit(0)) + 0.5), F.length("token") > 0  # all but the end
    rare = rare.groupBy("rid").agg(
        F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("more_known"),
        F.sum(log).alias("more_base"), F.sum(F.when(in_group, log).otherwise(0.0)).alias("more_model"))
    documents = found.join(rare, "rid", "left")
    return documents.select(
        "doc_id", "held_out", "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("model") + F.coalesce("more_model", F.lit(0.0))).alias("score"))
