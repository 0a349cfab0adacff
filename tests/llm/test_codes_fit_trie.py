"""Vector codes, best-fit packing and the prefix trie, against brute force."""

import bisect
import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from functools import cache

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayline.llm import bestfit, codes, trie

# --- vector codes ------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int"


def codes_by_hand(rows, parts=16, entries=64, rounds=2):
    """``(vec_id, code, error, label_error)`` and the codebooks' digest, in plain Python."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and np.isfinite(x) for x in r[1])]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    full = []
    for i, v, label in kept:
        ints = [int(np.floor(256 * float(np.float32(x)))) for x in v]
        ints += [0] * (width * parts - len(ints))
        full.append((i, [ints[p * width:(p + 1) * width] for p in range(parts)], label))
    full.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    books = [[list(r[1][p]) for r in full[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), e) for e, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for r in full:
                own[nearest(r[1][p], books[p])[1]].append(r[1][p])
            for e, xs in own.items():
                books[p][e] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
    found, by_label = [], Counter()
    for i, v, label in full:
        best = [nearest(v[p], books[p]) for p in range(parts)]
        found.append((i, "".join(f"{e:02x}" for _, e in best), sum(d for d, _ in best), label))
        by_label[label] += found[-1][2]
    text = ",".join(str(x) for book in books for c in book for x in c)
    return Counter((i, c, e, by_label[label]) for i, c, e, label in found), hashlib.sha256(text.encode()).hexdigest()


def some_vectors(n, seed, size=32):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        v = [rng.choice([-1, 0, 0.3, 0.7]) + rng.gauss(0, 0.2) for _ in range(size)]
        rows.append((k, v if k % 3 else [0.25] * size, rng.choice([None, 1, 2])))  # a third are equal
    return rows


@pytest.mark.parametrize("rows", [
    some_vectors(200, 1) + [(7, None, 1), (8, [], 1), (None, [0.5] * 32, None), (9, [None] * 32, 1),
                            (10, [float("nan")] * 32, 1), (11, [float("inf")] + [0.0] * 31, 2),
                            (3, [0.1] * 20, 3), (3, [0.1] * 20, 3)],
    some_vectors(20, 2, size=5),  # fewer vectors than entries, a length sixteen doesn't divide
    [(1, [], None), (2, [], None)],
])
def test_codes(spark, rows):
    got = codes.codes(spark.createDataFrame(rows, VECTORS).withColumn("rid", F.lit(1)).withColumn("v", F.lit("x")))
    want, digest = codes_by_hand(rows)
    found = got.collect()
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in found) == want
    assert {r.codebooks_sha256 for r in found} == {digest}


def test_codes_of_nothing(spark):
    got = codes.codes(spark.createDataFrame([(1, None, 1)], VECTORS))
    assert got.count() == 0
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]


def test_codes_of_huge_components(spark):
    """Beyond the bound a component counts as the bound; nothing overflows."""
    rows = [(1, [3e38] * 16, 1), (2, [-3e38] * 16, 1), (3, [0.0] * 16, 1)]
    got = {r.vec_id: r for r in codes.codes(spark.createDataFrame(rows, VECTORS), entries=1, rounds=0).collect()}
    assert got[2].error == 16 * (2 * codes.LARGEST) ** 2 and got[3].error == 16 * codes.LARGEST ** 2


def test_members_that_keep_their_entry_stay(spark):
    """Only the others go through a shuffle."""
    vectors = codes.scaled(spark.createDataFrame(some_vectors(120, 3), VECTORS))
    books = codes.first_codebooks(vectors)
    members = codes._moved_in(codes.cut(vectors, books, 4))
    moved = codes.assigned(members, codes.updated(members, books)).groupBy("moved").count().collect()
    assert {r["moved"] for r in moved} == {True, False}
    plan = codes.assigned(members, books).filter(~F.col("moved"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


# --- best-fit packing --------------------------------------------------------


def fewest_by_hand(sizes, length):
    """Sequences that best fit takes, one piece after the other, the largest first."""
    rooms, n = [], 0
    for s in sorted(sizes, reverse=True):
        at = bisect.bisect_left(rooms, s)
        room = rooms.pop(at) if at < len(rooms) else length
        n += at == len(rooms) and room == length
        if room > s:
            bisect.insort(rooms, room - s)
    return n


def random_sizes(kind, n, length, rng):
    if kind == "tiny":
        return [rng.choice([1, 1, 2, 5]) for _ in range(n)]
    if kind == "large":
        return [rng.randrange(length // 2 + 1, length + 1) for _ in range(n)]
    if kind == "third":  # equal pieces that fit three times
        return [length // 3] * n
    return [rng.choice([rng.randrange(1, length + 1), rng.randrange(1, length // 8), 7]) for _ in range(n)]


@pytest.mark.parametrize("kind,length", [("tiny", 64), ("large", 128), ("third", 100), ("mixed", 256)])
def test_places(spark, kind, length):
    sizes = random_sizes(kind, 900, length, random.Random(length))
    df = spark.createDataFrame(list(enumerate(sizes)), "rid long, size long").repartition(5)
    got = bestfit.places(df, length).collect()
    assert sorted((r.rid, r.size) for r in got) == list(enumerate(sizes))
    used = Counter()
    for r in got:
        used[r.seq] += r.size
    assert max(used.values()) <= length
    assert len(used) <= 1.02 * fewest_by_hand(sizes, length) + 1


def odd_texts():
    return [(1, "one two three"), (2, None), (3, ""), (3, ""), (None, "no id"), (4, "word " * 3000),
            (5, "<|endoftext|> stays text"), (6, "\n" * 20000 + "x"), (7, "a" * 30000), (8, "日本語 \U0001F600 \x85\x1c")]


@cache
def library():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(bestfit.tokenizer_path())
    tokenizer.encode_special_tokens = True
    return tokenizer


def ids_by_library(text):
    return library().encode(text or "", add_special_tokens=False).ids + [bestfit.END_ID]


def test_pack_holds_every_id_once(spark):
    docs = spark.createDataFrame(odd_texts(), "doc_id long, text string").withColumn(
        "rid", F.lit(0)).withColumn("seq", F.lit("x"))
    rows = bestfit.pack(docs).collect()
    want = Counter((i, tuple(ids_by_library(t))) for i, t in odd_texts())
    by_id = defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length and 0 < r.length <= 1024
        assert r.length == 1024 or r.piece == 0
        by_id[r.doc_id].append(r)
    for (i, ids), times in want.items():
        own = [r for r in by_id[i]]
        assert len(own) == times * (-(-len(ids) // 1024))
        for r in own:
            assert struct.unpack(f"<{r.length}I", r.ids) == ids[r.start:r.start + r.length]
        assert Counter(r.piece for r in own) == dict.fromkeys(range(-(-len(ids) // 1024)), times)
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        own.sort()
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) <= 1024
    got = bestfit.packed_digests(docs).collect()
    assert Counter(r.ids_crc32 for r in got) == Counter(zlib.crc32(r.ids) for r in rows)
    assert bestfit.pack(docs.limit(0)).count() == 0


def test_ids_are_the_librarys():
    encode, rng = bestfit.ByteEncoder(bestfit.tokenizer_path()), random.Random(5)
    for _ in range(300):
        text = "".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(128, 0x3000), 10, 32, 32, 9, 0x85, 0x1c]))
                       for _ in range(rng.randrange(80)))
        assert encode(text) + [bestfit.END_ID] == ids_by_library(text)


# --- prefix trie -------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string"


def trie_by_hand(paths):
    """Nodes of conversations, given as lists of turns, by walking all their prefixes."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, own in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += (len(own) - 1) * (len(p[-1][1]) if p else 0)
    rows = []
    for p, own in members.items():
        ids = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(p))))
        rows.append((min(own), len(p), min(members[p[:-1]]) if p else None, len(own), kids[p], leaves[p],
                     saved[p], hashlib.sha256(ids.encode()).hexdigest()))
    return Counter(rows)


def paths_by_hand(rows, rebuild):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    # Turns of one number are in an order of their digests; the rows here don't differ there.
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}
    if not rebuild:
        return own
    found = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        found[c] = own.get(c - c % 100, [])[:h] + ts[h:]
    return found


def some_turns(seed, n, alphabet=2):
    rng, rows = random.Random(seed), []
    for c in rng.sample(range(450), n):
        for k in range(rng.randrange(1, 9)):
            rows.append((c, k, rng.choice(["user", None]), rng.choice(["x", "yy", "é" * 40, None][:alphabet + 1])))
    return rows


def a_long_one(c, n):
    return [(c, k, "user", f"turn {k % 3}") for k in range(n)]


ODD_TURNS = [(0, None, "a", "first"), (0, 1, None, None), (0, 2, "", ""), (0, 2, "", ""), (None, 1, "a", "b"),
             (1, 1, "a", "x" * 100_000), (5, 0, "a", "only"), (105, 1, "no", "base")]


@pytest.mark.parametrize("rebuild", [False, True])
@pytest.mark.parametrize("rows", [
    some_turns(1, 120), some_turns(2, 200, 1), ODD_TURNS,
    a_long_one(100, 200) + a_long_one(101, 300) + a_long_one(7, 300) + some_turns(3, 5),
    [(c, k, "u", f"same {k}") for c in range(300) for k in range(3)],
])
def test_trie(spark, rows, rebuild):
    df = spark.createDataFrame(rows, TURNS).repartition(3).withColumn("depth", F.lit("x")).withColumn("k1", F.lit(1))
    found = trie.rebuilt(df) if rebuild else trie.as_they_are(df)
    got = Counter(tuple(r) for r in trie.trie(found).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"
    ).collect())
    assert got == trie_by_hand(paths_by_hand(rows, rebuild))


def test_a_full_sketch_changes_nothing(spark, monkeypatch):
    """If all prefixes look shared, all are grouped exactly."""
    monkeypatch.setattr(trie, "_maybe_shared", lambda bitmap, bits, k1, k2: np.ones(len(k1), bool))
    rows = some_turns(4, 60)
    got = trie.trie(trie.as_they_are(spark.createDataFrame(rows, TURNS))).collect()
    assert Counter(tuple(r) for r in got) == trie_by_hand(paths_by_hand(rows, False))


def test_sketch_has_no_false_singles(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-2**63, 2**63, (500, 2))
    many = np.concatenate([keys, keys[:200]])
    df = spark.createDataFrame([tuple(map(int, k)) for k in many], "k1 long, k2 long").repartition(6)
    bitmap = trie.sketch(df, 17)
    seen = trie._maybe_shared(bitmap, 17, keys[:, 0].copy(), keys[:, 1].copy()).astype(bool)
    assert seen[:200].all() and seen[200:].sum() < 10


def test_ends_of_many_slices(spark, monkeypatch):
    """A node where most conversations end is hashed in blocks."""
    rows = [(1, 1, 1, c) for c in range(3000)] + [(k, 2, 1, c) for k in range(40) for c in range(k % 4 + 1)]
    df = spark.createDataFrame(rows, "k1 long, k2 long, depth long, conv_id long").repartition(7)
    want = defaultdict(list)
    for *key, c in rows:
        want[tuple(key)].append(c)
    want = {k: hashlib.sha256(",".join(map(str, sorted(v))).encode()).hexdigest() for k, v in want.items()}
    assert {(r.k1, r.k2, r.depth): r.ends for r in trie.ends(df).collect()} == want


def test_trie_of_nothing(spark):
    assert trie.trie(trie.rebuilt(spark.createDataFrame([], TURNS))).count() == 0
    assert trie.trie(trie.as_they_are(spark.createDataFrame([(None, 1, "a", "b")], TURNS))).count() == 0
