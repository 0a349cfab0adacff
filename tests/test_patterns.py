"""The index of patterns and shadowed rules, against trying everything."""

import itertools
import random
import re
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from wayline import schema
from wayline.operators import patterns

RULE = "pattern string, name string"


def matches(pattern, value):
    """One pattern and one value in Python; a backslash takes the next sign as it is."""
    out, signs = "", iter(pattern)
    for c in signs:
        out += ".*" if c == "%" else "." if c == "_" else re.escape(next(signs, "") if c == "\\" else c)
    return re.fullmatch(out, value, re.I | re.S) is not None


def some_patterns(n, seed, alphabet="abAB%_ "):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(8))) for _ in range(n)]


def test_index_finds_what_trying_all_finds(spark):
    found = some_patterns(400, 1) + ["%", "_", "__", "", "%%", "é%", "%ÉA%", "\\%a", "a\\_%", "x\ny%", None, "ab", "ab"]
    values = sorted(set(some_patterns(150, 2, "abAB _c")) | {"", "é", "ÉAB", "%a", "a_b", "ab", "X\nyz", "\U0001F600ab"})
    rules = spark.createDataFrame([(p, str(k)) for k, p in enumerate(found)], RULE)
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "value string")
    got = rows(patterns.indexed_matches(df, rules))
    want = sorted(((v, p, str(k)) for v in values for k, p in enumerate(found) if p is not None and matches(p, v)),
                  key=lambda r: tuple(map(repr, r)))
    assert got == want
    assert rows(patterns.looped_matches(df, patterns.in_slices(rules, 2000))) == want


def test_a_hundred_thousand_rules(spark):
    """Every value meets a few of them."""
    names = spark.range(100_000).select(
        F.concat(F.when(F.col("id") % 3 == 0, "%").otherwise(""), F.substring(F.md5(F.col("id").cast("string")), 1, 5),
                 F.when(F.col("id") % 5 == 0, "_").otherwise("%")).alias("pattern"), F.col("id").alias("rule_id"))
    values = spark.range(2000).select(F.md5((F.col("id") * 50).cast("string")).alias("value"))
    start = time.time()
    got = rows(patterns.indexed_matches(values, names).select("value", "rule_id"))
    took = time.time() - start
    own = [r.pattern for r in names.orderBy("rule_id").collect()]
    exact, ends = {}, {}
    for k, p in enumerate(own):
        (ends if p[0] == "%" else exact).setdefault(p.strip("%_"), []).append((k, p))
    want = []
    for v in (r.value for r in values.collect()):
        near = exact.get(v[:5], []) + [x for lo in range(len(v) - 4) for x in ends.get(v[lo:lo + 5], [])]
        want += {(v, k) for k, p in near if matches(p, v)}
    assert got == sorted(want, key=lambda r: tuple(map(repr, r))) and len(got) > 1000
    assert took < 120


def test_a_value_meets_the_patterns_it_may_match(spark):
    """The pairs that are compared, as a share of all pairs."""
    groups = {p: set(g) for p, g in rows(spark.createDataFrame(
        [(p,) for p in ("%tableau prep%", "a_c", "%_%", "go", "%x")], "p string").select(
        "p", patterns.pattern_groups(F.col("p"))))}
    assert groups["%_%"] == set() and groups["go"] == {"go"} and groups["%x"] == {"x"}
    assert groups["a_c"] == {"a", "c"} and "u p" in groups["%tableau prep%"] and "%ta" not in groups["%tableau prep%"]


STRINGS = ["".join(s) for n in range(9) for s in itertools.product("abc", repeat=n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_shadowed_by_generated_strings(spark, seed):
    """Containment held to all strings of three letters up to a length."""
    rng = random.Random(seed)
    found = [(k // 3, "".join(rng.choice("aab%%_") for _ in range(rng.randrange(5))), "application", f"n{k}")
             for k in range(45)]
    found += [(9, "%A%", "client_app_id", "id"), (10, "%a%a%", "client_app_id", "id2"), (11, "_a", "client_app_id", "id3"),
              (12, "a\\%", "application", "escaped"), (13, "%a%", "client_app_id", "again")]
    own = {p: {s for s in STRINGS if matches(p, s)} for _, p, _, _ in found if "\\" not in p}
    want = []
    for r in found:
        if r[1] not in own:
            continue
        front = [(a[0], a[3], a[1]) for a in found if a[1] in own and a[2] == r[2] and (a[0], a[3]) < (r[0], r[3])
                 and own[r[1]] <= own[a[1]]]
        if front:
            want.append((*r, min(front)[2], min(front)[1]))
    got = rows(patterns.shadowed_rules(spark.createDataFrame(found, schema.RULES)))
    assert got == sorted(want, key=lambda r: tuple(map(repr, r))) and len(got) > 10


def test_rules_that_share_a_pattern(spark, monkeypatch):
    """Many rules of few patterns, in either case: what meets are the patterns, not the rules."""
    rng, met = random.Random(4), []
    kinds = ["%a%", "A%b", "ab%", "%_b%", "a_%", "abc", "%c%b%", "b", "%bc_", "ca%"]
    found = [(rng.randrange(40), rng.choice([str.upper, str.lower])(rng.choice(kinds)),
              rng.choice(["application", "client_app_id", None]), f"n{rng.randrange(20)}") for _ in range(900)]
    plain = patterns.indexed_matches
    monkeypatch.setattr(patterns, "indexed_matches", lambda *a: met.append(plain(*a)) or met[0])
    got = rows(patterns.shadowed_rules(spark.createDataFrame(found, schema.RULES)))
    own = {p: {s for s in STRINGS if matches(p, s)} for p in {r[1] for r in found}}
    over = {p: [q for q in own if own[p] <= own[q]] for p in own}
    want = []
    for r in found:
        front = [(a[0], a[3], a[1]) for a in found if r[2] and a[2] == r[2] and (a[0], a[3]) < (r[0], r[3])
                 and a[1] in over[r[1]]]
        if front:
            want.append((*r, min(front)[2], min(front)[1]))
    assert got == sorted(want, key=lambda r: tuple(map(repr, r))) and len(got) > 500
    assert met[0].count() <= 2 * len(kinds) ** 2


def test_long_texts_of_few_words(spark):
    """Texts whose groups of three are all common are told apart by longer ones."""
    rng, words = random.Random(6), ["steel", "bolt", "ring", "plate", "small"]
    values = [" ".join(w) for w in itertools.product(words, repeat=4)]
    found = [f"%{v[rng.randrange(9):][:rng.choice([2, 5, 6, 9, 12, 15])]}%" for v in rng.sample(values, 60)]
    found += [v.upper() for v in rng.sample(values, 40)] + ["steel_bolt%plate steel small"]
    got = rows(patterns.indexed_matches(
        spark.createDataFrame([(v,) for v in values], "value string"),
        spark.createDataFrame([(p, str(k)) for k, p in enumerate(found)], RULE)))
    assert got == sorted(((v, p, str(k)) for v in values for k, p in enumerate(found) if matches(p, v)),
                         key=lambda r: tuple(map(repr, r)))
    groups = spark.createDataFrame([("steel%bolt ring plate small",)], "p string").select(
        F.explode(patterns.pattern_groups(F.col("p"))).alias("g"))
    assert {len(r.g) for r in groups.collect()} == {3, 12}


@pytest.mark.parametrize("front,behind,covers", [
    ("%tableau%", "%TABLEAU prep%", True), ("%spark%", "%sparkflows%", True), ("%a%", "%a_", True),
    ("_%", "%a%", True), ("%_%", "%", False), ("__%", "%_%_%", True), ("___%", "%_%_%", False),
    ("%a_c%", "%abc%", True), ("%abc%", "%a_c%", False), ("a%b%c", "ab%%bc", True), ("%_a%", "%a%a%", True),
    ("%", "", True), ("", "%", False), ("go", "GO", True), ("%%", "%_%", True), ("%a_%", "%a%a%", True),
])
def test_covers(spark, front, behind, covers):
    found = spark.createDataFrame([(1, front, "application", "A"), (2, behind, "application", "B")], schema.RULES)
    assert [r.display_name for r in patterns.shadowed_rules(found).collect()] == ["B"] * covers
