"""``ILIKE`` patterns in large numbers: an index of them, and which cover which.

A pattern only matches values that hold its literal text.  Each pattern is
posted under one group of letters of that text, the one the fewest values have,
and a value looks up the groups it has itself.  Groups have up to three letters,
and six or twelve where the text is that long: where texts are made of few words,
all groups of three are common.  So a value meets
the patterns that could match it and no others, whatever their number; each pair
meets once, and the pattern decides.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.operators.bounded import BROADCAST_BYTES, text_bytes
from wayline.session import settle

#: Letters of a short group at most, and of the long ones.
LETTERS, LONG = 3, (6, 12)
#: A character no pattern has: what a wildcard may stand for, and a literal doesn't match.
FRESH = "\ue000"


def _groups(text: Column, size: Column) -> Column:
    """All groups of ``size`` letters of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    return F.when(F.length(text) >= size, F.transform(starts, lambda i: F.substring(text, i, size))).otherwise(
        F.array().cast("array<string>"))


def value_groups(value: Column) -> Column:
    """The different groups of one to ``LETTERS`` letters, and of ``LONG`` ones, of a value,
    in small letters."""
    text, sizes = F.lower(value), (*range(1, LETTERS + 1), *LONG)
    return F.array_distinct(F.flatten(F.array(*[_groups(text, F.lit(k)) for k in sizes])))


def pattern_groups(pattern: Column) -> Column:
    """Groups every value has that the pattern matches, of the longest short size there is and
    of the longest long one.

    None if the pattern has wildcards only.  A backslash makes the sign after it
    a literal; such patterns are left without groups.
    """
    runs = F.filter(F.split(F.lower(pattern), "[%_]+"), lambda run: run != "")
    letters = F.array_max(F.transform(runs, F.length))
    sizes = F.array_compact(F.array(F.least(F.lit(LETTERS), letters), F.array_max(
        F.filter(F.array(*map(F.lit, LONG)), lambda size: size <= letters))))
    groups = F.array_distinct(F.flatten(F.transform(sizes, lambda size: F.flatten(
        F.transform(runs, lambda run: _groups(run, size))))))
    none = F.array().cast("array<string>")
    return F.when(pattern.contains("\\") | (F.size(runs) == 0), none).otherwise(groups)


def in_slices(rules: DataFrame, limit: int = BROADCAST_BYTES) -> list[DataFrame]:
    """The rules in parts that are each small enough to broadcast.

    A measured small table is one part.  A larger one is cut by the hash of its
    key into parts of about half the limit; every rule lands in one of them.
    """
    parts = -(-2 * text_bytes(rules) // limit)
    if parts <= 2:
        return [rules]
    key = F.pmod(F.xxhash64(*rules.columns), F.lit(parts))
    return [rules.filter(key == i) for i in range(parts)]


def looped_matches(values: DataFrame, slices: Sequence[DataFrame]) -> DataFrame:
    """Rows ``value`` with every rule that matches, by trying every rule on every value.

    Values are dealt out before the comparison, which is the heavy part.
    """
    n = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = values.repartition(n, "value")
    return reduce(DataFrame.unionByName, [
        values.join(F.broadcast(part), F.ilike(F.col("value"), F.col("pattern"))) for part in slices])


def indexed_matches(values: DataFrame, rules: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The same rows, by the index.

    ``values`` has one column of different values, ``rules`` a ``pattern`` and
    any other columns.  Rules that are there twice match twice.  Patterns
    without a literal can't be looked up and are tried on all values.
    """
    columns, values = rules.columns, settle(values.filter(F.col("value").isNotNull()), "values")
    rules = settle(rules.filter(F.col("pattern").isNotNull()).withColumns(
        {"rule": F.monotonically_increasing_id(), "groups": pattern_groups(F.col("pattern"))}), "rules")
    posted = values.select("value", F.explode(value_groups(F.col("value"))).alias("group"))
    sizes = posted.groupBy("group").agg(F.count("*").alias("n"))
    rarest = rules.select("rule", F.explode("groups").alias("group")).join(sizes, "group", "left").groupBy("rule").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "group"))["group"].alias("group"))
    index = settle(rules.join(rarest, "rule").select("group", *columns), "index")
    found = posted.join(index, "group").filter(F.ilike(F.col("value"), F.col("pattern")))
    rest = rules.filter(F.size("groups") == 0).select(*columns)
    return found.select("value", *columns).unionByName(
        looped_matches(values, in_slices(rest, limit)).select("value", *columns))


def _expanded(parts: Column, times: Column, number: Column) -> Column:
    """A pattern's parts between its ``%``, with so many fresh characters at each as the
    digits of ``number`` in base ``times`` say."""
    def part(text: Column, i: Column) -> Column:
        digit = F.pmod(F.floor(number / F.pow(times, i)), times).cast("int")
        return F.when(i < F.size(parts) - 1, F.concat(text, F.repeat(F.lit(FRESH), digit))).otherwise(text)

    return F.array_join(F.transform(parts, part), "")


def shadowed_rules(rules: DataFrame) -> DataFrame:
    """Rules that can never win, since one rule tried before matches all they match.

    Rules of one field are tried by priority and then by name.  ``by_pattern``
    and ``by_name`` are those of the first rule that stands in front.  What several rules
    match together is not looked at; patterns with a backslash, which are not
    allowed, cover nothing and are not covered.

    A pattern's least value has nothing for ``%`` and a fresh character for
    ``_``: whoever covers the pattern matches that, so the index gives the
    candidates.  One of them with ``u`` signs ``_`` covers the pattern if it also
    matches every value with up to ``u + 1`` fresh characters for each ``%``.
    That many can't all be taken by ``_``, so a ``%`` takes one, and then takes
    any number of any characters as well.

    Rules of one field whose patterns differ in case at most cover the same, and
    the first of them stands for all; a rule in front of that one stands in front of
    the others too.  So pairs are those of different patterns, however many rules
    share one.
    """
    real = rules.filter(~F.col("pattern").contains("\\") & ~F.col("pattern").contains(FRESH))
    real = settle(real.select(
        "priority", "pattern", "source_field", "display_name", F.lower("pattern").alias("text")), "rules")
    order = F.struct("priority", "display_name")
    once = settle(real.filter(F.col("source_field").isNotNull()).groupBy("source_field", "text").agg(
        F.min(F.struct(order.alias("by_order"), F.col("pattern").alias("by_pattern"))).alias("own")).withColumns({
            "parts": F.split(F.regexp_replace(F.translate("text", "_", FRESH), "%+", "%"), "%"),
            "value": F.translate(F.translate("text", "%", ""), "_", FRESH)}), "patterns")
    front = once.select(F.col("text").alias("pattern"), "source_field", F.col("own").alias("by"))
    met = indexed_matches(once.select("value").distinct(), front)
    # A pattern covers itself, so what comes after its first rule isn't looked for.
    pairs = once.join(met, ["value", "source_field"]).filter(F.col("by.by_order") <= F.col("own.by_order"))
    times = F.length("pattern") - F.length(F.translate("pattern", "_", "")) + 2
    last = F.pow(times, F.size("parts") - 1).cast("long") - 1
    covered = pairs.filter(F.forall(
        F.sequence(F.lit(0).cast("long"), last),
        lambda number: F.ilike(_expanded(F.col("parts"), times, number), F.col("pattern"))))
    first = covered.groupBy("source_field", "text").agg(F.min("by").alias("by"))
    return real.join(first, ["source_field", "text"]).filter(F.col("by.by_order") < order).select(
        "priority", "pattern", "source_field", "display_name",
        F.col("by.by_pattern").alias("by_pattern"), F.col("by.by_order.display_name").alias("by_name"))
