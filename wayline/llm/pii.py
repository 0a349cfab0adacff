"""Personal data replaced by pseudonyms of the same format.

Numbers that pass the checks of their kind, and real dates, are permuted
within their format by a keyed Feistel network: equal values get equal
pseudonyms in every document, different values different ones, and whoever
holds the key can turn them back.  A card number stays a card number with a
right check digit, an address an address, a date a date.  Names of mailboxes
and secrets, which have no number behind them, get keyed digests, secrets such
of their length.

The key is the caller's, as an argument or in the session (``spark.wayline.pii.key``);
without one it is an error, since whoever has the key can undo the numbers.

Everything is built-in expressions on one row: a text is split at what looks
like personal data, every find is replaced, and the parts are joined again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.base import let, packed, unpacked

KEY_SETTING = "spark.wayline.pii.key"
#: For tests and the queries over the test tables; it hides nothing.
TEST_KEY = "not a secret"
ROUNDS = 8

_END, _START = r"(?![A-Za-z0-9_])", r"(?<![A-Za-z0-9_])"
#: How the tokens of some well-known services start, and what follows.
TOKENS = (r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}"
          r"|glpat-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{30,}|sk-[A-Za-z0-9_-]{20,}")
_TOKEN_STARTS = r"AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abprs]-|AIza|sk-"
_SECRET_NAME = (r"(?i:token|secret|password|passwd|api[_-]?key|access[_-]?key|secret[_-]?key)"
                r"[\x22']?\s{0,3}[=:]\s{0,3}")
#: What each kind looks like; the first kind that fits at a place wins.
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}",
    # In quotes anything, else a word of eight with a digit or of sixteen.
    "secret": _SECRET_NAME + r"(?:\x22[^\x22\r\n]{4,}\x22|'[^'\r\n]{4,}'"
              r"|(?=[^\s\x22',;]*\d|[^\s\x22',;]{16})[^\s\x22',;]{8,})|" + _START + f"(?:{TOKENS})" + r"(?![A-Za-z0-9_])",
    "iban": _START + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?" + _END,
    "ip6": r"(?<![A-Za-z0-9_:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?i:[23][0-9a-f]{3}|f[cde][0-9a-f]{2})"
           r"(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![A-Za-z0-9_:])",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)",
    "date": _START + r"(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})" + _END,
    "ssn": _START + r"\d{3}-\d{2}-\d{4}" + _END,
    "card": _START + r"(?:\d{4}[ -]?){3}\d{1,7}" + _END,
    "phone": r"(?<![A-Za-z0-9_+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}" + _END
             + r"|(?<![A-Za-z0-9_+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,4}" + _END,
}
ANY = "|".join(f"(?:{shape})" for shape in SHAPES.values())
#: Nothing above matches a text without one of these, which is quick to see.
HINT = rf"\d|@|::|(?i:token|secret|passw|key)|{_TOKEN_STARTS}"

#: Days from this day on are permuted: 400 years, 189 * 773 days, all of the same calendar.
FIRST_DAY, DAY_FACTORS = "1800-01-01", (189, 773)
#: All other days of the years 1 to 9999, so many before and after, are permuted among themselves.
DAYS_BEFORE, OTHER_FACTORS = 657_071, (762, 4601)
DATE_FORMATS = {"-": "yyyy-MM-dd", "/": "dd/MM/yyyy", ".": "dd.MM.yyyy"}


def keyed(key: str, *parts: Column) -> Column:
    """Keyed digest in hex; the parts must not be ambiguous when joined by bars."""
    return F.sha2(F.concat_ws("|", F.lit(key), *[p.cast("string") for p in parts], F.lit(key)), 256)


def feistel(value: Column, a: Column, b: Column, tweak: Column, key: str,
            back: bool = False) -> Column:
    """Keyed permutation of 0 .. a*b - 1.

    ``value`` is seen as two digits to bases ``a`` and ``b``; in turn each has
    a digest of the other added to it.  ``back`` undoes it.
    """
    def step(state, number):
        even = number % 2 == 0
        base = F.when(even, a).otherwise(b)
        fixed = F.when(even, state["y"]).otherwise(state["x"])
        digest = F.conv(F.substring(keyed(key, tweak, number, fixed), 1, 14), 16, 10).cast("long")
        moved = F.when(even, state["x"]).otherwise(state["y"])
        new = F.pmod(moved - digest if back else moved + digest, base)
        return F.struct(F.when(even, new).otherwise(state["x"]).alias("x"),
                        F.when(even, state["y"]).otherwise(new).alias("y"))

    start = F.struct(F.floor(value / b).cast("long").alias("x"), F.pmod(value, b).alias("y"))
    order = range(ROUNDS - 1, -1, -1) if back else range(ROUNDS)
    return F.aggregate(F.array(*[F.lit(k) for k in order]), start, step,
                       lambda s: s["x"] * b + s["y"])


def _power(n: Column) -> Column:
    """10 ** n as a long, for n up to 18."""
    return F.element_at(F.array(*[F.lit(10**k).cast("long") for k in range(19)]), (n + 1).cast("int"))


def permuted_digits(digits: Column, tweak: Column, key: str, back: bool = False) -> Column:
    """Permute a string of 2 to 18 digits among all strings of its length."""
    def body(d):
        n = F.length(d)
        half = F.floor(n / 2)
        moved = feistel(d.cast("long"), _power(half), _power(n - half),
                        F.concat_ws("|", tweak, n), key, back)
        return F.lpad(moved.cast("string"), n, "0")

    return let(digits, body)


def digits_of(text: Column) -> Column:
    return F.regexp_replace(text, r"\D+", "")


def _refilled(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced, in turn, by ``digits``."""
    def step(state, c):
        hit = c.between("0", "9")
        return F.struct(
            F.concat(state["text"], F.when(hit, F.substring(digits, state["at"], F.lit(1)))
                     .otherwise(c)).alias("text"),
            F.when(hit, state["at"] + 1).otherwise(state["at"]).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
                       step, lambda s: s["text"])


def luhn_digit(digits: Column) -> Column:
    """Check digit that makes a card number of ``digits`` right."""
    def value(c, i):
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 0, twice).otherwise(d)

    values = F.transform(F.split(F.reverse(digits), ""), value)
    total = F.aggregate(values, F.lit(0), lambda x, y: x + y)
    return F.pmod(-total, F.lit(10)).cast("string")


def luhn_fits(digits: Column) -> Column:
    n = F.length(digits)
    return luhn_digit(F.substring(digits, F.lit(1), n - 1)) == F.substring(digits, n, F.lit(1))


def iban_remainder(iban: Column) -> Column:
    """Remainder by 97 of a compact IBAN, 1 if it is right."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def step(state, c):
        letter = c.between("A", "Z")
        number = F.when(letter, F.ascii(c) - 55).otherwise(F.ascii(c) - 48)
        return F.pmod(state * F.when(letter, 100).otherwise(10) + number, F.lit(97)).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def permuted_account(digits: Column, tweak: Column, key: str) -> Column:
    """Permute 2 to 36 digits; more than 18 in two halves, each under the other."""
    n = F.length(digits)
    front = F.floor((n + 1) / 2).cast("int")

    def halves(h):
        under = F.concat_ws("|", tweak, h["back"])
        return let(permuted_digits(h["front"], under, key), lambda new: F.concat(
            new, permuted_digits(h["back"], F.concat_ws("|", tweak, new), key)))

    both = F.struct(F.substring(digits, F.lit(1), front).alias("front"),
                    F.substring(digits, front + 1, n).alias("back"))
    return F.when(n < 2, digits).when(n <= 18, permuted_digits(digits, tweak, key)).otherwise(let(both, halves))


def _iban(find: Column, key: str) -> Column:
    """Country and letters stay, the digits of the account are permuted, the check digits follow.

    A find may go on into words or numbers behind; the longest part up to a
    space that is right counts, and a card number may follow.
    """
    def compact(text):
        return F.replace(text, F.lit(" "), F.lit(""))

    def replaced(iban):
        def body(whole):
            country = F.substring(whole, 1, 2)
            account = F.substring(whole, F.lit(5), F.length(whole))
            new = permuted_account(digits_of(account), F.concat_ws("|", F.lit("iban"), country), key)

            def checked(rest):
                check = F.lpad((98 - iban_remainder(F.concat(country, F.lit("00"), rest))).cast("string"), 2, "0")
                return _spaced(iban, F.concat(country, check, rest))

            return let(_refilled(account, new), checked)

        return let(compact(iban), body)

    def right(end):
        return let(compact(F.substring(find, F.lit(1), end)), lambda c: F.length(c).between(15, 34)
                   & (iban_remainder(c) == 1))

    n = F.length(find)
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: (k == n) | (F.substring(find, k + 1, F.lit(1)) == " "))

    def split(end):
        rest = F.substring(find, end + 1, n)
        shown = F.when(end > 0, replaced(F.substring(find, F.lit(1), end))).otherwise(F.lit(""))
        card = F.regexp_extract(rest, SHAPES["card"], 0)
        at = F.instr(rest, card)
        behind = F.when(card != "", F.concat(
            F.substring(rest, F.lit(1), at - 1), _card(card, key),
            F.substring(rest, at + F.length(card), n))).otherwise(rest)
        return F.concat(shown, behind)

    return let(F.coalesce(F.array_max(F.filter(ends, right)), F.lit(0)), split)


def _spaced(shape: Column, compact: Column) -> Column:
    """``compact`` with the spaces of ``shape``."""
    def step(state, c):
        space = c == " "
        return F.struct(
            F.concat(state["text"], F.when(space, c).otherwise(
                F.substring(compact, state["at"], F.lit(1)))).alias("text"),
            F.when(space, state["at"]).otherwise(state["at"] + 1).alias("at"))

    return F.aggregate(F.split(shape, ""), F.struct(F.lit("").alias("text"), F.lit(1).alias("at")),
                       step, lambda s: s["text"])


def _ip(find: Column, key: str) -> Column:
    octets = F.transform(F.split(find, r"\."), lambda x: x.cast("int"))

    def body(o):
        value = F.aggregate(o, F.lit(0).cast("long"), lambda x, y: x * 256 + y)
        half = F.lit(65536).cast("long")
        moved = feistel(value, half, half, F.lit("ip"), key)
        new = let(moved, lambda m: F.concat_ws(".", *[
            F.pmod(F.shiftright(m, s), F.lit(256)).cast("string") for s in (24, 16, 8, 0)]))
        return F.when(F.array_max(o) < 256, new).otherwise(find)

    return let(octets, body)


def _ip6(find: Column, key: str) -> Column:
    """Four words of 32 bits, each permuted under the others; written in eight groups."""
    left = F.split(F.substring_index(find, "::", 1), ":")
    right = F.filter(F.split(F.when(find.contains("::"), F.substring_index(find, "::", -1)).otherwise(""), ":"),
                     lambda x: x != "")
    gap = 8 - F.size(left) - F.size(right)
    zeros = F.array_repeat(F.lit("0"), F.greatest(gap, F.lit(0)))
    groups = F.transform(F.concat(left, zeros, right), lambda x: F.conv(x, 16, 10).cast("long"))
    half = F.lit(65536).cast("long")

    def moved(words, k):
        others = [F.get(words, F.lit(j)) for j in range(4) if j != k]
        new = feistel(F.get(words, F.lit(k)), half, half, F.concat_ws("|", F.lit(f"ip6|{k}"), *others), key)
        return F.array(*[new if j == k else F.get(words, F.lit(j)) for j in range(4)])

    def steps(words, k=0):
        return words if k == 4 else let(moved(words, k), lambda w: steps(w, k + 1))

    def body(g):
        words = F.array(*[F.get(g, F.lit(2 * k)) * 65536 + F.get(g, F.lit(2 * k + 1)) for k in range(4)])
        new = let(words, lambda w: steps(w))
        return F.array_join(F.flatten(F.transform(new, lambda w: F.array(
            F.lower(F.hex(F.floor(w / 65536).cast("long"))), F.lower(F.hex(F.pmod(w, half)))))), ":")

    return F.when(F.size(groups) == 8, let(groups, body)).otherwise(find)


def _date(find: Column, key: str) -> Column:
    mark = F.regexp_extract(find, r"[-/.]", 0)
    out = find
    first = F.to_date(F.lit(FIRST_DAY))
    a, b, c, d = (F.lit(x).cast("long") for x in (*DAY_FACTORS, *OTHER_FACTORS))
    before = F.lit(DAYS_BEFORE).cast("long")

    def moved(day):
        since = F.date_diff(day, first).cast("long")
        near = feistel(since, a, b, F.lit("date"), key)
        # Days before the first are numbered from 0, those after the 400 years follow.
        far = feistel(F.when(since < 0, since + before).otherwise(since - a * b + before), c, d, F.lit("far"), key)
        new = F.when((since >= 0) & (since < a * b), near).otherwise(
            let(far, lambda n: F.when(n < before, n - before).otherwise(n - before + a * b)))
        return F.when(since >= -before, F.date_add(first, new.cast("int")))

    for sign, pattern in DATE_FORMATS.items():
        new = F.date_format(let(F.try_to_date(find, pattern), moved), pattern)
        out = F.when(mark == sign, F.coalesce(new, find)).otherwise(out)
    return out


def _card(find: Column, key: str) -> Column:
    def body(digits):
        n = F.length(digits)
        front = F.substring(digits, F.lit(1), n - 1)

        def moved(new):
            return _refilled(find, F.concat(new, luhn_digit(new)))

        good = let(permuted_digits(front, F.lit("card"), key), moved)
        return F.when(n.between(13, 19) & luhn_fits(digits), good).otherwise(find)

    return let(digits_of(find), body)


def _numbered(find: Column, tweak: str, key: str) -> Column:
    return _refilled(find, permuted_digits(digits_of(find), F.lit(tweak), key))


def _phone(find: Column, key: str) -> Column:
    """Seven to fifteen digits are a number; its country code stays."""
    code = F.regexp_extract(find, r"^\+\d{1,3}(?=[ .(-])|^\+\d", 0)
    moved = let(code, lambda c: F.concat(c, _numbered(
        F.substring(find, F.length(c) + 1, F.length(find)), "phone", key)))
    return F.when(F.length(digits_of(find)).between(7, 15), moved).otherwise(find)


def _ssn(find: Column, key: str) -> Column:
    valid = ~find.rlike(r"^(?:000|666|9)|-00-|-0000$")
    return F.when(valid, _numbered(find, "ssn", key)).otherwise(find)


def _email(find: Column, key: str) -> Column:
    box = keyed(key, F.lit("email"), F.lower(find))
    host = keyed(key, F.lit("host"), F.lower(F.substring_index(find, "@", -1)))
    return F.concat(F.lit("user"), F.substring(box, 1, 12), F.lit("@"), F.substring(host, 1, 8),
                    F.lit(".example"))


def _secret(find: Column, key: str) -> Column:
    """The name, or the start of a token, and the quotes stay; the value becomes a digest of its length."""
    head = F.regexp_extract(find, rf"^(?:{_SECRET_NAME}[\x22']?|{_TOKEN_STARTS})", 0)
    tail = F.regexp_extract(F.substring(head, F.length(head), F.lit(1)), r"[\x22']", 0)

    def body(v):
        digest = keyed(key, F.lit("secret"), v)
        return F.concat(head, F.substring(F.repeat(digest, (F.length(v) / 64 + 1).cast("int")), F.lit(1), F.length(v)), tail)

    return let(F.substring(find, F.length(head) + 1, F.length(find) - F.length(head) - F.length(tail)), body)


def kind_of(find: Column) -> Column:
    """The first kind whose shape a find has."""
    out = F.lit("phone")
    for kind, shape in reversed(SHAPES.items()):
        out = F.when(find.rlike(f"^(?:{shape})$"), F.lit(kind)).otherwise(out)
    return out


def pseudonym(find: Column, key: str) -> Column:
    """What stands for a find; itself if it isn't valid for its kind."""
    makers = {"email": _email, "secret": _secret, "iban": _iban, "ip6": _ip6, "ip": _ip, "date": _date,
              "ssn": _ssn, "card": _card, "phone": _phone}

    def body(kind):
        out = find
        for name, make in makers.items():
            out = F.when(kind == name, make(find, key)).otherwise(out)
        return out

    return let(kind_of(find), body)


def _with_finds(df: DataFrame, key: str | None) -> DataFrame:
    """``text`` with pseudonyms and ``n_replaced``, for rows with ``text``."""
    key = key or df.sparkSession.conf.get(KEY_SETTING, None)
    if not key:
        raise ValueError(f"pass a key or set {KEY_SETTING}")
    text = F.col("text")
    finds = F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))
    df = df.withColumn("finds", finds)
    some = F.size("finds") > 0
    # Texts are taken apart only where there is something to replace.
    df = df.withColumn("parts", F.when(some, F.split("text", ANY, -1)))
    df = df.withColumn("new", F.when(some, F.transform("finds", lambda x: pseudonym(x, key))))
    joined = F.concat(F.array_join(F.flatten(F.zip_with(
        F.slice("parts", F.lit(1), F.size("new")), "new", lambda p, n: F.array(p, n))), ""),
        F.element_at("parts", -1))
    changed = F.size(F.filter(F.arrays_zip("finds", "new"), lambda x: x["finds"] != x["new"]))
    return (df.withColumn("n_replaced", F.when(some, changed).otherwise(0))
            .withColumn("text", F.when(some, joined).otherwise(text))
            .drop("finds", "parts", "new"))


def pseudonymised(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``doc_id``, the text with pseudonyms, and how many finds were replaced.

    A null text stays null with nothing replaced, and an empty table gives an
    empty one.  Rows are taken one by one, so repeated rows and rows without an
    id are no matter.  Texts of any length are taken whole.
    """
    return _with_finds(docs.select("doc_id", "text"), key).select("doc_id", "text", "n_replaced")


def private_documents(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with pseudonyms in their texts and all columns as they were."""
    rows = _with_finds(docs.select(packed(docs).alias("row"), F.col("text").alias("text")), key)
    rows = rows.withColumn("row", F.col("row").withField("text", F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("row", F.col("row").withField(
            "n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))
    return unpacked(rows, docs.columns)
