"""Format-preserving pseudonyms of personal data, in DataFrame operations only.

Numbers and dates that pass their checks (Luhn for cards, ranges for addresses and dates) are permuted by keyed Feistel
networks within their own format: a card stays a valid card of its network, an address an address, a date a date, and so
on.  A permutation has no collisions and always maps a value to the same pseudonym under one key, so equal values stay
linked across documents while different ones stay apart.  Text between them is left alone.

All happens within a row, so that nothing is shuffled and rows that repeat a doc_id stay apart.  A value that a formula
needs several times is bound to a lambda's variable (`bound`), as Spark would else evaluate it anew at each place.  The
round function is HMAC-SHA-256; its two key pads come from a one-row table, so that no plan shows the key.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import shared

ROUNDS = 8
#: Patterns of what may be private, in order of precedence; the kind of a match is the first whose whole pattern fits it.
KINDS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?:AKIA[A-Z0-9]{16}|[0-9a-f]{40}|(?<=password=)[0-9a-f]{8,64})",
    "date": r"[0-9]{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])",
    "ip": r"(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])",
    "phone": r"\+[0-9]{1,3} ?\(?[0-9]{2,4}\)?[ -]?[0-9]{3,4}[ -]?[0-9]{4}",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "card": r"[0-9](?:[ -]?[0-9]){12,18}",
}
PATTERN = "(?<![A-Za-z0-9])(?=[A-Za-z0-9+])(?:" + "|".join(KINDS.values()) + ")(?![A-Za-z0-9])"
MARK = "password="
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
#: The calendar repeats every 400 years, which have 146097 days = 27 * 5411, so a day of them is a pair of residues.
CYCLE, DAYS_HIGH, DAYS_LOW = 400, 27, 5411


@dataclass(frozen=True)
class Key:
    """Columns with the inner and the outer pad of a key."""

    inner: Column
    outer: Column

    def digest(self, *parts: Column) -> Column:
        """HMAC-SHA-256 of the parts, in hex."""
        message = F.concat_ws("|", *(p.cast("string") for p in parts)).cast("binary")
        return F.sha2(F.concat(self.outer, F.unhex(F.sha2(F.concat(self.inner, message), 256))), 256)


def with_key(docs: DataFrame, key: str) -> tuple[DataFrame, Key]:
    """docs with the pads of a key as binary columns _inner and _outer, read from a one-row table."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    pads = [tuple(bytearray(x ^ pad for x in raw) for pad in (0x36, 0x5C))]
    table = _one_row(docs.sparkSession, pads)
    return docs.select("*", table.select("inner").scalar().alias("_inner"), table.select("outer").scalar().alias("_outer")), Key(F.col("_inner"), F.col("_outer"))


def _one_row(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "inner binary, outer binary")


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(digest: Column, modulus: Column) -> Column:
    """A number below the modulus from 60 bits of a digest."""
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % modulus


def _loop(start: Column, step) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def feistel_pair(high: Column, low: Column, n_high: Column, n_low: Column, key: Key, tweak: str) -> Column:
    """struct(a, b): a keyed permutation of pairs below (n_high, n_low)."""
    start = F.struct(high.cast("long").alias("a"), low.cast("long").alias("b"))

    def step(pair: Column, r: Column) -> Column:
        a, b = pair["a"], pair["b"]
        odd = r % 2 == 1
        return F.struct(
            F.when(odd, (a + _number(key.digest(F.lit(tweak), n_high, n_low, r, b), n_high)) % n_high).otherwise(a).alias("a"),
            F.when(odd, b).otherwise((b + _number(key.digest(F.lit(tweak), n_high, n_low, r, a), n_low)) % n_low).alias("b"),
        )

    return _loop(start, step)


def feistel_digits(digits: Column, key: Key, tweak: str) -> Column:
    """A keyed permutation of the strings of as many digits, up to 36."""

    def moved(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        rest = F.length(s) - half
        as_long = lambda x: F.concat(F.lit("0"), x).cast("long")
        size = lambda n: F.rpad(F.lit("1"), n + 1, "0").cast("long")
        return bound(
            F.struct(as_long(F.substring(s, F.lit(1), half)).alias("a"), as_long(F.substring(s, half + 1, rest)).alias("b"), size(half).alias("m"), size(rest).alias("n")),
            lambda x: bound(
                feistel_pair(x["a"], x["b"], x["m"], x["n"], key, tweak),
                lambda y: F.concat(F.lpad(y["a"].cast("string"), half, "0"), F.lpad(y["b"].cast("string"), rest, "0")),
            ),
        )

    return bound(digits, moved)


def _moved(text: Column, digest: Column, alphabets: tuple[str, ...]) -> Column:
    """Each character of text moved within the first alphabet that has it, by a byte of the digest."""

    def one(c: Column, i: Column, d: Column) -> Column:
        by = F.conv(F.substring(d, (i % 31) * 2 + F.lit(1), F.lit(2)), 16, 10).cast("int")
        out = c
        for alphabet in reversed(alphabets):
            at = F.instr(F.lit(alphabet), c)
            out = F.when(at > 0, F.substring(F.lit(alphabet), (at - 1 + by) % len(alphabet) + 1, F.lit(1))).otherwise(out)
        return out

    return bound(digest, lambda d: F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c == "", c).otherwise(one(c, i, d))), ""))


def feistel_text(text: Column, key: Key, alphabets: tuple[str, ...], tweak: str) -> Column:
    """A keyed permutation of the strings that have a character of the same alphabet at each place."""

    def moved(s: Column) -> Column:
        half = F.floor(F.length(s) / 2).cast("int")
        start = F.struct(F.substring(s, F.lit(1), half).alias("a"), F.substring(s, half + 1, F.length(s)).alias("b"))

        def step(pair: Column, r: Column) -> Column:
            a, b = pair["a"], pair["b"]
            odd = r % 2 == 1
            return F.struct(
                F.when(odd, _moved(a, key.digest(F.lit(tweak), r, F.length(a), b), alphabets)).otherwise(a).alias("a"),
                F.when(odd, b).otherwise(_moved(b, key.digest(F.lit(tweak), r, F.length(b), a), alphabets)).alias("b"),
            )

        return bound(_loop(start, step), lambda y: F.concat(y["a"], y["b"]))

    return bound(text, moved)


def _luhn_sum(digits: Column) -> Column:
    """Luhn's sum of a string of digits that a check digit would follow."""

    def of(s: Column) -> Column:
        n = F.length(s)

        def add(total: Column, i: Column) -> Column:
            d = F.substring(s, i, F.lit(1)).cast("int")
            twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
            return total + F.when((n - i) % 2 == 0, twice).otherwise(d)

        return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)

    return bound(digits, of)


def _check_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order, by those given."""

    def put(s: Column, d: Column) -> Column:
        def one(acc: Column, c: Column) -> Column:
            digit = F.instr(F.lit(DIGITS), c) > 0
            return F.struct(F.concat(acc["s"], F.when(digit, F.substring(d, acc["k"], F.lit(1))).otherwise(c)).alias("s"), (acc["k"] + digit.cast("int")).alias("k"))

        return F.aggregate(F.filter(F.split(s, ""), lambda c: c != ""), F.struct(F.lit("").alias("s"), F.lit(1).alias("k")), one)["s"]

    return bound(F.struct(shape.alias("s"), digits.alias("d")), lambda x: put(x["s"], x["d"]))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card(value: Column, key: Key) -> Column:
    """A card's pseudonym: first digit kept, check digit valid, blanks and dashes in place."""

    def of(digits: Column) -> Column:
        body = F.concat(F.substring(digits, 1, 1), feistel_digits(F.substring(digits, F.lit(2), F.length(digits) - 2), key, "card"))
        return bound(body, lambda b: _refill(value, F.concat(b, _check_digit(b))))

    return bound(_only_digits(value), of)


def is_card(value: Column) -> Column:
    return bound(_only_digits(value), lambda d: _check_digit(F.substring(d, F.lit(1), F.length(d) - 1)) == F.substring(d, -1, 1))


def date(value: Column, key: Key) -> Column:
    """A date's pseudonym within its 400 years; every date from 0000 to 9999 has one."""

    def of(d: Column) -> Column:
        begin = F.make_date(F.floor(F.year(d) / CYCLE).cast("int") * CYCLE, F.lit(1), F.lit(1))
        return bound(
            F.struct(begin.alias("begin"), F.datediff(d, begin).alias("day")),
            lambda x: bound(
                feistel_pair(F.floor(x["day"] / DAYS_LOW), x["day"] % DAYS_LOW, F.lit(DAYS_HIGH).cast("long"), F.lit(DAYS_LOW).cast("long"), key, "date"),
                lambda y: F.date_add(x["begin"], (y["a"] * DAYS_LOW + y["b"]).cast("int")).cast("string"),
            ),
        )

    return bound(F.try_to_date(value, "yyyy-MM-dd"), of)


def address(value: Column, key: Key) -> Column:
    size = F.lit(65_536).cast("long")

    def of(octet: Column) -> Column:
        return bound(
            feistel_pair(octet[0] * 256 + octet[1], octet[2] * 256 + octet[3], size, size, key, "ip"),
            lambda y: F.concat_ws(".", *(p.cast("string") for p in (F.floor(y["a"] / 256), y["a"] % 256, F.floor(y["b"] / 256), y["b"] % 256))),
        )

    return bound(F.transform(F.split(value, r"\."), lambda x: x.cast("long")), of)


def kind_of(value: Column, before: Column) -> Column:
    """The kind of a match with the text before it; null if it fails its check."""
    out = F.lit(None).cast("string")
    for kind, pattern in reversed(list(KINDS.items())):
        fits = F.regexp_like(value, F.lit(f"^(?:{pattern})$"))
        if kind == "secret":
            fits = fits | (F.endswith(before, F.lit(MARK)) & F.regexp_like(value, F.lit("^[0-9a-f]{8,64}$")))
        if kind == "card":
            fits = fits & is_card(value)
        if kind == "date":
            fits = fits & F.try_to_date(value, "yyyy-MM-dd").isNotNull()
        out = F.when(fits, F.lit(kind)).otherwise(out)
    return out


def pseudonym(kind: Column, value: Column, key: Key) -> Column:
    """What stands for a value; a value of no kind stays."""
    at = F.instr(value, "@")
    email = F.concat(feistel_text(F.substring(value, F.lit(1), at - 1), key, (DIGITS, LOWER, UPPER), "email"), F.substring(value, at, F.length(value)))
    hexed = F.regexp_like(value, F.lit("^[0-9a-f]+$"))
    secret = F.when(hexed, feistel_text(value, key, (HEX,), "secret")).otherwise(
        F.concat(F.substring(value, 1, 4), feistel_text(F.substring(value, F.lit(5), F.length(value)), key, (DIGITS, UPPER), "secret"))
    )
    code = F.length(F.regexp_extract(value, r"^(\+[0-9]{1,3})", 1))
    number = F.substring(value, code + 1, F.length(value))
    phone = F.concat(F.substring(value, F.lit(1), code), bound(number, lambda s: _refill(s, feistel_digits(_only_digits(s), key, "phone"))))
    ssn = _refill(value, feistel_digits(_only_digits(value), key, "ssn"))
    choices = {"email": email, "secret": secret, "date": date(value, key), "ip": address(value, key), "phone": phone, "ssn": ssn, "card": card(value, key)}
    out = value
    for k, v in choices.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def _split(docs: DataFrame) -> DataFrame:
    """docs with `values`, the matches of each text in order, and `parts`, the text before, between and behind them."""
    found = docs.withColumn("values", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)))
    return found.withColumn("parts", F.when(F.size("values") > 0, F.split("text", PATTERN, -1)).otherwise(F.array("text")))


def _kinds() -> Column:
    """Matches as structs of kind and value."""
    before = F.slice("parts", F.lit(1), F.size("values"))
    return F.zip_with("values", before, lambda v, p: F.struct(kind_of(v, p).alias("kind"), v.alias("value")))


def private_values(docs: DataFrame) -> DataFrame:
    """doc_id, place (from 0), kind, value: the matches of each row of docs in order; kind is null where a check failed."""
    rows = _split(shared.documents(docs)).select("doc_id", _kinds().alias("found"))
    return rows.select("doc_id", F.posexplode("found").alias("place", "m")).select("doc_id", "place", "m.kind", "m.value")


def pseudonymised(docs: DataFrame, *, key: str) -> DataFrame:
    """doc_id, n_found, kinds (distinct, sorted, comma-joined), text for each row of docs, private values replaced.

    Null text counts as empty and comes back empty; texts may be of any length.  A number or date that fails its check is
    no private value and stays.  Each row is treated by itself: rows that repeat a doc_id, with the same text or another,
    give a row each.  Other columns are ignored; an empty table gives no rows.
    """
    rows, pads = with_key(_split(shared.documents(docs)), key)
    rows = rows.withColumn("found", _kinds())
    rows = rows.withColumn("new", F.transform("found", lambda m: F.struct(m["kind"].alias("kind"), pseudonym(m["kind"], m["value"], pads).alias("text"))))
    known = F.filter(F.col("new.kind"), lambda k: k.isNotNull())
    between = F.slice("parts", F.lit(2), F.size("parts"))
    glued = F.concat(F.get("parts", F.lit(0)), F.array_join(F.zip_with(F.col("new.text"), between, lambda m, p: F.concat(m, p)), ""))
    return rows.select("doc_id", F.size(known).cast("long").alias("n_found"), F.array_join(F.array_sort(F.array_distinct(known)), ",").alias("kinds"), glued.alias("text"))
