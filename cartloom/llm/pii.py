"""Format-preserving pseudonyms, in SQL functions alone: numbers, dates and addresses are permuted within their format.

A value is first checked (Luhn, ranges, calendar), so that ordinary numbers stay. Its digits or letters
then go through a keyed Feistel network over their own domain: a permutation, so equal values get
equal pseudonyms in every document and different values different ones, and a valid value stays valid.
Separators, letter case and the number of digits stay, except that an octet of an IP address may take
one to three digits. The domain of a mail address stays in clear. Nothing is collected or joined: each
document is done on its own.

The patterns are bounded (an address by its grammar: 64 characters before the @, labels of 63, 127 of
them), so the search is linear in the text and its stack is bounded, whatever the text is.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartloom.sources.shared import free_name

ROUNDS = 8
#: A key as it stands in a plan, which Spark then prints as "*********(redacted)".
KEY_MARK, KEY_PATTERN = "pseudonym-key-", "pseudonym-key-[0-9a-f]{64}"
# Fixed formats. The order is that of preference.
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9-]{1,63}\.){1,127}[A-Za-z]{2,63}"
IP = r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"
DATE = r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b|\b\d{2}\.\d{2}\.\d{4}\b"
PHONE = r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}\b|\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}\b|\(\d{3}\) ?\d{3}-\d{4}\b|\b\d{3}-\d{3}-\d{4}\b"
CARD = r"\b\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}\b|\b\d{4}[ -]?\d{6}[ -]?\d{5}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
SECRET = r"\b[0-9a-f]{32,64}\b|\b[0-9A-F]{32,64}\b"
FOUND = "|".join((EMAIL, IP, DATE, PHONE, SSN, CARD, SECRET))
#: The day number of 1901-01-01 and the days of 28 years, in which the calendar repeats: 10227 = 21 * 487.
DAY0, ERA, ERA_A, ERA_B = -25202, 10227, 21, 487


def _prf(key: str, tag: Column, side: Column, i: Column) -> Column:
    """A 60-bit number of the key, the domain, the round and one half."""
    text = F.concat(F.lit(f"{key}|"), tag, F.lit("|"), i.cast("string"), F.lit("|"), side)
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, left: Column, right: Column, m: Column, n: Column, tag: Column) -> Column:
    """The struct (l, r) that the pair (left < m, right < n) is permuted to; the halves are added to by turns."""

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        l = F.when(even, (acc["l"] + _prf(key, tag, acc["r"].cast("string"), i) % m) % m).otherwise(acc["l"])
        r = F.when(even, acc["r"]).otherwise((acc["r"] + _prf(key, tag, acc["l"].cast("string"), i) % n) % n)
        return F.struct(l.alias("l"), r.alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def permuted_digits(key: str, digits: Column, tag: Column) -> Column:
    """Digits (1 to 36 of them) as others of the same number; tag tells domains apart."""

    def with_halves(d: Column) -> Column:
        n = F.length(d)
        a = F.floor(n / 2).cast("int")
        b = n - a
        left = F.when(a > 0, F.substr(d, F.lit(1), a)).otherwise("0").cast("long")
        power = lambda x: F.rpad(F.lit("1"), x + 1, "0").cast("long")
        both = _feistel(key, left, F.substr(d, a + 1, b).cast("long"), power(a), power(b), F.concat(tag, n.cast("string")))
        return _let(both, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, "0"), F.lpad(p["r"].cast("string"), b, "0")))

    return _let(digits, with_halves)


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of digits, of which the last is the check digit."""
    each = F.split(F.reverse(digits), "")
    doubled = F.transform(each, lambda c, i: F.when(i % 2 == 1, F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10).otherwise(c.cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + x)


def _fill(shape: Column, chars: Column, kind: str) -> Column:
    """shape with its characters of a kind (a class of a pattern) replaced by chars, in order; a capital gets a capital."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("i"))

    def put(acc: Column, c: Column) -> Column:
        hit = c.rlike(f"^[{kind}]$")
        new = F.substr(chars, acc["i"], F.lit(1))
        new = F.when(c.rlike("^[A-Z]$"), F.upper(new)).otherwise(new)
        return F.struct(F.concat(acc["s"], F.when(hit, new).otherwise(c)).alias("s"), (acc["i"] + hit.cast("int")).alias("i"))

    return F.aggregate(F.split(shape, ""), start, put)["s"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def card(key: str, value: Column) -> Column:
    """A card number with a valid check digit: all digits but the last are permuted, the last is computed anew."""

    def anew(digits: Column) -> Column:
        body = permuted_digits(key, F.substr(digits, F.lit(1), F.length(digits) - 1), F.lit("card"))
        return _let(body, lambda b: F.concat(b, ((10 - luhn_sum(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))

    return _let(_let(_digits(value), anew), lambda d: _fill(value, d, "0-9"))


def number(key: str, value: Column, tag: str) -> Column:
    return _let(permuted_digits(key, _digits(value), F.lit(tag)), lambda d: _fill(value, d, "0-9"))


def ssn(key: str, value: Column) -> Column:
    """A social security number: a permutation of the valid ones (898 areas, 99 groups, 9999 serial numbers)."""
    part = lambda i: F.split_part(value, F.lit("-"), F.lit(i)).cast("long")
    area = part(1) - 1 - (part(1) > 666).cast("long")
    both = _feistel(key, area * 99 + part(2) - 1, part(3) - 1, F.lit(898 * 99), F.lit(9999), F.lit("ssn"))

    def written_out(p: Column) -> Column:
        a = F.floor(p["l"] / 99) + 1
        a = a + (a >= 666).cast("long")
        each = (a, 3), (p["l"] % 99 + 1, 2), (p["r"] + 1, 4)
        return F.concat_ws("-", *[F.lpad(x.cast("string"), F.lit(n), F.lit("0")) for x, n in each])

    return _let(both, written_out)


def phone(key: str, value: Column) -> Column:
    """A phone number: the country code, up to the first separator, and all separators stay."""
    head = F.regexp_extract(value, r"^(\+\d{1,3}[ .(-]+|\+\d)?(.*)$", 1)
    rest = F.regexp_extract(value, r"^(\+\d{1,3}[ .(-]+|\+\d)?(.*)$", 2)
    return F.concat(head, number(key, rest, "phone"))


def ip(key: str, value: Column) -> Column:
    """An IPv4 address: a permutation of all 2**32."""
    part = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("long")
    both = _feistel(key, part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), F.lit("ip"))
    octets = lambda x: F.concat_ws(".", F.floor(x / 256).cast("string"), (x % 256).cast("string"))
    return _let(both, lambda p: F.concat_ws(".", octets(p["l"]), octets(p["r"])))


def _day(value: Column) -> Column:
    """The date that a text of one of the formats is, null if it is none. dd/MM/yyyy and dd.MM.yyyy."""
    iso = F.when(value.contains("-"), value).otherwise(F.concat_ws("-", F.substring(value, 7, 4), F.substring(value, 4, 2), F.substring(value, 1, 2)))
    return F.try_to_date(iso, "yyyy-MM-dd")


def date(key: str, value: Column) -> Column:
    """A date: a permutation of the 28 years, counted from 1901, that it lies in."""

    def anew(day: Column) -> Column:
        n = F.datediff(day, F.lit("1970-01-01").cast("date")) - DAY0
        era = F.floor(n / ERA)
        at = n - era * ERA
        both = _feistel(key, F.floor(at / ERA_B), at % ERA_B, F.lit(ERA_A), F.lit(ERA_B), F.concat(F.lit("date"), era.cast("string")))
        return _let(both, lambda p: F.date_add(F.lit("1970-01-01").cast("date"), (era * ERA + p["l"] * ERA_B + p["r"] + DAY0).cast("int")))

    shape = F.when(value.contains("-"), "yyyy-MM-dd").when(value.contains("/"), "dd/MM/yyyy").otherwise("dd.MM.yyyy")
    given = _let(_day(value), anew)
    return _let(
        given,
        lambda d: F.when(shape == "yyyy-MM-dd", F.date_format(d, "yyyy-MM-dd")).when(shape == "dd/MM/yyyy", F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "dd.MM.yyyy")),
    )


def letters(key: str, value: Column, alphabet: str, tag: str) -> Column:
    """Characters of an alphabet, each shifted by a number that depends on all the others of its half: a Feistel
    network whose halves are texts, for values longer than a number holds."""

    def shifted(half: Column, by: Column) -> Column:
        each = F.transform(
            F.split(half, ""),
            lambda c, i: F.substr(
                F.lit(alphabet),
                (F.instr(F.lit(alphabet), c) - 1 + F.conv(F.substr(by, i % 64 + 1, F.lit(1)), 16, 10).cast("int") + 16 * F.conv(F.substr(by, (i + 7) % 64 + 1, F.lit(1)), 16, 10).cast("int")) % len(alphabet) + 1,
                F.lit(1),
            ),
        )
        return F.when(F.length(half) > 0, F.array_join(each, "")).otherwise("")

    def turn(acc: Column, i: Column) -> Column:
        even = i % 2 == 0
        fixed = F.when(even, acc["r"]).otherwise(acc["l"])
        moved = F.when(even, acc["l"]).otherwise(acc["r"])
        by = F.sha2(F.concat(F.lit(f"{key}|{tag}|"), F.length(moved).cast("string"), F.lit("|"), i.cast("string"), F.lit("|"), fixed), 256)
        new = _let(by, lambda b: shifted(moved, b))
        return F.struct(F.when(even, new).otherwise(acc["l"]).alias("l"), F.when(even, acc["r"]).otherwise(new).alias("r"))

    a = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.when(a > 0, F.substr(value, F.lit(1), a)).otherwise("").alias("l"), F.substr(value, a + 1, F.length(value) - a).alias("r"))
    return _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn), lambda p: F.concat(p["l"], p["r"]))


LOWER = "abcdefghijklmnopqrstuvwxyz"
DIGITS = "0123456789"
HEX = "0123456789abcdef"


def email(key: str, value: Column) -> Column:
    """An address: letters and digits of the local part are permuted; its dots, its case and its domain stay.

    Addresses that differ in case alone are one, so their pseudonyms differ in case alone too.
    """
    local = F.split_part(value, F.lit("@"), F.lit(1))
    small = F.regexp_replace(F.lower(local), "[^a-z]", "")
    figures = F.regexp_replace(local, "[^0-9]", "")
    # digits are permuted under a key of the letters, letters under that of the shape
    new_small = F.when(F.length(small) > 0, letters(key, small, LOWER, "email")).otherwise("")
    few = permuted_digits(key, figures, F.concat(F.lit("email"), small))
    new_figures = F.when(F.length(figures) == 0, "").when(F.length(figures) <= 36, few).otherwise(letters(key, figures, DIGITS, "email"))
    filled = _let(new_small, lambda s: _fill(local, s, "A-Za-z"))
    return _let(filled, lambda f: F.concat(_let(new_figures, lambda d: _fill(f, d, "0-9")), F.lit("@"), F.split_part(value, F.lit("@"), F.lit(2))))


def kind_of(value: Column) -> Column:
    """email, ip, date, card, phone, ssn, secret, or null for what isn't valid: such a number is no one's and stays."""
    digits = _digits(value)
    octet = lambda i: F.split_part(value, F.lit("."), F.lit(i)).cast("int") <= 255
    return (
        F.when(value.contains("@"), "email")
        .when(value.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), F.when(octet(1) & octet(2) & octet(3) & octet(4), "ip"))
        .when(value.rlike(r"^(\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4})$"), F.when(_day(value).between("1901-01-01", "2096-12-31"), "date"))
        .when(value.rlike(r"^(\+|\()") | value.rlike(r"^\d{3}-\d{3}-\d{4}$"), F.when(F.length(digits).between(8, 16), "phone"))
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), F.when(~value.rlike(r"^(000|666|9)|-00-|-0000$"), "ssn"))
        .when(value.rlike(r"^[\d -]+$") & F.length(digits).between(13, 19), F.when(luhn_sum(digits) % 10 == 0, "card"))
        .when(value.rlike(r"^([0-9a-f]{32,64}|[0-9A-F]{32,64})$"), F.when(value.rlike("[a-fA-F]") & value.rlike("[0-9]"), "secret"))
    )


def pseudonym(key: str, value: Column) -> Column:
    """A found value as its pseudonym; what isn't valid stays."""
    kind = kind_of(value)
    return _let(
        kind,
        lambda k: F.when(k == "email", email(key, value))
        .when(k == "ip", ip(key, value))
        .when(k == "date", date(key, value))
        .when(k == "card", card(key, value))
        .when(k == "phone", phone(key, value))
        .when(k == "ssn", ssn(key, value))
        .when(k == "secret", F.when(value.rlike("[a-f]"), letters(key, value, HEX, "secret")).otherwise(F.upper(letters(key, F.lower(value), HEX, "secret"))))
        .otherwise(value),
    )


def hide_key(spark: SparkSession) -> None:
    """Plans show the key redacted, beside what the session's own pattern hides."""
    name = "spark.sql.redaction.string.regex"
    own = spark.conf.get(name, None) or spark.conf.get("spark.redaction.string.regex", None)
    if KEY_PATTERN not in (own or ""):
        spark.conf.set(name, f"(?:{own})|{KEY_PATTERN}" if own else KEY_PATTERN)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs (text, ...) with the values of text as pseudonyms, and n_found: how many values of each kind were found.

    A null text stays null and has none; nulls in other columns, ties and repeated rows stay as they
    are; no documents give no rows. All other columns stay, whatever their names: if there is an
    n_found already, the number's name is the first free one of n_found_1, n_found_2, ... A text without
    a digit or @ is not searched, as every format has one.

    The key is hashed, and plans show it redacted.
    """
    spark, names = docs.sparkSession, docs.columns
    hide_key(spark)
    key = KEY_MARK + hashlib.sha256(key.encode()).hexdigest()
    held, made, gaps, number_name = (free_name(names, x) for x in ("_found", "_new", "_between", "n_found"))
    found = F.when(F.col("text").rlike("[0-9@]"), F.regexp_extract_all("text", F.lit(FOUND), F.lit(0)))
    kept = docs.withColumn(held, F.when(F.size(found) > 0, found))
    new = F.transform(held, lambda v: F.struct(pseudonym(key, v).alias("new"), kind_of(v).alias("kind")))
    done = kept.withColumn(made, F.when(F.col(held).isNotNull(), new)).withColumn(gaps, F.when(F.col(held).isNotNull(), F.split("text", FOUND, -1)))
    joined = F.array_join(F.flatten(F.transform(gaps, lambda b, i: F.array(b, F.coalesce(F.get(F.col(made), i)["new"], F.lit(""))))), "")
    text = F.when(F.col(made).isNotNull(), joined).otherwise(F.col("text")).alias("text")
    n = F.coalesce(F.size(F.filter(made, lambda x: x["kind"].isNotNull())), F.lit(0))
    number_of = F.when(F.col(made).isNull(), F.lit(0)).otherwise(n).cast("long").alias(number_name)
    return done.select(*[text if c == "text" else F.col(f"`{c}`") for c in names], number_of)
