"""Format-preserving pseudonyms for personal data, in column expressions only.

One pattern finds e-mail addresses, IPv4 addresses, dates, phone numbers, card
and account numbers and long keys. Found values are validated and permuted by a
keyed Feistel network within their format: a digit stays a digit, a letter keeps
its case, punctuation stays. Equal values get equal pseudonyms in every document,
however they are punctuated, so they stay linked; without the key they cannot be
turned back.

  * card number (Luhn holds): all digits but the last are permuted and the last
    is set so that Luhn holds again. Other long numbers: all digits.
  * date: the day number is permuted within its block of 65,536 days from
    1920-01-01 (until 2099-06-06), so the result is a real date in the same
    notation. Impossible dates are left alone.
  * IPv4 address: the 32-bit number; numbers over 255 are left alone.
  * phone number: all digits behind the country code.
  * e-mail address: letters and digits of the local part.
  * key (32 hex digits or more): every hex digit.

Defined results
  * null text stays null with 0 findings, empty text stays empty; texts without a
    finding are unchanged; very long texts are scanned once, in linear time.
  * repeated rows get equal results; ids may be null; an empty table gives no rows.
  * extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
EPOCH = "1920-01-01"

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@[A-Za-z0-9-]{1,63}+(?:\.[A-Za-z0-9-]{1,63}+){1,8}+"
IPV4 = r"(?<![\w.])\d{1,3}+(?:\.\d{1,3}+){3}+(?![\w]|\.\d)"
ISO_DATE = r"(?<![\w-])\d{4}-\d{2}-\d{2}(?![\w-])"
DAY_DATE = r"(?<![\w./])\d{1,2}+(?:/\d{1,2}+/|\.\d{1,2}+\.)\d{4}(?![\w]|[./]\d)"
PHONE = r"(?<![\w+])\+\d{1,3}+[ .-]?(?:\(\d{1,4}+\)[ .-]?)?\d{2,4}+(?:[ .-]?\d{2,4}+){1,4}(?!\w)"
LOCAL_PHONE = r"(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)"
NUMBER = r"(?<![\w.])(?:\d{9,30}+|\d{4}(?:[ -]\d{4}){2,3}+(?:[ -]\d{1,3})?|\d{3}-\d{2}-\d{4})(?![\w])"
KEY = r"(?<!\w)[0-9a-f]{32,128}+(?!\w)"
FOUND = "|".join((EMAIL, IPV4, ISO_DATE, DAY_DATE, PHONE, LOCAL_PHONE, NUMBER, KEY))

Expr = Callable[[Column], Column]


def let(value: Column, body: Expr) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _hash(key: str, kind: str, step: Column, half: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}:{kind}:"), step.cast("string"), F.lit(":"), half), 256)


def _number(digest: Column, at: Column | int, digits: int) -> Column:
    at = F.lit(at) if isinstance(at, int) else at
    return F.conv(F.substring(digest, at, F.lit(digits)), 16, 10).cast("long")


def _shifted(half: Column, digest: Column, hexadecimal: bool) -> Column:
    """Each character moved within its own alphabet by two hex digits of the digest."""

    def move(i: Column) -> Column:
        c = F.ascii(F.substring(half, i + 1, F.lit(1)))
        by = _number(digest, (i % 32) * 2 + 1, 2)

        def within(first: int, size: int) -> Column:
            return F.char(((c - first + by) % size + first).cast("long"))

        if hexadecimal:
            at = F.when(c >= 97, c - 87).otherwise(c - 48)
            return F.substring(F.lit("0123456789abcdef"), ((at + by) % 16 + 1).cast("int"), F.lit(1))
        return F.when(c <= 57, within(48, 10)).when(c <= 90, within(65, 26)).otherwise(within(97, 26))

    n = F.length(half)
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), move), ""))


def feistel_characters(value: Column, key: str, kind: str, hexadecimal: bool = False) -> Column:
    """Keyed permutation of ASCII letters and digits that keeps each place's alphabet."""
    cut = F.floor(F.length(value) / 2).cast("int")
    start = F.struct(F.substring(value, F.lit(1), cut).alias("a"), F.substring(value, cut + 1, F.length(value)).alias("b"))

    def step(s: Column, i: Column) -> Column:
        a = let(_hash(key, kind, i, s["b"]), lambda h: _shifted(s["a"], h, hexadecimal))
        b = let(_hash(key, kind, i, s["a"]), lambda h: _shifted(s["b"], h, hexadecimal))
        return F.struct(F.when(i % 2 == 0, a).otherwise(s["a"]).alias("a"), F.when(i % 2 == 1, b).otherwise(s["b"]).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: F.concat(s["a"], s["b"]))


def feistel_number(value: Column, bits: int, key: str, kind: str) -> Column:
    """Keyed permutation of whole numbers of an even count of bits."""
    half = 1 << (bits // 2)
    start = F.struct(F.floor(value / half).cast("long").alias("a"), (value % half).cast("long").alias("b"))

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["b"].alias("a"), ((s["a"] + _number(_hash(key, kind, i, s["b"].cast("string")), 1, 8)) % half).alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step, lambda s: s["a"] * half + s["b"])


def luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; counted from the right, places of parity ``doubled`` count double."""

    def add(total: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, F.length(digits) - i, F.lit(1))) - 48
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when(i % 2 == doubled, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)


def _spread(form: Column, characters: Column, alphabet: str) -> Column:
    """Put the characters back into the places of ``form`` that hold one of the alphabet."""

    def take(s: Column, c: Column) -> Column:
        own = F.rlike(c, F.lit(alphabet))
        return F.struct(
            F.concat(s["out"], F.when(own, F.substring(characters, s["next"], F.lit(1))).otherwise(c)).alias("out"),
            (s["next"] + own.cast("int")).alias("next"))

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))
    return F.aggregate(F.split(form, ""), start, take, lambda s: s["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _account(value: Column, key: str) -> Column:
    def card(d: Column) -> Column:
        body = feistel_characters(F.substring(d, F.lit(1), F.length(d) - 1), key, "card")
        return let(body, lambda b: F.concat(b, ((10 - luhn_sum(b, 0) % 10) % 10).cast("string")))

    def new(d: Column) -> Column:
        valid = F.length(d).between(13, 19) & (luhn_sum(d, 1) % 10 == 0)
        return F.when(valid, card(d)).otherwise(feistel_characters(d, key, "number"))

    return let(let(_digits(value), new), lambda x: _spread(value, x, r"\d"))


def _ipv4(value: Column, key: str) -> Column:
    o = F.transform(F.split(value, r"\."), lambda x: x.cast("long"))
    number = ((o[0] * 256 + o[1]) * 256 + o[2]) * 256 + o[3]
    back = let(feistel_number(number, 32, key, "ipv4"), lambda n: F.concat_ws(".", *[(F.shiftright(n, s) % 256).cast("string") for s in (24, 16, 8, 0)]))
    return F.when(F.forall(o, lambda x: x <= 255), back).otherwise(value)


def _new_day(day: Column, key: str) -> Column:
    since = F.datediff(day, F.lit(EPOCH).cast("date")).cast("long")
    block = F.floor(since / 65536)
    return let(block * 65536 + feistel_number(since - block * 65536, 16, key, "date"),
               lambda n: F.date_add(F.lit(EPOCH).cast("date"), n.cast("int")))


def _date(value: Column, key: str) -> Column:
    def iso(day: Column) -> Column:
        return F.coalesce(F.date_format(_new_day(day, key), "yyyy-MM-dd"), value)

    def local(day: Column, form: str) -> Column:
        return F.date_format(_new_day(day, key), form)

    sign = F.when(F.contains(value, F.lit("/")), F.lit("/")).otherwise(F.lit("."))
    plain = F.translate(value, "/", ".")
    day_first, month_first = F.try_to_date(plain, "d.M.yyyy"), F.try_to_date(plain, "M.d.yyyy")
    other = F.coalesce(local(day_first, "dd.MM.yyyy"), local(month_first, "MM.dd.yyyy"))
    return F.when(F.contains(value, F.lit("-")), iso(F.try_to_date(value, "yyyy-MM-dd"))).otherwise(
        F.coalesce(F.when(sign == "/", F.translate(other, ".", "/")).otherwise(other), value))


def _phone(value: Column, key: str) -> Column:
    head = F.regexp_extract(value, r"^\+\d{1,3}(?=[ .-])|^\+\d", 0)
    tail = F.substring(value, F.length(head) + 1, F.length(value))
    new = let(_digits(tail), lambda d: feistel_characters(d, key, "phone"))
    return F.concat(head, let(new, lambda x: _spread(tail, x, r"\d")))


def _email(value: Column, key: str) -> Column:
    name = F.substring_index(value, "@", 1)
    new = let(F.regexp_replace(name, "[^A-Za-z0-9]", ""), lambda s: feistel_characters(s, key, "email"))
    return F.concat(let(new, lambda x: _spread(name, x, "[A-Za-z0-9]")), F.substring(value, F.length(name) + 1, F.length(value)))


def kind_of(value: Column) -> Column:
    whole = lambda p: F.rlike(value, F.lit(f"^(?:{p})$"))
    return (
        F.when(F.contains(value, F.lit("@")), "email").when(whole(IPV4), "ipv4").when(whole(f"{ISO_DATE}|{DAY_DATE}"), "date")
        .when(F.rlike(value, F.lit(r"^[+(]")), "phone").when(whole(NUMBER), "number").otherwise("key")
    )


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of one found value."""

    def of(kind: Column) -> Column:
        return (
            F.when(kind == "email", _email(value, key)).when(kind == "ipv4", _ipv4(value, key)).when(kind == "date", _date(value, key))
            .when(kind == "phone", _phone(value, key)).when(kind == "number", _account(value, key))
            .otherwise(feistel_characters(value, key, "key", hexadecimal=True))
        )

    return let(kind_of(value), of)


def pseudonymise(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, n_found): every row, with all findings replaced."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    some = F.rlike("text", F.lit(r"\d\d|\d\.\d|@|[0-9a-f]{32}"))
    hits = rows.withColumn("hits", F.when(some, F.regexp_extract_all("text", F.lit(FOUND), F.lit(0))))
    between = F.split(F.col("text"), FOUND, -1)
    rebuilt = let(between, lambda p: F.concat(
        p[0], F.array_join(F.transform(F.col("hits"), lambda h, i: F.concat(pseudonym(h, key), F.element_at(p, i + 2))), "")))
    n = F.coalesce(F.size("hits"), F.lit(0))
    return hits.select(
        F.col("id").alias(id_col), F.when(n > 0, rebuilt).otherwise(F.col("text")).alias("text"), F.greatest(n, F.lit(0)).alias("n_found"))
