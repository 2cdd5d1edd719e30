"""PII: format-preserving Feistel pseudonyms.  SQL functions only.

Numbers and dates that pass their validation are replaced by a keyed permutation of the values of the same
format, so equal values stay linked across documents and different ones stay apart:

==========  =======================================================  ==========================================
kind        validated by                                             permuted
==========  =======================================================  ==========================================
card        13-19 digits, plain or in groups; Luhn                   all but the last digit, which is computed
iban        country, 15-34 characters; remainder 1 modulo 97         digits after the check digits, computed anew
ssn         area not 000, 666 or 9xx, group not 00, serial not 0000  the three parts among their valid values
phone       +, 8-15 digits                                           digits after the country code
ip          four octets up to 255                                    all 32 bits
date        real day of 1900-2099, year first or day first           the day among those 73,049
==========  =======================================================  ==========================================

Separators, brackets and country codes stay.  A Feistel network of modular additions works on two parts
``(a, b)`` of any sizes: ``a += F(round, b) mod size_a``, then ``b += F(round, a) mod size_b``, with F cut from
SHA-256 of key, kind, round and value.  Mail addresses are no numbers: their local part becomes a keyed digest, the domain stays.

Null text stays null (counts 0); a text without such values is unchanged.  Values that look alike but fail validation
are left alone.  Other columns pass through.  Every row is independent: no shuffle, and repeated rows get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .one_permutation import bound

KINDS = ("email", "phone", "iban", "card", "ssn", "date", "ip")
ROUNDS = 4  # double rounds
FIRST_DAY, DAYS = "1900-01-01", 73049  # = 17 * 4297
_MAIL = r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}._%+\-]++@[\p{L}\p{N}\-]++(?:\.[\p{L}\p{N}\-]++)+"
#: A further digit of a phone number, with a separator before it and in brackets of up to four digits.
_NEXT = r"[ .\-]?(?:\((?=\d{1,4}\)))?\d(?:(?<=\(\d{1,4})\))?"
#: What begins after a space and is a value of its own, not the rest of a phone number: date, ip, ssn, card, mail address.
_OTHER = (
    r" (?:(?:\d{4}[\-/.]\d{2}[\-/.]\d{2}|\d{2}[\-/.]\d{2}[\-/.]\d{4}|\d{1,3}(?:\.\d{1,3}){3}|\d{3}-\d{2}-\d{4})(?!\d)"
    r"|(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{1,4}|\d{4}[ \-]\d{6}[ \-]\d{5})(?![ \-]?\d)|[\p{L}\p{N}._%+\-]++@)"
)
_PHONE = rf"(?<![\d+])\+\d(?:{_NEXT}){{7}}(?:(?!{_OTHER}){_NEXT}){{0,7}}(?!\d)"
_IBAN = r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z\d]{4}){2,7}(?: ?[A-Z\d]{1,3})?(?![\p{L}\p{N}])"
_SSN = r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d]|-\d)"
_DATE = r"(?<![\d./\-])(?:\d{4}([\-/.])\d{2}\1\d{2}|\d{2}([\-/.])\d{2}\2\d{4})(?!\d|[./\-]\d)"
_IP = r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)"
_CARD = r"(?<!\d)(?:\d{4}([ \-])\d{4}\3\d{4}\3\d{1,4}|\d{4}([ \-])\d{6}\4\d{5}|\d{13,19})(?!\d)"
#: Tried in this order at each place of the text (groups 1 and 2 are in dates, 3 and 4 in cards).
PATTERN = "|".join((_MAIL, _PHONE, _IBAN, _SSN, _DATE, _IP, _CARD))


def _round(key: str, kind: str, k: int, other: Column, size: Column) -> Column:
    """A keyed number below ``size`` (at most 1e10) from 60 bits of SHA-256."""
    text = F.concat_ws("|", F.lit(key), F.lit(kind), F.lit(str(k)), other.cast("string"))
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 15), 16, 10).cast("bigint") % size


def _feistel(key: str, kind: str, a: Column, b: Column, size_a: Column, size_b: Column, *, back: bool = False) -> Column:
    """Struct (a, b) after the rounds; ``back`` undoes them."""
    pair = lambda x, y: F.struct(x.alias("a"), y.alias("b"))
    state = F.array(pair(a.cast("bigint"), b.cast("bigint")))

    def step(k: int):
        def first(s: Column) -> Column:
            f = _round(key, kind, k, s["b"], size_a)
            return pair(F.pmod(s["a"] - f if back else s["a"] + f, size_a), s["b"])

        def second(s: Column) -> Column:
            f = _round(key, kind, k, s["a"], size_b)
            return pair(s["a"], F.pmod(s["b"] - f if back else s["b"] + f, size_b))

        return second if k % 2 else first

    for k in reversed(range(2 * ROUNDS)) if back else range(2 * ROUNDS):
        state = F.transform(state, step(k))
    return state[0]


def _big(n: int) -> Column:
    return F.lit(n).cast("bigint")


def _permute_digits(key: str, kind: str, digits: Column, back: bool) -> Column:
    """Digits of the same length (2 to 34; a single digit stays), cut in two halves of up to 17."""
    n = F.length(digits)
    left = F.floor(n / 2).cast("int")
    right = n - left
    size = lambda m: F.rpad(F.lit("1"), m + 1, "0").cast("bigint")

    def run(d: Column) -> Column:
        a, b = d.substr(F.lit(1), left).cast("bigint"), d.substr(left + 1, right).cast("bigint")
        out = _feistel(key, kind, a, b, size(left), size(right), back=back)
        return bound(out, lambda s: F.concat(F.lpad(s["a"].cast("string"), left, "0"), F.lpad(s["b"].cast("string"), right, "0")))

    return F.when(n < 2, digits).otherwise(bound(digits, run))


def _refill(shape: Column, digits: Column) -> Column:
    """The shape with its digits, from left to right, replaced by the given ones."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))

    def step(s: Column, c: Column) -> Column:
        digit = (c >= "0") & (c <= "9")
        return F.struct(
            F.concat(s["out"], F.when(digit, digits.substr(s["i"], F.lit(1))).otherwise(c)).alias("out"), (s["i"] + F.when(digit, 1).otherwise(0)).alias("i")
        )

    return F.aggregate(F.split(shape, ""), start, step, lambda s: s["out"])


def _luhn_sum(digits: Column, doubled: int) -> Column:
    """Luhn sum; the last digit is doubled if ``doubled`` is 0, the one before it if it is 1."""
    def step(s: Column, c: Column) -> Column:
        v = c.cast("int")
        w = F.when(s["i"] % 2 == doubled, F.when(v > 4, v * 2 - 9).otherwise(v * 2)).otherwise(v)
        return F.struct((s["i"] + 1).alias("i"), (s["t"] + w).alias("t"))

    return F.aggregate(F.split(F.reverse(digits), ""), F.struct(F.lit(0).alias("i"), F.lit(0).alias("t")), step, lambda s: s["t"])


def _mod97(text: Column) -> Column:
    """Remainder of the number that the characters spell (A is 10, ..., Z is 35)."""
    def step(r: Column, c: Column) -> Column:
        v = F.when((c >= "0") & (c <= "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return (r * F.when(v > 9, 100).otherwise(10) + v) % 97

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, r"[^0-9]", "")


def _card(key: str, m: Column, back: bool) -> Column:
    def run(d: Column) -> Column:
        body = F.substring(d, 1, 100).substr(F.lit(1), F.length(d) - 1)

        def close(p: Column) -> Column:
            check = F.pmod(F.lit(10) - _luhn_sum(p, 0) % 10, F.lit(10))
            return _refill(m, F.concat(p, check.cast("string")))

        return F.when(_luhn_sum(d, 1) % 10 == 0, bound(_permute_digits(key, "card", body, back), close))

    return bound(_digits(m), run)


def _iban(key: str, m: Column, back: bool) -> Column:
    def run(c: Column) -> Column:
        country, body = F.substring(c, 1, 2), c.substr(F.lit(5), F.lit(100))
        good = (F.length(c) >= 15) & (F.length(c) <= 34) & (_mod97(F.concat(body, F.substring(c, 1, 4))) == 1)

        def close(p: Column) -> Column:
            check = F.lit(98) - _mod97(F.concat(p, country, F.lit("00")))
            return F.concat(F.lpad(check.cast("string"), 2, "0"), _digits(p))

        moved = bound(bound(_permute_digits(key, "iban", _digits(body), back), lambda d: _refill(body, d)), close)
        return F.when(good, bound(moved, lambda d: _refill(m, d)))

    return bound(F.regexp_replace(m, " ", ""), run)


def _phone(key: str, m: Column, back: bool) -> Column:
    code = F.regexp_extract(m, r"^\+(?:1|7|\d{1,3}?(?=[ .\-(])|\d{2})", 0)
    rest = m.substr(F.length(code) + 1, F.lit(100))
    n = F.length(_digits(m))
    return F.when((n >= 8) & (n <= 15), F.concat(code, bound(_permute_digits(key, "phone", _digits(rest), back), lambda d: _refill(rest, d))))


def _ssn(key: str, m: Column, back: bool) -> Column:
    area, group, serial = (F.substring(m, a, n).cast("int") for a, n in ((1, 3), (5, 2), (8, 4)))
    good = (area > 0) & (area != 666) & (area < 900) & (group > 0) & (serial > 0)
    a = area - F.when(area > 666, 2).otherwise(1)
    moved = _feistel(key, "ssn", a, (group - 1) * 9999 + serial - 1, _big(898), _big(99 * 9999), back=back)

    def show(s: Column) -> Column:
        pad = lambda v, n: F.lpad(v.cast("string"), n, "0")
        return F.concat_ws("-", pad(s["a"] + F.when(s["a"] >= 665, 2).otherwise(1), 3), pad(F.floor(s["b"] / 9999).cast("int") + 1, 2), pad(s["b"] % 9999 + 1, 4))

    return F.when(good, bound(moved, show))


def _date(key: str, m: Column, back: bool) -> Column:
    """Read day first if that gives a date, else month first; written day first."""
    year_first = m.rlike(r"^\d{4}")
    sep = F.when(year_first, F.substring(m, 5, 1)).otherwise(F.substring(m, 3, 1))
    year = F.when(year_first, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    one, two = F.when(year_first, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)), F.when(year_first, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2))
    day = lambda d, mo: F.datediff(F.to_date(F.try_to_timestamp(F.concat_ws("-", year, mo, d), F.lit("yyyy-MM-dd"))), F.lit(FIRST_DAY).cast("date"))
    k = F.coalesce(day(one, two), F.when(~year_first, day(two, one)))
    moved = _feistel(key, "date", F.floor(k / 4297).cast("int"), k % 4297, _big(17), _big(4297), back=back)

    def show(s: Column) -> Column:
        to = F.date_add(F.lit(FIRST_DAY).cast("date"), (s["a"] * 4297 + s["b"]).cast("int"))
        y, mo, d = F.date_format(to, "yyyy"), F.date_format(to, "MM"), F.date_format(to, "dd")
        return F.when(year_first, F.concat(y, sep, mo, sep, d)).otherwise(F.concat(d, sep, mo, sep, y))

    return F.when((k >= 0) & (k < DAYS), bound(moved, show))


def _ip(key: str, m: Column, back: bool) -> Column:
    def run(o: Column) -> Column:
        v = [F.get(o, F.lit(i)).cast("int") for i in range(4)]
        good = (v[0] < 256) & (v[1] < 256) & (v[2] < 256) & (v[3] < 256)
        moved = _feistel(key, "ip", v[0] * 256 + v[1], v[2] * 256 + v[3], _big(65536), _big(65536), back=back)
        parts = lambda s: [F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256]
        return F.when(good, bound(moved, lambda s: F.concat_ws(".", *(x.cast("string") for x in parts(s)))))

    return bound(F.split(m, r"\."), run)


def _mail(key: str, m: Column) -> Column:
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(m)).cast("binary"), 256)
    return F.concat(F.lit("p"), F.substring(digest, 1, 20), F.lit("@"), F.substring_index(m, "@", -1))


def replace_match(m: Column, key: str, *, back: bool = False) -> Column:
    """Struct (kind, value) of one match: its kind and pseudonym, or null and itself if it fails validation.

    ``back`` undoes the permutations of numbers and dates (mail addresses are one-way)."""
    out = lambda kind, v: F.when(v.isNotNull(), F.struct(F.lit(kind).alias("kind"), v.alias("value")))
    whole = lambda p: m.rlike(f"^(?:{p})$")
    found = (
        F.when(F.instr(m, "@") > 0, F.struct(F.lit("email").alias("kind"), F.lit(None).cast("string").alias("value")) if back else out("email", _mail(key, m)))
        .when(m.startswith("+"), out("phone", _phone(key, m, back)))
        .when(m.rlike(r"^[A-Z]"), out("iban", _iban(key, m, back)))
        .when(whole(_SSN), out("ssn", _ssn(key, m, back)))
        .when(whole(_DATE), out("date", _date(key, m, back)))
        .when(whole(_IP), out("ip", _ip(key, m, back)))
        .otherwise(out("card", _card(key, m, back)))
    )
    return bound(found, lambda f: F.struct(f["kind"].alias("kind"), F.coalesce(f["value"], m).alias("value")))


def pseudonymised(text: Column, key: str, *, back: bool = False) -> Column:
    """Struct (text, kinds): the text with its personal values replaced and the kind of each."""
    none = F.array().cast("array<string>")

    def rebuild(pair: Column) -> Column:
        tail = F.transform(F.arrays_zip(pair["found"], F.slice(pair["between"], 2, F.size(pair["found"]))), lambda z: F.concat(z["found"]["value"], z["1"]))
        return F.struct(
            F.concat(pair["between"][0], F.array_join(tail, "")).alias("text"),
            F.filter(F.transform(pair["found"], lambda f: f["kind"]), lambda k: k.isNotNull()).alias("kinds"),
        )

    heavy = bound(
        F.struct(
            F.transform(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda m: replace_match(m, key, back=back)).alias("found"),
            F.split(text, PATTERN, -1).alias("between"),
        ),
        rebuild,
    )
    return F.when(text.rlike("[0-9@]"), heavy).otherwise(F.struct(text.alias("text"), none.alias("kinds")))


def pseudonymise(docs: DataFrame, text: str, key: str, *, counts: bool = True) -> DataFrame:
    """``docs`` with the text column replaced and, if asked, one ``n_<kind>`` column per kind of :data:`KINDS`
    (columns of these names are replaced)."""
    t = F.col(f"`{text}`")
    names = [f"n_{k}" for k in KINDS] if counts else []
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    done = docs.select(*kept, pseudonymised(t, key).alias("__pii"))
    out = [F.col("__pii.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in names]
    kinds = F.coalesce(F.col("__pii.kinds"), F.array().cast("array<string>"))
    each = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).alias(n) for k, n in zip(KINDS, names, strict=False)]
    return done.select(*out, *each)
