"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations in DataFrame expressions.

Found and validated: e-mail addresses, card numbers (13 to 19 digits that pass the Luhn check, and pass it again),
telephone numbers, IPv4 addresses (octets up to 255) and IPv6 addresses, IBANs (check digits kept right), US social
security numbers (valid areas and groups), dates (ISO and day-month-year or month-day-year with one separator), and
secrets that are assigned, of any length, or well-known keys. Each value is permuted by a keyed Feistel network inside its own format:
the digits of a number within its length, a date within the days from 1900 to 2099 that have its spelling, an address
within its octets, a name within its letters' and digits' places. Equal values get equal pseudonyms in all documents
(a telephone number however it is spaced, a date in either of the padded spellings), different values of a format
different ones, and the spelling (separators, case, length, order of a date) stays. Letters of an IBAN (the bank's code) stay,
as do letters of e-mail addresses and secrets outside the Latin and Russian alphabets. Everything else is untouched.

The round function is HMAC-SHA-256 under the job's key: the session setting ``spark.skein.pii.key``, or else the
environment's SKEIN_PII_KEY. Without either a published demonstration key is taken, with a warning: whoever knows the
key can undo the pseudonyms.

Null texts stay null, empty ones empty. Texts of any length are handled whole. Repeated rows give repeated results.
Extra columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import os
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import free_name, read

#: The session setting and the environment variable that hold a job's key; the key that is used without them is public.
KEY_SETTING, KEY_VARIABLE = "spark.skein.pii.key", "SKEIN_PII_KEY"
DEMONSTRATION_KEY = "skein-demonstration-key"
#: Shapes of personal data, tried in this order at each place of a text.
WORD_CHAR = r"\p{L}\p{M}\p{N}"
EMAIL = (
    rf"(?<![\p{{L}}\p{{M}}\p{{N}}])[\p{{L}}\p{{N}}][{WORD_CHAR}._%+-]{{0,63}}@[{WORD_CHAR}-]{{1,63}}(?:\.[{WORD_CHAR}-]{{1,63}}){{0,126}}\.[\p{{L}}\p{{M}}]{{2,63}}(?![{WORD_CHAR}-])"
)
#: Of any length; marks that may end the sentence stay outside.
SECRET_VALUE = r"[^\s\"'<>,;]*[^\s\"'<>,;.:?)\]]"
SECRET = (
    r"(?i:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)[ \t]{0,3}[:=][ \t]{0,3}[\"']?" + SECRET_VALUE
    + r"|(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])"
)
#: Lengths of IBANs by country; other countries' are found by shape alone.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK|FI|FO|GL|NL|FK", 19: "MK|SI", 20: "AT|BA|EE|KZ|LT|LU|XK|MN", 21: "CH|HR|LI|LV",
    22: "BG|BH|CR|DE|GB|GE|IE|ME|RS|VA", 23: "AE|GI|IL|IQ|TL|OM|SO", 24: "AD|CZ|ES|MD|PK|RO|SA|SE|SK|TN|VG", 25: "LY|PT|ST",
    26: "IS|TR", 27: "BI|DJ|FR|GR|IT|MC|MR|SM", 28: "AL|AZ|BY|CY|DO|GT|HU|LB|NI|PL|SV", 29: "BR|EG|PS|QA|UA", 30: "JO|KW|MU|YE",
    31: "MT|SC", 32: "LC", 33: "RU",
}
IBAN = "".join(
    rf"(?:{c})[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{{(n - 4) // 4}}}" + (rf" ?[A-Z0-9]{{{n % 4}}}" if n % 4 else "") + r"(?![A-Za-z0-9])|" for n, c in IBAN_LENGTHS.items()
) + r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
ISO_DATE = r"(?:19|20)[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])(?![0-9])"
DAY_DATE = r"(?:0?[1-9]|[12][0-9]|3[01])([-/.])(?:0?[1-9]|[12][0-9]|3[01])\2(?:19|20)[0-9]{2}(?![0-9])"
SSN = r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])"
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IPV4 = OCTET + r"(?:\." + OCTET + r"){3}(?![0-9]|\.[0-9])"
HEXTET = r"[0-9A-Fa-f]{1,4}"
#: Eight groups, or fewer around a double colon, one of them of three digits or more (``10::20`` is no address).
IPV6 = (
    rf"(?=[0-9A-Fa-f:]{{0,39}}[0-9A-Fa-f]{{3}})(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:(?:{HEXTET}:){{7}}{HEXTET}|(?:{HEXTET}:){{1,6}}:{HEXTET}(?::{HEXTET}){{0,5}}|(?:{HEXTET}:){{1,7}}:)"
    r"(?![0-9A-Za-z:])"
)
#: Country codes of one and two digits; all others have three.
CALLING_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"
#: American Express and Diners as written (4-6-5, 4-6-4), groups of four with a last one of up to seven, or 19 digits in fours.
CARD = r"3[0-9]{3}[ -]?[0-9]{6}[ -]?[0-9]{4,5}(?![0-9])|[0-9]{4}(?:[ -][0-9]{4}){3}[ -][0-9]{3}(?![0-9]|[-/.][0-9])|[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}(?![0-9])"
PHONE = r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}(?![0-9])|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}(?![0-9])|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9])"
KINDS = (("email", EMAIL), ("secret", SECRET), ("iban", IBAN), ("date", ISO_DATE + "|" + DAY_DATE), ("ssn", SSN), ("ipv6", IPV6), ("ip", IPV4), ("card", CARD), ("phone", PHONE))
#: One expression for all kinds; a value never starts inside a longer word or number.
FOUND = (
    r"(?<![A-Za-z0-9._%+@-])(?:" + "|".join(p for _, p in KINDS) + r")|(?<![A-Za-z0-9])(?:" + SECRET + "|" + CARD
    + r")|(?<![A-Za-z0-9.])" + IPV4
)
#: A text without any of these holds nothing to replace: every pattern asks for one of them.
HINT = r"[0-9@:=]|AKIA|ASIA"
ROUNDS = 8
FIRST_DAY, DAYS = "1900-01-01", 73049  # 1900-01-01 to 2099-12-31
ALPHABETS = (
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ",
)


def _keyed(key: str, *parts: Column) -> Column:
    """A keyed number below 16**13: the head of the HMAC-SHA-256 of the joined parts."""
    raw = key.encode()
    raw = (raw if len(raw) <= 64 else hashlib.sha256(raw).digest()).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    text = F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text), 256))), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _let(value: Column, body) -> Column:
    """Bind a column once: expressions used several times would otherwise be computed again each time."""
    return F.transform(F.array(value), body)[0]


def feistel_digits(digits: Column, key: str, tag: str) -> Column:
    """A keyed permutation of the decimal strings of each length (2 to 36 digits): an alternating Feistel network.

    The halves are numbers modulo powers of ten; each round adds a keyed function of one half to the other.
    """
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    rest = n - half

    def power(k):
        return F.conv(F.rpad(F.lit("1"), k.cast("int") + 1, "0"), 10, 10).cast("long")

    start = F.struct(
        F.substr(digits, F.lit(1), half).cast("long").alias("a"), F.substr(digits, half + 1, rest).cast("long").alias("b"),
        n.alias("n"), power(half).alias("pa"), power(rest).alias("pb"),
    )

    def one_round(s, r):
        odd = r % 2 == 1
        a = F.when(odd, F.pmod(s["a"] + _keyed(key, F.lit(tag), s["n"], r, s["b"]), s["pa"])).otherwise(s["a"])
        b = F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + _keyed(key, F.lit(tag), s["n"], r, s["a"]), s["pb"]))
        return F.struct(a.alias("a"), b.alias("b"), s["n"].alias("n"), s["pa"].alias("pa"), s["pb"].alias("pb"))

    def done(s):
        return F.concat(
            F.lpad(s["a"].cast("string"), F.floor(s["n"] / 2).cast("int"), "0"),
            F.lpad(s["b"].cast("string"), (s["n"] - F.floor(s["n"] / 2)).cast("int"), "0"),
        )

    rounds = F.array(*[F.lit(r) for r in range(ROUNDS)])
    return F.when(n < 2, _shift_digit(digits, key, tag)).otherwise(F.aggregate(rounds, start, one_round, done))


def _shift_digit(digits: Column, key: str, tag: str) -> Column:
    return F.when(F.length(digits) == 0, digits).otherwise(F.pmod(digits.cast("long") + _keyed(key, F.lit(tag)), F.lit(10)).cast("string"))


def feistel_below(value: Column, size: int, key: str, tag: str, inside=None, steps: int = 40) -> Column:
    """A keyed permutation of 0 .. size - 1, or of those of them that are ``inside``: a Feistel network over side * side
    numbers, walked until inside.

    The first return to a set along a permutation's cycles is one-to-one. ``steps`` bounds the walk; it is chosen so
    that a longer one has a chance below 10**-20 (a share of 0.22 of the numbers inside needs 200 steps).
    """
    side = int(size**0.5) + 1

    def network(v):
        start = F.struct(F.floor(v / side).cast("long").alias("a"), (v % side).cast("long").alias("b"))

        def one_round(s, r):
            odd = r % 2 == 1
            a = F.when(odd, F.pmod(s["a"] + _keyed(key, F.lit(tag), r, s["b"]), F.lit(side))).otherwise(s["a"])
            b = F.when(odd, s["b"]).otherwise(F.pmod(s["b"] + _keyed(key, F.lit(tag), r, s["a"]), F.lit(side)))
            return F.struct(a.alias("a"), b.alias("b"))

        return F.aggregate(F.array(*[F.lit(r) for r in range(ROUNDS)]), start, one_round, lambda s: s["a"] * side + s["b"])

    start = F.struct(value.cast("long").alias("v"), F.lit(False).alias("in"))

    def walk(s, _):
        def landed(v):
            ok = (v < size) if inside is None else (v < size) & inside(v)
            return F.struct(v.alias("v"), ok.alias("in"))

        return F.when(s["in"], s).otherwise(_let(network(s["v"]), landed))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, walk, lambda s: F.when(s["in"], s["v"]).otherwise(value.cast("long")))


def _refill(shape: Column, fresh: Column, kind: str) -> Column:
    """``shape`` with its characters of a class replaced in turn by those of ``fresh``."""
    pieces = F.split(shape, kind, -1)
    return F.array_join(
        F.transform(pieces, lambda p, k: F.concat(F.when(k == 0, F.lit("")).otherwise(F.substr(fresh, k, F.lit(1))), p)), ""
    )


def _digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string."""
    each = F.transform(F.reverse(F.split(digits, "")), lambda c, k: F.when(
        k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(F.filter(each, lambda c: c.isNotNull()), F.lit(0), lambda s, c: s + c)


def _card(value: Column, key: str) -> Column:
    """A number that passes the Luhn check: its digits permuted, with a right check digit. Others are no card numbers.

    Three digits after a number of 16 may be another value: they stay where only the 16 pass.
    """

    def permuted(d):
        body = feistel_digits(F.substr(d, F.lit(1), F.length(d) - 1), key, "card")

        def with_check(b):
            check = F.pmod(F.lit(10) - luhn_sum(F.concat(b, F.lit("0"))) % 10, F.lit(10))
            return F.concat(b, check.cast("int").cast("string"))

        return _let(body, with_check)

    def fresh(d):
        head, grouped = F.substr(d, F.lit(1), F.lit(16)), value.rlike("^(?:[0-9]{4}[ -]){4}[0-9]{3}$")
        return (
            F.when(luhn_sum(d) % 10 == 0, permuted(d))
            .when(grouped & (luhn_sum(head) % 10 == 0), F.concat(permuted(head), F.substr(d, F.lit(17), F.lit(3))))
            .otherwise(d)
        )

    return _refill(value, _let(_digits_of(value), fresh), "[0-9]")


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the other digits are permuted, however they are spaced."""
    head = F.regexp_extract(value, CALLING_CODE, 0)
    tail = F.substr(value, F.length(head) + 1)
    return F.concat(head, _refill(tail, feistel_digits(_digits_of(tail), key, "phone"), "[0-9]"))


def _ipv6(value: Column, key: str) -> Column:
    """The hexadecimal digits permuted in their places; groups and case stay."""
    lower = value.rlike("[a-f]") | ~value.rlike("[A-F]")
    made = [_spelling(value, key, "ipv6", (alphabet,)) for alphabet in ("0123456789abcdef", "0123456789ABCDEF")]
    mixed = value.rlike("[a-f]") & value.rlike("[A-F]")
    return F.when(mixed, _spelling(F.lower(value), key, "ipv6", ("0123456789abcdef",))).when(lower, made[0]).otherwise(made[1])


def _ip(value: Column, key: str) -> Column:
    """The address as a number below 2**32, permuted."""
    octets = F.transform(F.split(value, "[.]"), lambda o: o.cast("long"))
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, o: s * 256 + o)

    def spell(v):
        return F.concat_ws(".", *[F.floor(v / 256**k) % 256 for k in (3, 2, 1, 0)])

    return _let(feistel_below(number, 2**32, key, "ip"), spell)


def _date(value: Column, key: str) -> Column:
    """The day permuted among the days of two centuries that can be spelled alike: order of parts, widths and separator stay.

    Ambiguous dates are read day first; a second part over 12 makes it month first. A part of one digit stays one, a
    part of two digits has a leading zero where needed. Days that don't exist stay as they are.
    """
    parts = F.split(value, "[-/.]")
    sep = F.regexp_extract(value, "[-/.]", 0)
    iso = F.length(parts[0]) == 4
    month_first = (~iso) & (parts[1].cast("int") > 12)
    year = F.when(iso, parts[0]).otherwise(parts[2]).cast("int")
    month = F.when(iso | ~month_first, parts[1]).otherwise(parts[0]).cast("int")
    day = F.when(iso, parts[2]).when(month_first, parts[1]).otherwise(parts[0]).cast("int")
    real = F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")
    number = F.datediff(real, F.lit(FIRST_DAY).cast("date"))
    # Parts of one digit hold numbers below ten; a month comes first only where the day shows it.
    short_day = (~iso) & (~month_first) & (F.length(parts[0]) == 1)
    short_month = (~iso) & (F.length(F.when(month_first, parts[0]).otherwise(parts[1])) == 1)

    def of(v):
        return F.date_add(F.lit(FIRST_DAY).cast("date"), v.cast("int"))

    def alike(v):
        return _let(of(v), lambda d: (~short_day | (F.day(d) < 10)) & (~short_month | (F.month(d) < 10)) & (~month_first | (F.day(d) > 12)))

    def spell(v):
        def parts_of(d):
            y = F.year(d).cast("string")
            m = F.when(short_month, F.month(d).cast("string")).otherwise(F.format_string("%02d", F.month(d)))
            t = F.when(short_day, F.day(d).cast("string")).otherwise(F.format_string("%02d", F.day(d)))
            return F.when(iso, F.concat(y, sep, m, sep, t)).when(month_first, F.concat(m, sep, t, sep, y)).otherwise(F.concat(t, sep, m, sep, y))

        return _let(of(v), parts_of)

    return F.when(number.between(0, DAYS - 1), _let(feistel_below(number, DAYS, key, "date", alike, 200), spell)).otherwise(value)


def _ssn(value: Column, key: str) -> Column:
    """A valid number permuted among the valid ones: 898 areas, 99 groups, 9999 serials."""
    p = F.split(value, "-")
    area = p[0].cast("long")
    index = F.when(area > 666, area - 2).otherwise(area - 1)
    number = (index * 99 + p[1].cast("long") - 1) * 9999 + p[2].cast("long") - 1

    def spell(v):
        a = F.floor(v / (99 * 9999)) + 1
        return F.format_string(
            "%03d-%02d-%04d", F.when(a >= 666, a + 1).otherwise(a), F.floor(v / 9999) % 99 + 1, v % 9999 + 1
        )

    return _let(feistel_below(number, 898 * 99 * 9999, key, "ssn"), spell)


def _mod97(text: Column) -> Column:
    """An IBAN text (rearranged, without spaces) modulo 97."""
    codes = F.transform(F.split(text, ""), lambda c: F.when(c.rlike("[0-9]"), c.cast("long")).when(c.rlike("[A-Z]"), F.ascii(c).cast("long") - 55))
    return F.aggregate(F.filter(codes, lambda c: c.isNotNull()), F.lit(0).cast("long"), lambda s, c: F.when(c < 10, s * 10 + c).otherwise(s * 100 + c) % 97)


def _iban(value: Column, key: str) -> Column:
    """Digits of the account part permuted, check digits made right again; only values that pass the check."""

    def fresh(v):
        country, body = F.substr(v, F.lit(1), F.lit(2)), F.substr(v, F.lit(5))

        def whole(b):
            check = F.lit(98) - _mod97(F.concat(b, country, F.lit("00")))
            return F.concat(country, F.lpad(check.cast("string"), 2, "0"), b)

        made = _let(_refill(body, feistel_digits(_digits_of(body), key, "iban"), "[0-9]"), whole)
        valid = _mod97(F.concat(body, F.substr(v, F.lit(1), F.lit(4)))) == 1
        return F.when(valid & (F.length(_digits_of(body)) <= 36), _refill(value, made, "[A-Z0-9]")).otherwise(value)

    return _let(F.replace(value, F.lit(" "), F.lit("")), fresh)


def _spelling(value: Column, key: str, tag: str, alphabets: tuple[str, ...] = ALPHABETS) -> Column:
    """Letters and digits permuted in their places: each moves in its alphabet by a keyed amount of all that precedes it
    and then of all that follows, so that the whole is one-to-one and equal values stay equal."""

    def passed(text, side):
        chars = F.filter(F.split(text, ""), lambda c: F.length(c) > 0)

        def one(s, c):
            amount = _keyed(key, F.lit(tag), F.lit(side), F.length(s), s)

            def moved(m):
                out = c
                for alphabet in alphabets:
                    at = F.instr(F.lit(alphabet), c)
                    out = F.when(at > 0, F.substr(F.lit(alphabet), (F.pmod(at - 1 + m, F.lit(len(alphabet))) + 1).cast("int"), F.lit(1))).otherwise(out)
                return out

            return F.concat(s, _let(amount, moved))

        return F.aggregate(chars, F.lit(""), one)

    return F.reverse(passed(F.reverse(passed(value, "forward")), "backward"))


def _email(value: Column, key: str) -> Column:
    """The local part and the domain's first label are permuted; the rest of the domain stays."""
    local = F.substring_index(value, "@", 1)
    domain = F.substring_index(value, "@", -1)
    label = F.substring_index(domain, ".", 1)
    return F.concat(_spelling(local, key, "local"), F.lit("@"), _spelling(label, key, "domain"), F.substr(domain, F.length(label) + 1))


def _secret(value: Column, key: str) -> Column:
    """What is assigned is permuted; the name before it, or a key's four-letter mark, stays."""
    head = F.regexp_extract(value, r"^(?:[A-Za-z_-]+[ \t]*[:=][ \t]*[\"']?|AKIA|ASIA)", 0)
    return F.concat(head, _spelling(F.substr(value, F.length(head) + 1), key, "secret"))


def kind_of(value: Column) -> Column:
    """The kind of a found value: the first whose whole shape it has."""
    out = F.lit("other")
    for name, pattern in reversed(KINDS):
        out = F.when(value.rlike("^(?:" + pattern + ")$"), F.lit(name)).otherwise(out)
    return out


def job_key(spark: SparkSession) -> str:
    """The key of this job."""
    found = spark.conf.get(KEY_SETTING, None) or os.environ.get(KEY_VARIABLE)
    if not found:
        warnings.warn(f"neither {KEY_SETTING} nor {KEY_VARIABLE} is set: pseudonyms are made with a public key", stacklevel=3)
    return found or DEMONSTRATION_KEY


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a found value in its own format."""
    make = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ipv6": _ipv6, "ip": _ip, "card": _card, "phone": _phone}

    def of_kind(kind):
        return reduce(lambda out, name: F.when(kind == name, make[name](value, key)).otherwise(out), reversed([n for n, _ in KINDS]), value)

    return _let(kind_of(value), of_kind)


def found_values(text: Column) -> Column:
    """All values in a text, in order; texts without any of the signs that every value has are not searched."""
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(FOUND), F.lit(0))).otherwise(F.array().cast("array<string>"))


def pseudonymise(docs: DataFrame, key: str | None = None, counts: bool = False) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced; with ``counts`` also n_found and kinds (in text order).

    Without ``key`` the job's key is taken.
    """
    key = key or job_key(docs.sparkSession)
    name = free_name(docs, "found")
    # The values are found once; explode of a one-element array keeps the plan from searching again for every use.
    found = docs.withColumn(name, F.explode(F.array(F.coalesce(found_values(F.col("text")), F.array().cast("array<string>")))))
    between = F.split(F.col("text"), FOUND, -1)
    fresh = free_name(found, "fresh")
    found = found.withColumn(fresh, F.explode(F.array(F.transform(name, lambda v: pseudonym(v, key)))))
    woven = F.array_join(F.transform(F.arrays_zip(between.alias("t"), F.col(fresh).alias("p")), lambda x: F.concat(x["t"], F.coalesce(x["p"], F.lit("")))), "")
    text = F.when(F.size(name) > 0, woven).otherwise(F.col("text"))
    columns = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    if counts:
        # Shapes that fail their check stay as they are and don't count.
        changed = F.filter(name, lambda v, k: v != F.get(fresh, k))
        columns += [F.size(changed).cast("long").alias("n_found"), F.transform(changed, kind_of).alias("kinds")]
    return found.select(*columns)


def op4_pii_pseudonyms(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return pseudonymise(docs, counts=True).select("doc_id", "text", "n_found", F.concat_ws(",", "kinds").alias("kinds"))
