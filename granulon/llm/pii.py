"""Keyed pseudonyms that keep the format of what they replace; DataFrame expressions only.

Candidates are found by one pattern and validated: Luhn sums of card numbers, check digits of IBANs,
ranges of IPv4 octets, groups of IPv6 addresses, social security areas, country codes of phone numbers,
calendar dates from 1900 to 2099. A valid one is an element (l, r) of a product of two ranges, and a
Feistel network over the two ranges, with SHA-256 of the key as its round function, permutes that
product. So equal values get equal pseudonyms in all documents, different values of a kind get
different ones, and a pseudonym is as valid as the value was. Mail addresses and access tokens are no
numbers; they get a keyed hash of the same form. What isn't valid stays.

A phone number is its country code and its national number, however it is written: the code stays, and
the national number is permuted. With code 1 (or ten digits in the North American form) areas and
exchanges from 200 to 999 stay in that range, as does what lies below. Elsewhere a leading zero stays a
leading zero, and a trunk zero in brackets is no part of the number. National forms of other countries
without their code aren't recognised.

A domain with few values has few pseudonyms: whoever can ask for pseudonyms can list them. The key
must be kept like the data. Plans hold only a key derived from it, in a form that secret() has Spark
strike out of what it prints and logs; whoever can read the memory of the session can read it there.
"""

from __future__ import annotations

import hashlib
import hmac
import secrets
import warnings
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from granulon.llm.common import fresh

ROUNDS = 10
#: Setting of a session that holds the secret.
KEY_SETTING = "granulon.pii.key"
_DERIVED = "gk:"

# What is looked for, in order. (Java's syntax; no groups that capture.)
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+){1,9}"
SECRET_PREFIX = r"A[KS]IA|gh[oprsu]_|github_pat_|glpat-|xox[abeprs]-|AIza|[rs]k_live_|sk-|eyJ"
SECRET = (
    r"(?<![0-9A-Za-z_-])(?:A[KS]IA[0-9A-Z]{16}|gh[oprsu]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255}|glpat-[0-9A-Za-z_-]{20,64}|xox[abeprs]-[0-9A-Za-z-]{10,250}"
    r"|AIza[0-9A-Za-z_-]{35}|[rs]k_live_[0-9A-Za-z]{16,250}|sk-(?=[A-Za-z_-]*[0-9])[0-9A-Za-z_-]{20,250}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,})(?![0-9A-Za-z_-])"
)
TOKEN = r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[0-9])(?=[0-9A-Fa-f]*[A-Fa-f])[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])"
IBAN = r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?:[0-9A-Z]{11,30}|(?: [0-9A-Z]{4}){2,7}(?: [0-9A-Z]{1,3})?)(?![0-9A-Za-z])"
IPV6 = r"(?<![0-9A-Za-z:.])(?=[A-Fa-f:]*[0-9])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:]|\.[0-9])"
IPV4 = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
ISO_DATE = r"(?<![0-9-])[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9-])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
DAY_DATE = r"(?<![0-9./])[0-9]{1,2}(?:\.[0-9]{1,2}\.|/[0-9]{1,2}/)[0-9]{4}(?![0-9]|[./][0-9])"
NORTH_AMERICA = r"(?<![0-9A-Za-z+(])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
PHONE = NORTH_AMERICA + r"|(?<![0-9A-Za-z+])\+[0-9]{1,3}[ .-]?\(?[0-9]{1,4}\)?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9A-Za-z])(?<![0-9][-.,])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"
# Kinds with the same beginnings stand together behind one look at it.
PATTERN = f"{EMAIL}|(?<![0-9A-Za-z])(?:{'|'.join((SECRET, TOKEN, IBAN, IPV6))})|(?=[0-9+(])(?:{'|'.join((IPV4, ISO_DATE, SSN, DAY_DATE, PHONE, CARD))})"
# Country codes of one and of two digits. All others have three.
COUNTRY_CODE = r"^(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"

#: Days from 1900-01-01 to 2099-12-31, as a product.
FIRST_DAY, DAYS = "1900-01-01", (17, 4297)
#: Valid social security numbers: areas 001 to 899 without 666; groups and serials without zeros.
AREAS, GROUPS, SERIALS = 898, 99, 9999


def derived(key: str) -> str:
    """What plans hold in place of the secret."""
    return _DERIVED + hmac.new(key.encode(), b"granulon pseudonyms", hashlib.sha256).hexdigest()[:32]


_session_keys: dict[str, str] = {}


def secret(spark: SparkSession) -> str:
    """The secret in the session's setting granulon.pii.key.

    Without one: a random key of this application, with a warning. Values are then linked within the
    application, but not with what was written before.
    """
    key = spark.conf.get(KEY_SETTING, None)
    if key:
        return key
    warnings.warn(f"{KEY_SETTING} is not set: pseudonyms of this application aren't linked to others", RuntimeWarning, stacklevel=2)
    return _session_keys.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


def _strike_out(spark: SparkSession) -> None:
    """Have Spark leave derived keys out of printed and logged plans."""
    setting, own = "spark.sql.redaction.string.regex", _DERIVED + "[0-9a-f]{32}"
    before = spark.conf.get(setting, None)
    if own not in (before or ""):
        spark.conf.set(setting, f"{before}|{own}" if before else own)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _number(digits: Column) -> Column:
    return F.coalesce(digits.try_cast("bigint"), F.lit(0).cast("bigint"))


def _hash(key: str, tag: str | Column, *values: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(tag), *[v.cast("string") for v in values]), 256)


def _prf(key: str, tag: str | Column, i: Column, x: Column) -> Column:
    return F.conv(F.substring(_hash(key, tag, i, x), 1, 15), 16, 10).cast("bigint")


def feistel(key: str, tag: str | Column, left: Column, right: Column, a: Column, b: Column) -> Column:
    """A permutation of [0, a) x [0, b) as struct(l, r): in turn each side is shifted by a hash of the other."""
    pair = lambda x, y: F.struct(x.cast("bigint").alias("l"), y.cast("bigint").alias("r"))

    def step(s: Column, i: Column) -> Column:
        return F.when(i % 2 == 0, pair((s["l"] + _prf(key, tag, i, s["r"])) % a, s["r"])).otherwise(pair(s["l"], (s["r"] + _prf(key, tag, i, s["l"])) % b))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(left, right), step)


def _digits(key: str, tag: str, digits: Column) -> Column:
    """A string of 2 to 30 digits, permuted among those of its length."""

    def halves(d: Column) -> Column:
        n = F.length(d)
        k = F.floor(n / 2).cast("int")
        power = lambda e: F.pow(F.lit(10.0), e).cast("bigint")
        mixed = feistel(key, tag, _number(d.substr(F.lit(1), k)), _number(d.substr(k + 1, n - k)), power(k), power(n - k))
        return _let(mixed, lambda s: F.concat(F.lpad(s["l"].cast("string"), k, "0"), F.lpad(s["r"].cast("string"), n - k, "0")))

    return _let(digits, halves)


def _digit_sum(digits: Column, double_odd: bool) -> Column:
    """Luhn's sum, counted from the right; the rightmost digit is doubled if double_odd."""

    def add(s: Column, i: Column) -> Column:
        x = digits.substr(F.length(digits) - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == (1 if double_odd else 0), 2).otherwise(1)
        return s + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _card(key: str, m: Column) -> Column:
    def whole(d: Column) -> Column:
        payload = d.substr(F.lit(1), F.length(d) - 1)
        new = _let(_digits(key, "card", payload), lambda p: F.concat(p, ((10 - _digit_sum(p, True) % 10) % 10).cast("string")))
        return F.when(_digit_sum(d, False) % 10 == 0, _filled(m, new))

    return _let(F.regexp_replace(m, "[^0-9]", ""), whole)


def _filled(form: Column, digits: Column) -> Column:
    """form with its digits replaced by these, in order."""

    def put(s: Column, c: Column) -> Column:
        is_digit = c.between("0", "9")
        return F.struct(F.concat(s["o"], F.when(is_digit, digits.substr(s["k"] + 1, F.lit(1))).otherwise(c)).alias("o"), (s["k"] + is_digit.cast("int")).alias("k"))

    chars = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: form.substr(i, F.lit(1)))
    return F.aggregate(chars, F.struct(F.lit("").alias("o"), F.lit(0).alias("k")), put, lambda s: s["o"])


def _phone(key: str, m: Column) -> Column:
    """The country code stays; the national number is permuted, the same way in all spellings."""
    digits = F.regexp_replace(m, "[^0-9]", "")
    code = F.when(m.startswith("+"), F.regexp_extract(digits, COUNTRY_CODE, 0)).when(F.length(digits) == 11, "1").otherwise("")
    trunk = F.when(m.startswith("+") & m.contains("(0)"), "0").otherwise("")

    def whole(s: Column) -> Column:
        known = F.when(m.startswith("+"), s["c"]).otherwise("1")
        national = s["d"].substr(F.length(s["c"]) + F.length(s["t"]) + 1, F.length(s["d"]))
        put = lambda new: F.when(new.isNotNull(), _filled(m, F.concat(s["c"], s["t"], new)))
        return _let(F.struct(known.alias("k"), national.alias("n")), lambda p: F.when(p["k"] == "", None).otherwise(_let(F.when((p["k"] == "1") & (F.length(p["n"]) == 10), _north_american(key, p["n"])).otherwise(_national(key, p["k"], p["n"])), put)))

    return _let(F.struct(digits.alias("d"), code.alias("c"), trunk.alias("t")), whole)


def _north_american(key: str, n: Column) -> Column:
    """Ten digits; areas and exchanges below 200, which none has, are permuted among themselves."""

    def whole(s: Column) -> Column:
        low = lambda x: F.when(x < 200, 0).otherwise(200)
        span = lambda x: F.when(x < 200, 200).otherwise(800)
        mixed = feistel(key, "phone1", s["a"] - low(s["a"]), (s["e"] - low(s["e"])) * 10_000 + s["l"], span(s["a"]), span(s["e"]) * 10_000)
        show = lambda x, width: F.lpad(x.cast("bigint").cast("string"), width, "0")
        return _let(mixed, lambda p: F.concat(show(p["l"] + low(s["a"]), 3), show(F.floor(p["r"] / 10_000) + low(s["e"]), 3), show(p["r"] % 10_000, 4)))

    return _let(F.struct(_number(n.substr(1, 3)).alias("a"), _number(n.substr(4, 3)).alias("e"), _number(n.substr(7, 4)).alias("l")), whole)


def _national(key: str, code: Column, n: Column) -> Column:
    """7 to 15 digits, permuted among those of the length whose first digit is zero, or isn't, as this one's."""

    def whole(s: Column) -> Column:
        power = lambda e: F.pow(F.lit(10.0), e).cast("bigint")
        zero = s["d"].startswith("0")
        low = F.when(zero, 0).otherwise(power(s["k"] - 1))
        span = F.when(zero, 1).otherwise(9) * power(s["k"] - 1)
        rest = F.length(s["d"]) - s["k"]
        mixed = feistel(key, F.concat(F.lit("phone"), code), _number(s["d"].substr(F.lit(1), s["k"])) - low, _number(s["d"].substr(s["k"] + 1, rest)), span, power(rest))
        return _let(mixed, lambda p: F.concat(F.lpad((p["l"] + low).cast("string"), s["k"], "0"), F.lpad(p["r"].cast("string"), rest, "0")))

    return F.when(F.length(n).between(7, 15), _let(F.struct(n.alias("d"), F.floor(F.length(n) / 2).cast("int").alias("k")), whole))


def _remainder(text: Column) -> Column:
    """Of letters and digits read as a number (A is 10), the remainder by 97."""

    def add(r: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: text.substr(i, F.lit(1))), F.lit(0), add)


def _iban(key: str, m: Column) -> Column:
    """Country and letters stay, the account's digits are permuted, the check digits follow. What is no IBAN but ends in a card number: that."""

    def whole(v: Column) -> Column:
        country, account = v.substr(1, 2), v.substr(F.lit(5), F.length(v))
        new = _let(_filled(account, _digits(key, "iban", F.regexp_replace(account, "[^0-9]", ""))), lambda a: F.concat(F.lpad((98 - _remainder(F.concat(a, country, F.lit("00")))).cast("string"), 2, "0"), a))
        valid = (_remainder(F.concat(account, v.substr(1, 4))) == 1) & (F.length(F.regexp_replace(account, "[^0-9]", "")).between(2, 30))
        tail = F.regexp_extract(m, f"^[A-Z]{{2}}[0-9]{{2}} ?((?:{CARD}))$", 1)
        card = _let(tail, lambda t: F.when(t != "", _let(_card(key, t), lambda c: F.concat(m.substr(F.lit(1), F.length(m) - F.length(t)), c))))
        return F.when(valid, _let(new, lambda n: F.concat(country, _spaced(m.substr(F.lit(3), F.length(m)), n)))).otherwise(card)

    return _let(F.regexp_replace(m, " ", ""), whole)


def _spaced(form: Column, chars: Column) -> Column:
    """chars with spaces where form has them."""
    put = lambda s, c: F.struct(F.concat(s["o"], F.when(c == " ", c).otherwise(chars.substr(s["k"] + 1, F.lit(1)))).alias("o"), (s["k"] + (c != " ").cast("int")).alias("k"))
    each = F.transform(F.sequence(F.lit(1), F.length(form)), lambda i: form.substr(i, F.lit(1)))
    return F.aggregate(each, F.struct(F.lit("").alias("o"), F.lit(0).alias("k")), put, lambda s: s["o"])


def _ipv6(key: str, m: Column) -> Column:
    """Both halves of the 128 bits by turns, with exclusive or; written in eight groups. "::" and "::1" stay."""
    groups = lambda part: F.filter(F.split(part, ":"), lambda g: g != "")
    left, right = groups(F.substring_index(m, "::", 1)), groups(F.when(m.contains("::"), F.substring_index(m, "::", -1)).otherwise(""))

    def whole(s: Column) -> Column:
        filled = F.concat(s["a"], F.array_repeat(F.lit("0"), F.greatest(F.lit(0), 8 - F.size(s["a"]) - F.size(s["b"]))), s["b"])
        numbers = F.transform(filled, lambda g: F.conv(g, 16, 10).cast("bigint"))
        half = lambda g, at: F.aggregate(F.slice(g, at, 4), F.lit(0).cast("bigint"), lambda x, y: F.shiftleft(x, 16).bitwiseOR(y))
        wide = lambda h: F.shiftleft(F.conv(h.substr(1, 8), 16, 10).cast("bigint"), 32).bitwiseOR(F.conv(h.substr(9, 8), 16, 10).cast("bigint"))
        pair = lambda x, y: F.struct(x.alias("l"), y.alias("r"))

        def step(p: Column, i: Column) -> Column:
            turn = lambda x: wide(_hash(key, "ipv6", i, x))
            return F.when(i % 2 == 0, pair(p["l"].bitwiseXOR(turn(p["r"])), p["r"])).otherwise(pair(p["l"], p["r"].bitwiseXOR(turn(p["l"]))))

        def show(p: Column) -> Column:
            text = F.concat_ws(":", *[F.lower(F.hex(F.shiftrightunsigned(p[x], k).bitwiseAND(F.lit(65535)))) for x in ("l", "r") for k in (48, 32, 16, 0)])
            return F.when(m.rlike("[A-F]"), F.upper(text)).otherwise(text)

        return _let(numbers, lambda g: F.when((half(g, 1) != 0) | ~half(g, 5).isin(0, 1), _let(F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), pair(half(g, 1), half(g, 5)), step), show)))

    # Once "::" for one group or more, or eight groups; colons at the ends only as part of "::".
    size = F.size(left) + F.size(right)
    short = m.rlike("^[^:]*(?::[^:]+)*::(?:[^:]+:)*[^:]*$") & (size <= 7)
    return F.when(short | (m.rlike("^[^:]+(?::[^:]+){7}$") & (size == 8)), _let(F.struct(left.alias("a"), right.alias("b")), whole))


def _ipv4(key: str, m: Column) -> Column:
    octets = F.transform(F.split(m, r"\."), lambda x: x.cast("int"))

    def whole(o: Column) -> Column:
        at = lambda i: F.element_at(o, i)
        wide = F.lit(65536)
        mixed = feistel(key, "ipv4", at(1) * 256 + at(2), at(3) * 256 + at(4), wide, wide)
        new = _let(mixed, lambda s: F.concat_ws(".", *[F.floor(x / d).cast("bigint") % 256 if d > 1 else x % 256 for x in (s["l"], s["r"]) for d in (256, 1)]))
        return F.when(~F.exists(o, lambda x: x > 255), new)

    return _let(octets, whole)


def _ssn(key: str, m: Column) -> Column:
    def whole(s: Column) -> Column:
        area, group, serial = s["a"], s["g"], s["s"]
        index = area - 1 - (area > 666).cast("int")
        mixed = feistel(key, "ssn", index, (group - 1) * SERIALS + serial - 1, F.lit(AREAS), F.lit(GROUPS * SERIALS))

        def text(p: Column) -> Column:
            low = p["l"] + 1
            parts = ((low + (low >= 666).cast("int"), 3), (F.floor(p["r"] / SERIALS) + 1, 2), (p["r"] % SERIALS + 1, 4))
            return F.concat_ws("-", *[F.lpad(x.cast("bigint").cast("string"), n, "0") for x, n in parts])

        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        return F.when(valid, _let(mixed, text))

    return _let(F.struct(m.substr(1, 3).cast("int").alias("a"), m.substr(5, 2).cast("int").alias("g"), m.substr(8, 4).cast("int").alias("s")), whole)


def _date(key: str, day: Column, text: Callable[[Column], Column]) -> Column:
    a, b = DAYS

    def whole(d: Column) -> Column:
        n = F.datediff(d, F.lit(FIRST_DAY).cast("date"))
        mixed = feistel(key, "date", F.floor(n / b), n % b, F.lit(a), F.lit(b))
        new = _let(mixed, lambda s: F.date_add(F.lit(FIRST_DAY).cast("date"), (s["l"] * b + s["r"]).cast("int")))
        return F.when(d.isNotNull() & n.between(0, a * b - 1), _let(new, text))

    return _let(day, whole)


def _iso_date(key: str, m: Column) -> Column:
    return _date(key, m.try_cast("date"), lambda d: F.date_format(d, "yyyy-MM-dd"))


def _day_date(key: str, m: Column) -> Column:
    """Day first if that is a date, else month first; with leading zeros if the value has two digits in both places."""

    def whole(p: Column) -> Column:
        first, second, year = F.element_at(p, 1), F.element_at(p, 2), F.element_at(p, 3)
        day = lambda d, mth: F.concat_ws("-", year, F.lpad(mth, 2, "0"), F.lpad(d, 2, "0")).try_cast("date")
        padded = (F.length(first) == 2) & (F.length(second) == 2)
        dot = m.contains(".")

        def text(order: str) -> Callable[[Column], Column]:
            wide, short = ("dd.MM.yyyy", "d.M.yyyy") if order == "day" else ("MM.dd.yyyy", "M.d.yyyy")

            def show(d: Column) -> Column:
                t = F.when(padded, F.date_format(d, wide)).otherwise(F.date_format(d, short))
                return F.when(dot, t).otherwise(F.translate(t, ".", "/"))

            return show

        return F.coalesce(_date(key, day(first, second), text("day")), _date(key, day(second, first), text("month")))

    return _let(F.split(m, "[./]"), whole)


def _email(key: str, m: Column) -> Column:
    """The mailbox becomes a keyed hash of the whole address, at least 24 characters long, the domain one of the domain; its last part stays."""
    name, domain = F.substring_index(m, "@", 1), F.lower(F.substring_index(m, "@", -1))
    box = _hash(key, "email", F.lower(m)).substr(F.lit(1), F.least(F.greatest(F.length(name), F.lit(24)), F.lit(64)))
    return F.concat(box, F.lit("@"), _hash(key, "domain", domain).substr(1, 16), F.lit("."), F.substring_index(domain, ".", -1))


def _token(key: str, m: Column) -> Column:
    hashed = _hash(key, "token", F.lower(m)).substr(F.lit(1), F.length(m))
    return F.when(F.upper(m) == m, F.upper(hashed)).otherwise(hashed)


def _secret(key: str, m: Column) -> Column:
    """Behind the prefix that names its issuer, each letter and digit becomes another of its kind by a keyed hash of the whole."""
    n = F.length(F.regexp_extract(m, f"^(?:{SECRET_PREFIX})", 0))
    stream = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(F.length(m) / 16).cast("int")), lambda i: _hash(key, "secret", m, i)), "")

    def swap(h: Column) -> Callable[[Column], Column]:
        def one(i: Column) -> Column:
            c = m.substr(i, F.lit(1))
            x = F.conv(h.substr(4 * i - 3, F.lit(4)), 16, 10).cast("int")
            return F.when(i <= n, c).when(c.between("0", "9"), F.char(48 + x % 10)).when(c.between("A", "Z"), F.char(65 + x % 26)).when(c.between("a", "z"), F.char(97 + x % 26)).otherwise(c)

        return one

    return _let(stream, lambda h: F.array_join(F.transform(F.sequence(F.lit(1), F.length(m)), swap(h)), ""))


def _named(kind: str, m: Column) -> Callable[[Column], Column]:
    return lambda new: F.struct(F.when(new.isNotNull(), kind).alias("kind"), F.coalesce(new, m).alias("new"))


def pseudonym(m: Column, key: str) -> Column:
    """struct(kind, new) of a candidate; kind is null and new the candidate itself if it isn't valid."""
    kinds = (("email", EMAIL, _email), ("secret", SECRET, _secret), ("token", TOKEN, _token), ("iban", IBAN, _iban), ("ipv6", IPV6, _ipv6), ("ipv4", IPV4, _ipv4), ("date", ISO_DATE, _iso_date), ("ssn", SSN, _ssn), ("date", DAY_DATE, _day_date), ("phone", PHONE, _phone), ("card", CARD, _card))
    pick: Column | None = None
    for kind, pattern, make in kinds:
        made = _let(make(key, m), _named(kind, m))
        whole = m.rlike(f"^(?:{pattern})$")
        pick = F.when(whole, made) if pick is None else pick.when(whole, made)
    return pick.otherwise(F.struct(F.lit(None).cast("string").alias("kind"), m.alias("new")))


def pseudonymise(df: DataFrame, key: str, text_col: str = "text", found_col: str = "pii_found") -> DataFrame:
    """All rows and columns of df, with text replaced; behind them, as the last column, the kinds of what was replaced, in order.

    No shuffle. A null text stays null with no kinds, an empty one stays empty. The last column is named
    found_col, with underscores behind it if df has a column of that name. Repeated rows get the same
    text; an empty table stays empty.
    """
    _strike_out(df.sparkSession)
    key = derived(key)
    text = F.col(f"`{text_col}`")
    pattern = F.lit(PATTERN)
    # Texts without a digit, an at sign or the beginning of an access token have no candidate and skip the pattern.
    some = text.rlike(f"[0-9@]|{SECRET_PREFIX}")
    name, found = fresh(df, "_pii"), fresh(df, found_col)
    work = df.withColumn(name, F.when(some, F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), lambda m: pseudonym(m, key))))
    between = F.split(text, PATTERN, -1)
    new = F.concat(F.transform(F.col(name), lambda p: p["new"]), F.array(F.lit("")))
    glued = F.array_join(F.flatten(F.zip_with(between, new, lambda a, b: F.array(a, b))), "")
    kinds = F.filter(F.transform(F.col(name), lambda p: p["kind"]), lambda k: k.isNotNull())
    out = work.withColumn(text_col, F.when(F.size(name) > 0, glued).otherwise(text)).withColumn(found, F.coalesce(kinds, F.array().cast("array<string>")))
    return out.drop(name)
