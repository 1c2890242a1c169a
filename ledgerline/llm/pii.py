"""Format-preserving pseudonyms for personal numbers, dates and addresses, by keyed Feistel permutations.

What is found, in this order of preference where finds overlap: e-mail addresses, IPv4 addresses, dates
(year-month-day and day.month.year or month/day/year), account numbers (IBAN), phone numbers, social security
numbers and other long numbers. Each is validated (octets, calendar, areas, check digits) and permuted within
its format: a card number becomes another with a valid check digit, a date another date between 1900 and 2099,
an account another with valid check digits at the same letters, an e-mail address another with the same
punctuation and top-level domain. Separators stay where they are. Values are brought to a canonical form
first (digits alone, country codes by their table, lower case), so that spellings of one value stay linked,
and equal values have equal pseudonyms in all documents; the permutation depends on key, kind and format
alone, so that different values of a kind have different ones. IPv6 addresses aren't looked for.

A permutation of pairs (u, v), u below A and v below B, alternates u += F(v) mod A and v += F(u) mod B; one of
strings does so for each character of a half. Only DataFrame functions. Null text stays null. Each row gives
one row, repeated rows included; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ("email", "ip", "date", "iban", "phone", "ssn", "card", "number")
_EDGE, _END = "(?<![0-9A-Za-z])", "(?![0-9A-Za-z])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_PATTERNS = (
    ("email", "(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]*@[A-Za-z0-9-][A-Za-z0-9.-]*\\.[A-Za-z]{2,}"),
    ("ip", f"(?<![0-9A-Za-z.])(?:{_OCTET}\\.){{3}}{_OCTET}(?![0-9A-Za-z])(?!\\.[0-9])"),
    ("date", f"{_EDGE}(?:(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12][0-9]|3[01])|(?:0?[1-9]|[12][0-9]|3[01])\\.(?:0?[1-9]|1[0-2])\\.(?:19|20)[0-9]{{2}}|(?:0?[1-9]|1[0-2])/(?:0?[1-9]|[12][0-9]|3[01])/(?:19|20)[0-9]{{2}})(?![0-9A-SU-Za-z]|T(?![0-9]{{2}}:))"),
    ("iban", f"{_EDGE}[A-Z]{{2}}[0-9]{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?{_END}"),
    ("phone", f"(?<![0-9A-Za-z+])\\+[1-9][0-9]{{0,2}}[ .-]?(?:\\([0-9]{{2,4}}\\)|[0-9]{{2,4}})(?:[ .-]?[0-9]{{2,4}}){{2,4}}{_END}|{_EDGE}\\(?[0-9]{{3}}\\)?[ .-][0-9]{{3}}[ .-][0-9]{{4}}{_END}"),
    ("ssn", f"{_EDGE}(?!000|666|9)[0-9]{{3}}-(?!00)[0-9]{{2}}-(?!0000)[0-9]{{4}}{_END}"),
    ("number", f"{_EDGE}[0-9]{{4}}(?:[ -]?[0-9]{{4}}){{2,3}}(?:[ -]?[0-9]{{1,3}})?{_END}|{_EDGE}[0-9]{{4}}[ -][0-9]{{6}}[ -][0-9]{{5}}{_END}|{_EDGE}[0-9]{{9,19}}{_END}"),
)
_ANY = "|".join(f"(?:{p})" for _, p in _PATTERNS)
#: 17 x 4297 days from the first one: 1900-01-01 to 2099-12-31.
_FIRST_DAY, _DATE_A, _DATE_B = "1900-01-01", 17, 4297
_SSN = "^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$"
#: Calling codes of two digits; those that begin with 1 or 7 have one, all others three.
_TWO_DIGIT_COUNTRIES = "^(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
_LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789"


def _mix(key: str, *parts: Column) -> Column:
    """A 52-bit number from a keyed digest."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), *parts), 256), 1, 13), 16, 10).cast("long")


def permute_pair(u: Column, v: Column, a: Column, b: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Struct (u, v) after a keyed permutation of all pairs u < a, v < b."""

    def step(s: Column, r: Column) -> Column:
        even = (r % 2) == 0
        seed = _mix(key, tweak, r, F.when(even, s["v"]).otherwise(s["u"]))
        return F.struct(F.when(even, (s["u"] + seed % a) % a).otherwise(s["u"]).alias("u"), F.when(even, s["v"]).otherwise((s["v"] + seed % b) % b).alias("v"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(u.cast("long").alias("u"), v.cast("long").alias("v")), step)


def _power(n: Column) -> Column:
    return F.rpad(F.lit("1"), (n + 1).cast("int"), F.lit("0")).cast("long")


def permute_digits(digits: Column, key: str, tweak: Column) -> Column:
    """Another string of as many digits (two or more)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    own = F.concat_ws("|", tweak, n)
    out = permute_pair(F.substr(digits, F.lit(1), half).cast("long"), F.substr(digits, half + 1).cast("long"), _power(half), _power(n - half), key, own)
    return F.transform(F.array(out), lambda p: F.concat(F.lpad(p["u"].cast("string"), half, F.lit("0")), F.lpad(p["v"].cast("string"), (n - half).cast("int"), F.lit("0"))))[0]


def luhn_digit(body: Column) -> Column:
    """The check digit of a string of digits."""
    n = F.length(body)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.transform(F.array(F.substr(body, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 0, 2).otherwise(1)), lambda d: F.when(d > 9, d - 9).otherwise(d))[0])
    return ((10 - total % 10) % 10).cast("string")


def _refill(shape: Column, digits: Column) -> Column:
    """``shape`` with its digits replaced in order."""
    parts = F.split(shape, "")
    step = lambda s, c: F.when(c.rlike("^[0-9]$"), F.struct((s["i"] + 1).alias("i"), F.concat(s["t"], F.substr(digits, s["i"], F.lit(1))).alias("t"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["t"], c).alias("t")))
    return F.aggregate(parts, F.struct(F.lit(1).alias("i"), F.lit("").alias("t")), step)["t"]


def permute_letters(text: Column, key: str, tweak: Column, rounds: int = ROUNDS) -> Column:
    """Another string of as many of a-z and 0-9, one character or more."""
    half = F.floor(F.length(text) / 2).cast("int")

    def moved(half_text: Column, other: Column, r: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, F.length(text), r, other), 256)
        shift = lambda i: F.conv(F.substr(digest, 2 * (i % 32) + 1, F.lit(2)), 16, 10).cast("int")
        put = lambda c, i: F.substr(F.lit(_LETTERS), ((F.call_function("locate", c, F.lit(_LETTERS)) - 1) + shift(i)) % 36 + 1, F.lit(1))
        return F.array_join(F.transform(F.filter(F.split(half_text, ""), lambda c: c != ""), put), "")

    def step(s: Column, r: Column) -> Column:
        even = (r % 2) == 0
        return F.struct(F.when(even, moved(s["u"], s["v"], r)).otherwise(s["u"]).alias("u"), F.when(even, s["v"]).otherwise(moved(s["v"], s["u"], r)).alias("v"))

    out = F.aggregate(F.sequence(F.lit(0), F.lit(rounds - 1)), F.struct(F.substr(text, F.lit(1), half).alias("u"), F.substr(text, half + 1).alias("v")), step)
    return F.transform(F.array(out), lambda p: F.concat(p["u"], p["v"]))[0]


def _mod97(text: Column) -> Column:
    """Remainder of a string of digits and capitals, capitals read as 10 to 35."""
    step = lambda r, c: F.when(c.rlike("^[0-9]$"), (r * 10 + F.ascii(c) - 48) % 97).otherwise((r * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), F.lit(0), step)


def _iban_valid(value: Column) -> Column:
    bare = F.replace(value, F.lit(" "), F.lit(""))
    return F.length(bare).between(15, 34) & (_mod97(F.concat(F.substr(bare, F.lit(5)), F.left(bare, F.lit(4)))) == 1) & (F.length(F.regexp_replace(F.substr(bare, F.lit(5)), "[^0-9]", "")) >= 2)


def _iban_pseudonym(value: Column, key: str) -> Column:
    """Digits permuted, letters kept, check digits made anew."""
    bare = F.replace(value, F.lit(" "), F.lit(""))
    own, country = F.substr(bare, F.lit(5)), F.left(bare, F.lit(2))
    moved = _refill(own, permute_digits(F.regexp_replace(own, "[^0-9]", ""), key, F.concat_ws("|", F.lit("iban"), country, F.regexp_replace(own, "[0-9]", "#"))))
    check = lambda t: F.lpad((98 - _mod97(F.concat(t, country, F.lit("00")))).cast("string"), 2, F.lit("0"))
    return F.transform(F.array(moved), lambda t: _refill(value, F.concat(check(t), F.regexp_replace(t, "[^0-9]", ""))))[0]


def kind_of(value: Column) -> Column:
    """Kind of a find, null if it fails validation."""
    out = F
    digits = F.regexp_replace(value, "[^0-9]", "")
    for kind, pattern in _PATTERNS:
        full = value.rlike(f"^(?:{pattern})$")
        if kind == "date":
            full = full & _day(value).isNotNull()
        if kind == "number":
            card = full & F.length(digits).between(13, 19) & (luhn_digit(F.substr(digits, F.lit(1), F.length(digits) - 1)) == F.right(digits, F.lit(1)))
            out = out.when(card, "card").when(full & digits.rlike(_SSN), "ssn")
        if kind == "iban":
            full = full & _iban_valid(value)
        out = out.when(full, kind)
    return out


def _day(value: Column) -> Column:
    return F.coalesce(F.try_to_date(value, "yyyy-MM-dd"), F.try_to_date(value, "d.M.yyyy"), F.try_to_date(value, "M/d/yyyy"))


def _date_pseudonym(value: Column, key: str) -> Column:
    days = F.datediff(_day(value), F.lit(_FIRST_DAY).cast("date"))
    moved = permute_pair(F.floor(days / _DATE_B), days % _DATE_B, F.lit(_DATE_A), F.lit(_DATE_B), key, F.lit("date"))
    day = F.date_add(F.lit(_FIRST_DAY).cast("date"), (moved["u"] * _DATE_B + moved["v"]).cast("int"))
    wide = value.rlike("^[0-9]{2}[./]")
    form = F.when(value.contains("-"), F.date_format(day, "yyyy-MM-dd")).when(value.contains("."), F.when(wide, F.date_format(day, "dd.MM.yyyy")).otherwise(F.date_format(day, "d.M.yyyy")))
    other = form.otherwise(F.when(wide, F.date_format(day, "MM/dd/yyyy")).otherwise(F.date_format(day, "M/d/yyyy")))
    return other


def _ip_pseudonym(value: Column, key: str) -> Column:
    o = F.split(value, "\\.")
    part = lambda i: o[i].cast("long")
    moved = permute_pair(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, F.lit("ip"))
    return F.transform(F.array(moved), lambda p: F.concat_ws(".", F.floor(p["u"] / 256), p["u"] % 256, F.floor(p["v"] / 256), p["v"] % 256))[0]


def _put_letters(shape: Column, letters: Column) -> Column:
    """``shape`` with its letters and digits replaced in order."""
    step = lambda s, c: F.when(c.rlike("^[a-z0-9]$"), F.struct((s["i"] + 1).alias("i"), F.concat(s["t"], F.substr(letters, s["i"], F.lit(1))).alias("t"))).otherwise(F.struct(s["i"].alias("i"), F.concat(s["t"], c).alias("t")))
    return F.aggregate(F.filter(F.split(shape, ""), lambda c: c != ""), F.struct(F.lit(1).alias("i"), F.lit("").alias("t")), step)["t"]


def _email_pseudonym(value: Column, key: str) -> Column:
    """Local part and host, each permuted at its letters and digits; the top-level domain stays."""
    low = F.lower(value)
    top = F.substring_index(low, ".", -1)
    local, host = F.substring_index(low, "@", 1), F.substring_index(low, "@", -1)
    host = F.substr(host, F.lit(1), F.length(host) - F.length(top) - 1)
    part = lambda t, name: F.transform(F.array(permute_letters(F.regexp_replace(t, "[^a-z0-9]", ""), key, F.concat_ws("|", F.lit(name), F.regexp_replace(t, "[a-z0-9]", "#")))), lambda x: _put_letters(t, x))[0]
    return F.concat(part(local, "local"), F.lit("@"), part(host, "host"), F.lit("."), top)


def _ssn_digits(digits: Column, key: str) -> Column:
    """Areas 001-665 and 667-899, groups 01-99 and serials 0001-9999 among themselves."""
    area, group, serial = (F.substring(digits, a, n).cast("long") for a, n in ((1, 3), (4, 2), (6, 4)))
    moved = permute_pair(area - F.when(area > 666, 2).otherwise(1), (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, F.lit("ssn"))
    pad = lambda x, n: F.lpad(x.cast("string"), n, F.lit("0"))
    whole = lambda p: F.concat(pad(p["u"] + F.when(p["u"] >= 665, 2).otherwise(1), 3), pad(F.floor(p["v"] / 9999) + 1, 2), pad(p["v"] % 9999 + 1, 4))
    return F.transform(F.array(moved), whole)[0]


def pseudonym(value: Column, key: str) -> Column:
    """The pseudonym of a find; the find itself if it fails validation."""
    return F.transform(F.array(kind_of(value)), lambda kind: _pseudonym(value, kind, key))[0]


def _pseudonym(value: Column, kind: Column, key: str) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    n = F.length(digits)
    body = permute_digits(F.substr(digits, F.lit(1), n - 1), key, F.lit("card"))
    card = F.transform(F.array(body), lambda b: _refill(value, F.concat(b, luhn_digit(b))))[0]
    country = F.when(~value.startswith("+"), 0).when(digits.rlike("^[17]"), 1).when(digits.rlike(_TWO_DIGIT_COUNTRIES), 2).otherwise(3)
    phone = F.concat(F.substr(digits, F.lit(1), country), permute_digits(F.substr(digits, country + 1), key, F.concat(F.lit("phone"), F.substr(digits, F.lit(1), country))))
    return (
        F.when(kind == "email", _email_pseudonym(value, key))
        .when(kind == "ip", _ip_pseudonym(value, key))
        .when(kind == "date", _date_pseudonym(value, key))
        .when(kind == "iban", _iban_pseudonym(value, key))
        .when(kind == "card", card)
        .when(kind == "phone", _refill(value, phone))
        .when(kind == "ssn", _refill(value, _ssn_digits(digits, key)))
        .when(kind == "number", _refill(value, permute_digits(digits, key, kind)))
        .otherwise(value)
    )


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text with pseudonyms, and the number of finds of each kind; no shuffle."""
    hit = F.col("text").rlike(_ANY)
    found = docs.select("doc_id", "text", F.when(hit, F.regexp_extract_all("text", F.lit(_ANY), F.lit(0))).alias("__found"), F.when(hit, F.split("text", _ANY)).alias("__rest"))
    kinds = F.transform("__found", lambda x: F.struct(kind_of(x).alias("kind"), x.alias("value")))
    told = found.withColumn("__told", F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), _pseudonym(x["value"], x["kind"], key).alias("value"))))
    joined = F.concat(F.array_join(F.flatten(F.transform("__told", lambda t, i: F.array(F.get("__rest", i), t["value"]))), ""), F.element_at("__rest", -1))
    count = lambda kind: F.when(F.col("__told").isNull(), 0).otherwise(F.size(F.filter("__told", lambda t: t["kind"] == kind))).cast("long")
    return told.select("doc_id", F.when(F.col("__told").isNull(), F.col("text")).otherwise(joined).alias("text"), *(count(k).alias(f"n_{k}") for k in KINDS))
