"""Pseudonyms: permutations, validity, links and finds."""

import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from ledgerline.llm import pii


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def one(spark, values, f):
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", f(F.col("v")).alias("w"))
    return {r.v: r.w for r in df.collect()}


def test_digits_are_permuted(spark):
    values = [f"{i:03d}" for i in range(1000)]
    got = one(spark, values, lambda v: pii.permute_digits(v, "k", F.lit("t")))
    assert set(got.values()) == set(values) and sum(a == b for a, b in got.items()) < 10
    assert got != one(spark, values, lambda v: pii.permute_digits(v, "other", F.lit("t")))


def test_dates_are_permuted(spark):
    first = datetime.date(1900, 1, 1)
    values = [(first + datetime.timedelta(i)).isoformat() for i in range(0, 73049, 97)] + ["2099-12-01", "2099-12-31"]
    got = one(spark, values, lambda v: pii.pseudonym(v, "k"))
    assert len(set(got.values())) == len(values)
    assert all(datetime.date.fromisoformat(x) and x < "2100" for x in got.values())


def test_cards_stay_cards(spark):
    body = ["411111111111111", "492934838530632", "37828224631000"]
    values = [b + next(str(d) for d in range(10) if luhn(b + str(d))) for b in body] + ["4111-1111-1111-1111", "4111 1111 1111 1112"]
    got = one(spark, values, lambda v: pii.pseudonym(v, "k"))
    for v, w in got.items():
        assert re.sub("[0-9]", "#", v) == re.sub("[0-9]", "#", w) and v != w
    assert all(luhn(re.sub("[^0-9]", "", got[v])) for v in values[:-1])
    assert re.sub("-", "", got["4111-1111-1111-1111"]) == got["4111111111111111"]


def test_formats(spark):
    values = ["123-45-6789", "665-01-0001", "667-99-9999", "192.168.0.1", "+1 (017) 555-7713", "555-123-4567", "a.b@c.example.com", "2/30/2020", "31.12.1999", "1/2/2003"]
    got = one(spark, values, lambda v: pii.pseudonym(v, "k"))
    assert re.fullmatch("(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", got["123-45-6789"]) and got["665-01-0001"] != got["667-99-9999"]
    assert all(0 <= int(x) < 256 for x in got["192.168.0.1"].split("."))
    assert re.fullmatch(r"\+1 \([0-9]{3}\) [0-9]{3}-[0-9]{4}", got["+1 (017) 555-7713"])
    assert got["2/30/2020"] == "2/30/2020" and re.fullmatch(r"[0-9]+\.[0-9]+\.[0-9]{4}", got["31.12.1999"])
    assert all(got[v] != v for v in values if v != "2/30/2020")


def test_documents_lose_their_finds_and_nothing_else(docs):
    out = pii.pseudonymise(docs, "k")
    again = {r.doc_id: r for r in out.collect()}
    for r in docs.collect():
        finds = re.findall(pii._ANY, r.text)
        told = again[r.doc_id]
        assert sum(told[f"n_{k}"] for k in pii.KINDS) <= len(finds)
        assert told.text == r.text if not finds else all(f not in told.text for f in finds)
        assert re.split(pii._ANY, r.text)[0] == told.text[: len(re.split(pii._ANY, r.text)[0])]


def test_links_between_documents(spark):
    df = spark.createDataFrame([(1, "x 4929348385306327 y"), (2, "z\n4929348385306327"), (3, "4929348385306328")], "doc_id long, text string")
    a, b, c = (re.findall("[0-9]+", r.text)[0] for r in sorted(pii.pseudonymise(df, "k").collect()))
    assert a == b != c


def test_odd_tables(odd, none):
    out = pii.pseudonymise(odd, "k")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted(((r.doc_id, r.text) for r in odd.collect()), key=str)
    assert pii.pseudonymise(none, "k").count() == 0


# The same in plain Python, for comparison.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def mixed(*parts):
    return int(hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()[:13], 16)


def pair(u, v, a, b, key, tweak):
    for r in range(8):
        if r % 2 == 0:
            u = (u + mixed(key, tweak, r, v) % a) % a
        else:
            v = (v + mixed(key, tweak, r, u) % b) % b
    return u, v


def digits_of(d, key, tweak):
    h = len(d) // 2
    u, v = pair(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), key, f"{tweak}|{len(d)}")
    return f"{u:0{h}d}{v:0{len(d) - h}d}"


def letters_of(t, key, tweak):
    h = len(t) // 2
    u, v = t[:h], t[h:]

    def move(x, other, r):
        digest = hashlib.sha256(f"{key}|{tweak}|{len(t)}|{r}|{other}".encode()).hexdigest()
        return "".join(ALPHABET[(ALPHABET.index(c) + int(digest[2 * (i % 32) : 2 * (i % 32) + 2], 16)) % 36] for i, c in enumerate(x))

    for r in range(8):
        u, v = (move(u, v, r), v) if r % 2 == 0 else (u, move(v, u, r))
    return u + v


def put(shape, new, old="[0-9]"):
    it = iter(new)
    return re.sub(old, lambda m: next(it), shape)


def plain_find(t):
    """A find at the start of ``t``: length and pseudonym with key "k", or nothing."""
    if m := re.match(r"(20|19)\d\d-(\d\d)-(\d\d)(?![0-9A-Za-z])", t):
        try:
            day = (datetime.date.fromisoformat(m[0]) - datetime.date(1900, 1, 1)).days
        except ValueError:
            return None
        u, v = pair(day // 4297, day % 4297, 17, 4297, "k", "date")
        return m.end(), (datetime.date(1900, 1, 1) + datetime.timedelta(u * 4297 + v)).isoformat()
    if m := re.match(r"\d{3}-\d\d-\d{4}(?![0-9A-Za-z])", t):
        area, group, serial = map(int, m[0].split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        u, v = pair(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "k", "ssn")
        return m.end(), f"{u + (2 if u >= 665 else 1):03d}-{v // 9999 + 1:02d}-{v % 9999 + 1:04d}"
    if m := re.match(r"\d{16}(?![0-9A-Za-z])", t):
        if not luhn(m[0]):
            return m.end(), digits_of(m[0], "k", "number")
        body = digits_of(m[0][:-1], "k", "card")
        return m.end(), body + next(str(d) for d in range(10) if luhn(body + str(d)))
    if m := re.match(r"\+49[ 0-9]{8,14}(?![0-9A-Za-z])", t):
        d = re.sub(" ", "", m[0])[1:]
        return m.end(), put(m[0], "49" + digits_of(d[2:], "k", "phone49"))
    if m := re.match(r"[a-z][a-z0-9.]*@[a-z0-9.-]+\.[a-z]{2,}", t):
        local, host = m[0].split("@")
        host, top = host.rsplit(".", 1)
        one = lambda x, name: put(x, letters_of(re.sub("[^a-z0-9]", "", x), "k", f"{name}|{re.sub('[a-z0-9]', '#', x)}"), "[a-z0-9]")
        return m.end(), f"{one(local, 'local')}@{one(host, 'host')}.{top}"
    return None


def plain_text(t):
    out, i = "", 0
    while i < len(t):
        found = plain_find(t[i:]) if not (i and re.match("[0-9A-Za-z]", t[i - 1])) else None
        out, i = (out + found[1], i + found[0]) if found else (out + t[i], i + 1)
    return out


def test_texts_equal_plain_version(spark):
    rng = random.Random(9)
    digit = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    kinds = (
        lambda: f"{rng.randrange(1900, 2100)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 31):02d}", lambda: f"{digit(3)}-{digit(2)}-{digit(4)}", lambda: digit(16), lambda: "4929348385306327",
        lambda: f"+49 151 {digit(8)}", lambda: f"+49151{digit(8)}", lambda: f"{rng.choice(('jo.doe', 'x', 'ann1'))}@{rng.choice(('mail.example', 'a-b'))}.org",
    )
    table = [(i, "; ".join(rng.choice(("so", "it", "(is)", "12", rng.choice(kinds)(), rng.choice(kinds)())) for _ in range(40))) for i in range(60)]
    got = {r.doc_id: r.text for r in pii.pseudonymise(spark.createDataFrame(table, "doc_id long, text string"), "k").collect()}
    assert got == {i: plain_text(t) for i, t in table}


def test_spellings_stay_linked_and_checks_hold(spark):
    values = ["+49 151 23456789", "+4915123456789", "123-45-6789", "123456789", "DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32", "3782 822463 10005", "378282246310005", "Jo.Doe@Example.org", "jo.doe@example.org"]
    got = one(spark, values, lambda v: pii.pseudonym(v, "k"))
    bare = lambda v: re.sub("[^0-9a-zA-Z@.]", "", got[v])
    for a, b in zip(values[:6:2], values[1:6:2], strict=True):
        assert bare(a) == bare(b) and bare(a) != re.sub("[^0-9a-zA-Z]", "", a)
    assert bare("3782 822463 10005") == bare("378282246310005") and luhn(bare("378282246310005")) and got[values[-1]] == got[values[-2]]
    for v in (values[5], values[6]):
        moved = got[v].replace(" ", "")
        assert int("".join(str(int(c, 36)) for c in moved[4:] + moved[:4])) % 97 == 1 and re.sub("[0-9]", "#", got[v]) == re.sub("[0-9]", "#", v) and got[v] != v
    text = spark.createDataFrame([(1, "at 2024-03-01T10:00 and DE89 3704 0044 0532 0130 01")], "doc_id long, text string")
    row = pii.pseudonymise(text, "k").head()
    assert "2024-03-01" not in row.text and "T10:00" in row.text and row.n_iban == 0


def test_letters_are_permuted(spark):
    values = [a + b for a in ALPHABET for b in ALPHABET]
    got = one(spark, values, lambda v: pii.permute_letters(v, "k", F.lit("t")))
    assert set(got.values()) == set(values)
