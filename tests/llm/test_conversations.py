"""Conversation repair against a search of all edits, the damage against its rule, and odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from ledgerline.llm import conversations
from ledgerline.llm.conversations import BLANK, DUPLICATE, NONE, TRUNCATED, cheapest_edits

SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile("(s?(ua)+)?")


def least_edits(codes):
    """Cost and edits by uniform-cost search over (turn, roles so far), with a grammar check at the end."""
    queue, done = [(0, "", 0, "")], set()
    while queue:
        cost, edits, i, roles = heapq.heappop(queue)
        if (i, roles, edits) in done:
            continue
        done.add((i, roles, edits))
        if i == len(codes) and GRAMMAR.fullmatch(roles):
            return cost, edits
        if len(roles) > len(codes) + 3 or not re.fullmatch("s?(ua)*u?", roles):
            continue
        for role in "ua":
            heapq.heappush(queue, (cost + 2, edits + "I", i, roles + role))
        if i < len(codes):
            fault, initial = codes[i] // 4, "suax"[codes[i] % 4]
            heapq.heappush(queue, (cost + 3, edits + "D", i + 1, roles))
            if fault in (NONE, TRUNCATED):
                cut = fault == TRUNCATED
                heapq.heappush(queue, (cost + cut, edits + "K", i + 1, roles + initial))
                for role in "ua":
                    heapq.heappush(queue, (cost + 2 + cut, edits + "R", i + 1, roles + role))
    raise AssertionError


def test_edits_equal_a_search_of_all():
    rng = random.Random(11)
    for n in (0, 1, 2, 3, 4, 5, 6):
        for _ in range(60):
            codes = bytes(rng.choice([0, 1, 1, 2, 2, 3]) + 4 * rng.choice([NONE, NONE, NONE, BLANK, DUPLICATE, TRUNCATED]) for _ in range(n))
            assert cheapest_edits(codes) == least_edits(codes), codes


def test_checkpoints_do_not_change_long_edits():
    """A full table of vectors gives the same edits as the checkpoints."""
    rng = random.Random(5)
    codes = bytes(rng.randrange(16) for _ in range(3000))
    cost, edits = cheapest_edits(codes)
    vectors = [conversations._close(conversations._END)]
    for c in reversed(codes):
        vectors.append(conversations._before(c, vectors[-1]))
    assert cost == vectors[-1][0] and len(edits) - edits.count("I") == 3000
    spent = sum({"D": 3, "I": 2, "R": 2, "K": 0}[e] for e in edits)
    turns = [c for c in codes]
    i = 0
    for e in edits:
        if e != "I":
            spent += e in "KR" and turns[i] // 4 == TRUNCATED
            assert e == "D" or turns[i] // 4 in (NONE, TRUNCATED)
            i += 1
    assert spent == cost


def plain(rows):
    """The digest by the rules, one conversation after another."""
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = []
    for conv, own in out.items():
        own.sort()
        seen, codes = set(), []
        for *_, role, text in own:
            body = text.rstrip(" \t\n\x0b\x0c\r")
            codes.append("sua".find(role[:1] or "x") % 4 + 4 * (BLANK if not body else DUPLICATE if (role, text) in seen else TRUNCATED if body[-1] not in ".!?" else NONE))
            seen.add((role, text))
        cost, edits = cheapest_edits(bytes(codes))
        repaired, turns, last = [], iter(own), ""
        for e in edits:
            role, text = ("assistant" if last == "u" else "user"), ""
            if e != "I":
                *_, old, text = next(turns)
                role = old if e == "K" else role
            if e != "D":
                repaired.append(f"{role}:{text}")
                last = role[:1]
        numbers = {t for known, t, *_ in own if known}
        faults = [c // 4 for c in codes]
        initials = ["suax"[c % 4] for c in codes]
        assert GRAMMAR.fullmatch("".join(x[0] for x in repaired))
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        want.append((conv, max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, edits, hashlib.sha256("\n".join(repaired).encode()).hexdigest()))
    return sorted(want, key=str)


def digests(df):
    return sorted(map(tuple, conversations.repair_report(conversations.damage(df)).collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_report_equals_plain_rules(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet")
    assert digests(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


def test_odd_turns(spark):
    rng = random.Random(2)
    rows = [(None, None, None, None), (1, None, "user", None), (2, 3, "", "x."), (3, 1, "tool", "x" * 200_000 + ".")] + [(4, 0, "user", "again.")] * 3
    rows += [(5 + rng.randrange(40), rng.choice([None, *range(8)]), rng.choice(["user", "assistant", "system", "bot", None]), rng.choice(["Yes.", "No", " \n", "é!", None, "a:b?\t"])) for _ in range(500)]
    rows += [(99, i, "user" if i % 2 else "assistant", f"t{i % 700}.") for i in range(5000)]  # one long conversation
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).select("*", *(F.lit("clash").alias(c) for c in ("part", "again", "code", "copies")))
    got = digests(df)
    assert got == plain(rows) and len(got) == len({r[0] for r in rows})
    assert digests(df.limit(0)) == []


def test_dropped_conversations_stay(spark):
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    assert digests(spark.createDataFrame([(gone, 0, "user", "Hello.")], SCHEMA)) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "system", "Answer."), (1, 3, "user", "And?")]
    got = conversations.repair_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("place").collect()
    assert [tuple(r)[2:] for r in got] == [("K", "user", "Hi."), ("D", "user", "Hi."), ("R", "assistant", "Answer."), ("K", "user", "And?"), ("I", "assistant", "")]
