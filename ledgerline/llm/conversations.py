"""Repair of damaged conversations by the cheapest edits.

A conversation's roles must read ``(s?(ua)+)?`` by their initials: an optional system turn, then user and assistant in turn.
Edits: Keep (0), Rerole to user or assistant (2), Delete (3; blank and duplicate turns must go), Insert an empty turn (2);
a truncated turn that stays costs 1 more. Of the cheapest edits those with the ASCII-least initials win.

Everything of a conversation passes one task as a sorted stream, twice: first one byte a turn (role and fault), then the
texts, which are hashed or handed on as they come; they are never gathered. Over the bytes runs a dynamic program that
keeps the cost vectors of the four grammar states only at every sqrt(n)-th turn, and makes those between again while it
walks forward. So a conversation of n turns needs 2 n bytes besides its checkpoints. Rows of one conversation in one
task is what the digest asks for: a SHA-256 is sequential.

Nulls: in role and text one space each; a null turn sorts first and counts for no gap; rows with a null conv_id are one
conversation. Turns of equal number go by role, then text. Repeated rows are turns of their own (duplicates). An empty
table gives no rows. Only the four columns are read, whatever other columns are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain, groupby
from math import isqrt
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workspace import bounded_batches

#: States of the grammar: nothing yet, after system, after user, after assistant; where a user or assistant turn leads to.
_NEXT = (2, 2, 3, 2)
_END = (0, 1 << 60, 1 << 60, 0)
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
#: Faults of a turn.
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
_INITIALS = bytes(b"suax"[code % 4] for code in range(256))
_LEGAL = {b"su", b"ua", b"au"}
_WHITE = " \t\n\x0b\x0c\r"
Vector = tuple[int, int, int, int]


def _close(v: Vector) -> Vector:
    """Costs with inserted turns allowed."""
    user, assistant = min(v[2], INSERT + v[3]), min(v[3], INSERT + v[2])
    return min(v[0], INSERT + user), min(v[1], INSERT + user), user, assistant


def _kept(code: int, state: int) -> int | None:
    """The state behind a turn that stays with its role."""
    initial = code % 4
    if initial == 0:
        return 1 if state == 0 else None
    return _NEXT[state] if initial + 1 == _NEXT[state] else None


def _before(code: int, after: Vector) -> Vector:
    """Least cost to the end from before a turn, for each state, from those behind it."""
    fault, out = code // 4, []
    for state in range(4):
        cost = DELETE + after[state]
        if fault in (NONE, TRUNCATED):
            cut = CUT * (fault == TRUNCATED)
            cost = min(cost, REROLE + cut + after[_NEXT[state]])
            if (kept := _kept(code, state)) is not None:
                cost = min(cost, cut + after[kept])
        out.append(cost)
    return _close(tuple(out))


def cheapest_edits(codes: bytes) -> tuple[int, str]:
    """Cost and initials of the ASCII-least of the cheapest edits; ``codes``: role (s, u, a, other) + 4 * fault of each turn."""
    n = len(codes)
    step = isqrt(n) + 1
    checkpoints, v = {n: _close(_END)}, _close(_END)
    for i in range(n - 1, -1, -1):
        v = _before(codes[i], v)
        if i % step == 0:
            checkpoints[i] = v
    cost, out, state = v[0], bytearray(), 0
    for start in range(0, n + 1, step):
        end = min(start + step, n)
        block = [checkpoints[end]]
        for i in range(end - 1, start - 1, -1):
            block.append(_before(codes[i], block[-1]))
        block.reverse()
        i = start
        while True:
            here = block[i - start]
            left = here[state]
            behind = block[i - start + 1] if i < end else None
            if behind is not None and DELETE + behind[state] == left:
                out += b"D"
                i += 1
            elif INSERT + here[_NEXT[state]] == left:
                out += b"I"
                state = _NEXT[state]
            elif behind is None:
                break
            else:
                cut = CUT * (codes[i] // 4 == TRUNCATED)
                kept = _kept(codes[i], state)
                if kept is not None and cut + behind[kept] == left:
                    out += b"K"
                    state = kept
                else:
                    out += b"R"
                    state = _NEXT[state]
                i += 1
            if i == end < n:
                break
    return cost, out.decode()


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies): each turn's damage by the checksum of ``conv_id:turn``; 0 copies: it is dropped."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("copies"),
    )


def _stream(turns: DataFrame) -> DataFrame:
    """One exchange: each conversation's rows in order, all turns' codes (part 1) before all texts (part 2); part 0 tells that it exists."""
    copies = F.col("copies").cast("int") if "copies" in turns.columns else F.lit(1)
    parts = F.when(copies > 0, F.flatten(F.array(*(F.array_repeat(F.lit(p), copies) for p in (1, 2))))).otherwise(F.array(F.lit(0)))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), F.explode(parts).alias("part"))
    again = F.row_number().over(Window.partitionBy("conv_id", "part", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    body = F.rtrim("text", F.lit(_WHITE))
    fault = F.when(body == "", BLANK).when(F.col("again") > 1, DUPLICATE).when(~F.substring(body, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(NONE)
    initial = F.substring("role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    order = ("conv_id", "part", F.col("turn").asc_nulls_first(), "role", "text", "again")
    sorted_ = rows.repartition("conv_id").withColumn("again", again).sortWithinPartitions(*order)
    texts = F.col("part") == 2
    return sorted_.select("conv_id", "part", "turn", F.when(F.col("part") == 1, role + 4 * fault).alias("code"), F.when(texts, F.col("role")).alias("role"), F.when(texts, F.col("text")).alias("text"))


def _edits(audit: str, texts: Iterator[tuple]) -> Iterator[tuple[str, str, str]]:
    last = ""
    for edit in audit:
        role, text = "assistant" if last == "u" else "user", ""
        if edit != "I":
            *_, own, text = next(texts)
            if edit != "R":
                role = own
        if edit != "D":
            last = role[:1]
        yield edit, role, text


def _repairs(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, codes, gaps, cost, audit, edits) of each conversation; ``edits`` reads on in the stream."""
    rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
    for conv, own in groupby(rows, key=itemgetter(0)):
        codes, turns, first, last, texts = bytearray(), 0, None, None, iter(())
        for row in own:
            if row[1] == 2:
                texts = chain((row,), own)
                break
            if row[1] == 1:
                codes.append(row[3])
                if row[2] is not None:
                    first = row[2] if first is None else first
                    turns += row[2] != last
                    last = row[2]
        cost, audit = cheapest_edits(bytes(codes))
        yield conv, bytes(codes), 0 if last is None else last - first + 1 - turns, cost, audit, _edits(audit, texts)


def _report(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for conv, codes, gaps, cost, audit, edits in _repairs(batches):
        digest, between = hashlib.sha256(), b""
        for edit, role, text in edits:
            if edit != "D":
                digest.update(between + f"{role}:{text}".encode())
                between = b"\n"
        faults, initials = [c // 4 for c in codes], codes.translate(_INITIALS)
        illegal = sum(initials[i : i + 2] not in _LEGAL for i in range(len(initials) - 1))
        out.append((conv, gaps, *(faults.count(x) for x in (BLANK, DUPLICATE, TRUNCATED)), illegal, cost, audit, digest.hexdigest()))
        if len(out) == 1000:
            yield flush()
            out.clear()
    if out:
        yield flush()


def _turns(batches: Iterable[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    held = 0
    flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
    for conv, *_, edits in _repairs(batches):
        for place, row in enumerate(edits):
            out.append((conv, place, *row))
            held += len(row[2])
            if len(out) == 1000 or held > 1 << 20:
                yield flush()
                out.clear()
                held = 0
    if out:
        yield flush()


def _streamed(turns: DataFrame, run, columns: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType, _parse_datatype_string

    conv = next(f for f in turns.schema if f.name == "conv_id")
    schema = StructType([conv, *_parse_datatype_string(columns).fields])
    arrow = to_arrow_schema(schema)
    return bounded_batches(_stream(turns)).mapInArrow(lambda batches: run(batches, arrow), schema)


def repair_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): every edit of every conversation in order; deleted turns (D) have their old role and text."""
    return _streamed(turns, _turns, "place long, edit string, role string, text string")


def repair_report(turns: DataFrame) -> DataFrame:
    """A row for each conv_id: gaps of its turn numbers, faults, illegal neighbours, cost, edits and the digest of the repaired turns.

    ``turns``: conv_id, turn, role, text, and maybe copies (0: the turn is gone, but its conversation still counts).
    """
    return _streamed(turns, _report, "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")
