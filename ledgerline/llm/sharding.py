"""Rendezvous hashing of record keys over weighted shards.

A record goes to the shard with the largest ``-weight / ln(u)``, where ``u`` in (0, 1) comes from a
hash of the key and the shard's number. Only key, shard and weight count, so adding a shard moves
only the records that the new shard wins. A null key hashes as the empty string. Rows are kept as
they are: repeated rows each get a slot; they are counted first, so that any number of them is one row until then.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.llm.workspace import sized, unused

#: Rows that one task numbers at most, about; the slots' groups are made from it.
ROWS_A_GROUP = 1_000_000


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """Number of the shard that wins ``key``."""
    name = F.coalesce(key.cast("string"), F.lit(""))
    u = lambda i: (F.shiftrightunsigned(F.xxhash64(name, F.lit(i)), 11).cast("double") + 0.5) / float(1 << 53)
    scores = [F.struct((-F.lit(float(w)) / F.ln(u(i))).alias("score"), F.lit(-i).alias("i")) for i, w in enumerate(weights)]
    return (-(F.greatest(*scores) if len(scores) > 1 else scores[0])["i"]).cast("int")


def shard_records(df: DataFrame, key_col: str, weights: Sequence[float], out_col: str = "shard") -> DataFrame:
    """``df`` with each row's shard (a column of that name is replaced); no shuffle."""
    return df.withColumn(out_col, rendezvous_shard(F.col(key_col), weights))


def number_slots(df: DataFrame, shard_col: str, order: Sequence[str], rows_a_group: int = ROWS_A_GROUP) -> DataFrame:
    """``df`` with ``slot`` (a column of that name is replaced): 0, 1, ... in each shard, without a shard's rows ever meeting in one task.

    Equal rows are counted before they are dealt, and get their slots from the count. Each shard is dealt into hash groups of at
    most about ``rows_a_group`` distinct rows; a group's slots start where the groups before it end. The group sizes (shards x
    groups numbers) are broadcast if they are few and joined by a shuffle else. All columns must be such that rows can be grouped
    by them.
    """
    groups = max(8, -(-df.count() // rows_a_group))
    copies, group, start, ahead, same, other = unused(df, "__copies", "__group", "__start", "__ahead", "__shard", "__g")
    distinct = df.groupBy(*(c for c in df.columns if c != "slot")).agg(F.count(F.lit(1)).alias(copies))
    dealt = distinct.withColumn(group, F.pmod(F.xxhash64(*order), F.lit(groups)).cast("int"))
    sizes = dealt.groupBy(shard_col, group).agg(F.sum(copies).alias("n"))
    before = Window.partitionBy(shard_col).orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(F.col(shard_col).alias(same), F.col(group).alias(other), F.coalesce(F.sum("n").over(before), F.lit(0)).alias(start))
    own = Window.partitionBy(shard_col, group).orderBy(*order, *(c for c in distinct.columns if c not in (*order, copies))).rowsBetween(Window.unboundedPreceding, -1)
    numbered = dealt.withColumn(ahead, F.coalesce(F.sum(copies).over(own), F.lit(0)))
    joined = numbered.join(sized(starts), (F.col(shard_col) == F.col(same)) & (F.col(group) == F.col(other)))
    first = F.col(start) + F.col(ahead)
    return joined.withColumn("slot", F.explode(F.sequence(first, first + F.col(copies) - 1))).withColumn("slot", F.col("slot").cast("long")).drop(copies, group, start, ahead, same, other)


def shard_documents(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None) -> DataFrame:
    """Each document's size, checksum, shard, slot and the shard it would have with one shard more."""
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous_shard(F.col("doc_id"), weights).alias("shard"),
        rendezvous_shard(F.col("doc_id"), [*weights, sum(weights) / len(weights)]).alias("grown_shard"),
    )
    return number_slots(placed, "shard", ["doc_id", "text_crc32", "size"])
