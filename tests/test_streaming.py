from pathlib import Path

from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ledgerline.operators import lineage, mapping, snapshots
from ledgerline.operators.keyed_store import KeyedTable
from ledgerline.streaming.ingest import lifecycle_stream, upsert_stream

SCHEMA = "k int, v string"


def table(spark, path, buckets=8):
    return KeyedTable(spark, str(path), StructType.fromDDL(SCHEMA), ["k"], buckets)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_upsert_stream(spark, tmp_path):
    inbox, t = str(tmp_path / "inbox"), table(spark, tmp_path / "t")
    start = lambda: upsert_stream(spark.readStream.schema(SCHEMA).parquet(inbox), t, [F.desc("v")], str(tmp_path / "c"))
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], SCHEMA).write.mode("append").parquet(inbox)
    start().awaitTermination(120)
    spark.createDataFrame([(2, "x"), (3, "d")], SCHEMA).write.mode("append").parquet(inbox)
    start().awaitTermination(120)
    assert rows(t.read()) == [(1, "b"), (2, "x"), (3, "d")]


def test_a_commit_rewrites_the_touched_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path, 32)
    first = t.upsert(spark.range(2000).select(F.col("id").cast("int").alias("k"), F.repeat(F.lit("x"), F.lit(50)).alias("v")), [F.col("v")])
    before = {r.bucket: r.folder for r in t._commit(first)}
    second = t.upsert(spark.createDataFrame([(5, "new"), (5, "newer"), (9999, "more")], SCHEMA), [F.desc("v")])
    after = {r.bucket: r.folder for r in t._commit(second)}
    assert len(before) == 32 and 1 <= sum(before[b] != after[b] for b in before) <= 2
    assert t.read().count() == 2001 and rows(t.read().filter("k IN (5, 9999)")) == [(5, "newer"), (9999, "more")]
    # a reader of the first version sees it whole
    assert t.read(first).count() == 2000 and rows(t.read(first).filter("k = 5"))[0][1] != "newer"
    t.delete(spark.createDataFrame([(5,), (7,), (-1,)], "k int"))
    assert t.read().count() == 1999 and t.versions() == [1, 2, 3]
    assert t.expire(1) > 0 and t.versions() == [3] and t.read().count() == 1999
    assert len(list(Path(tmp_path).glob("data/*/*/*.parquet"))) == len({r.folder for r in t._commit(3) if r.folder})


def test_the_same_token_counts_once(spark, tmp_path):
    t = table(spark, tmp_path)
    one = spark.createDataFrame([(1, "a")], SCHEMA)
    assert t.read().collect() == [] and t.upsert(one, [F.col("v")], "run") == 1
    assert t.upsert(spark.createDataFrame([(1, "b")], SCHEMA), [F.col("v")], "run") == 1
    assert rows(t.read()) == [(1, "a")] and t.upsert(one.limit(0), [F.col("v")], "none") == 2 and rows(t.read()) == [(1, "a")]


LOG = "document_id string, event_id int, at timestamp, status string, filename string, parser_used string, confidence_score double, user string, tags array<string>"


def test_lifecycle_stream_equals_batch(spark, tmp_path):
    """Events that come late, out of order and twice, over three batches of a stream."""
    from datetime import datetime

    event = lambda doc, i, day, status, tags, user=None: (doc, i, datetime(2024, 1, day), status, f"{doc}.pdf", "ocr", 0.5, user, tags)
    batches = [[event("a", 3, 5, "exported", ["x"]), event("b", 9, 1, "ingested", None)], [event("a", 1, 1, "ingested", ["z", "x"], "ann")], [event("a", 2, 3, "parsed", []), event("a", 3, 5, "exported", ["x"])]]
    inbox = str(tmp_path / "inbox")
    every = [e for b in batches for e in b]
    states = lineage.lifecycle_states(spark.createDataFrame(every, LOG))
    t = KeyedTable(spark, str(tmp_path / "t"), states.schema, ["document_id"], 4)
    for b in batches:
        spark.createDataFrame(b, LOG).coalesce(1).write.mode("append").parquet(inbox)
        lifecycle_stream(spark.readStream.schema(LOG).parquet(inbox), t, str(tmp_path / "c")).awaitTermination(120)
    got = {r.document_id: r for r in lineage.lifecycle_records(t.read()).collect()}
    assert got == {r.document_id: r for r in lineage.lifecycle_records(states).collect()}
    a = got["a"]
    assert (a.version, a.status, a.user, a.tags) == (3, "exported", "unknown", ["x", "z"]) and [h.status for h in a.status_history] == ["ingested", "parsed", "exported"]
    assert got["b"].tags == [] and a.created_at == datetime(2024, 1, 1) and a.updated_at == datetime(2024, 1, 5)


def test_columns_are_remembered_once_a_run(spark, tmp_path):
    memory = KeyedTable(spark, str(tmp_path), StructType.fromDDL(mapping.MEMORY), ["mapping_key"], 4)
    columns = spark.createDataFrame([("Paid Amt", [1.0, 0.0]), ("Odd", [0.0, 1.0]), ("Lost", [-1.0, -1.0])], "header string, vector array<double>")
    candidates = spark.createDataFrame([("Total Paid", 0, [0.9, 0.1])], "candidate string, ord int, vector array<double>")
    outside = spark.createDataFrame([("Odd", "Status"), ("Paid Amt", "wrong")], "header string, field string")
    ask = lambda run: {r.header: (r.field, r.method) for r in mapping.resolve_columns(memory, columns, "g", candidates, outside, run).collect()}
    first = {"Paid Amt": ("Total Paid", "semantic"), "Odd": ("Status", "external")}
    assert ask("1") == first and ask("1") == first and memory.versions() == [1]
    assert ask("2") == {"Paid Amt": ("Total Paid", "memory"), "Odd": ("Status", "memory")}
    assert {(r.source_column_raw, r.hit_count) for r in memory.read().collect()} == {("Paid Amt", 1), ("Odd", 1)}
    # what a user corrected is not overwritten
    memory.upsert(memory.read().filter("source_column_raw = 'Odd'").withColumn("resolved_field", F.lit("State")).withColumn("user_corrected", F.lit(True)), [F.col("mapping_key")])
    entries = spark.createDataFrame([("Odd", "Status", "external", 75.0)], "source_column string, resolved_field string, method string, confidence double")
    assert snapshots.remembered_rows(memory.read(), entries, "g").collect() == []
