"""Rules on small tables with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators import documents, grid, mapping, records, signals, snapshots, stores


def each(spark, values, f):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.w for r in df.select("i", f(F.col("v")).alias("w")).orderBy("i").collect()]


def test_dates(spark):
    values = ["2024-01-02", "1/2/2024", "13/2/2024", "1-2-24", "3/4/75", "March 5, 2020", "5 Mar 2020", "2024/1/9", "soon", "", None]
    d = datetime.date
    assert each(spark, values, S.parse_date) == [d(2024, 1, 2), d(2024, 1, 2), d(2024, 2, 13), d(2024, 1, 2), d(1975, 3, 4), d(2020, 3, 5), d(2020, 3, 5), d(2024, 1, 9), None, None, None]
    assert each(spark, ["1.2.2024", "12/31/2024"], S.parse_order_date) == [d(2024, 2, 1), d(2024, 12, 31)]


def test_amounts_statuses_names(spark):
    assert each(spark, ["$1,234.5", "($20)", "12d", "", "-3", None], S.schema_amount) == ["1234.50", "-20.00", "12d", "", "-3.00", None]
    assert each(spark, [" Active ", "FILED", "other", "re-opened"], lambda v: S.schema_status(v, ("Open", "Closed", "Reopen"))) == ["Open", "FILED", "other", "Reopen"]
    assert each(spark, ["acme  LLC of jane DOE", " ", "n/a"], S.schema_name) == ["Acme LLC Of Jane Doe", " ", "N/A"]
    assert each(spark, ["tx", "New York", "Ontario", ""], S.schema_state) == ["TX", "NY", "Ontario", ""]
    assert each(spark, ["Y", "0", "maybe"], S.schema_boolean) == ["true", "false", "maybe"]


def test_standardising_twice_changes_nothing(spark):
    values = ["$1,000", "(5)", "x"]
    once = each(spark, values, S.schema_amount)
    assert each(spark, once, S.schema_amount) == once


def test_field_kinds_and_amount_columns(spark):
    names = ["Loss Date", "Total Incurred", "Claim Status", "Claimant", "State", "At Fault", "Notes"]
    assert each(spark, names, S.field_kind) == ["date", "amount", "status", "name", "state", "boolean", "text"]
    columns = ["LOSS PAID TO DATE", "Loss Date", "Claim Number", "Reserve_2", "Policy Number", "Total", "Legal"]
    assert each(spark, columns, S.is_financial) == [True, False, False, True, False, True, True]


def test_masking(spark):
    assert each(spark, ["secret", "ab", ""], S.masked) == ["****et", "**", ""]


def test_upsert_twice_is_upsert_once(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (2, "d"), (3, "e")], "k int, v string")
    once = stores.upsert(old, new, ["k"], [F.desc("v")])
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "d"), (3, "e")]
    assert sorted(map(tuple, stores.upsert(once, new, ["k"], [F.desc("v")]).collect())) == sorted(map(tuple, once.collect()))


def test_versions_and_appends(spark, tmp_path):
    df = spark.createDataFrame([(1,)], "k int")
    path = stores.write_version(df, str(tmp_path / "t"), 1)
    assert spark.read.parquet(path).count() == 1
    stores.append(df, str(tmp_path / "log"))
    stores.append(df, str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    with pytest.raises(ValueError):
        stores.filtered(df, "true", limit=1)


def test_sheet_hash_ignores_row_order(spark):
    rows = [("s", "b"), ("s", "a"), ("s", ""), ("s", " a")]
    hashes = {stores.sheet_hash(spark.createDataFrame(r, "sheet string, v string"), "sheet", "v").head().sheet_hash for r in (rows, rows[::-1])}
    assert len(hashes) == 1


def test_diff_of_equal_snapshots_is_empty(spark):
    f = spark.createDataFrame([("c", 1, "A", "x"), ("c", 1, "B", " "), ("c", 1, "D", "y")], "claim_id string, rec int, field string, value string")
    snap = snapshots.snapshots(f, F.col("rec")).withColumn("filename", F.lit("f"))
    assert snap.head().fields == {"A": "x", "D": "y"}
    same = snapshots.check_reingest(snap.drop("filename"), snap).head()
    assert (same.duplicate, same.changed, same.unchanged, same.changes) == (True, 0, 2, [])


def test_greedy_mapping_gives_each_column_once(spark):
    columns = spark.createDataFrame([("s", "Paid", 1), ("s", "Total Paid", 2), ("s", "Net Paid", 3)], "colset string, header string, pos int")
    aliases = spark.createDataFrame([("Total Paid", "paid"), ("Net Paid", "paid")], "field string, alias string")
    scores = mapping.header_scores(columns.select("header"), aliases)
    got = {r.field: (r.header, r.score) for r in mapping.greedy_mapping(columns, scores, ("Total Paid", "Net Paid")).collect()}
    assert got == {"Total Paid": ("Paid", 1.0), "Net Paid": ("Net Paid", 1.0)}


def test_standard_names(spark):
    headers = spark.createDataFrame([("DateOfLoss_x",), ("loss date",), ("foo",)], "header string")
    phrases = spark.createDataFrame([("date of loss", "Loss Date"), ("loss date", "Loss Date"), ("loss", "Loss")], "phrase string, standard string")
    got = {r.header: (r.standard, r.score) for r in mapping.standard_names(headers, phrases).collect()}
    assert got == {"DateOfLoss_x": ("Loss Date", 30), "loss date": ("Loss Date", 20)}


def test_model_call_keeps_failures(spark):
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")

    def fails(b):
        raise RuntimeError("down")

    got = mapping.call_model(rows, "k", fails, "label string", wait=0).collect()
    assert sorted((r.k, r.label, r.error) for r in got) == [("a", None, "down"), ("b", None, "down")]
    good = mapping.call_model(rows, "k", lambda b: b.assign(label=b.k + "!"), "label string").collect()
    assert sorted((r.k, r.label, r.error) for r in good) == [("a", "a!", None), ("b", "b!", None)]


def test_csv_grid(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿Claim No,Paid,Loss Date\r\n"C,1",5,"x\ny"\nshort\n'.encode())
    got = [(r.row_no, r.cells) for r in grid.read_csv_grid(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert got == [(1, ["Claim No", "Paid", "Loss Date"]), (2, ["C,1", "5", "x\ny"]), (3, ["short"])]


def test_upload_verdicts(spark):
    files = spark.createDataFrame([(".pdf", 4, bytearray(b"%PDF")), (".PDF", 4, bytearray(b"PK\x03\x04")), (".csv", 0, bytearray()), (".txt", 26 << 20, bytearray(b"x"))], "ext string, length long, content binary")
    assert [r.reason for r in grid.upload_verdict(files).collect()] == [None, "content does not match the extension", "empty", "too large"]


def test_decoding(spark):
    df = spark.createDataFrame([(1, bytearray("é\r\nb\rc".encode())), (2, bytearray("é".encode("latin-1")))], "i int, content binary")
    assert [r.t for r in df.select("i", documents.decoded(F.col("content")).alias("t")).orderBy("i").collect()] == ["é\nb\nc", "é"]


def test_html(spark):
    html = '<p>A&nbsp;&amp; b</p><SCRIPT x="1">no\n</SCRIPT><br/>c<style>z</style>  d'
    assert each(spark, [html], documents.html_text) == ["A & b\n \nc d"]


def test_label_lines(spark):
    df = spark.createDataFrame([(1, "Claim No: C-1\nStatus = open\nclaim_no: other\nPaid    55\nno label here")], "doc_id int, text string")
    got = sorted((r.label, r.value, r.confidence) for r in documents.label_lines(df).collect())
    assert got == [("Claim No", "C-1", 0.9), ("Paid", "55", 0.75), ("Status", "open", 0.85)]


def test_date_order_penalties(spark):
    d = datetime.date
    df = spark.createDataFrame([(1, d(2024, 3, 1), d(2024, 2, 1), d(2024, 1, 1), 90, 35, 5), (2, None, d(2024, 2, 1), None, 90, 90, 90)], "rec int, loss date, reported date, closed date, loss_confidence int, reported_confidence int, closed_confidence int")
    got = [tuple(r)[4:] for r in records.date_order_conflicts(df).orderBy("rec").collect()]
    assert got == [(30, 10, 10), (90, 90, 90)]


def test_keyword_signals_leave_out_negated_ones_and_cut_keywords_like_texts(spark):
    from ledgerline.operators.documents import keyword_signals

    words = ["fracture", "injury", "injured", "pre-litigation", "pre-existing condition", "follow-up required", "non-renewing", "extra-contractual", "Loss of the entire estate"]
    dictionary = spark.createDataFrame([(w, "t", "High") for w in words], "keyword string, type string, severity string")
    far = "word, " * 40 + "unbroken" * 30 + " "
    made = [
        "There is no fracture.", "She denies injury.", "He was not injured", "A fracture was found.", "In pre-litigation: a pre-existing condition, follow-up required",
        "non-renewing and extra-contractual", "loss of the entire estate", "x" * 900 + " fracture", far + "fracture " + "y" * 400, "I am fine, no pain. Injury is old.",
    ]
    got = keyword_signals(spark.createDataFrame(list(enumerate(made)), "doc_id long, text string"), dictionary).collect()
    kinds = {i: {r.keyword for r in got if r.doc_id == i} for i in range(len(made))}
    assert kinds == {0: set(), 1: set(), 2: set(), 3: {words[0]}, 4: set(words[3:6]), 5: set(words[6:8]), 6: {words[8]}, 7: {words[0]}, 8: {words[0]}, 9: set()}
    snippets = {r.doc_id: r.snippet for r in got}
    assert len(snippets[7]) == 798 and snippets[7].endswith("…")
    assert snippets[8].startswith("unbroken" * 30 + " fracture")


def test_ids_and_values_by_similar_names(spark):
    rows = [
        ("s", 1, 1, "Number of the Claim", "77-A"), ("s", 1, 2, "Other", "AB-1234"), ("s", 2, 1, "Number of the Claim", "7"), ("s", 2, 2, "Other", "AB-1234"),
        ("s", 3, 1, "Number of the Claim", "88"), ("s", 3, 2, "Claim No", "99"), ("s", 4, 1, "Amount for Paid", "5"), ("s", 4, 2, "Status", "open"),
    ]
    fields = spark.createDataFrame(rows, "sheet string, rec int, pos int, field string, value string")
    ids = {r.rec: (r.claim_id, r.stage) for r in signals.claim_ids(fields).collect()}
    assert ids == {1: ("77-A", 1), 2: ("AB-1234", 2), 3: ("99", 1), 4: ("5", 3)}
    found = {r.rec: r.value for r in signals.lookup_value(fields, ("paid amount", "claim number")).collect()}
    assert found == {1: "77-A", 2: "7", 3: "88", 4: "5"}


def test_greedy_mapping_asks_the_outside_map_last(spark):
    columns = spark.createDataFrame([("c", "Paid", 1), ("c", "Other", 2), ("c", "More", 3)], "colset string, header string, pos int")
    scores = spark.createDataFrame([("Paid", "Total Paid", 0.9), ("Other", "Net Paid", 0.5)], "header string, field string, score double")
    outside = spark.createDataFrame([("More", "Net Paid"), ("Other", "Net Paid"), ("Other", "Total Paid"), ("Gone", "Tax")], "header string, field string")
    got = {(r.field, r.header, r.score, r.source) for r in mapping.greedy_mapping(columns, scores, ("Total Paid", "Net Paid", "Tax"), outside=outside).collect()}
    assert got == {("Total Paid", "Paid", 0.9, "header"), ("Net Paid", "Other", 0.75, "outside")}


def test_mapped_records_fill_from_the_title(spark):
    values = spark.createDataFrame([("c", 1, "Paid", "$5"), ("c", 2, "Paid", "five"), ("c", 2, "Free", "x")], "sheet string, rec int, header string, value string")
    mapped = spark.createDataFrame([("c", "Total Paid", "Paid", 1.0, "header")], "colset string, field string, header string, score double, source string")
    titles = spark.createDataFrame([("c", "Total Paid", "$9", 1), ("c", "Tax Paid", "$7", 2), ("c", "Unknown", "u", 3), ("d", "Tax Paid", "$1", 1)], "sheet string, field string, value string, row_no int")
    got = {(r.rec, r.field, r.header, r.value, r.header_score, r.value_score, r.confidence, r.source) for r in mapping.mapped_records(values, mapped, titles, ("Total Paid", "Tax Paid")).collect()}
    title = ("Tax Paid", "[title row 2]", "$7", 100, 100, 95, "title")
    assert got == {(1, "Total Paid", "Paid", "$5", 100, 100, 100, "header"), (2, "Total Paid", "Paid", "five", 100, 30, 58, "header"), (1, *title), (2, *title)}
