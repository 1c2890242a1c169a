"""Passes over the blocks of a document on hand-worked rows."""

from pyspark.sql import functions as F

from ledgerline.operators.blocks import block_fields, title_case

SCHEMA = "doc_id string, block_id int, block_type string, text string, table_index int, row_index int, col_index int"


def fields(spark, *rows):
    blocks = spark.createDataFrame([("d", i + 1, *r) for i, r in enumerate(rows)], SCHEMA)
    return {r.field: (r.value, r.confidence, r.source_block) for r in block_fields(blocks).collect()}


def cell(text, row, col):
    return ("table_cell", text, 0, row, col)


def text(t):
    return ("paragraph", t, None, None, None)


def test_an_earlier_pass_wins(spark):
    rows = [cell("Status", 0, 0), cell("open", 0, 1), ("table_row", "status | closed", 0, 0, None), text("STATUS : void")]
    assert fields(spark, *rows) == {"Status": ("void", 0.95, 4)}
    assert fields(spark, *rows[:3]) == {"Status": ("closed", 0.92, 3)}
    assert fields(spark, *rows[:2]) == {"Status": ("open", 0.93, 2)}


def test_cells_of_other_rows_or_columns_are_no_pair(spark):
    assert fields(spark, cell("Status", 0, 0), cell("open", 1, 1), cell("Claim date", 1, 2), cell("x" * 201, 1, 3), cell("Tax", 2, 0), cell("5", 2, 2)) == {}


def test_patterns_reach_over_blocks_only_without_fields(spark):
    rows = [text("see Loss"), text("Date"), text(":"), text("1 May"), text("Carrier - ACME")]
    assert fields(spark, *rows) == {"Loss Date": ("1 May", 0.8, None), "Carrier": ("ACME", 0.8, None)}
    assert fields(spark, *rows, text("note: x")) == {"Note": ("x", 0.95, 6)}


def test_title_case(spark):
    names = ["o'brien-smith no.2b", "TAX (2nd)", "", "été a_b"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(title_case(F.col("n"))).collect()] == [n.title() for n in names]
