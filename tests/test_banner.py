"""Banner passes on hand-worked sheets."""

from ledgerline.operators.banner import banner_fields


def facts(spark, rows, header=None):
    grid = spark.createDataFrame([("s", i + 1, r) for i, r in enumerate(rows)], "sheet string, row_no int, cells array<string>")
    heads = spark.createDataFrame([("s", header)], "sheet string, header_row int")
    return {r.field: r.value for r in banner_fields(grid, heads).collect() if r.field != "Sheet Name"}


def test_a_cell_is_taken_once(spark):
    rows = [["Loss Runs Inc - Detail Listing"], ["Carrier: Alpha Insurance", "Beta LLC"], ["Insured", "Account", "Treaty", "T1"], ["Gamma Holdings"]]
    # Insured takes Account as its value, so that Account is no label; the first line's company is the first of all
    assert facts(spark, rows) == {"TPA Name": "Loss Runs Inc", "Carrier": "Loss Runs Inc", "Insured Name": "Beta LLC", "Treaty": "T1"}


def test_neighbours_reach_three_columns(spark):
    assert facts(spark, [["Desk"], ["Treaty", None, None, "T1"], ["LOB", None, None, None, "Cyber"]]) == {"TPA Name": "Desk", "Treaty": "T1", "Sheet Title": "LOB", "Line of Business": "Cyber"}


def test_rows_of_the_header_on_do_not_count(spark):
    rows = [["Prepared by: Desk"], ["Policy Period", "1/1/2024 to 31.12.2024"], ["Claim No", "Date", "Paid"], ["Treaty", "T1"]]
    assert facts(spark, rows, 3) == {"TPA Name": "Desk", "Policy Period Start": "1/1/2024", "Policy Period End": "31.12.2024"}


def test_odd_sheets(spark):
    assert facts(spark, [[None, " "], [], ["(see overleaf)"], ["12.5"], ["Treaty:"]]) == {"Sheet Title": "(see overleaf)"}
    empty = spark.createDataFrame([], "sheet string, row_no int, cells array<string>")
    assert banner_fields(empty).collect() == []
