"""Dates of the document rules: days that the calendar has, read without failed parses."""

import datetime

from pyspark.sql import functions as F

from ledgerline.operators.rules import rule_date


def test_rule_dates_by_calendar(spark):
    d = datetime.date
    want = {
        "2024-2-29": d(2024, 2, 29), "2023-02-29": None, "1900-2-29": None, "2000-02-29": d(2000, 2, 29), "2024-13-01": None, "2024-00-10": None, "2024-4-31": None, "2024-4-30": d(2024, 4, 30), "2024-1-0": None,
        "1/2/2024": d(2024, 1, 2), "13/2/2024": d(2024, 2, 13), "31/4/2024": None, "12/31/1999": d(1999, 12, 31), "0/1/2024": None, "Sept. 25th, 1997": d(1997, 9, 25), "MARCH 5 1960 noon": d(1960, 3, 5), "Feb. 30, 1990": None,
        "foo 3, 1990": None, "Dec 31st 0001": d(1, 12, 31), " \t2024-01-02\n": d(2024, 1, 2), "": None, "soon": None, "2024-01-02x": None, "1/2/24": None, None: None,
    }
    df = spark.createDataFrame([(v,) for v in want], "v string").select("v", rule_date(F.col("v")).alias("d"))
    assert {r.v: r.d for r in df.collect()} == want
    assert "gettimestamp" not in df._jdf.queryExecution().optimizedPlan().toString().lower()
