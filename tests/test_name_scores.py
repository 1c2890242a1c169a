"""Likeness of names: against a plain version, with the names' words at hand or not, and cut before names meet."""

import itertools

from pyspark.sql import functions as F

from ledgerline.operators import review as R


def plain(a, b):
    words = lambda k: {w for w in k.split("_") if len(w) > 1 and w not in R.NAME_STOPS}
    short, long, x, y = min(len(a), len(b)), max(len(a), len(b)), words(a), words(b)
    if a == b or long == 0:
        return 1.0 if a == b else 0.0
    if (a in b or b in a) and short >= 0.6 * long:
        return short / long
    shared, least, most = len(x & y), min(len(x), len(y)), max(len(x), len(y))
    if least == 0:
        return 0.0
    if shared == least and (least >= 2 or least / most >= 0.5):
        return 0.6
    return shared / len(x | y) if shared / len(x | y) >= 0.4 else 0.0


def test_name_scores(spark):
    keys = ["", "a", "claim", "claim_number", "number_of_claim", "claimant_name", "name", "date_reported", "reported_date_of_loss", "net_total_incurred_amount", "total_incurred", "paid_total_to", "id_no", "status", "claim_claim_number"]
    df = spark.createDataFrame(list(itertools.product(keys, keys)), "a string, b string")
    df = df.withColumns({"x": R.name_words(F.col("a")), "y": R.name_words(F.col("b"))})
    got = df.select("a", "b", R.name_score(F.col("a"), F.col("b")).alias("s"), R.name_score(F.col("a"), F.col("b"), F.col("x"), F.col("y")).alias("t")).collect()
    assert all(abs(r.s - plain(r.a, r.b)) < 1e-12 and r.s == r.t for r in got)


def test_words_are_cut_before_names_meet(spark):
    e = spark.createDataFrame([(1, "Claim Number", "x1", 1)], "doc_id int, name string, value string, page int")
    o = spark.createDataFrame([(1, "claim-number:", "x1 abc", 1, 0.9, 1)], "doc_id int, name string, value string, page int, confidence double, pos int")
    found = R.ocr_matches(e, o)
    assert [r.ocr_name for r in found.collect()] == ["claim-number:"]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and not any("split(" in line for line in joins)
