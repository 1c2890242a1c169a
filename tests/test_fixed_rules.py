"""Cases that once failed or gave wrong rows."""

from pyspark.sql import functions as F

from ledgerline.operators import documents, export, grid, layout, mapping, records, signals, snapshots

REGION = "sheet string, type string, row_start int, col_start int, value string"


def regions(spark, *values):
    rows = [("s", "TITLE", i + 1, 1, v) for i, v in enumerate(values)]
    return {r.field: r.value for r in grid.merged_fields(spark.createDataFrame(rows, REGION)).collect()}


def test_dotted_periods(spark):
    assert regions(spark, "Period: 1.2.2024 to 31.12.2024") == {"Policy Period Start": "1.2.2024", "Policy Period End": "31.12.2024"}


def test_companies_without_a_label(spark):
    assert regions(spark, "Print Excess Ins. Co", "AR LLC", "Third Corp", "Umbrella", "(see Other Inc)") == {"Carrier": "Print Excess Ins. Co", "Insured Name": "AR LLC", "Insured Name [R3C1]": "Third Corp", "Line of Business": "Umbrella", "Title [R5C1]": "(see Other Inc)"}
    # a company takes the insured's place, so that the label after it tells nothing new
    assert regions(spark, "Carrier: Alpha", "AR LLC", "Insured: Beta", "Carrier: Gamma") == {"Carrier": "Alpha", "Carrier Name": "Alpha", "Insured Name": "AR LLC", "Insured": "Beta"}


def test_a_field_twice_in_a_record(spark):
    rows = [("s", 1, "C", 1, "Status", "open", None), ("s", 1, "C", 2, "Paid", "5", None), ("s", 1, "C", 3, "Status", "closed", None)]
    f = spark.createDataFrame(rows, "sheet string, rec int, claim_id string, pos int, field string, value string, original string")
    assert export.record_maps(f).head().fields == {"Paid": "5", "Status": "closed"}
    assert '"Status":{"value":"closed"' in export.transaction_documents(f).head().document
    assert snapshots.snapshots(f, F.col("rec")).head().fields == {"Paid": "5", "Status": "closed"}


def test_column_letters(spark):
    at = {0: "A", 25: "Z", 26: "AA", 701: "ZZ", 702: "AAA", 16383: "XFD"}
    got = spark.createDataFrame([(p,) for p in at], "p int").select("p", layout.column_letter(F.col("p")).alias("x")).collect()
    assert {r.p: r.x for r in got} == at


def test_texts_of_a_repeated_document(spark):
    docs = spark.createDataFrame([(1, "fire at 1/2/2024"), (1, "fire at 1/2/2024"), (2, None)], "doc_id int, text string")
    e = spark.createDataFrame([(1, "Loss Date", "1/2/2024", 0.9), (2, "Peril", "fire", 0.9)], "doc_id int, name string, value string, confidence double")
    assert documents.grounded(e, docs).filter("doc_id = 1").count() == 1
    assert layout.verbatim_dates(e, docs).filter("doc_id = 1").count() == 1
    s = spark.createDataFrame([(1, "legal_escalation", "damages", "d", "s", 0.9, "Low")], "doc_id int, type string, keyword string, description string, snippet string, confidence double, severity string")
    assert layout.grounded_signals(s, docs, {}).count() == 1 and signals.reclassify(s, docs).count() == 1


def test_documents_without_text(spark):
    docs = spark.createDataFrame([(1, None), (2, " \n"), (3, "invoice invoice total")], "doc_id int, text string")
    got = documents.classify(documents.dictionary_scores(docs, {"Bill": ("invoice", "total")}), least=2, lead=1, empty=documents.without_text(docs)).collect()
    assert {r.doc_id: (r.classification, r.confidence, r.source, r.route) for r in got if r.doc_id < 3} == {k: ("Legal", 0.0, "fallback", "manual_review") for k in (1, 2)}


def test_rows_of_large_sums(spark):
    rows = [["x", "60000", "70000.5", "80000"], ["AB-C123", "60000", "70000", "80000"], ["12345", "60000", "70000", "80000"], ["x", "60000", "70000"], ["x", "60000", "70000", "10"]]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, cells array<string>").filter(grid.is_aggregate(F.col("cells"))).collect()
    assert [r.i for r in got] == [0]


def test_embedding_match_without_and_with_many_candidates(spark):
    h = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 0.0])], "header string, vector array<double>")
    none = spark.createDataFrame([], "candidate string, ord int, vector array<double>")
    assert sorted(map(tuple, mapping.embedding_match(h, none).collect())) == [("a", None, None), ("b", None, None)]
    many = spark.range(3000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("candidate"), F.col("id").alias("ord"), F.array(F.cos(F.col("id") % 100), F.sin(F.col("id") % 100)).alias("vector"))
    assert sorted(map(tuple, mapping.embedding_match(h, many, block=700).collect())) == [("a", "c0", 1.0), ("b", None, 0.0)]


def test_layers_of_many_signals(spark):
    words = [f"word number {i} of a long list of signals" for i in range(60)]
    s = spark.range(40_000).select(F.lit(1).alias("doc_id"), F.when(F.col("id") < 10, "model").otherwise("keyword").alias("layer"), F.col("id").alias("ord"), F.lit("T").alias("type"), F.concat(F.element_at(F.array(*map(F.lit, words)), (F.col("id") % 60 + 1).cast("int")), F.when(F.col("id") % 2 == 0, " x").otherwise(" y")).alias("keyword"))
    # ten of the model, whose beginnings ("word numbe") cover every keyword
    assert signals.merge_layers(s).count() == 10


def test_edits_at_one_time(spark):
    f = spark.createDataFrame([(1, "a", "x")], "rec int, field string, value string")
    e = spark.createDataFrame([(1, "a", "edit", "p", 5), (1, "a", "edit", "q", 5)], "rec int, field string, kind string, new_value string, edited_at int")
    assert records.overlay_edits(f, e).head().value == "q"
