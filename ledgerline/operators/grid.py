"""Raw grids (sheet, row_no from 1, cells) to records: sheet kind, header row, row filters, records, label pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values.
CLAIM_WORDS = ("claim", "employee name", "driver name", "claimant", "file")
MEASURE_WORDS = ("date", "incurred", "paid", "injury", "incident", "amount", "reserve")
CHECK_WORDS = ("check number", "check no", "check #", "cheque number", "cheque no")
LEDGER_WORDS = ("payee", "date", "amount", "balance", "debit", "credit")
CLAIM_KEYS = ("claim number", "claim no", "claim #", "claim id", "claim_id", "claim ref", "claimant", "file number", "file no", "file num", "file ref")
LOSS_DATES = ("loss date", "date of loss", "loss dt", "accident date", "occurrence date", "incident date", "date of injury", "date of incident", "injury date", "dol")
AMOUNTS = ("incurred", "paid", "reserve", "outstanding", "total paid", "total incurred", "indemnity", "expense")
SUMMARY_WORDS = ("# claims", "num claims", "number of claims", "claim count", "loss ratio", "loss rate", "frequency", "severity")
REGISTER_WORDS = ("running total", "running balance", "payment/debit", "deposit/credit", "balance")
TOTAL_CELLS = ("totals", "total", "grand total")
AGGREGATE_START = "^(total|totals|grand\\s*total|subtotal|aggregate|summary|sum|report\\s*(date|total|summary)|all\\s+adjusters|ytd\\s+total|period\\s+total|fiscal\\s+total|portfolio\\s+total)"
AGGREGATE_INSIDE = "aggregate|summary|totals?_|_total|report_date|all_adjuster"
AGGREGATE_TOKENS = ("total", "totals", "aggregate", "summary", "subtotal", "grand", "portfolio", "report")
#: A row of three numbers or more, all above this, is one of sums, unless it starts like a claim. Cells are texts: those that are plain numbers count.
LARGE, CLAIM_ID, PLAIN_NUMBER = 50_000, "^([A-Z]{2,5}[-_][A-Z]{0,3}[0-9]{3,}|[0-9]{4,}$)", "^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)$"
#: Rows in which a header or the kind of a sheet is looked for; part of the rule.
TOP_ROWS = 20
MAGIC = {".pdf": "25504446", ".xlsx": "504B0304", ".docx": "504B0304"}
MAX_BYTES = 25 << 20


def read_csv_grid(spark: SparkSession, paths: str) -> DataFrame:
    """(sheet: path, row_no, cells) for each record of CSV files, raw strings in file order.

    Files are read in splits. A line starts a record if the quotes before it in its file are even: each split counts its lines'
    quotes and record starts, and the sums over the splits before (a row a split) give every line its place. Only records with
    line ends inside quotes are gathered, a few lines each. Rows may differ in length; an empty line is a row without cells; bytes
    that are no UTF-8 become question marks of Unicode. Quotes must be balanced, and lines end in ``\\n`` or ``\\r\\n``.
    """
    at = ["sheet", "split"]
    lines = spark.read.option("lineSep", "\n").text(paths).select(F.col("_metadata.file_path").alias("sheet"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("line"), "value")
    own = Window.partitionBy(*at).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = lines.withColumn("quotes", quotes).withColumn("after", F.sum("quotes").over(own))
    before = F.col("after") - F.col("quotes")
    # record starts in a split, if an even or an odd number of quotes stands before it
    sums = lines.groupBy(*at).agg(F.sum("quotes").alias("q"), F.count_if(before % 2 == 0).alias("even"), F.count_if(before % 2 == 1).alias("odd"))
    ahead = Window.partitionBy("sheet").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = sums.withColumn("open", F.coalesce(F.sum("q").over(ahead), F.lit(0)) % 2)
    splits = splits.withColumn("records", F.coalesce(F.sum(F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("odd"))).over(ahead), F.lit(0))).select(*at, "open", "records")
    placed = lines.join(splits, at)
    starts = ((F.col("open") + before) % 2 == 0).cast("int")
    ends = (F.col("open") + F.col("after")) % 2 == 0
    placed = placed.withColumns({"starts": starts, "ends": ends}).withColumn("row_no", F.col("records") + F.sum("starts").over(own))
    whole = placed.filter("starts = 1 AND ends").select("sheet", "row_no", "value")
    parts = F.array_sort(F.collect_list(F.struct("split", "line", "value")))
    torn = placed.filter("NOT (starts = 1 AND ends)").groupBy("sheet", "row_no").agg(F.array_join(F.transform(parts, lambda p: p["value"]), "\n").alias("value"))
    text = F.regexp_replace(F.when(F.col("row_no") == 1, F.regexp_replace("value", "^\ufeff", "")).otherwise(F.col("value")), "\r$", "")
    return whole.unionByName(torn).select("sheet", F.col("row_no").cast("int").alias("row_no"), csv_cells(text).alias("cells"))


def csv_cells(record: Column) -> Column:
    """The cells of a CSV record; quoted ones without their quotes, doubled quotes as one."""
    quoted = '"([^"]*+(?:""[^"]*+)*+)"'
    tokens = F.regexp_extract_all(F.concat(F.lit(","), record), F.lit(f",((?:{quoted})?[^,]*)"), 1)
    plain = lambda c: F.concat(F.replace(F.regexp_extract(c, f"(?s)^{quoted}", 1), F.lit('""'), F.lit('"')), F.regexp_replace(c, f"(?s)^{quoted}", ""))
    return F.when(record == "", F.array().cast("array<string>")).otherwise(F.transform(tokens, lambda c: F.when(F.startswith(c, F.lit('"')), plain(c)).otherwise(c)))


def upload_verdict(files: DataFrame) -> DataFrame:
    """Files (ext, length, content) with ``ok`` and the reason against."""
    ext = F.lower("ext")
    magic = F.try_element_at(F.create_map(*(F.lit(x) for kv in MAGIC.items() for x in kv)), ext)
    reason = F.when(F.col("length") > MAX_BYTES, "too large").when(F.col("length") == 0, "empty").when(magic.isNotNull() & (F.hex(F.substring("content", 1, 4)) != magic), "content does not match the extension")
    return files.select("*", reason.alias("reason")).withColumn("ok", F.col("reason").isNull())


def _has(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(text, w))


def _filled(cells: Column) -> Column:
    return F.filter(F.transform(cells, lambda c: F.trim(c)), lambda c: c.isNotNull() & (c != ""))


def _row_text(cells: Column) -> Column:
    return F.lower(F.array_join(F.filter(cells, lambda c: c.isNotNull() & (c != "")), " "))


def classify_sheets(grid: DataFrame) -> DataFrame:
    """(sheet, kind, confidence) by the words of a sheet's top rows."""
    top = grid.filter(F.col("row_no") <= TOP_ROWS)
    lone = (F.size(_filled(F.col("cells"))) == 1) & (F.lower(F.element_at(F.concat(_filled(F.col("cells")), F.array(F.lit(""))), 1)) == "line of business")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", _row_text(F.col("cells")).alias("t")))), lambda x: x["t"]), " ")
    s = top.groupBy("sheet").agg(text.alias("t"), F.bool_or(lone).alias("lone"))
    t = F.col("t")
    check, payee, ledger = _has(t, (*CHECK_WORDS, "check num")), F.contains(t, F.lit("payee")), _has(t, REGISTER_WORDS)
    loss = F.when(_has(t, CLAIM_KEYS), 2).otherwise(0) + _has(t, LOSS_DATES).cast("int") + _has(t, AMOUNTS).cast("int")
    commercial = F.when(F.contains(t, F.lit("policy")) & _has(t, ("claim", "incurred")), 3).otherwise(0)
    s = s.withColumns({"summary": F.contains(t, F.lit("line of business")) & (_has(t, SUMMARY_WORDS) | F.col("lone")), "register": check & (payee | ledger), "signals": check.cast("int") + payee.cast("int") + ledger.cast("int"), "loss": loss, "commercial": commercial})
    top_score, margin = F.greatest("loss", "commercial"), F.abs(F.col("loss") - F.col("commercial")) / F.greatest("loss", "commercial", F.lit(1))
    base = F.when(top_score >= 3, 0.65).when(top_score == 2, 0.5).otherwise(0.35)
    kind = F.when(F.col("summary"), "SUMMARY").when(F.col("register"), "CHECK_REGISTER").when(top_score == 0, "UNKNOWN").when(F.col("loss") >= F.col("commercial"), "LOSS_RUN").otherwise("COMMERCIAL_LOSS_RUN")
    sure = F.when(F.col("summary"), 0.9).when(F.col("register"), F.least(F.lit(0.85), 0.55 + 0.1 * F.col("signals"))).when(top_score == 0, 0.0).otherwise(F.least(F.lit(0.85), base + 0.2 * margin))
    return s.select("sheet", kind.alias("kind"), F.bround(sure, 2).alias("confidence"))


def header_rows(grid: DataFrame) -> DataFrame:
    """(sheet, header_row): the first top row with claim and measure words or a check register's, else the first with three filled cells."""
    t = _row_text(F.col("cells"))
    match = (_has(t, CLAIM_WORDS) & _has(t, MEASURE_WORDS)) | (_has(t, CHECK_WORDS) & _has(t, LEDGER_WORDS))
    wide = F.size(F.filter("cells", lambda c: c.isNotNull() & (c != ""))) >= 3
    top = grid.filter(F.col("row_no") <= TOP_ROWS)
    found = top.groupBy("sheet").agg(F.coalesce(F.min(F.when(match, F.col("row_no"))), F.min(F.when(wide, F.col("row_no")))).alias("header_row"))
    return found.filter("header_row IS NOT NULL")


def merged_headers(first: Column, second: Column) -> Column:
    """Two header rows as one: group and sub header joined; repeats numbered from the second on."""
    names = F.zip_with(first, second, lambda g, s: F.trim(F.when(F.upper(F.trim(g)) == F.upper(F.trim(s)), s).otherwise(F.concat_ws(" ", F.nullif(F.trim(g), F.lit("")), F.nullif(F.trim(s), F.lit(""))))))
    nth = F.transform(names, lambda n, i: F.size(F.filter(F.slice(names, F.lit(1), i + 1), lambda x: x == n)))
    return F.zip_with(names, nth, lambda n, k: F.when((n == "") | (k == 1), n).otherwise(F.concat(n, F.lit("_"), k.cast("string"))))


def is_separator(cells: Column) -> Column:
    f = _filled(cells)
    return (F.size(f) > 0) & F.forall(f, lambda c: c == "----------")


def is_aggregate(cells: Column) -> Column:
    """Rows of totals, summaries and report lines rather than records."""
    f = _filled(cells)
    first = F.element_at(F.concat(f, F.array(F.lit(""))), 1)
    tokens = F.split(F.lower(first), "[_\\s]+")
    token = (F.size(tokens) >= 2) & F.exists(tokens, lambda x: x.isin(*AGGREGATE_TOKENS))
    lines = F.exists(F.slice(f, 1, 6), lambda c: c.rlike("(?i)^(total\\s+claims|report\\s+date|all\\s+adjusters|open:\\s*[0-9]|pend:\\s*[0-9])"))
    numbers = F.filter(F.transform(f, lambda c: F.when(c.rlike(PLAIN_NUMBER), c.cast("double"))), lambda x: x.isNotNull())
    sums = (F.size(numbers) >= 3) & F.forall(numbers, lambda x: x > LARGE) & ~first.rlike(f"(?i){CLAIM_ID}")
    return (F.size(f) > 0) & (sums | first.rlike(f"(?i){AGGREGATE_START}") | first.rlike(f"(?i)({AGGREGATE_INSIDE})") | token | lines)


def is_total(cells: Column) -> Column:
    return F.exists(cells, lambda c: F.coalesce(F.lower(F.trim(c)), F.lit("")).isin(*TOTAL_CELLS))


def body_rows(grid: DataFrame) -> DataFrame:
    """Rows under the header up to the first row of totals, without blank and aggregate rows."""
    under = grid.join(header_rows(grid), "sheet").filter("row_no > header_row")
    end = under.filter(is_total(F.col("cells"))).groupBy("sheet").agg(F.min("row_no").alias("end_row"))
    open_rows = under.join(end, "sheet", "left").filter("end_row IS NULL OR row_no < end_row")
    return open_rows.filter((F.size(_filled(F.col("cells"))) > 0) & ~is_aggregate(F.col("cells"))).select("sheet", "row_no", "header_row", "cells")


def grid_records(grid: DataFrame) -> DataFrame:
    """(sheet, row_no, pos, field, value): cells under their headers; of headers that repeat the last column counts."""
    heads = grid.join(header_rows(grid), "sheet").filter("row_no = header_row").select("sheet", F.posexplode("cells").alias("at", "h"))
    heads = heads.select("sheet", (F.col("at") + 1).alias("pos"), F.coalesce(F.trim("h"), F.concat(F.lit("Column_"), F.col("at").cast("string"))).alias("field"))
    last = heads.groupBy("sheet", "field").agg(F.max("pos").alias("pos"))
    cells = body_rows(grid).select("sheet", "row_no", F.posexplode("cells").alias("at", "c")).select("sheet", "row_no", (F.col("at") + 1).alias("pos"), F.coalesce(F.trim("c"), F.lit("")).alias("value"))
    return cells.join(last, ["sheet", "pos"]).select("sheet", "row_no", "pos", "field", "value")


def dimensions(grid: DataFrame) -> DataFrame:
    return grid.groupBy("sheet").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("cells")).alias("columns"))


def attach_subrows(rows: DataFrame) -> DataFrame:
    """Rows (sheet, row_no, kind: main, sub or close) with the main row that each sub row belongs to; a closing row ends a record."""
    w = Window.partitionBy("sheet").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    marker = F.when(F.col("kind") == "main", F.col("row_no")).when(F.col("kind") == "close", 0)
    owned = rows.withColumn("owner", F.last(marker, ignorenulls=True).over(w))
    return owned.filter("kind <> 'close' AND owner > 0")


def fill_if_empty(main: DataFrame, sub: DataFrame) -> DataFrame:
    """Fields of records, those that are empty or missing taken from their sub rows."""
    both = main.withColumn("p", F.lit(0)).unionByName(sub.withColumn("p", F.lit(1))).filter("trim(value) <> ''")
    w = Window.partitionBy("sheet", "row_no", "field").orderBy("p", "value")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("p", "r")


LEGACY_AMOUNTS = ("paid", "incurred", "outstanding")  # fixed values


def _two_rows(grid: DataFrame, rows: int) -> DataFrame:
    """Neighbouring top rows of a sheet with the number of filled cells, and cells at all, of both."""
    w = Window.partitionBy("sheet").orderBy("row_no")
    there = lambda c: F.size(F.filter(c, lambda x: x.isNotNull()))
    filled = lambda c: F.size(F.filter(c, lambda x: x.isNotNull() & (x != "")))
    two = grid.filter(F.col("row_no") <= rows + 1).withColumn("under", F.lead("cells").over(w)).filter(F.col("under").isNotNull() & (F.col("row_no") <= rows))
    text = F.lower(F.array_join(F.filter(F.concat("cells", "under"), lambda x: x.isNotNull() & (x != "")), " "))
    return two.select("sheet", "row_no", text.alias("text"), there(F.col("cells")).alias("there1"), there(F.col("under")).alias("there2"), filled(F.col("cells")).alias("filled1"), filled(F.col("under")).alias("filled2"))


def legacy_sheets(grid: DataFrame) -> DataFrame:
    """(sheet, legacy): whether a sheet is laid out for print, with dashed separators or a header of a sparse and a full row."""
    dashed = grid.groupBy("sheet").agg(F.bool_or(is_separator(F.col("cells"))).alias("dashed"))
    wide = (F.col("there2") >= 5) & (F.col("there1") >= 2) & (F.col("filled1") >= 2) & (F.col("filled2") > 1.5 * F.col("filled1"))
    named = _has(F.col("text"), ("file", "claim")) & _has(F.col("text"), LEGACY_AMOUNTS)
    headed = _two_rows(grid, TOP_ROWS).groupBy("sheet").agg(F.bool_or(wide & named).alias("headed"))
    return dashed.join(headed, "sheet", "left").select("sheet", (F.col("dashed") | F.coalesce("headed", F.lit(False))).alias("legacy"))


def legacy_header_rows(grid: DataFrame, top: int = 25) -> DataFrame:
    """(sheet, first_row, second_row) of the first two-row header; both the same where the upper row is nearly empty."""
    named = _has(F.col("text"), ("file", "claim", "assured")) & _has(F.col("text"), LEGACY_AMOUNTS)
    first = F.when(F.col("filled1") >= 2, F.col("row_no")).when(F.col("filled2") >= 5, F.col("row_no") + 1)
    found = _two_rows(grid, top).filter((F.col("filled2") >= 4) & named).withColumn("first_row", first).filter("first_row IS NOT NULL")
    return found.groupBy("sheet").agg(F.min_by(F.struct("first_row", (F.col("row_no") + 1).alias("second_row")), "row_no").alias("h")).select("sheet", "h.first_row", "h.second_row")


def is_subtotal(cells: Column) -> Column:
    return F.coalesce(F.get(_filled(cells), F.lit(0)).rlike("(?i)^total(?![0-9a-z_])"), F.lit(False))


def is_subrow(cells: Column) -> Column:
    """Rows that continue a record: no first cell, one to three filled ones, something in the second or fourth."""
    n = F.size(_filled(cells))
    return (F.size(cells) > 0) & F.get(cells, F.lit(0)).isNull() & n.between(1, 3) & (F.get(cells, F.lit(1)).isNotNull() | F.get(cells, F.lit(3)).isNotNull())


def row_kinds(grid: DataFrame) -> DataFrame:
    """Rows with their kind: close (blank, separators, subtotals, aggregates), sub or main."""
    c = F.col("cells")
    closing = (F.size(_filled(c)) == 0) | is_separator(c) | is_subtotal(c) | is_aggregate(c)
    return grid.withColumn("kind", F.when(closing, "close").when(is_subrow(c), "sub").otherwise("main"))


# Fixed values.
_TO = "[\\s\u2013\u2014\\-to]+"
#: Field, pattern, group; of these only the first region with the field counts as understood.
BANNER_ONCE = (
    ("Policy Number", "Policy\\s*(?:#|No\\.?|Number)?\\s*[:\\-]\\s*([A-Z0-9][A-Z0-9\\-/.]+)", 1), ("Insured Name", "Insured\\s*[:\\-]\\s*([^|;]+)", 1),
    ("Contract Number", "Contract\\s*(?:No\\.?|Number|#|Ref)?\\s*[:\\-]\\s*([A-Z0-9][A-Z0-9\\-/.]+)", 1),
)
_STATE, _CARRIER = "State\\s*[:\\-]\\s*([^|;]+)", "Carrier\\s*[:\\-]\\s*([^|;]+)"
_UNDERWRITING_DAY, _PERIOD_DAY = "(\\d{1,2}\\s+\\w+\\s+\\d{4}|\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{2,4})", "(\\d{1,2}[/\\-\\.]\\d{1,2}[/\\-\\.]\\d{2,4}|\\d{1,2}\\s+\\w+\\s+\\d{4})"
_UNDERWRITING, _PERIOD = f"Underwriting\\s+Period\\s*[:\\-]?\\s*{_UNDERWRITING_DAY}{_TO}{_UNDERWRITING_DAY}", f"Period\\s*[:\\-]?\\s*{_PERIOD_DAY}{_TO}{_PERIOD_DAY}"
BANNER_ALWAYS = (
    ("Carrier", _CARRIER, 1), ("Carrier Name", _CARRIER, 1), ("State", _STATE, 1), ("Jurisdiction", _STATE, 1), ("State Code", _STATE, 1),
    ("Underwriting Period Start", _UNDERWRITING, 1), ("Underwriting Period End", _UNDERWRITING, 2), ("Policy Period Start", _PERIOD, 1), ("Policy Period End", _PERIOD, 2),
)
BUSINESS_LINES = (
    ("workers['\u2019\\s\\-]*compensation", "Workers Compensation"), ("workers[\\s\\-]*comp\\b", "Workers Compensation"), ("\\bW\\.?C\\.?\\b(?:\\s+loss|\\s+claim|\\s+run)?", "Workers Compensation"),
    ("commercial\\s+general\\s+liability", "Commercial General Liability"), ("\\bC\\.?G\\.?L\\.?\\b", "Commercial General Liability"), ("commercial\\s+auto(?:mobile|motive)?", "Commercial Auto"),
    ("commercial\\s+prop(?:erty)?", "Commercial Property"), ("professional\\s+liability", "Professional Liability"), ("\\bE\\.?\\s*&\\s*O\\.?\\b", "Professional Liability"), ("general\\s+liability|\\bG\\.?L\\.?\\b", "General Liability"),
)


def merged_fields(regions: DataFrame) -> DataFrame:
    """(sheet, field, value, row_start, col_start) from merged title and header regions (sheet, type, row_start, col_start, value).

    Regions in order, as a fold over a sheet's array of them (a sheet has some dozens): labelled facts and lines of business by
    pattern, the first of a field wins; a region that tells nothing new gives its own ``KEY: value``; without a separator a line of
    business or a company (the first is the carrier, if none is known, later ones the insured), else its text under its place.
    """
    from ledgerline.operators.banner import line_kind
    from ledgerline.operators.blocks import title_case

    v = F.trim("value")
    part = lambda f, p, g, once: F.when(v.rlike(f"(?i){p}"), F.struct(F.lit(f).alias("field"), F.trim(F.regexp_extract("value", f"(?i){p}", g)).alias("value"), F.lit(once).alias("once")))
    underwriting = v.rlike(f"(?i){_UNDERWRITING}")
    line = F.coalesce(*(F.when(v.rlike(f"(?i){p}"), F.struct(F.lit("Line of Business").alias("field"), F.lit(name).alias("value"), F.lit(True).alias("once"))) for p, name in BUSINESS_LINES))
    always = [F.when(~underwriting, part(f, p, g, False)) if p == _PERIOD else part(f, p, g, False) for f, p, g in BANNER_ALWAYS]
    facts = F.filter(F.array(*(part(f, p, g, True) for f, p, g in BANNER_ONCE), *always, line), lambda x: x.isNotNull())
    spot = F.concat(F.lit(" [R"), F.col("row_start").cast("string"), F.lit("C"), F.col("col_start").cast("string"), F.lit("]"))
    pair = "^([^:\\-]{3,40})[:\\-]\\s*(.+)$"
    kind = line_kind(v)
    key = F.when(v.rlike(pair), title_case(F.trim(F.regexp_extract(v, pair, 1)))).otherwise(F.coalesce(kind["field"], F.concat(F.initcap("type"), spot)))
    raw = F.struct(key.alias("field"), F.when(v.rlike(pair), F.trim(F.regexp_extract(v, pair, 2))).otherwise(F.coalesce(kind["value"], v)).alias("value"), (~v.rlike(pair) & (kind["field"] == "company")).alias("company"))
    told = regions.filter(F.col("type").isin("TITLE", "HEADER") & (v != "")).select("sheet", F.struct("row_start", "col_start", v.alias("text"), spot.alias("spot"), facts.alias("facts"), raw.alias("raw")).alias("x"))
    found = "array<struct<field:string,value:string,row_start:int,col_start:int>>"
    has = lambda acc, name: F.exists(acc, lambda f: f["field"] == name)

    def add(acc: Column, x: Column) -> Column:
        put = lambda f, value: F.struct(f.alias("field"), value.alias("value"), x["row_start"].cast("int").alias("row_start"), x["col_start"].cast("int").alias("col_start"))
        new = F.transform(F.filter(x["facts"], lambda f: ~has(acc, f["field"])), lambda f: put(f["field"], f["value"]))
        known = F.exists(x["facts"], lambda f: ~f["once"] | ~has(acc, f["field"]))
        name = F.when(F.coalesce(x["raw"]["company"], F.lit(False)), F.when(has(acc, "Carrier") | has(acc, "Insured Name"), "Insured Name").otherwise("Carrier")).otherwise(x["raw"]["field"])
        own = put(F.when(has(acc, name), F.concat(name, x["spot"])).otherwise(name), x["raw"]["value"])
        return F.when(known, F.concat(acc, new)).otherwise(F.concat(F.filter(acc, lambda f: f["field"] != own["field"]), F.array(own)))

    own = told.groupBy("sheet").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    return own.select("sheet", F.explode(F.aggregate("xs", F.array().cast(found), add)).alias("f")).select("sheet", "f.*")
