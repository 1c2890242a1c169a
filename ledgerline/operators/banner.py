"""Key-value facts in the rows above a sheet's header, in three passes of which a later one doesn't see what an earlier one took.

A banner has at most ``TOP_ROWS`` rows (part of the rule), so what is ordered by sheet stays small; sheets are independent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.operators import grid as grids

# Fixed values.
LABELS = {
    "prepared for": "Reinsurer", "reinsurer": "Reinsurer", "prepared by": "TPA Name", "treaty": "Treaty", "program": "Treaty", "policy": "Policy Number", "cedant": "Cedant", "ceding company": "Cedant", "insurer": "Cedant",
    "valuation date": "Valuation Date", "valuation": "Valuation Date", "as of": "Valuation Date", "report date": "Report Date", "report generated": "Report Date", "effective date": "Effective Date",
    "policy number": "Policy Number", "policy no": "Policy Number", "policy #": "Policy Number", "insured": "Insured Name", "named insured": "Insured Name", "line of business": "Line of Business", "lob": "Line of Business", "coverage": "Coverage Type",
    "period ended": "Valuation Date", "period ending": "Valuation Date", "period end": "Valuation Date", "as at": "Valuation Date", "underwriting period": "Underwriting Period", "policy period": "Policy Period", "coverage period": "Policy Period",
    "contract number": "Contract Number", "contract no": "Contract Number", "contract #": "Contract Number", "contract": "Contract Number", "carrier": "Carrier", "carrier name": "Carrier", "underwriter": "Carrier",
    "assured": "Insured Name", "account": "Insured Name", "program year": "Program Year", "claims administrator": "TPA Name",
}
RANGES = ("Underwriting Period", "Policy Period")
DATE = "(\\d{1,2}\\s+[A-Za-z]{3,9}\\s+\\d{2,4}|[A-Za-z]{3,9}\\s+\\d{1,2},?\\s+\\d{4}|\\d{1,2}[/\\-\\.]\\d{1,2}[/\\-\\.]\\d{2,4}|\\d{4}-\\d{2}-\\d{2})"
DATE_RANGE = f"(?i)^{DATE}\\s*(?:to|through|thru|[\u2013\u2014\\-])\\s*{DATE}$"
COMPANY = (
    "(?i)\\b(llc|l\\.l\\.c|inc|inc\\.|incorporated|corp|corporation|co\\.|co|company|ltd|limited|lp|llp|plc|holdings|group|partners|properties|associates|enterprises|"
    "ins\\.?|insurance|assurance|underwriters|mgmt|management|trust|estates)\\b"
)
BUSINESS_LINES = (
    ("workers[\u2019'\\s\\-]*comp(?:ensation)?", "Workers Compensation"), ("commercial\\s+general\\s+liability", "Commercial General Liability"), ("commercial\\s+auto(?:mobile)?", "Commercial Auto"), ("commercial\\s+prop(?:erty)?", "Commercial Property"),
    ("professional\\s+liability", "Professional Liability"), ("general\\s+liability", "General Liability"), ("\\bumbrella\\b", "Umbrella"), ("\\bexcess\\s+casualty\\b", "Excess Casualty"), ("\\binland\\s+marine\\b", "Inland Marine"), ("\\bcyber\\b", "Cyber"),
)
NOTE = "(?i)^\\(.*\\)$|^(see|note|source|continued)\\b"
LABEL_LIKE, VALUE_LIKE, NUMBERS = "^[A-Za-z][A-Za-z0-9 &/#.'\\-]{1,38}$", "^[\\dA-Z]", "^[\\d$,()\\-\\.]+$"
INLINE = "^([A-Za-z][^:]{0,40}):\\s*([^\\n]+)$"
REPORT_TAIL, LOSS_RUN = "(?i)\\b(report|run|detail|summary|schedule|listing)\\b", "(?i)(?:loss\\s+run\\s+report|annual\\s+loss\\s+run)\\s*[\u2014\\-\u2013]+\\s*([^\\n]+)"
#: Rows that are read where no header is known; columns between a label and its value; filled cells from which a row is no caption.
OPEN_ROWS, REACH, WIDE = 15, 3, 4
_WHITE = " \t\n\x0b\x0c\r"


def _strip(v: Column) -> Column:
    return F.trim(v, F.lit(_WHITE))


def banner_label(raw: Column) -> Column:
    """The field that a label means, null if it is none of ``LABELS``."""
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.try_element_at(known, F.regexp_replace(F.lower(F.rtrim(_strip(raw), F.lit(":"))), "\\s+", " "))


def _fact(order: int, at: Column, then: Column, field: Column, value: Column, col: Column, source: str) -> Column:
    return F.struct(F.lit(order).alias("order"), at.cast("int").alias("at"), then.cast("int").alias("then"), field.alias("field"), value.alias("value"), col.cast("int").alias("col"), F.lit(source).alias("source"))


def _inline(v: Column) -> Column:
    """Facts ``LABEL: value`` in a cell."""
    pairs = F.transform(F.split(v, "\\s{3,}|\\|"), lambda s: F.struct(banner_label(F.regexp_extract(_strip(s), INLINE, 1)).alias("field"), _strip(F.regexp_extract(_strip(s), INLINE, 2)).alias("value")))
    told = F.filter(pairs, lambda p: p["field"].isNotNull() & (p["value"] != ""))
    return F.when(F.contains(v, F.lit(":")) & ~v.rlike("^\\d"), told).otherwise(F.slice(told, F.lit(1), F.lit(0)))


def _labels(cells: Column) -> Column:
    """Places of the cells (col, v, told) that are labels of their right neighbours; a value is no label again."""

    def next_label(acc: Column, i: Column) -> Column:
        a, b = F.element_at(cells, i), F.element_at(cells, i + 1)
        label = (F.size(a["told"]) == 0) & a["v"].rlike(LABEL_LIKE) & (F.size(F.split(a["v"], "\\s+")) <= 5) & banner_label(a["v"]).isNotNull()
        yes = (i >= acc["next"]) & label & (b["col"] - a["col"] <= REACH) & b["v"].rlike(VALUE_LIKE)
        return F.when(yes, F.struct(F.array_append(acc["found"], i).alias("found"), (i + 2).alias("next"))).otherwise(acc)

    start = F.struct(F.array().cast("array<int>").alias("found"), F.lit(1).alias("next"))
    places = F.sequence(F.lit(1), F.greatest(F.size(cells) - 1, F.lit(1)))
    return F.when(F.size(cells) > 1, F.aggregate(places, start, next_label)["found"]).otherwise(F.array().cast("array<int>"))


def _administrator(v: Column) -> Column:
    """The name in a first line, without what it says of the report."""
    first = _strip(F.regexp_extract(v, "^([^\u2014\u2013]*)", 1))
    head = F.substring_index(first, " - ", 1)
    tail = F.substring(first, F.length(head) + 4, F.length(first))
    return F.when(F.contains(first, F.lit(" - ")) & tail.rlike(REPORT_TAIL), _strip(head)).otherwise(first)


def _told(field: str, value: Column) -> Column:
    return F.struct(F.lit(field).alias("field"), value.alias("value"))


def line_kind(v: Column) -> Column:
    """Field and value of a line that names a line of business or a company (field ``company``: its place decides what it is); else null."""
    lines = [F.when(v.rlike(f"(?i){p}"), _told("Line of Business", F.lit(name))) for p, name in BUSINESS_LINES]
    return F.when(~v.rlike(NOTE), F.coalesce(*lines, F.when(v.rlike(COMPANY), _told("company", v))))


def _caption(v: Column) -> Column:
    """Field and value of a line without a label."""
    title = F.when(v.rlike(LOSS_RUN), _strip(F.regexp_extract(v, LOSS_RUN, 1))).otherwise(v)
    return F.coalesce(line_kind(v), _told("Sheet Title", title))


def banner_fields(grid: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(sheet, field, value, source, excel_row, excel_col) of each sheet of ``grid`` (sheet, row_no, cells: as displayed).

    Rows above the header (``headers``: sheet, header_row; by default as ``header_rows`` finds it), else the first ``OPEN_ROWS``.
    Passes of a row: ``LABEL: value`` inside cells, a label cell and its neighbour, captions. The first value of a field counts;
    periods become start and end. The first company without a label is the carrier, later ones the insured. Every sheet has the
    field Sheet Name. Null and blank cells don't count; of repeated rows of a sheet the first facts count as of others.
    """
    heads = grids.header_rows(grid) if headers is None else headers
    top = grid.filter(F.col("row_no") <= max(OPEN_ROWS, grids.TOP_ROWS + 5)).join(heads.select("sheet", "header_row"), "sheet", "left")
    rows = top.filter(F.col("row_no") < F.coalesce("header_row", F.lit(OPEN_ROWS + 1)))
    cells = F.filter(F.transform("cells", lambda c, i: F.struct((i + 1).alias("col"), _strip(c).alias("v"))), lambda x: x["v"].isNotNull() & (x["v"] != ""))
    rows = rows.select("sheet", "row_no", F.transform(cells, lambda x: F.struct(x["col"], x["v"], _inline(x["v"]).alias("told"))).alias("c")).filter(F.size("c") > 0)
    rows = rows.withColumn("labels", _labels(F.col("c")))
    inside = F.flatten(F.transform("c", lambda x: F.transform(x["told"], lambda p, k: _fact(1, x["col"], k, p["field"], p["value"], x["col"], "title_kv"))))
    beside = F.transform("labels", lambda i: _fact(2, i, F.lit(0), banner_label(F.element_at("c", i)["v"]), F.element_at("c", i + 1)["v"], F.element_at("c", i + 1)["col"], "title_kv"))
    rows = rows.withColumn("facts", F.concat(inside, beside))
    free = F.filter("c", lambda x, i: (F.size(x["told"]) == 0) & ~F.array_contains("labels", i + 1) & ~F.array_contains("labels", i) & ~F.contains(x["v"], F.lit(":")) & ~x["v"].rlike(NUMBERS))
    rows = rows.withColumn("free", F.when(F.size("c") < WIDE, free).otherwise(F.slice(free, F.lit(1), F.lit(0))))
    # the first line names the administrator, unless a label did: up to the first name its cells are nothing else
    names = F.transform("free", lambda x: _administrator(x["v"]))
    asked = (F.col("row_no") == 1) & ~F.exists("facts", lambda f: f["field"] == "TPA Name")
    lead = F.when(asked, F.coalesce(F.nullif(F.array_position(F.transform(names, lambda n: n != ""), F.lit(True)), F.lit(0)), F.lit(WIDE))).otherwise(0)
    rows = rows.withColumns({"names": names, "lead": lead.cast("int")})

    def captions(x: Column, i: Column) -> Column:
        name = F.get("names", i)
        say = lambda k, f, v: _fact(3, x["col"], F.lit(k), f, v, x["col"], "title_banner")
        own = _caption(x["v"])
        first = F.when(name.rlike(COMPANY), F.array(say(0, F.lit("TPA Name"), name), say(1, F.lit("company"), name))).otherwise(F.array(say(0, F.lit("TPA Name"), name)))
        return F.when(i + 1 == F.col("lead"), first).when(i >= F.col("lead"), F.array(say(0, own["field"], own["value"])))

    told = rows.select("sheet", "row_no", F.explode(F.concat("facts", F.flatten(F.filter(F.transform("free", captions), lambda a: a.isNotNull())))).alias("f")).select("sheet", "row_no", "f.*").filter("value <> ''")
    nth = F.row_number().over(Window.partitionBy("sheet", "field").orderBy("row_no", "order", "at", "then"))
    told = told.withColumn("field", F.when(F.col("field") == "company", F.when(nth == 1, "Carrier").otherwise("Insured Name")).otherwise(F.col("field")))
    period = F.col("field").isin(*RANGES) & F.col("value").rlike(DATE_RANGE)
    ends = F.array(*(F.struct(F.concat("field", F.lit(name)).alias("field"), F.regexp_extract("value", DATE_RANGE, g).alias("value")) for g, name in ((1, " Start"), (2, " End"))))
    each = told.withColumn("e", F.explode(F.when(period, ends).otherwise(F.array(F.struct("field", "value"))))).drop("field", "value").select("*", "e.*")
    first = each.groupBy("sheet", "field").agg(F.min_by(F.struct("value", "source", F.col("row_no").cast("int").alias("excel_row"), F.col("col").alias("excel_col")), F.struct("row_no", "order", "at", "then", "value")).alias("x")).select("sheet", "field", "x.*")
    tabs = grid.select("sheet").distinct().select("sheet", F.lit("Sheet Name").alias("field"), F.col("sheet").alias("value"), F.lit("sheet_tab").alias("source"), F.lit(0).alias("excel_row"), F.lit(0).alias("excel_col"))
    return first.unionByName(tabs)
