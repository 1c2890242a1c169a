"""Fields from the ordered blocks of word documents: paragraphs, table rows and table cells.

``blocks``: doc_id, block_id (their order), block_type (paragraph, table_row or table_cell), text, table_index, row_index, col_index.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
LABEL_WORDS = ("policy", "claim", "insured", "carrier", "date", "status", "premium", "limit", "deductible", "period", "name", "number", "less", "add", "tax")
LABELS = {
    "claim number": "Claim Number", "claim no": "Claim Number", "claim #": "Claim Number", "claim id": "Claim Number", "policy number": "Policy Number", "policy no": "Policy Number", "policy #": "Policy Number", "insured": "Insured",
    "carrier": "Carrier", "loss date": "Loss Date", "date of loss": "Loss Date", "date reported": "Date Reported", "status": "Status", "claimant": "Claimant Name", "claimant name": "Claimant Name", "description of loss": "Description of Loss",
    "total paid": "Total Paid", "reserve": "Reserve", "total incurred": "Total Incurred", "effective date": "Effective Date", "expiration date": "Expiration Date", "lob": "Line of Business", "line of business": "Line of Business",
}
INLINE = "^\\s*([A-Za-z0-9 #/_\\-\\(\\)\\.]{2,60})\\s*:\\s*([^\\n]+?)\\s*$"
FALLBACKS = (
    ("\\bPolicy\\s*(?:Number|No|#)\\s*[:\\-]?\\s*([A-Z0-9\\-_\\/]+)", "Policy Number"), ("\\bClaim\\s*(?:Number|No|#|ID)\\s*[:\\-]?\\s*([A-Z0-9\\-_\\/]+)", "Claim Number"), ("\\bInsured\\s*[:\\-]?\\s*([^\\n\\r]+)", "Insured"),
    ("\\bCarrier\\s*[:\\-]?\\s*([^\\n\\r]+)", "Carrier"), ("\\bLoss\\s*Date\\s*[:\\-]?\\s*([^\\n\\r]+)", "Loss Date"), ("\\bEffective\\s*Date\\s*[:\\-]?\\s*([^\\n\\r]+)", "Effective Date"),
)
INLINE_SURE, ROW_SURE, CELLS_SURE, FALLBACK_SURE = 0.95, 0.92, 0.93, 0.80
LABEL_CHARS, VALUE_CHARS = 60, 200
_WHITE = " \t\n\x0b\x0c\r"
#: Words of a fallback pattern at most, so blocks over which a match that starts in one can reach.
_SPAN = 3


def _strip(c: Column) -> Column:
    return F.trim(c, F.lit(_WHITE))


def title_case(text: Column) -> Column:
    """Each letter that follows no letter in upper case, other letters in lower case."""
    chars = F.split(F.lower(text), "")
    return F.array_join(F.transform(chars, lambda c, i: F.when((i > 0) & F.coalesce(F.get(chars, i - 1), F.lit("")).rlike("\\p{L}"), c).otherwise(F.upper(c))), "")


def field_name(label: Column) -> Column:
    """The canonical name of a label, else the label in title case."""
    known = F.create_map(*(F.lit(x) for kv in LABELS.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.regexp_replace(F.lower(_strip(label)), "\\s+", " ")), title_case(_strip(label)))


def is_label(text: Column) -> Column:
    t = F.lower(_strip(text))
    return (F.length(t) <= LABEL_CHARS) & F.exists(F.array(*(F.lit(w) for w in LABEL_WORDS)), lambda w: F.contains(t, w))


def block_fields(blocks: DataFrame) -> DataFrame:
    """(doc_id, field, value, confidence, source_block, source_text): the first value of each field.

    Passes: ``Label: Value`` in any block, rows ``Label | Value`` of tables, a cell with a label and the cell to its right. Only
    documents without a field in any of these get what patterns find in their text. An earlier pass wins, then the earlier block.
    Null and blank blocks don't count; blocks of one document are ordered in one task, as a stream, and not gathered.
    """
    b = blocks.select("doc_id", "block_id", "block_type", _strip(F.col("text")).alias("text"), "table_index", "row_index", "col_index").filter("text <> ''")
    order = Window.partitionBy("doc_id").orderBy("block_id")
    fact = lambda n, name, value, sure, text: F.struct(F.lit(n).alias("pass"), name.alias("field"), value.alias("value"), F.lit(sure).alias("confidence"), text.alias("source_text"))
    text = F.col("text")
    inline = F.when(text.rlike(INLINE), fact(1, field_name(F.regexp_extract(text, INLINE, 1)), _strip(F.regexp_extract(text, INLINE, 2)), INLINE_SURE, text))
    parts = F.filter(F.transform(F.split(text, "\\|"), lambda p: _strip(p)), lambda p: p != "")
    row = F.when((F.col("block_type") == "table_row") & (F.size(parts) >= 2) & F.lower(F.get(parts, F.lit(0))).isin(*LABELS), fact(2, field_name(F.get(parts, F.lit(0))), F.get(parts, F.lit(1)), ROW_SURE, text))
    both = b.select("*", F.array(inline, row).alias("facts"))
    here = both.select("doc_id", "block_id", F.explode(F.filter("facts", lambda f: f.isNotNull())).alias("f")).select("doc_id", F.col("block_id").alias("source_block"), "f.*")
    right = {c: F.lead(c).over(order) for c in ("block_id", "text", "table_index", "row_index", "col_index")}
    cells = b.filter("block_type = 'table_cell'").withColumns({f"r_{c}": x for c, x in right.items()})
    beside = F.col("table_index").eqNullSafe(F.col("r_table_index")) & F.col("row_index").eqNullSafe(F.col("r_row_index")) & (F.col("r_col_index") == F.coalesce("col_index", F.lit(0)) + 1)
    pairs = cells.filter(beside & is_label(text) & (F.length("r_text") <= VALUE_CHARS))
    pairs = pairs.select("doc_id", F.col("r_block_id").alias("source_block"), fact(3, field_name(text), F.col("r_text"), CELLS_SURE, F.concat(text, F.lit(": "), F.col("r_text"))).alias("f")).select("doc_id", "source_block", "f.*")
    told = here.unionByName(pairs)
    # a pattern may reach from its block into those behind it; it counts where it starts
    ahead = F.concat_ws("\n", text, *(F.lead("text", k).over(order) for k in range(1, _SPAN + 1)))
    lines = b.join(told.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("ahead", ahead)
    starts = lambda p: F.regexp_instr("ahead", F.lit(p)).between(1, F.length("text"))
    hits = [F.when(starts(f"(?i){p}"), fact(4, F.lit(name), _strip(F.regexp_extract("ahead", f"(?i){p}", 1)), FALLBACK_SURE, _strip(F.regexp_extract("ahead", f"(?i){p}", 1)))) for p, name in FALLBACKS]
    rest = lines.select("doc_id", F.col("block_id").alias("source_block"), F.explode(F.filter(F.array(*hits), lambda f: f.isNotNull())).alias("f")).select("doc_id", "source_block", "f.*")
    first = told.unionByName(rest).groupBy("doc_id", "field").agg(F.min_by(F.struct("value", "confidence", F.when(F.col("pass") < 4, F.col("source_block")).alias("source_block"), "source_text"), F.struct("pass", "source_block", "value")).alias("x"))
    return first.select("doc_id", "field", "x.*")
