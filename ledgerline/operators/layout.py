"""Sub-row cells, merged regions, totals rows, label blocks, and the grounding of dates and signals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import standardize as S
from ledgerline.operators.documents import one_text

# Fixed values.
ADDRESS = "(?i)^([0-9]+\\s+\\w.*|P\\.?O\\.?\\s*BOX\\s+[0-9]|[0-9]+[-/][0-9]+\\s+\\w.*)"
ADDRESS_SUFFIX = "(?i)\\b(st|street|ave|avenue|blvd|boulevard|rd|road|dr|drive|ln|lane|ct|court|pl|place|way|cir|circle|hwy|highway|pkwy|parkway|terr|ter|loop|trail|trl|run|box|suite|ste|apt|unit|floor|fl)\\b"
CITY_STATE_ZIP = "(?i)^([A-Za-z\\s]{2,30},?\\s+[A-Z]{2}\\s+[0-9]{5}(-[0-9]{4})?|[A-Za-z\\s]{2,30},?\\s+[A-Z]{2}$|[0-9]{5}(-[0-9]{4})?$)"
PERIL = "(?i)\\b(fire|flood|wind|windstorm|hail|storm|tornado|hurricane|tropical\\s+storm|water\\s+damage|water\\s+intrusion|theft|vandalism|slip|fall|trip|collision|accident|explosion|lightning|freeze|ice|snow|earthquake|sinkhole|mold|liability|negligence|assault|discrimination|wrongful|product\\s+liability|premises|auto|vehicle|medical|workers|comp|injury|glass|burst\\s+pipe|pipe\\s+burst|roof|damage)\\b"
PERSON = "^[A-Z][A-Za-z'-]+(\\s+[A-Z][A-Za-z'-]+){1,4}$"
DATE_NAMES = "date filed|date of loss|date of report|incident date|loss date|time of loss|date of incident|date reported|filing date|report date"
PLAIN_WORDS = ("signal", "detected", "identified", "document", "indicates", "referenced", "mentioned", "present", "reported", "found", "noted")


def column_letter(pos: Column) -> Column:
    """A, B, ... Z, AA, ... of a position from 0, up to three letters (18,278 columns)."""
    letter = lambda n: F.char((F.lit(65) + n).cast("long"))
    two, three = pos - 26, pos - 702
    last_two = lambda p: F.concat(letter(F.floor(p / 26) % 26), letter(p % 26))
    return F.when(pos < 26, letter(pos)).when(two < 676, last_two(two)).otherwise(F.concat(letter(F.floor(three / 676)), last_two(three)))


def subrow_kind(v: Column, pos: Column) -> Column:
    """What a sub row's cell holds: address, place, peril, person, or its column."""
    s = F.trim(v)
    address = s.rlike(ADDRESS) | (s.rlike(ADDRESS_SUFFIX) & s.rlike("[0-9]"))
    return F.when(address, "Address").when(s.rlike(CITY_STATE_ZIP), "City State Zip").when(s.rlike(PERIL), "Cause of Loss").when(s.rlike(PERSON), "Claimant Name").otherwise(F.concat(F.lit("SubRow_"), column_letter(pos)))


def subrow_fields(rows: DataFrame) -> DataFrame:
    """(sheet, row_no, pos, field, value) of sub rows (sheet, row_no, cells); repeats of a kind in a row are numbered."""
    cells = rows.select("sheet", "row_no", F.posexplode("cells").alias("pos", "value")).filter("trim(value) <> ''")
    kinds = cells.withColumn("kind", subrow_kind(F.col("value"), F.col("pos")))
    n = F.row_number().over(Window.partitionBy("sheet", "row_no", "kind").orderBy("pos"))
    return kinds.withColumn("n", n).select("sheet", "row_no", "pos", F.when(F.col("n") == 1, F.col("kind")).otherwise(F.concat_ws("_", "kind", "n")).alias("field"), F.trim("value").alias("value"))


def region_kind(row_start: Column, span_cols: Column, span_rows: Column) -> Column:
    return F.when((row_start <= 3) & (span_cols >= 3), "TITLE").when((span_cols >= 2) & (span_rows == 1), "HEADER").otherwise("DATA")


def explicit_totals(grid: DataFrame, headers: DataFrame) -> DataFrame:
    """Sums of the amount columns over the rows under the header that speak of totals; ``headers`` is (sheet, header_row)."""
    joined = grid.join(headers, "sheet")
    heads = joined.filter("row_no = header_row").select("sheet", F.posexplode("cells").alias("pos", "field")).withColumn("field", F.trim("field")).filter(S.is_financial(F.col("field")))
    rows = joined.filter("row_no > header_row").filter(F.lower(F.array_join("cells", " ")).rlike("total|sum"))
    number = S.number_of(F.trim(F.regexp_replace("value", "[,$]", "")))
    cells = rows.select("sheet", F.posexplode("cells").alias("pos", "value")).join(heads, ["sheet", "pos"]).select("sheet", "field", number.alias("n"))
    return cells.filter("n IS NOT NULL").groupBy("sheet", "field").agg(F.sum("n").alias("total"))


def label_blocks(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, no, line) to labels and values: ``label: value``, or a line that ends in a colon and the lines up to the next label."""
    text = F.trim("line")
    label = F.regexp_extract(text, "^([A-Za-z][A-Za-z0-9 /#_.-]{0,59}):\\s*(.*)$", 1)
    marked = lines.filter(text != "").select("doc_id", "no", text.alias("line"), label.alias("label"))
    w = Window.partitionBy("doc_id").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    island = marked.withColumn("block", F.sum((F.col("label") != "").cast("int")).over(w)).filter("block > 0")
    value = F.when(F.col("label") != "", F.trim(F.regexp_replace("line", "^[^:]*:", ""))).otherwise(F.col("line"))
    parts = F.array_sort(F.collect_list(F.when(value != "", F.struct("no", value.alias("v")))))
    blocks = island.groupBy("doc_id", "block").agg(F.max("label").alias("label"), F.array_join(F.transform(parts, lambda p: p["v"]), " ").alias("value"))
    return blocks.filter("value <> ''")


def verbatim_dates(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """Entities (doc_id, name, value) without date fields whose value, with or without its time, the text lacks."""
    joined = entities.join(one_text(docs).select("doc_id", F.lower("text").alias("low")), "doc_id")
    day = F.trim(F.regexp_replace("value", "\\s+[0-9]{1,2}:[0-9]{2}.*$", ""))
    there = F.contains("low", F.lower("value")) | ((F.length(day) >= 4) & F.contains("low", F.lower(day)))
    return joined.filter(~F.lower("name").rlike(DATE_NAMES) | (F.trim("value") == "") | there).drop("low")


def grounded_signals(signals: DataFrame, docs: DataFrame, hints: Mapping[str, Sequence[str]], cap: float = 0.45) -> DataFrame:
    """Signals (doc_id, type, keyword, description, snippet, confidence) with whether the text bears them out; none is dropped."""
    joined = signals.join(one_text(docs).select("doc_id", F.lower("text").alias("low")).withColumn("words", F.split("low", "\\s+")), "doc_id")
    tokens = lambda c, n: F.array_distinct(F.filter(F.split(F.lower(c), "\\s+"), lambda w: F.length(w) >= n))
    share = lambda t: F.size(F.array_intersect(t, "words")) / F.greatest(F.size(t), F.lit(1))
    snippet = (F.length("snippet") >= 3) & (F.contains("low", F.lower("snippet")) | (share(tokens("snippet", 3)) >= 0.25))
    trigger = (F.col("keyword") != "") & (F.contains("low", F.lower("keyword")) | F.arrays_overlap(tokens("keyword", 4), "words"))
    told = F.filter(tokens("description", 5), lambda w: ~w.isin(*PLAIN_WORDS))
    described = (F.size(told) > 0) & (share(told) >= 0.3)
    hint = F.lit(False)
    for kind, words in hints.items():
        hint = hint | ((F.lower("type") == kind) & F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.col("low"), w)))
    ok = F.coalesce(snippet, F.lit(False)) | F.coalesce(trigger, F.lit(False)) | F.coalesce(described, F.lit(False)) | hint
    return joined.withColumn("verified", ok).select("doc_id", "type", "keyword", F.when(ok, F.col("confidence")).otherwise(F.least("confidence", F.lit(cap))).alias("confidence"), "verified")


def merge_ocr(text_fields: DataFrame, ocr: DataFrame) -> DataFrame:
    """Fields (doc_id, page, name, value, confidence) of the page text with the OCR's confidence where it is above 0, and the OCR's own fields."""
    key = F.trim(F.regexp_replace(F.lower("name"), "[\\s:]+", " "))
    a = text_fields.withColumn("k", key)
    b = ocr.withColumn("k", key).groupBy("doc_id", "page", "k").agg(F.max_by(F.struct("name", "value"), F.struct("confidence", "name", "value")).alias("o"), F.max("confidence").alias("o_confidence")).select("*", F.col("o.name").alias("o_name"), F.col("o.value").alias("o_value")).drop("o")
    both = a.join(b, ["doc_id", "page", "k"], "full_outer")
    sure = F.when(F.col("o_confidence") > 0, F.col("o_confidence")).otherwise(F.col("confidence"))
    return both.select("doc_id", "page", F.coalesce("name", "o_name").alias("name"), F.coalesce("value", "o_value").alias("value"), F.coalesce(sure, F.lit(0.0)).alias("confidence"))


def taxonomy(text: Column, kinds: Sequence[tuple[str, Sequence[str]]], otherwise: str) -> Column:
    """The first kind of which a word occurs in the text."""
    out = F
    for kind, words in kinds:
        out = out.when(F.exists(F.array(*(F.lit(w) for w in words)), lambda w: F.contains(F.lower(text), w)), kind)
    return out.otherwise(otherwise)


#: Headings of sections and the field that each gives, none for general ones. Fixed values.
SECTIONS = {"cause(s) of action": "Causes of Action", "causes of action": "Causes of Action", "case complaint summary": "Case Complaint Summary", "complaint summary": "Case Complaint Summary", "overview": None, "case details": None}
NO_NAMES = ("field", "details", "key", "value", "source", "trellis")  # fixed values


def table_fields(rows: DataFrame) -> DataFrame:
    """(doc_id, tbl, row, col, field, value, confidence) from table rows (doc_id, tbl, row, cells).

    In a table of rows in capitals over rows of values, each such pair of rows gives its columns (0.93); in
    any other the first two cells of a row are label and value (0.95). The first of each label in a document
    counts, later tables before earlier ones. A table is one group and at most as long as a page's table is.
    """
    full = rows.select("doc_id", "tbl", "row", F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))).alias("cells")).filter(F.exists("cells", lambda c: c != ""))
    own = Window.partitionBy("doc_id", "tbl")
    order = own.orderBy("row")
    marked = full.withColumn("upper", F.forall("cells", lambda c: c == F.upper(c)))
    marked = marked.withColumns({"next_upper": F.lead("upper").over(order), "next": F.lead("cells").over(order), "next_row": F.lead("row").over(order)})
    opens = F.col("upper") & ~F.coalesce("next_upper", F.lit(True))
    told = marked.withColumns({"opens": opens, "n": F.count(F.lit(1)).over(own), "capitals": F.sum(F.col("upper").cast("int")).over(own), "pairs": F.sum(opens.cast("int")).over(own)})
    paired = (F.col("n") >= 2) & (F.col("capitals") >= 0.4 * F.col("n")) & (F.col("pairs") >= 2)
    cells = F.arrays_zip("cells", "next")
    down = told.filter(paired & F.col("opens")).select("doc_id", "tbl", F.col("next_row").alias("row"), F.posexplode(cells).alias("col", "c"), F.lit(0.93).alias("confidence"))
    down = down.select("doc_id", "tbl", "row", "col", F.col("c.cells").alias("field"), F.col("c.next").alias("value"), "confidence")
    across = told.filter(~paired & (F.size("cells") >= 2)).select("doc_id", "tbl", "row", F.lit(1).alias("col"), F.get("cells", F.lit(0)).alias("field"), F.get("cells", F.lit(1)).alias("value"), F.lit(0.95).alias("confidence")).filter("field <> value")
    return _first_named(down.unionByName(across), [F.desc("tbl"), F.col("row"), F.col("col")])


def _first_named(fields: DataFrame, order: list) -> DataFrame:
    named = fields.withColumn("field", F.trim(F.regexp_replace(F.trim("field"), "^:+|:+$", ""))).filter("field <> '' AND trim(value) <> ''").filter(~F.lower("field").isin(*NO_NAMES))
    w = Window.partitionBy("doc_id", F.upper("field")).orderBy(*order)
    return named.withColumn("r", F.row_number().over(w)).filter("r = 1").drop("r")


def section_fields(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, para, field, value, confidence) from paragraphs (doc_id, para, text).

    The lines under a known heading up to the next one or a source line, joined (0.90), and ``label: value``
    lines outside headings (0.85); the first of each label counts.
    """
    t = paragraphs.select("doc_id", "para", F.trim("text").alias("text"))
    head = F.regexp_replace(F.lower("text"), ":+$", "")
    known = head.isin(*SECTIONS)
    stop = known | F.col("text").startswith("Source:")
    w = Window.partitionBy("doc_id").orderBy("para").rowsBetween(Window.unboundedPreceding, 0)
    marked = t.withColumn("head", F.when(known & (F.length("text") <= 300), head)).withColumn("start", F.last(F.when(stop, F.struct("para", "head")), ignorenulls=True).over(w))
    names = F.create_map(*(F.lit(x) for k, v in SECTIONS.items() if v for x in (k, v)))
    under = marked.filter("start.head IS NOT NULL AND start.para <> para AND text <> ''").withColumn("field", F.try_element_at(names, F.col("start.head"))).filter("field IS NOT NULL")
    lines = F.array_sort(F.collect_list(F.struct("para", "text")))
    sections = under.groupBy("doc_id", F.col("start.para").alias("para"), "field").agg(F.array_join(F.transform(lines, lambda x: x["text"]), " | ").alias("value")).withColumn("confidence", F.lit(0.90))
    inline = "^([^\n]{1,59}?): (.+)$"
    pairs = t.filter(~known & (F.length("text") <= 300) & ~F.col("text").startswith("http") & F.col("text").rlike(inline))
    pairs = pairs.select("doc_id", "para", F.regexp_extract("text", inline, 1).alias("field"), F.regexp_extract("text", inline, 2).alias("value"), F.lit(0.85).alias("confidence"))
    return _first_named(sections.unionByName(pairs), [F.col("para")])
