"""Fields of word documents, one for each order, with five layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import blocks
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import CLAIMS_CTE, claims

#: Layout, block, type, text (@: the claim's id, %: its claimant), table, row, column.
_BLOCKS = (
    (0, 1, "paragraph", "Claim No : @", None, None, None), (0, 2, "paragraph", "claim  number: later", None, None, None), (0, 3, "table_row", "Policy # | P-@ | x", 0, 0, None), (0, 4, "table_cell", "Policy #", 0, 0, 0), (0, 5, "table_cell", "P-@", 0, 0, 1), (0, 6, "table_cell", "x", 0, 0, 2),
    (0, 7, "table_row", "Adjuster name | %", 0, 1, None), (0, 8, "table_cell", "Adjuster name", 0, 1, 0), (0, 9, "table_cell", "%", 0, 1, 1), (0, 10, "table_row", "Tax (2nd) | 5", 0, 2, None), (0, 11, "table_cell", "Tax (2nd)", 0, 2, 0), (0, 12, "table_cell", "5", 0, 2, 2),
    (1, 1, "paragraph", "nothing here", None, None, None), (1, 2, "paragraph", "The Policy", None, None, None), (1, 3, "paragraph", "Number", None, None, None), (1, 4, "paragraph", "-", None, None, None), (1, 5, "paragraph", "pol/@ of %", None, None, None), (1, 6, "paragraph", "uninsured; Insured", None, None, None), (1, 7, "paragraph", "%", None, None, None),
    (1, 8, "paragraph", "no claim number", None, None, None), (1, 9, "paragraph", "Loss Date 1/2/2024", None, None, None), (1, 10, "paragraph", "insured again", None, None, None),
    (2, 1, "table_cell", "Status", 1, 4, None), (2, 2, "table_cell", "open @", 1, 4, 1), (2, 3, "table_cell", "date of loss", 1, 4, 2), (2, 4, "table_cell", "1/1/2024", 1, 5, 3), (2, 5, "table_cell", "Total incurred", 2, 0, 0), (2, 6, "table_cell", "9", 2, 0, 1), (2, 7, "table_row", "Total Incurred | 10 | 11", 2, 0, None), (2, 8, "paragraph", "o'brien-smith no.2b: %", None, None, None),
    (3, 1, "paragraph", "Time 10:30", None, None, None), (3, 2, "paragraph", "A:", None, None, None), (3, 3, "paragraph", " ", None, None, None), (3, 4, "paragraph", None, None, None, None), (3, 5, "table_row", "Status |", 0, 0, None), (3, 6, "paragraph", "Carrier: % ", None, None, None), (3, 7, "paragraph", "CARRIER: other", None, None, None),
    (4, 1, "paragraph", "no field at all", None, None, None), (4, 2, "paragraph", "Effective", None, None, None), (4, 3, "paragraph", "dates", None, None, None),
)
_COLUMNS = "layout, block_id, block_type, text, table_index, row_index, col_index"
_ROWS = ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'" for x in r) + ")" for r in _BLOCKS)
_Q = lambda p: "'" + p.replace("'", "''") + "'"
_MAP = "MAP {" + ", ".join("'{}': '{}'".format(*kv) for kv in blocks.LABELS.items()) + "}"
_TITLE = "array_to_string(list_transform(range(1, len({0}) + 1), lambda i: CASE WHEN i > 1 AND regexp_matches(({0})[i - 1:i - 1], '[A-Za-z]') THEN lower(({0})[i:i]) ELSE upper(({0})[i:i]) END), '')"
_NAME = lambda x: f"coalesce({_MAP}[regexp_replace(lower(trim({x})), '\\s+', ' ', 'g')], {_TITLE.format(f'trim({x})')})"
_PATTERNS = "(VALUES " + ", ".join(f"({_Q('(?i)' + p)}, '{name}')" for p, name in blocks.FALLBACKS) + ") AS t(p, field)"
_FOUND = " UNION ALL ".join(f"SELECT doc_id, '{name}' AS field, trim(regexp_extract(body, {_Q('(?i)' + p)}, 1)) AS value FROM bodies WHERE regexp_matches(body, {_Q('(?i)' + p)})" for p, name in blocks.FALLBACKS)


@query(
    f"""WITH {CLAIMS_CTE}, t({_COLUMNS}) AS (VALUES {_ROWS}),
 b AS (SELECT rec AS doc_id, block_id, block_type, trim(replace(replace(text, '@', claim_id), '%', claimant_name)) AS text, table_index, row_index, col_index FROM claims JOIN t ON layout = rec % 5 WHERE trim(text) <> ''),
 one AS (SELECT 1 AS pass, doc_id, block_id, {_NAME(f"regexp_extract(text, {_Q(blocks.INLINE)}, 1)")} AS field, trim(regexp_extract(text, {_Q(blocks.INLINE)}, 2)) AS value, 0.95 AS confidence, text FROM b WHERE regexp_matches(text, {_Q(blocks.INLINE)})),
 parts AS (SELECT *, list_filter(list_transform(string_split(text, '|'), lambda x: trim(x)), lambda x: x <> '') AS p FROM b WHERE block_type = 'table_row'),
 two AS (SELECT 2, doc_id, block_id, {_MAP}[lower(p[1])], p[2], 0.92, text FROM parts WHERE len(p) >= 2 AND lower(p[1]) IN {tuple(blocks.LABELS)}),
 cells AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY block_id) AS k FROM b WHERE block_type = 'table_cell'),
 three AS (SELECT 3, l.doc_id, r.block_id, {_NAME("l.text")}, r.text, 0.93, l.text || ': ' || r.text FROM cells l JOIN cells r ON l.doc_id = r.doc_id AND r.k = l.k + 1 AND l.table_index = r.table_index AND l.row_index = r.row_index AND r.col_index = coalesce(l.col_index, 0) + 1
  WHERE len(l.text) <= 60 AND len(r.text) <= 200 AND regexp_matches(lower(l.text), '{"|".join(blocks.LABEL_WORDS)}')),
 told AS (FROM one UNION ALL FROM two UNION ALL FROM three),
 bodies AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY block_id) AS body FROM b WHERE doc_id NOT IN (SELECT doc_id FROM told) GROUP BY doc_id),
 found AS ({_FOUND}),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY pass, block_id) AS r FROM told)
SELECT doc_id, field, value, CAST(confidence AS DOUBLE) AS confidence, CAST(block_id AS INTEGER) AS source_block, text AS source_text FROM ranked WHERE r = 1
UNION ALL SELECT doc_id, field, value, 0.8, NULL, value FROM found"""
)
def x17_block_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    layouts = F.broadcast(spark.createDataFrame(_BLOCKS, "layout int, block_id int, block_type string, text string, table_index int, row_index int, col_index int"))
    c = claims(spark, sf_dir).withColumn("layout", (F.col("rec") % 5).cast("int")).join(layouts, "layout")
    text = F.replace(F.replace("text", F.lit("@"), F.col("claim_id")), F.lit("%"), F.col("claimant_name"))
    return blocks.block_fields(c.select(F.col("rec").alias("doc_id"), "block_id", "block_type", text.alias("text"), "table_index", "row_index", "col_index"))
