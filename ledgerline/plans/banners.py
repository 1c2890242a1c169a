"""Banner facts of print-style sheets, one for each customer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import banner
from ledgerline.plans.registry import query
from ledgerline.sources.fixtures import table

#: Rows of cells in the SQL that both engines read; {a} makes an array.
_BANNER = """
SELECT concat('tab ', CAST(c_custkey AS STRING)) AS sheet, CAST(row_no AS INT) AS row_no,
 CASE row_no
  WHEN 1 THEN CASE CAST(c_custkey % 6 AS INT)
   WHEN 0 THEN {a}('Acme Services LLC - Loss Run Report', NULL, c_name) WHEN 1 THEN {a}(concat(c_name, ' \u2014 Claims Summary'), NULL, NULL) WHEN 2 THEN {a}('Prepared By: Beta Desk   Report Date: 1/2/2024', 'PERIOD ENDED', '12/31/2025')
   WHEN 3 THEN {a}('\u2014 hidden', 'Delta Group - East', 'Commercial Property') WHEN 4 THEN {a}('12,345', ' ', concat('Run of ', c_name)) ELSE {a}('Claims Administrator', concat('Desk ', c_mktsegment), 'Omega Trust') END
  WHEN 2 THEN CASE CAST(c_custkey % 5 AS INT)
   WHEN 0 THEN {a}(concat('CONTRACT NUMBER:PLIC/', CAST(c_custkey AS STRING), '   Treaty: T-1|Unknown: x'), 'note', '1:2') WHEN 1 THEN {a}('POLICY', 'LOB', 'CYBER') WHEN 2 THEN {a}('Policy', c_mktsegment, 'LOB', 'Marine')
   WHEN 3 THEN {a}('Account', NULL, NULL, NULL, c_name) ELSE {a}('Treaty:', 'T-9', 'lower') END
  WHEN 3 THEN CASE CAST(c_custkey % 4 AS INT)
   WHEN 0 THEN {a}('UNDERWRITING PERIOD', '01/01/2024 to 12/31/2024') WHEN 1 THEN {a}('Policy Period: 1 Jan 2024 - 31 Dec 2024') WHEN 2 THEN {a}('Coverage Period', NULL, 'Rolling') ELSE {a}('policy  period: 2024-01-01 \u2013 2024-12-31 | As Of: 3.4.2024') END
  WHEN 4 THEN {a}(CASE WHEN c_custkey % 3 = 0 THEN concat('Zurich Insurance ', c_name) WHEN c_custkey % 3 = 1 THEN 'Annual Loss Run \u2014 All States' ELSE '(see next Company page)' END)
  WHEN 5 THEN {a}(concat(c_name, ' Holdings'), CASE WHEN c_custkey % 2 = 0 THEN 'Workers Comp' END)
  WHEN 6 THEN {a}('Gamma Ltd', CASE WHEN c_custkey % 7 = 1 THEN 'Insured' END, CASE WHEN c_custkey % 7 = 1 THEN 'Named Person' END)
  WHEN 7 THEN {a}('Carrier Corp', 'B', 'C', 'General Liability')
  WHEN 8 THEN {a}('Claim No', 'Loss Date', 'Paid')
  ELSE {a}(CASE WHEN row_no > 15 THEN 'Program Year' ELSE 'Reinsurer' END, concat('R', CAST(row_no AS STRING))) END AS cells
FROM (SELECT *, {rows} AS row_no FROM {customer}) t
WHERE row_no <> 9 OR c_custkey % 11 = 4
"""
#: Some sheets have no header: their first rows count, up to the fifteenth.
_HEADER = "CASE WHEN c_custkey % 11 = 4 THEN NULL ELSE 8 END"
_DUCK = _BANNER.replace("AS STRING", "AS VARCHAR").format(a="list_value", customer="customer", rows="unnest(range(1, 18))")
_LABELS = "MAP {" + ", ".join("'{}': '{}'".format(*kv) for kv in banner.LABELS.items()) + "}"
_QUOTE = lambda p: "'" + p.replace("'", "''") + "'"
_LINES = " ".join(f"WHEN regexp_matches(v, {_QUOTE('(?i)' + p)}) THEN '{name}'" for p, name in banner.BUSINESS_LINES)
_CANON = lambda x: f"{_LABELS}[regexp_replace(lower(rtrim(trim({x}), ':')), '\\s+', ' ', 'g')]"
_SQL = f"""
WITH grid AS ({_DUCK}),
 heads AS (SELECT concat('tab ', CAST(c_custkey AS VARCHAR)) AS sheet, {_HEADER} AS header_row FROM customer),
 cells AS (SELECT sheet, row_no, i AS col, trim(cells[i]) AS v FROM (SELECT sheet, row_no, cells, unnest(range(1, len(cells) + 1)) AS i FROM grid JOIN heads USING (sheet) WHERE row_no < coalesce(header_row, 16)) WHERE trim(cells[i]) <> ''),
 numbered AS (SELECT *, row_number() OVER (PARTITION BY sheet, row_no ORDER BY col) AS k, count(*) OVER (PARTITION BY sheet, row_no) AS n FROM cells),
 parts AS (SELECT *, trim(part) AS p FROM (SELECT *, unnest(string_split_regex(v, '\\s{{3,}}|\\|')) AS part, unnest(range(100)) AS seq FROM numbered WHERE contains(v, ':') AND NOT regexp_matches(v, '^\\d')) WHERE part IS NOT NULL),
 inside AS (SELECT sheet, row_no, col, k, seq, {_CANON(f"regexp_extract(p, {_QUOTE(banner.INLINE)}, 1)")} AS field, trim(regexp_extract(p, {_QUOTE(banner.INLINE)}, 2)) AS value FROM parts),
 taken AS (SELECT DISTINCT sheet, row_no, k FROM inside WHERE field IS NOT NULL AND value <> ''),
 pairs AS (SELECT a.*, b.v AS value, b.col AS value_col, {_CANON("a.v")} AS field FROM numbered a JOIN numbered b ON a.sheet = b.sheet AND a.row_no = b.row_no AND b.k = a.k + 1 ANTI JOIN taken t ON a.sheet = t.sheet AND a.row_no = t.row_no AND a.k = t.k),
 fit AS (SELECT *, k - row_number() OVER (PARTITION BY sheet, row_no ORDER BY k) AS island FROM pairs WHERE field IS NOT NULL AND regexp_matches(v, {_QUOTE(banner.LABEL_LIKE)}) AND value_col - col <= 3 AND regexp_matches(value, '^[\\dA-Z]')),
 beside AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sheet, row_no, island ORDER BY k) AS nth FROM fit) WHERE nth % 2 = 1),
 used AS (SELECT * FROM taken UNION SELECT sheet, row_no, k FROM beside UNION SELECT sheet, row_no, k + 1 FROM beside),
 free AS (SELECT n.* FROM numbered n ANTI JOIN used u ON n.sheet = u.sheet AND n.row_no = u.row_no AND n.k = u.k WHERE n < 4 AND NOT contains(v, ':') AND NOT regexp_matches(v, {_QUOTE(banner.NUMBERS)})),
 administered AS (SELECT sheet FROM inside WHERE row_no = 1 AND field = 'TPA Name' UNION SELECT sheet FROM beside WHERE row_no = 1 AND field = 'TPA Name'),
 cut AS (SELECT *, trim(string_split_regex(v, '\\s*[\u2014\u2013]\\s*')[1]) AS name FROM free),
 named AS (SELECT * REPLACE (CASE WHEN contains(name, ' - ') AND regexp_matches(substr(name, instr(name, ' - ') + 3), {_QUOTE(banner.REPORT_TAIL)}) THEN trim(substr(name, 1, instr(name, ' - ') - 1)) ELSE name END AS name) FROM cut),
 leads AS (SELECT sheet, row_no, coalesce(min(k) FILTER (name <> ''), 99) AS until FROM named WHERE row_no = 1 AND sheet NOT IN (FROM administered) GROUP BY ALL),
 captions AS (SELECT named.*, until FROM named LEFT JOIN leads USING (sheet, row_no)),
 spoken AS (SELECT sheet, row_no, col, 0 AS seq, 'TPA Name' AS field, name AS value FROM captions WHERE k = until
  UNION ALL SELECT sheet, row_no, col, 1, 'company', name FROM captions WHERE k = until AND regexp_matches(name, {_QUOTE(banner.COMPANY)})
  UNION ALL SELECT sheet, row_no, col, 0, CASE WHEN note THEN 'Sheet Title' WHEN line IS NOT NULL THEN 'Line of Business' WHEN company THEN 'company' ELSE 'Sheet Title' END,
   CASE WHEN NOT note AND line IS NOT NULL THEN line WHEN NOT note AND company THEN v WHEN regexp_matches(v, {_QUOTE(banner.LOSS_RUN)}) THEN trim(regexp_extract(v, {_QUOTE(banner.LOSS_RUN)}, 1)) ELSE v END
   FROM (SELECT *, regexp_matches(v, {_QUOTE(banner.NOTE)}) AS note, CASE {_LINES} END AS line, regexp_matches(v, {_QUOTE(banner.COMPANY)}) AS company FROM captions WHERE until IS NULL OR k > until)),
 ranked AS (SELECT * REPLACE (CASE WHEN field <> 'company' THEN field WHEN row_number() OVER (PARTITION BY sheet, field ORDER BY row_no, col, seq) = 1 THEN 'Carrier' ELSE 'Insured Name' END AS field) FROM spoken),
 told AS (SELECT sheet, row_no, 1 AS pass, col AS spot, seq, field, value, col, 'title_kv' AS source FROM inside WHERE field IS NOT NULL
  UNION ALL SELECT sheet, row_no, 2, k, 0, field, value, value_col, 'title_kv' FROM beside UNION ALL SELECT sheet, row_no, 3, col, seq, field, value, col, 'title_banner' FROM ranked),
 periods AS (SELECT *, field IN ('Underwriting Period', 'Policy Period') AND regexp_matches(value, {_QUOTE(banner.DATE_RANGE)}) AS period FROM told WHERE value <> ''),
 each AS (SELECT * FROM periods WHERE NOT period UNION ALL SELECT * REPLACE (field || ' Start' AS field, regexp_extract(value, {_QUOTE(banner.DATE_RANGE)}, 1) AS value) FROM periods WHERE period
  UNION ALL SELECT * REPLACE (field || ' End' AS field, regexp_extract(value, {_QUOTE(banner.DATE_RANGE)}, 2) AS value) FROM periods WHERE period)
SELECT sheet, field, value, source, row_no AS excel_row, CAST(col AS INTEGER) AS excel_col FROM (SELECT *, row_number() OVER (PARTITION BY sheet, field ORDER BY row_no, pass, spot, seq) AS r FROM each) WHERE r = 1
UNION ALL SELECT DISTINCT sheet, 'Sheet Name', sheet, 'sheet_tab', 0, 0 FROM grid
"""


@query(_SQL)
def x09_banner_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    rows = spark.sql(_BANNER.format(a="array", customer="{customer}", rows="explode(sequence(1, 17))"), customer=customer)
    heads = customer.selectExpr("concat('tab ', CAST(c_custkey AS STRING)) AS sheet", f"{_HEADER} AS header_row")
    return banner.banner_fields(rows, heads)
