"""SQL of the searches and of the conversation repair, for tables of test size."""

from __future__ import annotations

TOP_K = """
WITH told AS (SELECT row_number() OVER () AS r, vec_id, len(embedding) AS dim, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
 asked AS (SELECT min(r) AS r, vec_id, dim, q FROM told WHERE vec_id % 50 = 0 GROUP BY vec_id, dim, q),
 scores AS (SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(range(1, a.dim + 1), lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM asked a JOIN told b ON a.dim = b.dim AND a.r <> b.r)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scores)
WHERE rank <= 5
"""

_TERMS = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
LEXICAL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format("coalesce(text, '')")} AS w FROM documents),
 told AS (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, w FROM d WHERE len(w) > 0),
 totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM told),
 terms AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM told) GROUP BY r, term),
 weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * (SELECT docs FROM totals) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM terms GROUP BY term),
 norms AS (SELECT r, doc_id, 100 - 90 + (90 * n * docs) // l AS m FROM told, totals),
 items AS (SELECT row_number() OVER () AS item, item_id, {_TERMS.format("text")} AS w FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)),
 asked AS (SELECT DISTINCT item, item_id, unnest(w) AS term FROM items),
 scores AS (SELECT item, item_id, r, doc_id, CAST(sum(wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
  FROM asked JOIN weights USING (term) JOIN terms USING (term) JOIN norms USING (r) GROUP BY item, item_id, r, doc_id)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS FIRST) AS INTEGER) AS rank FROM scores WHERE score > 0)
WHERE rank <= 10
"""


def _add(state: str, cost: str, edits: str) -> str:
    """A state's value, its cost in nine digits and then its edits, after more of both."""
    return f"lpad(CAST(CAST({state}[1:9] AS INTEGER) + {cost} AS VARCHAR), 9, '0') || {state}[10:] || '{edits}'"


_CRC32 = "4294967295 - list_reduce(list_concat([4294967295], list_transform(string_split(name, ''), lambda c: unicode(c))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1))))"
_FREE = "least(v0, v1, v3)"
REPAIR = f"""
WITH RECURSIVE named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
 kinds AS (SELECT *, ({_CRC32}) % 20 AS kind FROM named),
 convs AS (SELECT conv_id, row_number() OVER () AS k FROM (SELECT DISTINCT conv_id FROM conversations)),
 damaged AS (SELECT k, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds JOIN convs ON kinds.conv_id IS NOT DISTINCT FROM convs.conv_id),
 placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn NULLS FIRST, role, text) AS i, rtrim(text, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS body FROM damaged),
 seen AS (SELECT *, min(i) OVER (PARTITION BY k, role, text) < i AS again FROM placed),
 turns AS (SELECT k, i, turn, role, text, role[1:1] AS initial, CASE WHEN body = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM seen),
 steps AS (SELECT *, fault IN ('', 'truncated') AS may, CAST(fault = 'truncated' AS INTEGER) AS cut FROM turns),
 walk(k, i, v0, v1, v2, v3) AS (
  SELECT k, CAST(0 AS BIGINT), '000000000', CAST(NULL AS VARCHAR), '000000002I', '000000004II' FROM convs
  UNION ALL
  SELECT k, i, b0, b1, least(b2, {_add("b0", "2", "I")}, {_add("b1", "2", "I")}, {_add("b3", "2", "I")}), least(b3, {_add("b2", "2", "I")}, {_add("b0", "4", "II")}, {_add("b1", "4", "II")})
  FROM (SELECT w.k, s.i, {_add("v0", "3", "D")} AS b0,
   least({_add("v1", "3", "D")}, CASE WHEN may AND initial = 's' THEN {_add("v0", "cut", "K")} END) AS b1,
   least({_add("v2", "3", "D")}, CASE WHEN may AND initial = 'u' THEN {_add(_FREE, "cut", "K")} END, CASE WHEN may THEN {_add(_FREE, "2 + cut", "R")} END) AS b2,
   least({_add("v3", "3", "D")}, CASE WHEN may AND initial = 'a' THEN {_add("v2", "cut", "K")} END, CASE WHEN may THEN {_add("v2", "2 + cut", "R")} END) AS b3
   FROM walk w JOIN steps s ON s.k = w.k AND s.i = w.i + 1)),
 best AS (SELECT k, CAST(least(v0, v3)[1:9] AS BIGINT) AS cost, least(v0, v3)[10:] AS audit FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i DESC) AS back FROM walk) WHERE back = 1),
 letters AS (SELECT k, audit, unnest(range(1, len(audit) + 1)) AS e FROM best),
 edits AS (SELECT k, e, audit[e] AS edit, e - len(regexp_replace(audit[1:e], '[^I]', '', 'g')) AS i, e - len(regexp_replace(audit[1:e], '[^D]', '', 'g')) AS kept FROM letters),
 known AS (SELECT edits.k, e, edit, kept, role, text, bool_or(edit = 'K' AND kept = 1 AND initial = 's') OVER (PARTITION BY edits.k) AS led FROM edits LEFT JOIN turns ON edits.k = turns.k AND edits.i = turns.i WHERE edit <> 'D'),
 lines AS (SELECT k, e, CASE WHEN edit = 'K' THEN role WHEN (kept - CAST(led AS INTEGER)) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END AS line FROM known),
 hashes AS (SELECT k, sha256(string_agg(line, chr(10) ORDER BY e)) AS h FROM lines GROUP BY k),
 pairs AS (SELECT k, initial, lag(initial) OVER (PARTITION BY k ORDER BY i) AS previous, i FROM turns),
 illegal AS (SELECT k, count(*) AS n FROM pairs WHERE i > 1 AND previous || initial NOT IN ('su', 'ua', 'au') GROUP BY k),
 faults AS (SELECT k, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated FROM turns GROUP BY k)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(n, 0) AS illegal, cost, audit, coalesce(h, sha256('')) AS repaired_sha256
FROM convs JOIN best USING (k) LEFT JOIN faults USING (k) LEFT JOIN illegal USING (k) LEFT JOIN hashes USING (k)
"""
