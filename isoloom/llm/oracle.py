"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from isoloom.llm.license_scan import TEMPLATES, THRESHOLD
from isoloom.llm.line_dedup import LOWER, UPPER

_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def _lower(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


LINE_DEDUP = f"""
WITH lines AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (SELECT *, trim({_lower('line')}, {_BLANKS}) AS key FROM lines),
hot AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT k.doc_id, k.line, k.pos, h.key IS NOT NULL AS gone FROM keyed k LEFT JOIN hot h ON k.key = h.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def _license_scan() -> str:
    rows = ", ".join("('{}', '{}')".format(k, " ".join(v.split()).replace("'", "''")) for k, v in sorted(TEMPLATES.items()))
    words = "list_filter(regexp_split_to_array(lower(t), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"
    pairs = "CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END"
    return f"""
WITH template AS (SELECT license, {words} AS w FROM (VALUES {rows}) v(license, t)),
template_pair AS (SELECT DISTINCT license, unnest({pairs}) AS p FROM template),
template_size AS (SELECT license, count(*) AS m FROM template_pair GROUP BY license),
unit AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS t, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents
  UNION ALL SELECT doc_id, text, -1 FROM documents WHERE contains(text, chr(10))),
worded AS (SELECT doc_id, line, {words} AS w FROM unit),
unit_pair AS (SELECT DISTINCT doc_id, line, unnest({pairs}) AS p FROM worded),
unit_size AS (SELECT doc_id, line, count(*) AS n FROM unit_pair GROUP BY ALL),
common AS (SELECT doc_id, line, license, count(*) AS c FROM unit_pair JOIN template_pair USING (p) GROUP BY ALL),
dice AS (SELECT doc_id, line, license, 2.0::double * c / (n + m) AS dice FROM common JOIN unit_size USING (doc_id, line) JOIN template_size USING (license)),
matched AS (SELECT * FROM dice WHERE dice >= {THRESHOLD}::double),
best AS (SELECT doc_id, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses, arg_min(license, (-dice, license)) AS best_license, max(dice) AS best_dice FROM matched GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, best_license, coalesce(best_dice, 0.0::double) AS best_dice
FROM documents d LEFT JOIN best USING (doc_id)
"""


NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id
FROM documents d JOIN r USING (doc_id) LEFT JOIN n USING (doc_id) GROUP BY d.doc_id, n.n
"""

DECONTAMINATE = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
bw AS (SELECT item_id, regexp_extract_all({_lower('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
bwin AS (SELECT DISTINCT item_id, least(10, len(ws)) AS k, unnest(list_transform(range(1, len(ws) - least(10, len(ws)) + 2), lambda i: array_to_string(ws[i:i + least(10, len(ws)) - 1], ' '))) AS win FROM bw WHERE len(ws) > 0),
ks AS (SELECT DISTINCT k FROM bwin),
dwin AS (SELECT doc_id, k, unnest(range(1, len(ws) - k + 2)) AS pos, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS win FROM dw, ks WHERE len(ws) >= k),
hit AS (SELECT doc_id, pos, k, item_id FROM dwin JOIN bwin USING (k, win)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(pos, pos + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(i) AS n_items, string_agg(i, ',' ORDER BY i) AS names FROM (SELECT DISTINCT doc_id, item_id::varchar AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL = {"op4_line_dedup": LINE_DEDUP, "op6_license_scan": _license_scan(), "op7_ngram_join": NGRAM_JOIN, "op9_decontaminate": DECONTAMINATE}
