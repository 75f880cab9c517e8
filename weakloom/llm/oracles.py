"""DuckDB SQL giving the rows of the registered queries that SQL can express.

Without SQL: op1 (learned profiles), op2 (windows depend on token counts), op3 and op9 (token ids), op10 (learned
field) and the pipeline. They are tested against plain versions.
"""

from __future__ import annotations

from weakloom.llm.license_scan import TEMPLATES

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FOLDED = f"translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}')"
_ALNUM = rf"regexp_extract_all({{}}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_BLANKS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no
  FROM documents),
spoken AS (SELECT * FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
kinds AS (SELECT line, length(line) AS n, min((doc_id, no)) AS first FROM spoken GROUP BY line),
long_kinds AS (SELECT * FROM kinds WHERE n >= 24),
near AS (
  SELECT DISTINCT CASE WHEN a.first < b.first THEN b.line ELSE a.line END AS line
  FROM long_kinds a JOIN long_kinds b ON b.n BETWEEN a.n - 2 AND a.n AND a.line <> b.line AND levenshtein(a.line, b.line) <= 2),
judged AS (
  SELECT s.doc_id, s.no, n.line IS NOT NULL AS near, n.line IS NOT NULL OR (s.doc_id, s.no) <> k.first AS gone
  FROM spoken s JOIN kinds k USING (line) LEFT JOIN near n USING (line)),
per_line AS (
  SELECT l.doc_id, l.no, l.line, coalesce(j.gone, false) AS gone, coalesce(j.gone AND j.near, false) AS near
  FROM lines l LEFT JOIN judged j USING (doc_id, no)),
found AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (near) AS n_near,
         string_agg(line, chr(10) ORDER BY no) FILTER (NOT gone) AS kept
  FROM per_line GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_near, 0) AS n_near,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN found USING (doc_id)
"""

OP5 = rf"""
WITH d AS (SELECT doc_id, {_ALNUM.format(_FOLDED)} AS w FROM documents),
items AS (SELECT item_id, {_ALNUM.format(_FOLDED)} AS w FROM benchmark),
item_windows AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
  FROM items, unnest(range(1, len(w) - least(10, len(w)) + 2)) t(i) WHERE len(w) > 0),
doc_windows AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM d, (SELECT DISTINCT n FROM item_windows), unnest(range(1, len(w) - n + 2)) t(i)),
hits AS (SELECT doc_id, i, n, item_id FROM doc_windows JOIN item_windows USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hits, unnest(range(i, i + n)) t(j) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP6 = rf"""
WITH d AS (SELECT doc_id, {_BLANKS.format("coalesce(text, '')")} AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM d, unnest(range(1, len(w) - 11)) t(i)),
first AS (SELECT k, min(doc_id) AS low FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, j FROM win JOIN first USING (k), unnest(range(i, i + 13)) t(j) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (
  SELECT words.doc_id, count(gone.j) AS n_removed, string_agg(word, ' ' ORDER BY words.j) FILTER (gone.j IS NULL) AS kept
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.j = words.j GROUP BY words.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""

OP7 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_BLANKS.format(_FOLDED)} AS w FROM documents),
tokens AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS t FROM d, unnest(range(1, greatest(len(w) - 2, 2))) x(i)
  WHERE len(w) > 0),
sizes AS (SELECT doc_id, count(*) AS n FROM tokens GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM tokens a JOIN tokens b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (
  SELECT doc_id, doc_id AS other FROM d
  UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.other)
SELECT d.doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id
FROM d LEFT JOIN sizes USING (doc_id) JOIN reach USING (doc_id) GROUP BY d.doc_id
"""

_TEMPLATE_ROWS = ", ".join(f"('{label}', list_distinct(string_split('{words}', ' ')))" for label, words in TEMPLATES)
OP8 = rf"""
WITH d AS (SELECT doc_id, text, {_ALNUM.format(_FOLDED)} AS w FROM documents),
phrases(label, p) AS (VALUES ('gpl', ['gnu', 'general', 'public', 'license']), ('apache', ['apache', 'license']),
                             ('cc-by', ['cc', 'by']), ('mit', ['mit', 'license'])),
places AS (
  SELECT doc_id, i - 1 AS place, label FROM d, phrases, unnest(range(1, len(w) + 1)) t(i) WHERE w[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word FROM places GROUP BY doc_id),
templates(label, t) AS (VALUES {_TEMPLATE_ROWS}),
blocks AS (SELECT doc_id, list_distinct({_ALNUM.format("line")}) AS b
           FROM (SELECT doc_id, unnest(string_split({_FOLDED}, chr(10))) AS line FROM documents)),
hits AS (
  SELECT doc_id, label, len(list_intersect(b, t)) AS common, len(t) AS size FROM blocks, templates
  WHERE 10 * len(list_intersect(b, t)) >= 9 * len(t)),
best AS (SELECT doc_id, max(common / size) AS best FROM hits GROUP BY doc_id),
base_names AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names FROM (SELECT DISTINCT doc_id, label FROM places) GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(label, ',' ORDER BY label) AS names
          FROM (SELECT doc_id, label FROM places UNION SELECT doc_id, label FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_names.names, '') AS base_labels, coalesce(every.names, '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN base_names USING (doc_id) LEFT JOIN every USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op4_line_dedup": OP4,
    "op5_decontamination": OP5,
    "op6_substring_dedup": OP6,
    "op7_jaccard_join": OP7,
    "op8_license_scan": OP8,
}


def all_oracles() -> dict[str, str]:
    return dict(ORACLES)
