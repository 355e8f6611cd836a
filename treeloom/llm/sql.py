"""SQL (DuckDB) for the queries of this package that it can express.

Left out: op1 and op10 (a tokenizer), op3 (places of matches in code points),
op4 (connected components over all pairs; too slow on whole tables), op6 (a
learned model), op8 (prefix hashes) and the pipeline.  Tests hold those against
brute force.
"""

from __future__ import annotations

from .common import UPPER
from .license_scan import PHRASES, TEMPLATES

_LOW = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"

OP2 = f"""
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, {_LOW} AS t FROM documents) WINDOW w AS (PARTITION BY t)
"""

OP5 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    md5('mix:' || doc_id::VARCHAR) AS o FROM documents),
src AS (SELECT key, any_value(source) AS source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap FROM sized GROUP BY key),
slots AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS slot FROM src),
weighed AS (SELECT *, slot + 1 AS weight, cap::DOUBLE / (slot + 1) AS per FROM slots),
levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER rising, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER rising, 0))::DOUBLE AS level
  FROM weighed WINDOW rising AS (ORDER BY per, key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT arg_min(level, struct_pack(a := per, b := key)) AS level FROM levels WHERE level <= per),
targets AS (SELECT key, source_size, slot, least(cap::DOUBLE, common.level * weight) AS target FROM levels, common),
placed AS (
  SELECT doc_id, size, source_size, target, slot, round(target)::BIGINT AS wanted,
    coalesce(sum(size) OVER (PARTITION BY key ORDER BY o, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM sized JOIN targets USING (key)),
turned AS (SELECT *, CASE WHEN source_size > 0 THEN wanted // source_size ELSE 0 END AS turns FROM placed),
taken AS (SELECT *, greatest(0, least(wanted - turns * source_size - start, size)) AS last FROM turned),
counted AS (SELECT *, CASE WHEN size > 0 THEN turns + (last > 0)::INT ELSE 0 END AS copies, [-0.5, 0.0, 0.5][slot + 1]::DOUBLE AS s, least(1.0::DOUBLE, start::DOUBLE / wanted) AS x FROM taken)
SELECT doc_id, size, source_size, target, (turns * size + last)::BIGINT AS taken, copies::BIGINT AS copies,
  CASE WHEN copies > 0 THEN 2 * x / ((1 - s) + sqrt((1 - s) * (1 - s) + 4 * s * x)) END AS position
FROM counted
"""


def _all_words(phrase: str) -> str:
    return " AND ".join(f"words[i + {k + 1}] = '{w}'" for k, w in enumerate(phrase.split()))


_PLACES = " || ".join(
    f"list_transform(list_filter(range(0, greatest(0, len(words) - {len(p.split()) - 1})), lambda i: {_all_words(p)}), lambda i: struct_pack(place := i, label := '{label}'))"
    for p, label in PHRASES
)
_TEMPLATES = ", ".join(f"('{label}', {sorted(set(text.split()))!r})" for text, label in TEMPLATES)
_TOKENS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP7 = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_LOW} AS low FROM documents),
worded AS (SELECT r, doc_id, low, regexp_extract_all(low, {_TOKENS}) AS words FROM docs),
based AS (SELECT r, doc_id, low, len(words) AS n_words, {_PLACES} AS places FROM worded),
templates(label, tokens) AS (VALUES {_TEMPLATES}),
blocks AS (SELECT r, regexp_extract_all(unnest(string_split(low, chr(10))), {_TOKENS}) AS block FROM docs),
met AS (
  SELECT r, label, len(list_intersect(tokens, block)) / len(tokens) AS part FROM blocks, templates
  WHERE len(list_intersect(tokens, block)) >= ceil(len(tokens) * 90 / 100)),
more AS (SELECT r, list(DISTINCT label) AS labels, max(part) AS part FROM met GROUP BY r)
SELECT doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(list_transform(places, lambda p: p.place))::BIGINT AS first_word,
  list_max(list_transform(places, lambda p: p.place))::BIGINT AS last_word,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label) || coalesce(labels, []))), ',') AS labels,
  CASE WHEN len(places) > 0 THEN 1.0::DOUBLE ELSE coalesce(part, 0.0)::DOUBLE END AS score
FROM based LEFT JOIN more USING (r)
"""

_HEX = "('0x' || substr(h, {0}, {1}))::INT"
OP9 = rf"""
WITH pages_ AS (
  SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.+$', '') AS h0,
    DATE '2024-01-01' + (((page_id * 7919) % 366 + 366) % 366)::INT AS fetched_at FROM pages),
captures AS (SELECT page_id, CASE WHEN h0 <> '' THEN h0 END AS host, fetched_at FROM pages_),
split_ AS (SELECT page_id, fetched_at, string_split(host, '.') AS parts FROM captures WHERE host IS NOT NULL),
wanted AS (
  SELECT page_id, fetched_at, len(parts) - k + 1 AS depth, array_to_string(parts[k:], '.') AS pattern
  FROM (SELECT *, unnest(range(1, greatest(len(parts) - 1, 1) + 1)) AS k FROM split_)),
hashed AS (SELECT DISTINCT pattern, md5(pattern) AS h FROM wanted),
dated AS (
  SELECT pattern, {_HEX.format(1, 1)} AS pick, {_HEX.format(9, 1)} AS kind, {_HEX.format(3, 2)} % 200 AS a,
    {_HEX.format(3, 2)} % 200 + {_HEX.format(5, 2)} % 90 + 1 AS b, {_HEX.format(3, 2)} % 200 + {_HEX.format(5, 2)} % 90 + {_HEX.format(7, 2)} % 90 + 2 AS c FROM hashed),
spans AS (
  SELECT pattern, DATE '2024-01-01' + a AS valid_from, CASE WHEN pick < 4 THEN DATE '2024-01-01' + b END AS valid_to, kind FROM dated WHERE pick < 8
  UNION ALL SELECT pattern, DATE '2024-01-01' + c, NULL, kind FROM dated WHERE pick < 4),
active AS (
  SELECT w.page_id, depth, pattern, valid_from, CASE WHEN kind < 5 THEN 'spam' WHEN kind < 10 THEN 'adult' ELSE 'malware' END AS category
  FROM wanted w JOIN spans USING (pattern) WHERE valid_from <= fetched_at AND (valid_to IS NULL OR fetched_at < valid_to)),
best AS (SELECT page_id, count(*) AS n, max(struct_pack(depth := depth, pattern := pattern, valid_from := valid_from, category := category)) AS e FROM active GROUP BY 1)
SELECT page_id, host, strftime(fetched_at, '%Y-%m-%d') AS fetched_at, coalesce(n, 0) AS n_active, n IS NOT NULL AS blocked, e.pattern AS pattern, strftime(e.valid_from, '%Y-%m-%d') AS since, e.category AS category
FROM captures LEFT JOIN best USING (page_id)
"""

ORACLE_SQL: dict[str, str] = {"op2_exact_dedup": OP2, "op5_mixing": OP5, "op7_license_scan": OP7, "op9_url_filter": OP9}
