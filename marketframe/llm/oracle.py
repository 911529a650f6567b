"""The queries that SQL can express, written independently for DuckDB."""

from __future__ import annotations

SQL: dict[str, str] = {}

_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op1_ngram_jaccard_join"] = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5
      THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
           FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y
          WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.x, e.y FROM reach r JOIN edges e ON r.y = e.x),
comp AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
SELECT d.doc_id, COALESCE(s.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN comp c ON c.doc_id = d.doc_id"""

_ASSIGN = (r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


def _matches(kind: int, pattern: str, group: int) -> str:
    return f"""SELECT doc_id, owner, {kind} AS kind, regexp_extract_all(t, '{pattern}', 0) AS hits,
       regexp_extract_all(t, '{pattern}', {group}) AS vals, string_split_regex(t, '{pattern}') AS gaps FROM d"""


SQL["op3_secret_scan"] = rf"""
WITH d AS (SELECT doc_id, source AS owner, COALESCE(text, '') AS t FROM documents),
m AS ({_matches(0, _ASSIGN, 2)} UNION ALL {_matches(1, 'AKIA[A-Z0-9]+', 0)}
      UNION ALL {_matches(2, '[0-9a-f]+', 0)} UNION ALL {_matches(3, '[A-Za-z0-9+/_-]{20,}', 0)}),
each AS (SELECT doc_id, owner, kind, unnest(range(1, len(hits) + 1)) AS i, hits, vals, gaps FROM m
         WHERE len(list_filter(vals, lambda v: length(v) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE 20 END)) > 0),
placed AS (
  SELECT doc_id, owner, kind, vals[i] AS value,
         CAST(list_sum(list_transform(gaps[1:i], lambda x: length(x)))
              + COALESCE(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(hits[i]) AS n
  FROM each WHERE length(vals[i]) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 WHEN 2 THEN 16 ELSE 20 END),
looks AS (
  SELECT *, s + n AS e, regexp_matches(value, '[A-Za-z]') AND regexp_matches(value, '[0-9]')
      AND NOT EXISTS (SELECT 1 FROM unnest(range(1, length(value) - 4)) r(k)
                      WHERE replace(value[k:k + 5], value[k:k], '') = '')
      AND NOT regexp_matches(value, '(?i)example|sample|dummy|placeholder|changeme|your|test') AS live_look,
      regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AS mixed
  FROM placed),
spans AS (SELECT * FROM looks WHERE kind < 3 OR (live_look AND mixed)),
held AS (SELECT value, count(DISTINCT owner) AS owners FROM spans GROUP BY value),
judged AS (SELECT s.*, owners >= 3 AS example, owners = 1 AND live_look AS live FROM spans s JOIN held USING (value)),
shown AS (
  SELECT doc_id, kind, s, e, live, example FROM judged WHERE kind < 3
  UNION ALL
  SELECT doc_id, kind, s, e, live, example FROM judged o WHERE kind = 3 AND live AND NOT EXISTS (
    SELECT 1 FROM judged b WHERE b.doc_id = o.doc_id AND b.kind < 3 AND o.s < b.e AND b.s < o.e)),
per_doc AS (
  SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
         count(*) FILTER (kind = 2) AS n_hex,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind)
           FILTER (kind < 3) AS base,
         string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans,
         count(*) FILTER (kind < 3 AND live) AS n_live, count(*) FILTER (kind < 3 AND example) AS n_example
  FROM shown GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n_assign, 0) AS n_assign, COALESCE(n_access, 0) AS n_access, COALESCE(n_hex, 0) AS n_hex,
       sha256(COALESCE(base, '')) AS base_sha256, COALESCE(spans, '') AS spans,
       COALESCE(n_live, 0) AS n_live, COALESCE(n_example, 0) AS n_example
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"""

SQL["op9_line_dedup"] = r"""
WITH raw AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS place
  FROM documents WHERE text IS NOT NULL),
line AS (
  SELECT doc_id, place, lines[place] AS raw,
         list_filter(string_split(lower(translate(lines[place], chr(9) || chr(11) || chr(12) || chr(13), '    ')), ' '),
                     lambda x: x <> '') AS w
  FROM raw),
first AS (SELECT w, min({'d': doc_id, 'p': place}) AS fst FROM line WHERE len(w) > 0 GROUP BY w),
variants AS (
  SELECT w, fst, unnest(list_concat(
    list_transform(range(1, len(w) + 1), lambda i: concat_ws(chr(1), array_to_string(w[1:i - 1], ' '),
                                                        array_to_string(w[i + 1:len(w)], ' '), len(w) - 1)),
    list_transform(range(0, len(w) + 1), lambda i: concat_ws(chr(1), array_to_string(w[1:i], ' '),
                                                        array_to_string(w[i + 1:len(w)], ' '), len(w))))) AS k
  FROM first WHERE len(w) >= 8),
low AS (SELECT k, min(fst) AS fst FROM variants GROUP BY k HAVING count(DISTINCT fst) > 1),
near AS (SELECT DISTINCT v.w FROM variants v JOIN low ON v.k = low.k AND v.fst > low.fst),
kept AS (
  SELECT l.doc_id, l.place, l.raw,
         len(l.w) = 0 OR (f.fst = {'d': l.doc_id, 'p': l.place} AND n.w IS NULL) AS stays
  FROM line l LEFT JOIN first f ON f.w = l.w LEFT JOIN near n ON n.w = l.w),
per_doc AS (SELECT doc_id, COALESCE(string_agg(raw, chr(10) ORDER BY place) FILTER (stays), '') AS text,
                   count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_removed FROM kept GROUP BY doc_id)
SELECT d.doc_id, p.text, COALESCE(n_lines, 0) AS n_lines, COALESCE(n_removed, 0) AS n_removed
FROM documents d LEFT JOIN per_doc p ON p.doc_id = d.doc_id"""

_WHOLE = r"""
whole AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)"""


def _round(n: int) -> str:
    """Assignment to the entries of round ``n``, and the entries after it."""
    return f"""
near{n} AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(part, entry),
                                                            lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
  FROM part JOIN book{n} USING (p) GROUP BY r, p),
mean{n} AS MATERIALIZED (
  SELECT p, e, list(x ORDER BY i) AS entry FROM (
    SELECT p, m.e AS e, i, CAST(floor(sum(part[i]) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS x
    FROM part JOIN near{n} USING (r, p), range(1, len(part) + 1) t(i) GROUP BY p, m.e, i) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (
  SELECT b.p, b.e, COALESCE(m.entry, b.entry) AS entry FROM book{n} b LEFT JOIN mean{n} m ON m.p = b.p AND m.e = b.e)"""


SQL["op12_vector_codes"] = f"""
WITH {_WHOLE},
part AS MATERIALIZED (
  SELECT r, p, v[p * (len(v) // 16) + 1:(p + 1) * (len(v) // 16)] AS part FROM whole, range(16) t(p)),
book0 AS MATERIALIZED (
  SELECT p, e, part AS entry
  FROM part JOIN (SELECT r, row_number() OVER (ORDER BY vec_id, v) - 1 AS e FROM whole
                  QUALIFY e < 64) USING (r)),
{_round(0)},
{_round(1)},
last AS MATERIALIZED (
  SELECT r, p, min(struct_pack(d := list_sum(list_transform(list_zip(part, entry),
                                                            lambda z: (z[1] - z[2]) * (z[1] - z[2]))), e := e)) AS m
  FROM part JOIN book2 USING (p) GROUP BY r, p),
coded AS (
  SELECT r, string_agg(printf('%02x', m.e), '' ORDER BY p) AS code, CAST(sum(m.d) AS BIGINT) AS error FROM last GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) FROM book2) AS codebooks_sha256
FROM coded JOIN whole USING (r)"""

SQL["op13_bit_sliced_search"] = f"""
WITH {_WHOLE}
SELECT q.vec_id AS query_id,
       CAST(row_number() OVER (PARTITION BY q.r ORDER BY score DESC, c.vec_id) AS INTEGER) AS rank, c.vec_id, score
FROM (SELECT a.r AS q, b.r AS c, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM whole a JOIN whole b ON a.vec_id % 50 = 0 AND a.r <> b.r) s
JOIN whole q ON q.r = s.q JOIN whole c ON c.r = s.c
QUALIFY rank <= 5"""
