"""DuckDB SQL with the same rows as registered queries of this package, where SQL can express them."""

from __future__ import annotations

from tidewell.llm.license_scan import BASE, EXTENT, NEAR, NOTICES, SHARE, SHINGLE

#: Links by shared shingles, components by reachability.
SHINGLE_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_distinct([array_to_string(w[i:i + 4], ' ') FOR i IN range(1, len(w) - 3)]) END AS s FROM w
), x AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k, any_value(x.n) AS m, any_value(y.n) AS n FROM x JOIN x AS y ON x.e = y.e AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (m + n - k)),
r AS (SELECT a AS id, b AS c FROM l UNION SELECT r.id, l.b FROM r JOIN l ON r.c = l.a),
c AS (SELECT id, min(c) AS c FROM r GROUP BY 1)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, least(s.doc_id, coalesce(c.c, s.doc_id)) AS component_id FROM s LEFT JOIN c ON s.doc_id = c.id
"""

#: Costs from the last row back, then letters from the first row on, both by recursion; nodes are 1 start, 2 system, 3 user, 4 assistant.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE k AS (
  SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), d AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split(k, '')]),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, i: if(x & 1 = 1, xor(x >> 1, 3988292384), x >> 1)))) % 20 AS what FROM k
), g AS (
  SELECT conv_id, turn, if(what = 4, 'user', role) AS role, CASE what WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(if(what = 3, 2, 1))) AS copy FROM d WHERE what <> 0
), o AS (
  SELECT *, rtrim(text, E' \t\n\x0b\x0c\r') AS trimmed, left(role, 1) AS a, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth, lag(left(role, 1)) OVER w AS before
  FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 64), md5(text), copy)
), f AS (
  SELECT *, CASE WHEN trimmed = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN right(trimmed, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM o
), r AS (
  SELECT conv_id, i, n, role, text, a, if(fault = 'truncated', 3, 0) AS t, fault NOT IN ('blank', 'duplicate') AS free FROM f
), b AS (
  SELECT conv_id, n + 1 AS i, [0, 6, 3, 0] AS c FROM r WHERE i = 1
  UNION ALL
  SELECT conv_id, i, [least(e[1], 3 + e[3], 6 + e[4]), least(e[2], 3 + e[3], 6 + e[4]), least(e[3], 3 + e[4]), least(e[4], 3 + e[3])] FROM (
    SELECT r.conv_id, r.i, [
      least(4 + c[1], if(free, 3 + t + c[3], NULL), if(free AND a = 's', t + c[2], NULL), if(free AND a = 'u', t + c[3], NULL)),
      least(4 + c[2], if(free, 3 + t + c[3], NULL), if(free AND a = 'u', t + c[3], NULL)),
      least(4 + c[3], if(free, 3 + t + c[4], NULL), if(free AND a = 'a', t + c[4], NULL)),
      least(4 + c[4], if(free, 3 + t + c[3], NULL), if(free AND a = 'u', t + c[3], NULL))] AS e
    FROM b JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i + 1)
), x AS (
  SELECT b.conv_id, b.i, b.c, y.c AS c2, r.role, r.text, r.a, r.t, coalesce(r.free, false) AS free, r.i IS NULL AS over
  FROM b LEFT JOIN r ON b.conv_id IS NOT DISTINCT FROM r.conv_id AND b.i = r.i LEFT JOIN b AS y ON b.conv_id IS NOT DISTINCT FROM y.conv_id AND y.i = b.i + 1
), w AS (
  SELECT conv_id, i, 1 AS q, '' AS audit, []::VARCHAR[] AS lines FROM b WHERE i = 1
  UNION ALL
  SELECT conv_id, i + (letter <> 'I')::INT, CASE letter WHEN 'D' THEN q WHEN 'K' THEN kept ELSE made END, audit || letter,
    CASE letter WHEN 'D' THEN lines WHEN 'K' THEN list_append(lines, role || ':' || text) WHEN 'R' THEN list_append(lines, named || ':' || text) ELSE list_append(lines, named || ':') END
  FROM (
    SELECT *, CASE WHEN NOT over AND c[q] = 4 + c2[q] THEN 'D' WHEN c[q] = 3 + c[made] THEN 'I' WHEN free AND kept > 0 AND c[q] = t + c2[kept] THEN 'K' ELSE 'R' END AS letter FROM (
      SELECT w.*, x.c, x.c2, x.role, x.text, x.t, x.free, x.over, if(w.q = 3, 4, 3) AS made, if(w.q = 3, 'assistant', 'user') AS named,
        CASE WHEN x.a = 's' AND w.q = 1 THEN 2 WHEN x.a = 'u' AND w.q <> 3 THEN 3 WHEN x.a = 'a' AND w.q = 3 THEN 4 ELSE 0 END AS kept
      FROM w JOIN x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = x.i WHERE NOT (x.over AND w.q IN (1, 4))))
), z AS (
  SELECT w.conv_id, w.audit, sha256(array_to_string(w.lines, chr(10))) AS digest FROM w JOIN x ON w.conv_id IS NOT DISTINCT FROM x.conv_id AND w.i = x.i AND x.over WHERE w.q IN (1, 4)
), s AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
    count_if(before IS NOT NULL AND before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id
)
SELECT c.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c[1], 0) AS BIGINT) AS cost, coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON c.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN z ON c.conv_id IS NOT DISTINCT FROM z.conv_id LEFT JOIN b ON c.conv_id IS NOT DISTINCT FROM b.conv_id AND b.i = 1
"""


def _windows_sql() -> str:
    rows = [(w, n, notice.label, notice.base, at, len(notice.windows())) for n, notice in enumerate(BASE + NOTICES) for at, w in enumerate(notice.windows())]
    return ", ".join(f"('{w}', {n}, '{label}', {str(base).lower()}, {at}, {size})" for w, n, label, base, at, size in rows)


#: The same votes, diagonals, spans and choice among those that overlap.
LICENSE_SCAN = rf"""
WITH t(g, notice, label, base, place, size) AS (VALUES {_windows_sql()}),
w AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS (
  SELECT row, p, array_to_string(w[p + 1:p + {SHINGLE}], ' ') AS g FROM (SELECT row, w, unnest(range(len(w) - {SHINGLE - 1})) AS p FROM w)
), v AS (
  SELECT row, notice, p - place AS diagonal, any_value(label) AS label, any_value(base) AS base, any_value(size) AS size, list(DISTINCT place) AS places, min(p) AS first, max(p) AS last FROM g JOIN t USING (g) GROUP BY ALL
), b AS (
  SELECT row, count(*) AS n, min(diagonal) AS first_word, max(diagonal) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM v WHERE base AND len(places) = size GROUP BY row
), a AS (SELECT *, diagonal - lag(diagonal) OVER (PARTITION BY row, notice ORDER BY diagonal) > {NEAR} AS begins FROM v WHERE NOT base
), m AS (SELECT *, sum(coalesce(begins, false)::INT) OVER (PARTITION BY row, notice ORDER BY diagonal) AS grp FROM a
), s AS (
  SELECT row, notice, min(first) AS first, max(last) AS last, any_value(label) AS label, if(max(last) - min(first) + 1 <= {EXTENT} * any_value(size), len(list_distinct(flatten(list(places)))), max(len(places))) / any_value(size) AS share FROM m GROUP BY row, notice, grp
), o AS (SELECT *, coalesce(first > max(last) OVER (PARTITION BY row ORDER BY first, last, notice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS apart FROM s WHERE share >= {SHARE}
), c AS (SELECT *, sum(apart::INT) OVER (PARTITION BY row ORDER BY first, last, notice) AS cluster FROM o
), h AS (SELECT *, share = max(share) OVER (PARTITION BY row, cluster) AS best FROM c
), l AS (SELECT row, label FROM h WHERE best UNION SELECT row, label FROM v WHERE base AND len(places) = size
), j AS (SELECT row, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM l GROUP BY row
), x AS (SELECT row, max(share) AS share FROM s GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(b.n, 0) AS n_base, first_word, last_word, coalesce(b.labels, '') AS base_labels, coalesce(j.labels, '') AS labels, CAST(if(b.n > 0, 1, coalesce(x.share, 0)) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (row) LEFT JOIN j USING (row) LEFT JOIN x USING (row)
"""


def _vector_codes_sql(rounds: int = 4) -> str:
    sql = """
WITH kept AS (
  SELECT row_number() OVER () AS row, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), parts AS MATERIALIZED (
  SELECT row, p, v[p * len(v) // 4 + 1:(p + 1) * len(v) // 4] AS v FROM kept, range(4) AS r(p)
), first AS (SELECT row, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept QUALIFY e < 256),
b0 AS MATERIALIZED (SELECT p, e, v FROM parts JOIN first USING (row))"""
    for n in range(rounds + 1):
        sql += f""",
a{n} AS MATERIALIZED (
  SELECT row, p, min(d) AS m FROM (SELECT row, p, {{'d': list_sum(list_transform(list_zip(parts.v, b{n}.v), lambda x: (x[1] - x[2]) * (x[1] - x[2]))), 'e': e}} AS d FROM parts JOIN b{n} USING (p)) GROUP BY ALL
)"""
        if n < rounds:
            sql += f""",
u{n} AS (SELECT p, m['e'] AS e, i, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a{n}.p, m, unnest(v) AS x, unnest(range(len(v))) AS i FROM a{n} JOIN parts USING (row, p)) GROUP BY ALL),
b{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(n.v, b{n}.v) AS v FROM b{n} LEFT JOIN (SELECT p, e, list(x ORDER BY i) AS v FROM u{n} GROUP BY ALL) n USING (p, e))"""
    return sql + f""",
c AS (SELECT row, string_agg(printf('%02x', m['e']), '' ORDER BY p) AS code, CAST(sum(m['d']) AS BIGINT) AS error FROM a{rounds} GROUP BY row)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM b{rounds}) AS codebooks_sha256 FROM c JOIN kept USING (row)
"""


VECTOR_CODES = _vector_codes_sql()
