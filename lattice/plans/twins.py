"""DuckDB twins of folds: recursion over the ranked rows of each key, one row a step, with the fold's state as columns."""

from __future__ import annotations

_LOG = "e AS (SELECT user_id, event_id, event_type, value, epoch_us(ts) / 1000000 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events)"


def _stars(k: int) -> str:
    """The k-th greedy choice of every label: the best of the rest, given the largest similarity to those chosen before."""
    earlier = " UNION ALL ".join(f"SELECT label, vec_id FROM c{j}" for j in range(1, k))
    near = f"coalesce((SELECT greatest(0, max(m.s)) FROM m JOIN ({earlier}) x ON m.b = x.vec_id AND m.label = x.label WHERE m.a = g.a AND m.label = g.label), 0)" if k > 1 else "0"
    rest = f"WHERE NOT EXISTS (SELECT 1 FROM ({earlier}) x WHERE x.vec_id = g.a)" if k > 1 else ""
    return f"c{k} AS (SELECT label, arg_max(a, (round(1 - 0.3 * generic - 0.5 * {near}, 9), -a)) AS vec_id FROM g {rest} GROUP BY label)"


TWINS = {
    "token_bucket_decisions": f"""
WITH RECURSIVE {_LOG},
f AS (
  SELECT user_id, event_id, t, rn, true AS allowed, 1::DOUBLE AS tokens FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, t, rn, x >= 1, x - (x >= 1)::INT FROM (
    SELECT e.user_id, e.event_id, e.t, e.rn, least(2::DOUBLE, f.tokens + (e.t - f.t) * (1::DOUBLE / 120) / 60) AS x FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, allowed FROM f""",
    "throttled_events": f"""
WITH RECURSIVE {_LOG},
f AS (
  SELECT user_id, event_id, rn, true AS written, t, event_type AS s, value AS p FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, w, CASE WHEN w THEN nt ELSE t END, CASE WHEN w THEN ns ELSE s END, CASE WHEN w THEN np ELSE p END FROM (
    SELECT e.user_id, e.event_id, e.rn, f.t, f.s, f.p, e.t AS nt, e.event_type AS ns, e.value AS np,
           e.event_type = 'error' OR e.event_type <> f.s OR abs(e.value - f.p) >= 20 OR e.t - f.t >= 7200 AS w
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, written FROM f""",
    "circuit_breaker_states": f"""
WITH RECURSIVE {_LOG},
f AS (
  SELECT user_id, event_id, rn, 'closed' AS state, (event_type = 'error')::INT AS failures, NULL::DOUBLE AS opened FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, CASE WHEN refused THEN 'open' WHEN opened IS NULL THEN 'closed' ELSE 'half_open' END,
         CASE WHEN refused THEN failures WHEN bad THEN failures + 1 ELSE 0 END,
         CASE WHEN refused THEN opened WHEN bad AND (opened IS NOT NULL OR failures + 1 >= 2) THEN t END
  FROM (
    SELECT e.user_id, e.event_id, e.rn, e.t, e.event_type = 'error' AS bad, f.failures, f.opened, f.opened IS NOT NULL AND e.t - f.opened < 86400 AS refused
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, state FROM f""",
    "circuit_breaker_cooldown": f"""
WITH RECURSIVE {_LOG},
f AS (
  SELECT user_id, event_id, rn, 'closed' AS state, (event_type = 'error')::INT AS failures, CASE WHEN event_type = 'error' AND 1 >= 2 THEN t END AS opened FROM e WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, CASE WHEN o IS NULL THEN 'closed' ELSE 'open' END, CASE WHEN o IS NOT NULL THEN n WHEN bad THEN n + 1 ELSE 0 END,
         CASE WHEN o IS NOT NULL THEN o WHEN bad AND n + 1 >= 2 THEN t END
  FROM (
    SELECT e.user_id, e.event_id, e.rn, e.t, e.event_type = 'error' AS bad, CASE WHEN f.opened IS NOT NULL AND e.t - f.opened >= 86400 THEN 0 ELSE f.failures END AS n,
           CASE WHEN f.opened IS NOT NULL AND e.t - f.opened >= 86400 THEN NULL ELSE f.opened END AS o
    FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1))
SELECT user_id, event_id, state FROM f""",
    "lpt_bins": """
WITH RECURSIVE c AS (SELECT o_custkey, o_orderkey, ceil(o_totalprice / 1000)::BIGINT AS cost FROM orders),
o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY cost DESC, o_orderkey) AS rn FROM c),
s AS (SELECT o_custkey, least(count(*), greatest(1, ceil(sum(cost) / 650)))::BIGINT AS n FROM c GROUP BY 1),
f AS (
  SELECT o_custkey, NULL::BIGINT AS o_orderkey, NULL::BIGINT AS cost, 0::BIGINT AS rn, NULL::BIGINT AS bin, list_transform(range(n), lambda x: 0::BIGINT) AS loads FROM s
  UNION ALL
  SELECT o_custkey, o_orderkey, cost, rn, k - 1, CASE WHEN k > len(loads) THEN list_append(loads, cost) ELSE list_transform(loads, lambda x, i: CASE WHEN i = k THEN x + cost ELSE x END) END
  FROM (
    SELECT o.o_custkey, o.o_orderkey, o.cost, o.rn, f.loads,
           CASE WHEN list_min(f.loads) + o.cost <= 1000 THEN list_position(f.loads, list_min(f.loads)) ELSE len(f.loads) + 1 END::BIGINT AS k
    FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.rn = f.rn + 1))
SELECT o_custkey, o_orderkey, cost, bin FROM f WHERE rn > 0""",
    "budget_merge": """
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity::BIGINT AS tokens, l_extendedprice AS gain FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey::VARCHAR, tokens, gain) AS n FROM l),
m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY gain DESC, n) > 1 AS later FROM i),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY later, gain DESC, n) AS rn FROM m),
f AS (
  SELECT l_orderkey, l_linenumber, tokens, rn, tokens <= 80 AS kept, CASE WHEN tokens <= 80 THEN tokens ELSE 0 END AS used, (tokens <= 80)::INT AS taken FROM o WHERE rn = 1
  UNION ALL
  SELECT l_orderkey, l_linenumber, tokens, rn, k, used + CASE WHEN k THEN tokens ELSE 0 END, taken + k::INT FROM (
    SELECT o.l_orderkey, o.l_linenumber, o.tokens, o.rn, f.used, f.taken, f.taken < 4 AND f.used + o.tokens <= 80 AS k FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.rn = f.rn + 1))
SELECT l_orderkey, l_linenumber, tokens, kept FROM f""",
    "mmr_representatives": f"""
WITH m AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b, CASE WHEN a.vec_id = b.vec_id THEN 0 ELSE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) END AS s FROM embeddings a JOIN embeddings b ON a.label = b.label),
g AS (SELECT label, a, avg(s) AS generic FROM m GROUP BY 1, 2),
{", ".join(_stars(k) for k in range(1, 6))}
{" UNION ALL ".join(f"SELECT label, vec_id, {k} AS position FROM c{k}" for k in range(1, 6))}""",
    "utterance_units": """
WITH RECURSIVE r AS (SELECT conv_id, turn, role, text, turn * 20.0::DOUBLE AS s, turn * 20.0::DOUBLE + least(60, length(text) / 50) AS e FROM conversations),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY s, e, turn) AS rn FROM r WHERE e > s AND regexp_matches(text, '\\S')),
f AS (
  SELECT conv_id, turn, rn, 0 AS unit, s AS b, e, role, text FROM o WHERE rn = 1
  UNION ALL
  SELECT conv_id, turn, rn, unit + cut::INT, CASE WHEN cut THEN s ELSE b END, e, role, text FROM (
    SELECT o.*, f.unit, f.b, o.e - f.b > 30 OR (f.e - f.b >= 5 AND (o.s - f.e >= 0.8 OR (o.role <> '' AND f.role <> '' AND o.role <> f.role) OR regexp_matches(f.text, '[。！？!?；;.]\\s*$'))) AS cut
    FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1))
SELECT c.conv_id, c.turn, f.unit FROM conversations c LEFT JOIN f ON c.conv_id = f.conv_id AND c.turn = f.turn""",
    "short_segment_merge": """
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (
  SELECT conv_id, turn, rn, 0 AS segment, (n >= 400)::INT AS next, CASE WHEN n >= 400 THEN 0 ELSE n END AS size FROM o WHERE rn = 1
  UNION ALL
  SELECT o.conv_id, o.turn, o.rn, f.next, f.next + (f.size + o.n >= 400)::INT, CASE WHEN f.size + o.n >= 400 THEN 0 ELSE f.size + o.n END FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1),
l AS (SELECT conv_id, arg_max(next, rn) AS last, arg_max(size, rn) AS rest FROM f GROUP BY 1)
SELECT f.conv_id, f.turn, CASE WHEN l.rest > 0 AND l.last > 0 THEN least(f.segment, l.last - 1) ELSE f.segment END AS segment FROM f JOIN l USING (conv_id)""",
    "sentence_merge": """
WITH RECURSIVE o AS (SELECT conv_id, turn, length(text) AS c, length(text) / 15 AS d, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM conversations),
f AS (
  SELECT conv_id, turn, rn, 0 AS g, d, c, d < 40 AND c < 500 AS going, d AS d0, c AS c0 FROM o WHERE rn = 1
  UNION ALL
  SELECT conv_id, turn, rn, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN gd + d0 ELSE d0 END, CASE WHEN j THEN gc + c0 ELSE c0 END, j OR (d0 < 40 AND c0 < 500), d0, c0 FROM (
    SELECT o.conv_id, o.turn, o.rn, f.g, f.d AS gd, f.c AS gc, o.d AS d0, o.c AS c0, f.going AND f.d < 20 AND f.c < 500 AND f.d + o.d < 40 AND f.c + o.c < 500 AS j
    FROM f JOIN o ON o.conv_id = f.conv_id AND o.rn = f.rn + 1)),
s AS (SELECT conv_id, g, arg_max(d, rn) AS d, arg_max(c, rn) AS c, arg_max(going, rn) AS going FROM f GROUP BY 1, 2),
t AS (SELECT b.conv_id, b.g FROM s b JOIN s a ON a.conv_id = b.conv_id AND a.g = b.g - 1 WHERE b.g = (SELECT max(g) FROM s x WHERE x.conv_id = b.conv_id) AND b.going AND b.d < 20 AND b.c < 500 AND a.d + b.d < 40 AND a.c + b.c < 500)
SELECT f.conv_id, f.turn, f.g - (t.g IS NOT NULL)::INT AS grp FROM f LEFT JOIN t ON t.conv_id = f.conv_id AND t.g = f.g""",
    "page_groups": """
WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents),
p AS (SELECT doc_id, pos // 10 AS page, ceil(sum(length(line)) / 4)::BIGINT AS n FROM l GROUP BY 1, 2),
t AS (SELECT doc_id, sum(n)::BIGINT AS total, max(page) AS last, ceil((sum(n) / ceil(sum(n) / 500) + 500) / 2)::BIGINT AS average FROM p GROUP BY 1),
f AS (
  SELECT doc_id, -1::BIGINT AS page, 0::BIGINT AS start, 0::BIGINT AS size, 0::BIGINT AS before, NULL::BIGINT AS a, NULL::BIGINT AS b FROM t WHERE total > 500
  UNION ALL
  SELECT doc_id, page, CASE WHEN cut THEN greatest(page - 1, 0) ELSE start END, CASE WHEN cut THEN before ELSE size END + n, n, CASE WHEN cut THEN start END, CASE WHEN cut THEN page - 1 END FROM (
    SELECT f.doc_id, p.page, f.start, f.size, f.before, p.n, f.size + p.n > t.average AS cut FROM f JOIN p ON p.doc_id = f.doc_id AND p.page = f.page + 1 JOIN t ON t.doc_id = f.doc_id))
SELECT doc_id, a AS first_page, b AS last_page FROM f WHERE a IS NOT NULL
UNION ALL SELECT f.doc_id, f.start, f.page FROM f JOIN t ON f.doc_id = t.doc_id AND f.page = t.last
UNION ALL SELECT doc_id, 0, last FROM t WHERE total <= 500""",
    "edit_log_states": f"""
WITH RECURSIVE {_LOG},
k AS (SELECT *, CASE event_type WHEN 'click' THEN 'undo' WHEN 'purchase' THEN 'redo' ELSE 'apply' END AS kind FROM e),
f AS (
  SELECT user_id, NULL::BIGINT AS event_id, 0::BIGINT AS rn, 0 AS revision, NULL::VARCHAR AS value, []::VARCHAR[] AS undo, []::VARCHAR[] AS redo FROM k WHERE rn = 1
  UNION ALL
  SELECT user_id, event_id, rn, revision + (a OR u OR r)::INT, CASE WHEN a THEN event_type WHEN u THEN undo[-1] WHEN r THEN redo[-1] ELSE value END,
         CASE WHEN a THEN list_append(undo, value)[-50:] WHEN u THEN undo[:-2] WHEN r THEN list_append(undo, value) ELSE undo END,
         CASE WHEN a THEN []::VARCHAR[] WHEN u THEN list_append(redo, value) WHEN r THEN redo[:-2] ELSE redo END
  FROM (
    SELECT k.user_id, k.event_id, k.rn, k.event_type, f.revision, f.value, f.undo, f.redo, k.kind = 'apply' AND k.event_type IS DISTINCT FROM f.value AS a,
           k.kind = 'undo' AND len(f.undo) > 0 AS u, k.kind = 'redo' AND len(f.redo) > 0 AS r
    FROM f JOIN k ON k.user_id = f.user_id AND k.rn = f.rn + 1))
SELECT user_id, event_id, revision, value FROM f WHERE rn > 0""",
    "subtree_thinning": """
WITH n AS (SELECT conv_id, turn, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, ceil(length(text) / 4)::BIGINT AS tokens, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations),
e AS (SELECT a.conv_id, a.i, coalesce(min(b.i), max(z.n)) AS stop FROM n a JOIN (SELECT conv_id, count(*) AS n FROM n GROUP BY 1) z ON z.conv_id = a.conv_id LEFT JOIN n b ON b.conv_id = a.conv_id AND b.i > a.i AND b.level <= a.level GROUP BY 1, 2),
t AS (SELECT e.conv_id, e.i, e.stop, sum(n.tokens) AS total FROM e JOIN n ON n.conv_id = e.conv_id AND n.i >= e.i AND n.i < e.stop GROUP BY 1, 2, 3)
SELECT n.conv_id, n.turn, n.level, n.tokens, coalesce(min(t.i), any_value(n.i)) AS owner FROM n LEFT JOIN t ON t.conv_id = n.conv_id AND t.i <= n.i AND n.i < t.stop AND t.total < 150 GROUP BY 1, 2, 3, 4""",
    "drop_priority_trim": """
WITH l AS (SELECT l_orderkey, l_linenumber, l_returnflag AS kind, l_quantity::BIGINT AS size, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity::BIGINT) AS n FROM lineitem),
w AS (
  SELECT *, sum(size) OVER (PARTITION BY l_orderkey) AS total,
         coalesce(sum(size) OVER (PARTITION BY l_orderkey ORDER BY CASE kind WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 3 END, n DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM l)
SELECT l_orderkey, l_linenumber, kind, size, total - gone <= 100 AS kept FROM w""",
    "line_clusters": """
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, l_discount * 100 AS top, l_discount * 100 + l_tax * 50 + 1 AS bottom FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, top, bottom) AS n FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY top, n) AS rn FROM i),
f AS (
  SELECT l_orderkey, l_linenumber, rn, 0 AS line, top, bottom FROM o WHERE rn = 1
  UNION ALL
  SELECT o.l_orderkey, o.l_linenumber, o.rn, f.line + (NOT least(o.bottom, f.bottom) - greatest(o.top, f.top) > 0.6 * least(o.bottom - o.top, f.bottom - f.top))::INT, o.top, o.bottom
  FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.rn = f.rn + 1)
SELECT l_orderkey, l_linenumber, line FROM f""",
    "optional_expansion": """
WITH RECURSIVE l AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey, l_suppkey ORDER BY l_linenumber, l_quantity::BIGINT, l_discount) > 1 AS covered, l_discount AS score, l_quantity::BIGINT AS size FROM lineitem),
i AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, size, score) AS n FROM l),
o AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY covered, score DESC, n) AS rn FROM i),
f AS (
  SELECT l_orderkey, NULL::BIGINT AS l_linenumber, 0::BIGINT AS rn, false AS taken, 0::BIGINT AS used FROM o WHERE rn = 1
  UNION ALL
  SELECT l_orderkey, l_linenumber, rn, k, used + CASE WHEN k THEN size ELSE 0 END FROM (
    SELECT o.l_orderkey, o.l_linenumber, o.rn, o.size, f.used, o.score >= 0.02 AND f.used < 90 AND f.used + o.size <= 90 AS k FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.rn = f.rn + 1))
SELECT l_orderkey, l_linenumber, taken FROM f WHERE rn > 0""",
    "scored_line_split": """
WITH RECURSIVE k(mark, worth) AS (VALUES ('。', 100), ('！', 100), ('？', 100), ('；', 80), ('.', 100), ('!', 100), ('?', 100), (';', 80), ('，', 60), (',', 60), ('、', 40), ('：', 50), (':', 50)),
m AS (SELECT map(list(mark ORDER BY mark), list(worth ORDER BY mark)) AS w FROM k),
p AS (
  SELECT conv_id, turn, '' AS path, text AS t, length(text) > 42 AS open FROM conversations WHERE text <> ''
  UNION ALL
  SELECT conv_id, turn, path || side, part, length(part) > 42 FROM (
    SELECT conv_id, turn, path, unnest(['0', '1']) AS side, unnest([regexp_replace(t[:cut], '\\s+$', ''), regexp_replace(t[cut + 1:], '^\\s+', '')]) AS part FROM (
      SELECT conv_id, turn, path, t, CASE WHEN best IS NOT NULL THEN -(best % 1000000) + 1000000 WHEN length(t) <= 60 THEN NULL WHEN blank > 0 THEN blank ELSE 42 END AS cut FROM (
        SELECT p.*, list_max(list_filter(list_transform(generate_series(1, length(t)), lambda i: CASE WHEN w[t[i]] IS NOT NULL AND least(i, length(t) - i) > 4 THEN (w[t[i]] - abs(2 * i - length(t)) + 100000) * 1000000 + 1000000 - i END), lambda x: x IS NOT NULL)) AS best,
               list_max(list_filter(generate_series(5, 42), lambda i: t[i] = ' ')) AS blank
        FROM p, m WHERE open)) WHERE cut IS NOT NULL) WHERE part <> ''),
z AS (SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.conv_id = a.conv_id AND b.turn = a.turn AND b.path IN (a.path || '0', a.path || '1')))
SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY path) - 1 AS line_no, t AS line FROM z""",
    "weak_headings": """
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
t AS (SELECT doc_id, line, trim(line) AS t FROM l),
h AS (
  SELECT doc_id, length(t) BETWEEN 1 AND 100 AND NOT regexp_matches(t, '[|]|://|^(http:|https:|www\\.)|[。！？；，,;]$|^[\\d\\s./年月日:-]+$') AND (
      regexp_matches(t, '^#{1,6}\\s+\\S.{0,79}$') OR regexp_matches(t, '^第[一二三四五六七八九十百千万零〇两0-9]+[章节篇部]\\s*[:：、.．-]?\\s*(\\S.{0,59})?$')
      OR regexp_matches(t, '^[一二三四五六七八九十百千万零〇两]+[、.．]\\s*\\S.{0,59}$') OR regexp_matches(t, '^[（(]\\s*[一二三四五六七八九十百千万零〇两]+\\s*[）)]\\s*\\S.{0,59}$')
      OR regexp_matches(t, '^\\d{1,2}\\.\\d{1,2}(\\.\\d{1,2})?\\s+\\S.{0,59}$') OR regexp_matches(t, '^\\d{1,2}[、．]\\s*\\S.{0,59}$') OR regexp_matches(t, '^\\d{1,2}\\.(\\s+\\S|[^\\s%\\d]).{0,59}$')) AS heading,
    regexp_matches(t, '(?i)^\\s*(目录|contents)\\s*$') OR regexp_matches(t, '(?:[.…·•。．\\s]{3,}|\\t+)\\s*\\d{1,4}\\s*$') OR regexp_matches(t, '\\.{2,}\\s*\\d{1,4}$')
      OR regexp_matches(t, '(?i)^\\s*(chapter\\s*\\d+|第[一二三四五六七八九十百千万零〇两0-9]+[章节篇]|[（(]?[一二三四五六七八九十百千万零〇两0-9]+[)）]|\\d+[、.．]).{0,64}\\d{1,4}$') OR (length(t) <= 80 AND regexp_matches(t, '[·•\\s]{2,}\\d{1,4}$')) AS toc,
    regexp_matches(line, '(?i)^\\s*((图表|图|表)\\s*\\d|(figure|fig\\.?|table)\\s*\\d+)') AS figure
  FROM t)
SELECT doc_id, count(*) FILTER (WHERE heading) AS headings, count(*) FILTER (WHERE toc) AS toc_lines, count(*) FILTER (WHERE figure) AS figures, count(*) AS lines FROM h GROUP BY 1""",
}
