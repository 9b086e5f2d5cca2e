"""DuckDB SQL for the operators that SQL can express, written independently of the Spark plans."""

from __future__ import annotations

_SPLIT = r"list_filter(regexp_split_to_array({0}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"

PASSAGES = f"""
WITH w AS (SELECT doc_id, {_SPLIT.format("coalesce(text, '')")} AS ws FROM documents),
starts AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
firsts AS (SELECT k, min(doc_id) AS f FROM starts GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM starts JOIN firsts USING (k), range(50) t(j) WHERE f < doc_id),
words AS (SELECT doc_id, generate_subscripts(ws, 1) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT words.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, string_agg(word, ' ' ORDER BY words.p) FILTER (gone.p IS NULL) AS rest
  FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY words.doc_id)
SELECT w.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

NEAR_COPIES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(ws[i : i + 3], ' ')) AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id < b.doc_id GROUP BY ALL),
l AS MATERIALIZED (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
e AS MATERIALIZED (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
walk(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.doc_id, e.y FROM walk JOIN e ON e.x = walk.reached)
SELECT walk.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(reached) AS component_id, min(reached) = walk.doc_id AS kept FROM walk LEFT JOIN n ON n.doc_id = walk.doc_id GROUP BY walk.doc_id
"""

LINES = f"""
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL),
e AS (SELECT doc_id, line_no, ws, array_to_string(ws, ' ') AS k, doc_id * 1000000 + line_no AS pos FROM (SELECT doc_id, line_no, {_SPLIT.format("line")} AS ws FROM l) WHERE len(ws) > 0),
d AS (SELECT k, any_value(ws) AS ws, min(pos) AS pos FROM e GROUP BY k),
m AS (SELECT DISTINCT k, ws, pos, unnest([len(ws) // 2, (len(ws) - 1) // 2]) AS m FROM d WHERE len(ws) >= 5),
h AS (SELECT k, ws, pos, m, 'head' AS side, md5(array_to_string(ws[1 : m], ' ')) AS part FROM m UNION ALL SELECT k, ws, pos, m, 'tail', md5(array_to_string(ws[len(ws) - m + 1 : len(ws)], ' ')) FROM m),
c AS (SELECT DISTINCT a.k AS k, CASE WHEN len(a.ws) >= len(b.ws) THEN a.ws ELSE b.ws END AS x, CASE WHEN len(a.ws) >= len(b.ws) THEN b.ws ELSE a.ws END AS y
  FROM h a JOIN h b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND a.pos > b.pos AND abs(len(a.ws) - len(b.ws)) <= 1),
near AS (SELECT DISTINCT k FROM c WHERE CASE WHEN len(x) = len(y) THEN len(list_filter(range(1, len(x) + 1), lambda i: x[i] <> y[i])) <= 1
  ELSE len(list_filter(range(1, len(x) + 1), lambda i: list_concat(x[1 : i - 1], x[i + 1 : len(x)]) = y)) > 0 END),
gone AS (SELECT e.doc_id, e.line_no FROM e JOIN d USING (k) WHERE e.pos > d.pos OR k IN (SELECT k FROM near)),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.line_no) AS n_removed, string_agg(line, chr(10) ORDER BY l.line_no) FILTER (gone.line_no IS NULL) AS rest
  FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.line_no = l.line_no GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(rest, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

_NORMAL = r"lower(trim(regexp_replace({0}, '[ \t\n\r\f\v]+', ' ', 'g')))"
_UNITS = f"""list_filter(list_distinct(list_transform(list_concat([{{0}}], regexp_split_to_array({{0}}, '\\n[ \\t\\r]*\\n')), lambda x: {_NORMAL.format("x")})), lambda x: x <> '')"""

QUOTES = f"""
WITH RECURSIVE b AS (SELECT conv_id, turn, min(text) AS t FROM conversations WHERE text IS NOT NULL GROUP BY ALL),
th AS (SELECT c.conv_id, c.turn, c.role, coalesce('> > ' || replace(b2.t, chr(10), chr(10) || '> > ') || chr(10), '') || coalesce('> ' || replace(b1.t, chr(10), chr(10) || '> ') || chr(10), '') || chr(10) || coalesce(c.text, '') AS text
  FROM conversations c LEFT JOIN b b1 ON b1.conv_id = c.conv_id AND b1.turn + 1 = c.turn LEFT JOIN b b2 ON b2.conv_id = c.conv_id AND b2.turn + 2 = c.turn),
l0 AS (SELECT conv_id, turn, generate_subscripts(string_split(text, chr(10)), 1) AS no, unnest(string_split(text, chr(10))) AS line FROM th),
l AS (SELECT conv_id, turn, no, length(regexp_replace(regexp_extract(line, '^(?:[ \\t]*>)+'), '[^>]', '', 'g')) AS level, regexp_replace(regexp_replace(line, '^(?:[ \\t]*>)+', ''), '^ ', '') AS body FROM l0),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id, turn ORDER BY no) AS run FROM (SELECT *, CASE WHEN lag(level) OVER (PARTITION BY conv_id, turn ORDER BY no) = level THEN 0 ELSE 1 END AS fresh FROM l)),
q AS (SELECT conv_id, turn, run, level, string_agg(body, chr(10) ORDER BY no) AS text FROM i WHERE level > 0 GROUP BY ALL),
own AS (SELECT conv_id, turn, trim(regexp_replace(string_agg(body, chr(10) ORDER BY no) FILTER (level = 0), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g')) AS content FROM i GROUP BY ALL),
m AS (SELECT th.conv_id, th.turn, th.role, coalesce(content, '') AS content FROM th JOIN own ON own.conv_id = th.conv_id AND own.turn = th.turn),
u AS (SELECT conv_id, turn, unnest({_UNITS.format("content")}) AS unit FROM m),
here AS (SELECT conv_id, unit, min(turn) AS first_turn FROM u GROUP BY ALL),
anyw AS (SELECT unit, conv_id AS any_conv, first_turn AS any_turn FROM here QUALIFY row_number() OVER (PARTITION BY unit ORDER BY conv_id) = 1),
p0 AS (SELECT conv_id, turn, run, level, {_UNITS.format("text")} AS units FROM q),
p AS (SELECT conv_id, turn, run, level, unnest(units) AS unit, generate_subscripts(units, 1) = 1 AS whole FROM p0),
f0 AS (SELECT p.*, CASE WHEN here.first_turn < p.turn THEN here.first_turn END AS inside FROM p LEFT JOIN here ON here.conv_id = p.conv_id AND here.unit = p.unit),
f AS (SELECT f0.*, inside IS NOT NULL AS near, CASE WHEN inside IS NULL AND any_conv <> conv_id THEN any_conv END AS out_conv, any_turn FROM f0 LEFT JOIN anyw ON anyw.unit = f0.unit),
t AS (SELECT conv_id, turn, run, level, near, whole, coalesce(inside, any_turn) AS to_turn, CASE WHEN near THEN conv_id ELSE out_conv END AS to_conv FROM f WHERE near OR out_conv IS NOT NULL),
n AS (SELECT conv_id, turn, count(DISTINCT run) AS n_linked FROM t GROUP BY ALL),
g AS (SELECT conv_id, turn, near, to_turn, to_conv FROM t WHERE level = 1 QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY near DESC, whole DESC, to_turn DESC, to_conv DESC) = 1),
walk(conv_id, turn, depth, path) AS (SELECT m.conv_id, m.turn, 0, lpad(m.turn::VARCHAR, 10, '0') FROM m LEFT JOIN g ON g.conv_id = m.conv_id AND g.turn = m.turn WHERE g.near IS NOT TRUE
  UNION ALL SELECT g.conv_id, g.turn, depth + 1, path || '/' || lpad(g.turn::VARCHAR, 10, '0') FROM walk JOIN g ON g.near AND g.conv_id = walk.conv_id AND g.to_turn = walk.turn),
o AS (SELECT conv_id, turn, depth, row_number() OVER (PARTITION BY conv_id ORDER BY path) AS position FROM (SELECT DISTINCT conv_id, turn, depth, path FROM walk)),
chat AS (SELECT m.conv_id, (position - 1) // 1000 AS part, md5(string_agg('<|' || coalesce(role, '') || '|>' || chr(10) || content || chr(10), '' ORDER BY position, role, content)) AS chat_md5 FROM m JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn WHERE content <> '' GROUP BY ALL)
SELECT m.conv_id, m.turn, m.role, g.to_conv AS parent_conv_id, g.to_turn AS parent_turn, o.depth, o.position, (SELECT count(*) FROM q WHERE q.conv_id = m.conv_id AND q.turn = m.turn) AS n_quotes,
  coalesce(n.n_linked, 0) AS n_linked, md5(m.content) AS content_md5, (o.position - 1) // 1000 AS part, chat.chat_md5
FROM m LEFT JOIN g ON g.conv_id = m.conv_id AND g.turn = m.turn LEFT JOIN n ON n.conv_id = m.conv_id AND n.turn = m.turn LEFT JOIN o ON o.conv_id = m.conv_id AND o.turn = m.turn
  LEFT JOIN chat ON chat.conv_id = m.conv_id AND chat.part = (o.position - 1) // 1000
"""

_PLAIN = r"list_filter(regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

LEAKS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_PLAIN.format("text")} AS ws FROM documents),
i AS (SELECT item_id, {_PLAIN.format("text")} AS ws FROM benchmark),
p AS (SELECT DISTINCT item_id, len(w) AS k, array_to_string(w, ' ') AS s FROM (SELECT item_id, unnest(list_transform(range(1, greatest(1, len(ws) - 9) + 1), lambda j: ws[j : j + 9])) AS w FROM i WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT k FROM p),
s AS (SELECT r, j, k, array_to_string(ws[j : j + k - 1], ' ') AS s FROM (SELECT r, ws, k, unnest(range(1, len(ws) - k + 2)) AS j FROM d, lens WHERE len(ws) >= k)),
o AS (SELECT r, j, s.k AS k, item_id FROM s JOIN p ON p.k = s.k AND p.s = s.s),
h AS (SELECT r, count(DISTINCT j + q) AS n_hit FROM (SELECT DISTINCT r, j, k FROM o), range(10) t(q) WHERE q < k GROUP BY r),
n AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM o GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""

AUDIT = """
WITH RECURSIVE w AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
j AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
  {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
   'E': coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)} AS x FROM w LEFT JOIN j USING (doc_id)),
g AS (SELECT part, good, toxic, (CASE WHEN x.A THEN 'A' ELSE '' END) || (CASE WHEN x.B THEN 'B' ELSE '' END) || (CASE WHEN x.C THEN 'C' ELSE '' END) || (CASE WHEN x.D THEN 'D' ELSE '' END) || (CASE WHEN x.E THEN 'E' ELSE '' END) AS fails, count(*) AS n FROM f GROUP BY ALL),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || l FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l) WHERE NOT contains(filter_order, l)),
s AS (SELECT filter_order, step, filter_order[step : step] AS l, filter_order[1 : step - 1] AS before FROM (SELECT filter_order, unnest(range(1, 6))::INT AS step FROM o WHERE length(filter_order) = 5)),
y AS (SELECT part, filter_order, step, l, good, toxic, n, contains(fails, l) AS hit, fails = l AS alone, length(translate(fails, before, '')) < length(fails) AS earlier FROM g, s),
r AS (SELECT part, filter_order, step, l, sum(n) FILTER (NOT hit AND NOT earlier) AS kept, sum(n) FILTER (hit AND NOT earlier) AS removed, sum(n) FILTER (hit AND earlier) AS redundant, sum(n) FILTER (alone) AS unique_fails,
  sum(n) FILTER (hit AND NOT earlier AND good) AS good_lost, sum(n) FILTER (hit AND NOT earlier AND toxic) AS toxic_lost FROM y GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, l), 0)::BIGINT AS shapley FROM r
"""


def _codes(rounds: int = 4, entries: int = 256) -> str:
    """Four parts, k-means from the smallest ids; x holds the integers of a part."""
    near = """a{r} AS MATERIALIZED (SELECT rid, p, (m % 256)::BIGINT AS e, m // 256 AS d FROM (SELECT rid, x.p AS p, min((list_inner_product(x.x, x.x) - 2 * list_inner_product(x.x, c.x) + list_inner_product(c.x, c.x))::BIGINT * 256 + c.e) AS m
  FROM x JOIN c{r} c ON c.p = x.p GROUP BY ALL))"""
    move = """c{n} AS MATERIALIZED (SELECT c.p AS p, c.e AS e, coalesce(n.x, c.x) AS x FROM c{r} c LEFT JOIN (SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT p, e, i, floor(sum(v) / count(*)) AS s
  FROM (SELECT x.p AS p, a.e AS e, generate_subscripts(x.x, 1) AS i, unnest(x.x) AS v FROM x JOIN a{r} a USING (rid, p)) GROUP BY ALL) GROUP BY ALL) n ON n.p = c.p AND n.e = c.e)"""
    steps = ", ".join(near.format(r=r) + (", " + move.format(r=r, n=r + 1) if r < rounds else "") for r in range(rounds + 1))
    return f"""
WITH v AS (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid, vec_id, label, embedding FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
x AS MATERIALIZED (SELECT rid, p, list_transform(embedding[p * len(embedding) // 4 + 1 : (p + 1) * len(embedding) // 4], lambda y: floor(1024 * y::DOUBLE)) AS x FROM v, range(4) t(p)),
c0 AS (SELECT p, rid - 1 AS e, x FROM x WHERE rid <= {entries}), {steps},
h AS (SELECT sha256(string_agg(v::BIGINT::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, generate_subscripts(x, 1) AS i, unnest(x) AS v FROM c{rounds})),
k AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN k USING (rid), h
"""


CODES = _codes()
