"""DuckDB statements for the queries whose whole result SQL can express."""

SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d),
ranked AS (
  SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(w[i:i + 19], ' ') ORDER BY doc_id, i) AS nth FROM starts
),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM ranked WHERE nth > 1),
placed AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (
  SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS text, count(*) AS n
  FROM placed p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, (len(d.w) - coalesce(k.n, 0))::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (doc_id)
"""

DECONTAMINATION = r"""
WITH item_words AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
),
doc_words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
),
item_starts AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0),
item_windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM item_starts),
lengths AS (SELECT DISTINCT n FROM item_windows),
doc_starts AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc_words, lengths),
found AS (
  SELECT s.doc_id, s.i, s.n, m.item_id FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc_starts) s
  JOIN item_windows m ON s.n = m.n AND s.g = m.g
),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(h.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM doc_words d LEFT JOIN hit h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

CHAT_FORMAT = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS place FROM t
),
whole AS (
  SELECT conv_id, count(*) AS n, list({'role': role, 'text': text} ORDER BY place) AS turns,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY place) AS shown
  FROM placed GROUP BY conv_id
),
firsts AS (SELECT turns, any_value(n) AS n, any_value(shown) AS shown, min(conv_id) AS conv_id FROM whole GROUP BY turns),
inner_parts AS (SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM firsts))
SELECT conv_id, n::BIGINT AS n_turns, shown AS text FROM firsts f WHERE NOT EXISTS (SELECT 1 FROM inner_parts i WHERE i.turns = f.turns)
"""

NEAR_DEDUP = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared s JOIN sizes x ON s.a = x.doc_id JOIN sizes y ON s.b = y.doc_id WHERE 100 * s.n >= 75 * (x.n + y.n - s.n)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(doc_id, seen) AS (SELECT a, b FROM edges UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON r.seen = e.a),
least_seen AS (SELECT doc_id, min(seen) AS seen FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(l.seen, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(l.seen, d.doc_id)) AS kept
FROM d LEFT JOIN sizes s USING (doc_id) LEFT JOIN least_seen l USING (doc_id)
"""

# One round: nearest centroids, then floors of the means; centroids without vectors stay.
_ASSIGNED = """
a{r} AS MATERIALIZED (
  SELECT id, arg_min(k, (d, k)) AS k, min(d) AS d FROM (
    SELECT e.id, c.k, list_sum(list_transform(list_zip(e.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept e, c{r} c
  ) GROUP BY id
)"""
_MOVED = """
m{r} AS (
  SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM (
    SELECT a.k, u.i, sum(u.x)::BIGINT AS s, count(*) AS n
    FROM a{r} a JOIN (SELECT id, unnest(v) AS x, unnest(range(1, 65)) AS i FROM kept) u USING (id) GROUP BY a.k, u.i
  ) GROUP BY k
),
c{n} AS MATERIALIZED (SELECT c.k, coalesce(m.v, c.v) AS v FROM c{r} c LEFT JOIN m{r} m USING (k))"""
CENTROID_CLUSTERS = f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v FROM (SELECT sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept ORDER BY h, v LIMIT 16)
),
{",".join(_ASSIGNED.format(r=r) + "," + _MOVED.format(r=r, n=r + 1) for r in range(3))},
{_ASSIGNED.format(r=3)}
SELECT e.vec_id, a.k::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM kept e JOIN a3 a USING (id) JOIN c3 c ON c.k = a.k
"""

# Rows are numbered within their conversation; the search is a table of the best (cost, audit) for each of the four states, with
# at most two insertions before each row and at the end.
CONVERSATION_REPAIR = r"""
WITH RECURSIVE bits AS (SELECT list(c ORDER BY n) AS tab FROM (
  SELECT n, list_reduce([n] || list_transform(range(8), lambda i: 0::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
  FROM (SELECT unnest(range(256)) AS n)
)),
keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), '') AS letters
  FROM conversations
),
fates AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce([4294967295] || list_transform(letters, lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS fate
  FROM keyed, bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN fate = 1 THEN '' WHEN fate = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE WHEN fate = 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM fates WHERE fate <> 0
),
placed AS (
  SELECT coalesce(conv_id::VARCHAR, '') AS conv, turn, role, text, left(role, 1) AS initial, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth
  FROM damaged
),
judged AS (
  SELECT *, CASE WHEN body = '' THEN 1 WHEN nth > 1 THEN 2 WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault,
    lag(initial) OVER (PARTITION BY conv ORDER BY i) || initial AS pair
  FROM placed
),
told AS (
  SELECT conv, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) AS n,
    count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM judged GROUP BY conv
),
-- Ways from one state to another without a row, then with one: state 0 nothing, 1 s, 2 u, 3 a.
inserted(a, b, cost, audit) AS (VALUES (0, 0, 0, ''), (1, 1, 0, ''), (2, 2, 0, ''), (3, 3, 0, ''), (0, 2, 3, 'I'), (1, 2, 3, 'I'), (2, 3, 3, 'I'),
  (3, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 3, 6, 'II')),
steps(a, initial, b) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
taken AS (
  SELECT conv, i, s.a, s.b, CASE WHEN s.initial = j.initial THEN 0 ELSE 3 END + CASE WHEN fault = 3 THEN 3 ELSE 0 END AS cost,
    CASE WHEN s.initial = j.initial THEN 'K' ELSE 'R' END AS edit
  FROM judged j, steps s WHERE fault IN (0, 3) AND (s.initial = j.initial OR s.initial <> 's')
  UNION ALL SELECT conv, i, a, a, 4, 'D' FROM judged, (SELECT unnest(range(4)) AS a)
),
best(conv, i, state, cost, audit) AS (
  SELECT conv, 0::BIGINT, 0::BIGINT, 0::BIGINT, '' FROM told
  UNION ALL
  SELECT conv, i, state, least_way.c, least_way.w FROM (
    SELECT b.conv, t.i, t.b::BIGINT AS state, min({'c': (b.cost + x.cost + t.cost)::BIGINT, 'w': b.audit || x.audit || t.edit}) AS least_way
    FROM best b JOIN inserted x ON x.a = b.state JOIN taken t ON t.conv = b.conv AND t.i = b.i + 1 AND t.a = x.b
    GROUP BY b.conv, t.i, t.b
  )
),
solved AS (
  SELECT conv, way.c AS cost, way.w AS audit FROM (
    SELECT b.conv, min({'c': b.cost + x.cost, 'w': b.audit || x.audit}) AS way
    FROM best b JOIN told t ON t.conv = b.conv AND t.n = b.i JOIN inserted x ON x.a = b.state AND x.b IN (0, 3) GROUP BY b.conv
  )
),
edits AS (
  SELECT conv, edit, k, count(*) FILTER (edit <> 'I') OVER (PARTITION BY conv ORDER BY k) AS i,
    count(*) FILTER (edit <> 'D') OVER (PARTITION BY conv ORDER BY k) AS e
  FROM (SELECT conv, unnest(string_split(audit, '')) AS edit, unnest(range(1, len(audit) + 1)) AS k FROM solved WHERE audit <> '')
),
matched AS (
  SELECT e.conv, e.edit, e.k, e.e, CASE WHEN e.edit <> 'I' THEN j.role END AS role, CASE WHEN e.edit <> 'I' THEN j.text END AS text,
    max(CASE WHEN e.edit = 'K' AND e.e = 1 AND j.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY e.conv) AS opened
  FROM edits e LEFT JOIN judged j ON j.conv = e.conv AND j.i = e.i
),
repaired AS (
  SELECT conv, string_agg(CASE WHEN edit = 'K' THEN role WHEN (e - opened) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS whole
  FROM matched WHERE edit <> 'D' GROUP BY conv
)
SELECT o.conv_id, coalesce(t.gaps, 0)::BIGINT AS gaps, coalesce(t.blank, 0)::BIGINT AS blank, coalesce(t.duplicate, 0)::BIGINT AS duplicate,
  coalesce(t.truncated, 0)::BIGINT AS truncated, coalesce(t.illegal, 0)::BIGINT AS illegal, coalesce(s.cost, 0)::BIGINT AS cost,
  coalesce(s.audit, '') AS audit, sha256(coalesce(r.whole, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id::VARCHAR, '') AS conv FROM conversations) o
LEFT JOIN told t USING (conv) LEFT JOIN solved s USING (conv) LEFT JOIN repaired r USING (conv)
"""

ORACLES: dict[str, str] = {
    "op1_substring_dedup": SUBSTRING_DEDUP,
    "op4_decontamination": DECONTAMINATION,
    "op5_chat_format": CHAT_FORMAT,
    "op6_near_dedup": NEAR_DEDUP,
    "op11_centroid_clusters": CENTROID_CLUSTERS,
    "op13_conversation_repair": CONVERSATION_REPAIR,
}
