"""The results of the queries as DuckDB SQL, by plainer methods: whole comparisons, recursion and joins on prefixes."""

from __future__ import annotations

_BLANK = r"\x20\x09-\x0D"

# crc32 of ASCII text, byte by byte over a table made from its polynomial
_CRC_TABLE = ("SELECT list(v ORDER BY n) AS t FROM (SELECT n, list_reduce([CAST(n AS BIGINT), 0, 0, 0, 0, 0, 0, 0, 0], "
              "lambda a, b: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(n))")


def _crc32(text: str) -> str:
    """Over rows that also hold the table ``t``."""
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, length({text}) + 1), "
            f"lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), "
            "4294967295)")


def _usable(v: str) -> str:
    return (f"({v} IS NOT NULL AND len({v}) > 0 AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0)")


_WORDS = f"regexp_extract_all(COALESCE({{}}, ''), '[^{_BLANK}]+')"


def _classes(ids: str, links: str) -> str:
    """The smallest id reachable over ``links`` (a, b, both ways) of each of ``ids`` (id)."""
    return (f"reached AS (SELECT id, id AS other FROM {ids} UNION SELECT r.id, l.b FROM reached r JOIN {links} l ON l.a = r.other), "
            "classes AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)")


OP1 = f"""
WITH RECURSIVE split AS (SELECT doc_id, {_WORDS.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w
                         FROM documents),
sets AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
           ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s FROM split),
flat AS (SELECT doc_id, len(s) AS n, unnest(s) AS shingle FROM sets),
links AS (SELECT x.doc_id AS a, y.doc_id AS b FROM flat x JOIN flat y ON y.shingle = x.shingle AND y.doc_id <> x.doc_id
          GROUP BY x.doc_id, y.doc_id, x.n, y.n HAVING 100 * count(*) >= 75 * (x.n + y.n - count(*))),
ids AS (SELECT doc_id AS id FROM documents), {_classes('ids', 'links')}
SELECT doc_id, len(s) AS n_shingles, component_id, doc_id = component_id AS kept FROM sets JOIN classes ON id = doc_id
"""

OP3 = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
                     WHERE {_usable('embedding')} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON y.vec_id <> x.vec_id AND len(y.e) = len(x.e)
          WHERE list_cosine_similarity(x.e, y.e) >= 0.95),
ids AS (SELECT vec_id AS id FROM embeddings), {_classes('ids', 'links')}
SELECT id AS vec_id, (SELECT count(*) FROM links WHERE a = id) AS n_links, component_id, id = component_id AS kept FROM classes
"""

OP5 = f"""
WITH split AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM split),
starts AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, w FROM split WHERE len(w) >= 35),
windows AS (SELECT doc_id, i, count(*) OVER (PARTITION BY array_to_string(w[i:i + 34], ' ')) > 1 AS again FROM starts),
marked AS (SELECT x.doc_id, x.i, x.word, bool_or(COALESCE(y.again, FALSE)) OVER
             (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone
           FROM words x LEFT JOIN windows y ON y.doc_id = x.doc_id AND y.i = x.i),
sums AS (SELECT doc_id, count(*) FILTER (WHERE gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone) AS kept
         FROM marked GROUP BY doc_id)
SELECT s.doc_id, len(s.w) AS n_words, COALESCE(n_removed, 0) AS n_removed, sha256(COALESCE(kept, '')) AS kept_sha256
FROM split s LEFT JOIN sums m ON m.doc_id = s.doc_id
"""

OP10 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND {_usable('embedding')}),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM d) WHERE rank <= 5
"""

OP11 = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND {_usable('embedding')} AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
        sqrt(list_reduce(list_prepend(CAST(0 AS DOUBLE), list_transform(list_zip(q.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))),
                         lambda a, b: a + b)) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
"""

OP12 = f"""
WITH RECURSIVE crc AS ({_CRC_TABLE}),
base AS (SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
                COALESCE(CAST(conv_id AS VARCHAR), ' ') || ':' || COALESCE(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
kinds AS (SELECT *, {_crc32('k')} % 20 AS kind FROM base, crc),
harmed AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                  CASE WHEN kind = 1 THEN '' WHEN kind = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, kind
           FROM kinds WHERE kind <> 0),
twice AS (SELECT * FROM harmed UNION ALL SELECT * FROM harmed WHERE kind = 3),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM twice),
faulty AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS initial,
             CASE WHEN NOT regexp_matches(text, '[^{_BLANK}]') THEN 'blank'
                  WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                  WHEN NOT regexp_matches(text, '[.!?][{_BLANK}]*$') THEN 'truncated' ELSE '' END AS fault,
             lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed),
added(q, q2, ops, lines) AS (VALUES
  (0, 0, '', ''), (0, 2, 'I', chr(10) || 'user:'), (0, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (1, 1, '', ''), (1, 2, 'I', chr(10) || 'user:'), (1, 3, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'),
  (2, 2, '', ''), (2, 3, 'I', chr(10) || 'assistant:'), (3, 3, '', ''), (3, 2, 'I', chr(10) || 'user:')),
used(op, q, initial, q2, role, price) AS (VALUES
  ('D', 0, NULL, 0, NULL, 3), ('D', 1, NULL, 1, NULL, 3), ('D', 2, NULL, 2, NULL, 3), ('D', 3, NULL, 3, NULL, 3),
  ('K', 0, 's', 1, NULL, 0), ('K', 0, 'u', 2, NULL, 0), ('K', 1, 'u', 2, NULL, 0), ('K', 3, 'u', 2, NULL, 0), ('K', 2, 'a', 3, NULL, 0),
  ('R', 0, NULL, 2, 'user', 2), ('R', 1, NULL, 2, 'user', 2), ('R', 3, NULL, 2, 'user', 2), ('R', 2, NULL, 3, 'assistant', 2)),
ways(conv_id, i, q, best) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), 0, {{'cost': CAST(0 AS BIGINT), 'audit': '', 'lines': ''}} FROM placed
  UNION ALL
  SELECT w.conv_id, f.i, u.q2, min({{
      'cost': CAST(w.best.cost + 2 * length(a.ops) + u.price + CASE WHEN u.op <> 'D' AND f.fault = 'truncated' THEN 1 ELSE 0 END AS BIGINT),
      'audit': w.best.audit || a.ops || u.op,
      'lines': w.best.lines || a.lines || CASE WHEN u.op = 'D' THEN '' ELSE chr(10) || COALESCE(u.role, f.role) || ':' || f.text END}})
  FROM ways w JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1
  JOIN added a ON a.q = w.q
  JOIN used u ON u.q = a.q2 AND (u.op = 'D' OR f.fault NOT IN ('blank', 'duplicate') AND (u.op = 'R' OR u.initial = f.initial))
  GROUP BY w.conv_id, f.i, u.q2),
sums AS (SELECT conv_id, count(*) AS n, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
           count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
           count(*) FILTER (WHERE fault = 'truncated') AS truncated,
           count(*) FILTER (WHERE i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
         FROM faulty GROUP BY conv_id),
final AS (SELECT w.conv_id, min({{'cost': CAST(w.best.cost + 2 * length(a.ops) AS BIGINT), 'audit': w.best.audit || a.ops,
                               'lines': w.best.lines || a.lines}}) AS best
          FROM ways w JOIN sums s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i
          JOIN added a ON a.q = w.q AND a.q2 IN (0, 3) GROUP BY w.conv_id)
SELECT o.conv_id, COALESCE(s.gaps, 0) AS gaps, COALESCE(s.blank, 0) AS blank, COALESCE(s.duplicate, 0) AS duplicate,
       COALESCE(s.truncated, 0) AS truncated, COALESCE(s.illegal, 0) AS illegal, COALESCE(f.best.cost, 0) AS cost,
       COALESCE(f.best.audit, '') AS audit, sha256(COALESCE(substr(f.best.lines, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN sums s ON s.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN final f ON f.conv_id IS NOT DISTINCT FROM o.conv_id
"""

OP13 = f"""
WITH crc AS ({_CRC_TABLE}),
own AS (SELECT conv_id, COALESCE(role, '') AS role, COALESCE(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, COALESCE(role, ''), COALESCE(text, '')) AS n
        FROM conversations WHERE conv_id IS NOT NULL),
named AS (SELECT conv_id, n, sha256(role || chr(0) || text) AS name,
                 CAST(len(regexp_extract_all(text, '[^{_BLANK}]+')) AS BIGINT) AS words FROM own),
ids AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS k, conv_id - conv_id % 20 AS base FROM (SELECT DISTINCT conv_id FROM named)),
convs AS (SELECT conv_id, base, {_crc32('k')} % 4 AS h FROM ids, crc),
turns AS (SELECT c.conv_id, b.n, b.name, b.words FROM convs c JOIN named b ON b.conv_id = c.base AND b.n <= c.h
          UNION ALL SELECT c.conv_id, o.n + 100, o.name, o.words FROM convs c JOIN named o ON o.conv_id = c.conv_id AND o.n > c.h),
steps AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY n) AS d, words,
                 list(name) OVER (PARTITION BY conv_id ORDER BY n ROWS UNBOUNDED PRECEDING) AS node FROM turns
          UNION ALL SELECT conv_id, 0, 0, [] FROM convs),
lengths AS (SELECT conv_id, max(d) AS length FROM steps GROUP BY conv_id),
nodes AS (SELECT s.node, max(s.d) AS depth, min(s.conv_id) AS conv_id, count(*) AS n_convs, max(s.words) AS words,
                 COALESCE(string_agg(CAST(s.conv_id AS VARCHAR), ',' ORDER BY s.conv_id) FILTER (WHERE s.d = l.length), '') AS ends
          FROM steps s JOIN lengths l ON l.conv_id = s.conv_id GROUP BY s.node),
linked AS (SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.node[:n.depth] = n.node) AS n_children
           FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.node = n.node[:n.depth - 1]),
below AS (SELECT t.node, CAST(count(*) FILTER (WHERE u.n_children = 0) AS BIGINT) AS n_leaves,
                 CAST(sum((u.n_convs - 1) * u.words) AS BIGINT) AS saved_tokens
          FROM linked t JOIN linked u ON u.depth >= t.depth AND u.node[:t.depth] = t.node GROUP BY t.node)
SELECT l.conv_id, CAST(l.depth AS BIGINT) AS depth, l.parent_conv_id, l.n_convs, l.n_children, b.n_leaves, b.saved_tokens,
       sha256(l.ends) AS ends_sha256
FROM linked l JOIN below b ON b.node = l.node
"""

ORACLES = {"op1_minhash_near_dedup": OP1, "op3_embedding_near_dedup": OP3, "op5_substring_dedup": OP5, "op10_exact_topk": OP10,
           "op11_rotated_codes": OP11, "op12_conversation_repair": OP12, "op13_prefix_trie": OP13}
