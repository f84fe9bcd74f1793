"""DuckDB SQL of those queries that SQL expresses over whole tables in reasonable time."""

LINES = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(parts, 1) AS pos, unnest(parts) AS line
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
), keyed AS (
  SELECT *, translate(
    trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeated AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.keeper AS gone
  FROM keyed AS k LEFT JOIN repeated AS r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

TOP_SCORES = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM vectors AS q JOIN vectors AS c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

CONVERSATION_TRIE = """
WITH placed AS (
  SELECT conv_id, k, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, k) AS pos
  FROM (
    SELECT conv_id, turn, length(coalesce(text, '')) AS n,
           md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k
    FROM conversations WHERE conv_id IS NOT NULL
  )
), convs AS (  -- the checksum: bytes, each with eight shifts after it
  SELECT conv_id, xor(list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END
  ), 4294967295) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM placed)
), given AS (
  SELECT c.conv_id, 0 AS part, p.pos, p.k, p.n
  FROM convs AS c JOIN placed AS p ON p.conv_id = c.conv_id - c.conv_id % 100 AND p.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, p.pos, p.k, p.n FROM convs AS c JOIN placed AS p ON p.conv_id = c.conv_id AND p.pos > c.h
), sequences AS (
  SELECT c.conv_id, coalesce(list(g.k ORDER BY part, pos) FILTER (g.k IS NOT NULL), []) AS ks,
         coalesce(list(g.n ORDER BY part, pos) FILTER (g.k IS NOT NULL), []) AS ns
  FROM convs AS c LEFT JOIN given AS g ON c.conv_id = g.conv_id GROUP BY c.conv_id
), beginnings AS (
  SELECT conv_id, ns, len(ks) AS len,
         list_transform(range(len(ks) + 1), lambda e: concat(e, ':', md5(array_to_string(ks[1:e], ',')))) AS path
  FROM sequences
), entries AS (
  SELECT conv_id, ns, len, path, unnest(range(len + 1)) AS depth FROM beginnings
), nodes AS (
  SELECT path[depth + 1] AS node, depth, any_value(path[depth]) AS parent, any_value(path[1:depth + 1]) AS path, min(conv_id) AS conv_id,
         count(*) AS n_convs, CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * any_value(ns[depth]) END AS own,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len = depth), '')) AS ends_sha256
  FROM entries GROUP BY path[depth + 1], depth
), children AS (
  SELECT parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent
), sums AS (
  SELECT above AS node, sum(own) AS saved_tokens, count(*) FILTER (leaf) AS n_leaves
  FROM (
    SELECT unnest(n.path) AS above, own, c.node IS NULL AS leaf FROM nodes AS n LEFT JOIN children AS c ON n.node = c.node
  ) GROUP BY above
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, s.n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes AS n JOIN sums AS s ON n.node = s.node LEFT JOIN children AS c ON n.node = c.node
LEFT JOIN nodes AS p ON n.depth > 0 AND n.parent = p.node
"""

ORACLES: dict[str, str] = {
    "op1_line_dedup": LINES,
    "op4_exact_top": TOP_SCORES,
    "op13_conversation_trie": CONVERSATION_TRIE,
}
