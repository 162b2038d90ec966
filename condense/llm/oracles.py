"""DuckDB SQL of the queries that SQL can express."""

#: CRC-32 of the text ``{0}``, with ``crc.t`` the table of its 256 remainders.
_CRC = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode({0}))),
    lambda i: CAST('0x' || substr(hex(encode({0})), CAST(2 * i + 1 AS INT), 2) AS BIGINT))),
    lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])), 4294967295::BIGINT)"""
_CRC_TABLE = """crc AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda a, k: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384::BIGINT) ELSE a >> 1 END)) AS t)"""

ORACLES = {
    "op12_resample": f"""
WITH {_CRC_TABLE},
w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM (SELECT doc_id, text FROM documents UNION ALL SELECT -1 - item_id, text FROM benchmark)),
f AS (
  SELECT doc_id, f, count(*) AS n FROM (
    SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w)
  GROUP BY ALL),
h AS (SELECT f, {_CRC.format("f")} % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), crc),
c AS (
  SELECT bucket, coalesce(sum(n) FILTER (doc_id >= 0), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (doc_id < 0), 0)::DOUBLE AS t
  FROM f JOIN h USING (f) GROUP BY bucket),
a AS (SELECT sum(s) AS s_all, sum(t) AS t_all FROM c),
g AS (SELECT bucket, floor(1000 * ln((t + 1) * (s_all + 10000) / ((s + 1) * (t_all + 10000)))) AS gain FROM c, a),
m AS (
  SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight
  FROM f JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
d AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) AS h
  FROM documents LEFT JOIN m USING (doc_id)),
r AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score,
         n_features >= 39 AS able FROM d)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= 25 * total // 100 THEN place END AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) FILTER (able) OVER () AS total FROM r)
""",
    "op13_trie": f"""
WITH {_CRC_TABLE},
o AS (
  SELECT conv_id, list((coalesce(role, ''), coalesce(text, '')) ORDER BY turn NULLS FIRST) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
k AS (SELECT conv_id, turns, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h FROM o, crc),
c AS (
  SELECT k.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.turns[1:h] END, k.turns[h + 1:]) AS turns
  FROM k LEFT JOIN o b ON b.conv_id = k.conv_id - k.conv_id % 100),
p AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM c),
n AS (
  SELECT turns[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, bool_and(len(turns) = depth) AS leaf,
         coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (len(turns) = depth), '') AS ends
  FROM p GROUP BY ALL),
s AS (
  SELECT path, unnest(range(0, depth + 1)) AS above, leaf, CASE WHEN depth = 0 THEN 0 ELSE (n_convs - 1) * length(path[-1][2]) END AS saved
  FROM n),
t AS (
  SELECT path[1:above] AS path, count(*) FILTER (leaf) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens,
         count(*) FILTER (len(path) = above + 1) AS n_children
  FROM s GROUP BY path[1:above])
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, t.n_children, t.n_leaves, t.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN t ON t.path = n.path LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]
""",
    "op5_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h,
             min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(k // 4 AS INT) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (k % 4) AS INT)) & 31) AS INT) + 1, 1)),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM f
""",
    "op6_itq": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT e.vec_id, (SELECT count(*) FROM links WHERE links.a = e.vec_id) AS n_links, c.component_id,
       e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c ON c.a = e.vec_id
""",
    "op10_chosen_path": """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
c AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.a = d.doc_id
""",
    "op9_chat": """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, length(regexp_replace(text, '(<<|<|\\[)(\\\\*)(/?SYS>>|/?s>|/?INST\\]|/?ROLE\\]|/TURN\\]|NEXT\\])', '\\1\\\\\\2\\3', 'g')) AS n,
         lag(role) OVER w IS NOT DISTINCT FROM role AS goes_on, lead(role) OVER w IS NOT DISTINCT FROM role AS more
  FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
f AS (
  SELECT *, n + CASE WHEN goes_on THEN 6 WHEN role = 'user' THEN 10 WHEN role = 'assistant' THEN 1 WHEN role = 'system' THEN 8 ELSE 13 + length(role) END
              + CASE WHEN more THEN 0 WHEN role = 'user' THEN 8 WHEN role = 'assistant' THEN 4 WHEN role = 'system' THEN 11 ELSE 7 END AS chars
  FROM e)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
""",
}
