"""DuckDB SQL that must give the rows of the queries, where SQL can state them."""

CHAT_SQL = r"""
WITH rows_ AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS place,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) + 1 AS tokens
  FROM rows_),
led AS (
  SELECT *, place = 0 AND role = 'system' AS lead_in FROM numbered),
summed AS (
  SELECT *,
    CASE WHEN lead_in THEN 0 ELSE tokens END AS own_tokens,
    max(CASE WHEN lead_in THEN tokens ELSE 0 END) OVER (PARTITION BY conv_id) AS system_tokens
  FROM led),
begun AS (
  SELECT *, sum(own_tokens) OVER (PARTITION BY conv_id ORDER BY place) - own_tokens AS begin_,
         greatest(128, 384 - system_tokens) AS room
  FROM summed),
homes AS (
  SELECT *, CASE WHEN lead_in THEN 0 ELSE floor(begin_ / room)::BIGINT END AS home FROM begun),
turns AS (
  SELECT *,
    length(replace(replace(replace(replace(replace(role, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]'))
    + length(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'),
      '[INST]', '[\INST]'), '[/INST]', '[\/INST]')) + 20 AS chars
  FROM homes),
firsts AS (
  SELECT conv_id, home, min(place) AS place, min(begin_) AS begin_ FROM turns WHERE NOT lead_in GROUP BY ALL),
repeats AS (
  SELECT t.conv_id, sum(t.chars) AS chars
  FROM turns t JOIN firsts f
    ON f.conv_id IS NOT DISTINCT FROM t.conv_id AND f.home > t.home
   AND (t.lead_in OR (f.place - t.place BETWEEN 1 AND 2 AND f.begin_ - t.begin_ <= 128))
  GROUP BY ALL)
SELECT t.conv_id, count(*) AS n_turns,
  sha256(string_agg(t.role || chr(10) || t.text || chr(10), '' ORDER BY t.place)) AS turns_sha256,
  coalesce(sum(length(t.text)) FILTER (WHERE t.role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(t.text, '' ORDER BY t.place) FILTER (WHERE t.role = 'assistant'), '')) AS loss_sha256,
  (sum(t.chars) + coalesce(max(r.chars), 0))::BIGINT AS formatted_chars
FROM turns t LEFT JOIN repeats r ON r.conv_id IS NOT DISTINCT FROM t.conv_id
GROUP BY t.conv_id
"""

NEAR_SQL = r"""
WITH RECURSIVE words_ AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[]
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words_),
texts AS (  -- equal sets once: the smallest id stands for them
  SELECT doc_id, len(s) AS n, s, min(doc_id) OVER (PARTITION BY list_sort(s)) AS rep FROM sets),
members AS (
  SELECT doc_id AS rep, n, unnest(s) AS shingle FROM texts WHERE doc_id = rep),
links AS (
  SELECT a.rep AS a, b.rep AS b
  FROM members a JOIN members b ON a.shingle = b.shingle AND a.rep < b.rep AND a.n * 4 >= b.n * 3 AND b.n * 4 >= a.n * 3
  GROUP BY a.rep, b.rep, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(node, seen) AS (
  SELECT DISTINCT a, a FROM edges
  UNION
  SELECT e.b, r.seen FROM reach r JOIN edges e ON e.a = r.node),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT t.doc_id, t.n AS n_shingles,
  CASE WHEN t.n = 0 THEN t.doc_id ELSE coalesce(c.component, t.rep) END AS component_id,
  t.doc_id = CASE WHEN t.n = 0 THEN t.doc_id ELSE coalesce(c.component, t.rep) END AS kept
FROM texts t LEFT JOIN components c ON c.node = t.rep
"""

VECTORS_SQL = r"""
WITH RECURSIVE unit AS (
  SELECT vec_id, embedding::DOUBLE[] AS v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) AS length
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v)
  WHERE list_dot_product(a.v, b.v) / (a.length * b.length) >= 0.95),
reach(node, seen) AS (
  SELECT DISTINCT a, a FROM links
  UNION
  SELECT l.b, r.seen FROM reach r JOIN links l ON l.a = r.node),
components AS (SELECT node, min(seen) AS component FROM reach GROUP BY node),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id,
  coalesce(c.component, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN components c ON c.node = e.vec_id LEFT JOIN counts n ON n.a = e.vec_id
"""

URLS_SQL = r"""
WITH rules(host, path, verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
addresses AS (
  SELECT page_id, row_number() OVER () AS nr,
    coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
fits AS (
  SELECT a.nr, r.host || r.path AS rule, r.verdict
  FROM addresses a JOIN rules r
    ON (a.host = r.host OR ends_with(a.host, '.' || r.host)) AND starts_with(a.path, r.path)
  QUALIFY row_number() OVER (PARTITION BY a.nr ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) = 1)
SELECT a.page_id, a.host, a.path, f.rule, coalesce(f.verdict, 'allow') AS verdict,
  CASE WHEN f.rule IS NOT NULL THEN split_part(f.rule, '/', 1) END AS rule_host,
  CASE WHEN f.rule IS NOT NULL THEN substr(f.rule, instr(f.rule, '/')) END AS rule_path
FROM addresses a LEFT JOIN fits f ON f.nr = a.nr
"""

TRIE_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
    md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
numbered AS (
  SELECT conv_id, digest, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, digest) - 1 AS place
  FROM turns),
convs AS (  -- crc32 of the decimal number, bit by bit
  SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS family,
    xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
      lambda c, b: list_reduce(list_concat([xor(c, b)], range(8)),
        lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295::BIGINT) % 4 AS taken
  FROM (SELECT DISTINCT conv_id FROM numbered)),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, n.place, n.digest, n.words
  FROM convs c JOIN numbered n ON n.conv_id = c.family AND n.place < c.taken
  UNION ALL
  SELECT c.conv_id, 1, n.place, n.digest, n.words
  FROM convs c JOIN numbered n ON n.conv_id = c.conv_id AND n.place >= c.taken),
paths AS (
  SELECT c.conv_id, coalesce(list(r.digest ORDER BY part, place) FILTER (WHERE r.digest IS NOT NULL), []) AS path,
    coalesce(list(r.words ORDER BY part, place) FILTER (WHERE r.digest IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN rebuilt r ON r.conv_id = c.conv_id GROUP BY c.conv_id),
steps AS (
  SELECT conv_id, d, path[1:d] AS node, coalesce(words[d], 0) AS words, d = len(path) AS ending
  FROM paths, unnest(range(len(path) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ending), '')) AS ends_sha256
  FROM steps GROUP BY node, d),
children AS (SELECT node[1:d - 1] AS node, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
full_ AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c ON c.node = n.node),
sums AS (
  SELECT f.node[1:t.j] AS node, sum((f.n_children = 0)::BIGINT)::BIGINT AS n_leaves,
    sum((f.n_convs - 1) * f.words)::BIGINT AS saved_tokens
  FROM full_ f, unnest(range(f.d + 1)) AS t(j) GROUP BY 1)
SELECT f.conv_id, f.d AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children, s.n_leaves, s.saved_tokens, f.ends_sha256
FROM full_ f JOIN sums s ON s.node = f.node LEFT JOIN full_ p ON f.d > 0 AND p.node = f.node[1:f.d - 1]
"""
