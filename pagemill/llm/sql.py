"""DuckDB SQL for the queries that SQL can express."""

#: Words of a text or item, lower-cased in ASCII only.
_WORDS = r"""regexp_extract_all(translate(coalesce({x}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

DECONTAMINATION = f"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id, {_WORDS.format(x="text")} AS words FROM documents
), item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS.format(x="text")} AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL
), item_window AS (
  SELECT DISTINCT item, least(len(words), 10) AS n, array_to_string(words[i : i + least(len(words), 10) - 1], ' ') AS w
  FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM item WHERE len(words) > 0)
), doc_window AS (
  SELECT k, i, n, array_to_string(words[i : i + n - 1], ' ') AS w
  FROM (SELECT k, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM item_window) WHERE len(words) >= n)
), hit AS (
  SELECT k, i, n, item FROM doc_window JOIN item_window USING (n, w)
), words_hit AS (
  SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT k, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT k, i, n FROM hit)) GROUP BY k
), items_hit AS (
  SELECT k, count(DISTINCT item) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT k, item FROM hit) GROUP BY k
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN words_hit USING (k) LEFT JOIN items_hit USING (k)
"""

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM pairs
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

URL_FILTER = """
WITH part AS (
  SELECT page_id, CASE WHEN coalesce(strpos(url, '://'), 0) > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id,
         translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) AS path
  FROM part
), rules(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), fitting AS (
  SELECT c.page_id, c.host, c.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY c.page_id, c.host, c.path ORDER BY length(r.host || r.path) DESC, length(r.host) DESC) AS k
  FROM cut c LEFT JOIN rules r ON ends_with('.' || c.host, '.' || r.host) AND starts_with(c.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fitting WHERE k = 1
"""

NEAR_DUPLICATES = """
WITH RECURSIVE doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS words FROM documents
), shingle AS (
  SELECT DISTINCT doc_id, array_to_string(words[i : i + least(len(words), 5) - 1], ' ') AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM doc WHERE len(words) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id
), common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS (
  SELECT x, y FROM common JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 100 * common.n >= 75 * (p.n + q.n - common.n)
), edge AS (
  SELECT x, y FROM link UNION ALL SELECT y, x FROM link
), reach(x, y) AS (
  SELECT doc_id, doc_id FROM doc UNION SELECT r.x, e.y FROM reach r JOIN edge e ON r.y = e.x
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM doc d LEFT JOIN size s ON s.doc_id = d.doc_id JOIN (SELECT x, min(y) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id
"""

#: Marks of quotes at the beginning of a line.
_MARKS = r"^((?:[ \t]{0,3}>)+)[ \t]?"
_NORMAL = r"trim(regexp_replace(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'))"
#: Normalised lines that aren't blank.
_UNITS = "list_filter(list_transform({x}, lambda z: " + _NORMAL.format(x="z") + "), lambda z: z <> '')"

QUOTATION_LINKING = rf"""
WITH RECURSIVE message AS (
  SELECT row_number() OVER () AS k, conv_id, turn, role, regexp_split_to_array(coalesce(text, ''), '\r\n|\n|\r') AS lines FROM conversations
), line AS (
  SELECT k, conv_id, turn, i, length(regexp_replace(regexp_extract(l, '{_MARKS}', 1), '[^>]', '', 'g')) AS level, regexp_replace(l, '{_MARKS}', '') AS t
  FROM (SELECT k, conv_id, turn, unnest(range(1, len(lines) + 1)) AS i, unnest(lines) AS l FROM message)
), run AS (
  SELECT *, i - row_number() OVER (PARTITION BY k, level ORDER BY i) AS g FROM line
), passage AS (
  SELECT k, conv_id, turn, level, min(i) AS no, {_UNITS.format(x="list(t ORDER BY i)")} AS lines, {_NORMAL.format(x="string_agg(t, chr(10) ORDER BY i)")} AS words
  FROM run WHERE level > 0 GROUP BY k, conv_id, turn, level, g HAVING {_NORMAL.format(x="string_agg(t, chr(10) ORDER BY i)")} <> ''
), own AS (
  SELECT m.k, m.conv_id, m.turn, m.role, coalesce(regexp_replace(string_agg(t, chr(10) ORDER BY i) FILTER (level = 0), '^[ \t\n]+|[ \t\n]+$', '', 'g'), '') AS body, max(level) AS max_level
  FROM message m JOIN line l ON l.k = m.k GROUP BY m.k, m.conv_id, m.turn, m.role
), said AS (
  SELECT DISTINCT conv_id, turn, array_to_string({_UNITS.format(x="string_split(body, chr(10))")}, chr(10)) AS lines, {_NORMAL.format(x="body")} AS words FROM own
), asked AS (
  SELECT DISTINCT conv_id, turn, no, level, array_to_string(lines, chr(10)) AS lines, words, lines[1] AS first FROM passage
), linked AS (
  SELECT p.conv_id, p.turn, p.no, p.level, p.words,
    (SELECT max(s.turn) FROM said s WHERE s.conv_id = p.conv_id AND s.turn < p.turn AND contains(chr(10) || s.lines || chr(10), chr(10) || p.lines || chr(10))) AS by_lines,
    (SELECT max(s.turn) FROM said s WHERE s.conv_id = p.conv_id AND s.turn < p.turn AND (s.words = p.words OR (len(string_split(p.words, ' ')) > 2 AND contains(' ' || s.words || ' ', ' ' || p.words || ' ')))) AS by_words,
    (SELECT max(s.turn) FROM said s WHERE s.conv_id = p.conv_id AND s.turn < p.turn AND contains(chr(10) || s.lines || chr(10), chr(10) || p.first || chr(10))) AS by_first
  FROM asked p
), link AS (
  SELECT conv_id, turn, count(*) AS n_linked, max(coalesce(by_lines, by_words, by_first)) FILTER (level = 1) AS quoted,
         string_agg(level || ':' || coalesce(by_lines, by_words, by_first) || CASE WHEN coalesce(by_lines, by_words) IS NULL THEN ':first' ELSE ':whole' END, ',' ORDER BY no, level, md5('w' || words)) AS links
  FROM linked WHERE coalesce(by_lines, by_words, by_first) IS NOT NULL GROUP BY conv_id, turn
), follow AS (
  SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT DISTINCT conv_id, turn FROM message WHERE conv_id IS NOT NULL AND turn IS NOT NULL)
), parent AS (
  SELECT f.conv_id, f.turn, coalesce(n_linked, 0) AS n_linked, links, before, coalesce(quoted, before) AS reply_to FROM follow f LEFT JOIN link l ON l.conv_id = f.conv_id AND l.turn = f.turn
), threaded AS (
  SELECT *, max(CASE WHEN reply_to = before THEN NULL ELSE turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS thread FROM parent
), tree(conv_id, turn, root, depth, path) AS (
  SELECT conv_id, turn, turn, 0, [turn] FROM threaded WHERE reply_to IS NULL
  UNION ALL
  SELECT c.conv_id, c.turn, t.root, t.depth + 1, list_append(t.path, c.turn) FROM tree t JOIN threaded c ON c.conv_id = t.conv_id AND c.reply_to = t.turn
), walked AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY path) - 1 AS reply_order FROM tree
), counted AS (
  SELECT k, count(*) AS n FROM passage GROUP BY k
)
SELECT o.conv_id, o.turn, o.role, o.body, CAST(coalesce(c.n, 0) AS BIGINT) AS n_passages, CAST(coalesce(h.n_linked, 0) AS BIGINT) AS n_linked, CAST(o.max_level AS BIGINT) AS max_level,
       h.reply_to, coalesce(h.thread, o.turn) AS thread, coalesce(t.root, o.turn) AS root, CAST(coalesce(t.depth, 0) AS BIGINT) AS depth,
       coalesce(h.links, '') AS links, CAST(coalesce(t.reply_order, 0) AS BIGINT) AS reply_order
FROM own o LEFT JOIN threaded h ON h.conv_id = o.conv_id AND h.turn = o.turn LEFT JOIN walked t ON t.conv_id = o.conv_id AND t.turn = o.turn LEFT JOIN counted c ON c.k = o.k
"""
