"""SQL for DuckDB that gives the rows of the queries which SQL can express, written from their definitions."""

DECONTAMINATE = r"""
WITH lowered AS (
  SELECT 0 AS kind, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
worded AS (SELECT kind, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lowered),
wanted AS (
  SELECT DISTINCT id, least(10, len(w)) AS width, array_to_string(list_slice(w, i, i + least(10, len(w)) - 1), ' ') AS pattern
  FROM (SELECT id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM worded WHERE kind = 1 AND len(w) > 0)),
hits AS (
  SELECT d.id, d.i, p.width, p.id AS item
  FROM (SELECT id, w, width, unnest(range(1, len(w) - width + 2)) AS i
        FROM worded, (SELECT DISTINCT width FROM wanted) WHERE kind = 0 AND len(w) >= width) d
  JOIN wanted p ON p.width = d.width AND p.pattern = array_to_string(list_slice(d.w, d.i, d.i + d.width - 1), ' ')),
words AS (SELECT id, count(DISTINCT spot) AS n_hit FROM (SELECT id, unnest(range(i, i + width)) AS spot FROM hits) GROUP BY 1),
items AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY 1)
SELECT worded.id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM worded LEFT JOIN words ON words.id = worded.id LEFT JOIN items ON items.id = worded.id WHERE kind = 0
"""

NEAR_VECTORS = r"""
WITH RECURSIVE usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0),
linked AS (SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.vec_id <> b.vec_id
           WHERE list_cosine_similarity(a.e, b.e) >= 9e-1),
reach AS (SELECT vec_id AS a, vec_id AS b FROM usable UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b),
least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY 1),
counted AS (SELECT a, count(*) AS n FROM linked GROUP BY 1)
SELECT e.vec_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_links, coalesce(l.component_id, e.vec_id) AS component_id,
  e.vec_id = coalesce(l.component_id, e.vec_id) AS kept
FROM embeddings e LEFT JOIN least l ON l.a = e.vec_id LEFT JOIN counted c ON c.a = e.vec_id
"""

REPEATED_WINDOWS = r"""
WITH worded AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM worded WHERE len(w) >= 35)),
again AS (SELECT h FROM windows GROUP BY 1 HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT doc_id, spot FROM (
    SELECT doc_id, unnest(range(i, i + 35)) AS spot FROM windows JOIN again USING (h))),
kept AS (
  SELECT t.doc_id, string_agg(word, ' ' ORDER BY t.spot) AS text
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS spot FROM worded) t
  LEFT JOIN gone g ON g.doc_id = t.doc_id AND g.spot = t.spot WHERE g.spot IS NULL GROUP BY 1),
count_gone AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT worded.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept.text, '')) AS kept_sha256
FROM worded LEFT JOIN count_gone c ON c.doc_id = worded.doc_id LEFT JOIN kept ON kept.doc_id = worded.doc_id
"""

NEAR_COPIES = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
shingles AS (
  SELECT doc_id, shingle, count(*) AS n
  FROM (SELECT doc_id, array_to_string(list_slice(w, i, i + 4), ' ') AS shingle
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM worded WHERE len(w) > 0))
  GROUP BY 1, 2),
totals AS (SELECT doc_id, sum(n) AS n FROM shingles GROUP BY 1),
linked AS (
  SELECT a, b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS shared
    FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN totals s ON s.doc_id = a JOIN totals t ON t.doc_id = b
  WHERE shared * 10 >= 8 * (s.n + t.n - shared)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT a AS doc_id, min(b) AS class_id, a = min(b) AS kept FROM reach GROUP BY 1
"""

MIX = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS BIGINT) AS weight
  FROM sized GROUP BY source),
total AS (SELECT CAST(sum(source_size) AS BIGINT) AS words FROM sources),
levels AS (
  SELECT a.source, a.weight, a.source_size, 3 * a.source_size / CAST(a.weight AS DOUBLE) AS bound,
    (SELECT CAST((SELECT words FROM total)
              - coalesce(sum(CASE WHEN 3 * b.source_size / CAST(b.weight AS DOUBLE) < 3 * a.source_size / CAST(a.weight AS DOUBLE)
                             THEN 3 * b.source_size END), 0) AS DOUBLE)
       / CAST(sum(CASE WHEN 3 * b.source_size / CAST(b.weight AS DOUBLE) >= 3 * a.source_size / CAST(a.weight AS DOUBLE)
                       THEN b.weight END) AS DOUBLE)
     FROM sources b) AS level
  FROM sources a),
goal AS (SELECT max(level) AS level FROM levels WHERE level <= bound),
targets AS (
  SELECT l.source, l.source_size,
    CASE WHEN g.level >= l.bound THEN CAST(3 * l.source_size AS DOUBLE) ELSE g.level * l.weight END AS target
  FROM levels l, goal g),
rates AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('0|' || coalesce(CAST(s.doc_id AS VARCHAR), '') || '|' || CAST(s.size AS VARCHAR)), 1, 8))
         AS BIGINT) / 4294967296.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM rates
"""

MANIFEST = r"""
WITH RECURSIVE
checks AS (
  SELECT DISTINCT CAST(doc_id AS VARCHAR) AS s, 0 AS k, CAST(4294967295 AS BIGINT) AS crc FROM documents WHERE doc_id IS NOT NULL
  UNION ALL
  SELECT s, k + 1, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT s, k, CASE WHEN k % 8 = 0 THEN xor(crc, ascii(substr(s, k // 8 + 1, 1))) ELSE crc END AS c
        FROM checks WHERE k < 8 * length(s))),
seventh AS (SELECT s FROM checks WHERE k = 8 * length(s) AND xor(crc, 4294967295) % 7 = 0),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || body) AS leaf,
    sha256(head || CASE WHEN n_chars IS NULL THEN '-'
                        ELSE strlen(CAST(n_chars + (s IS NOT NULL)::INTEGER AS VARCHAR)) || ':' || CAST(n_chars + (s IS NOT NULL)::INTEGER AS VARCHAR) END || body) AS changed
  FROM (SELECT doc_id, lang, n_chars, seventh.s,
          coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
            || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
          coalesce(strlen(text) || ':' || text, '-') AS body
        FROM documents LEFT JOIN seventh ON seventh.s = CAST(doc_id AS VARCHAR))),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
    dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g FROM leaves),
tree AS (
  SELECT 0 AS lvl, g, idx, n, leaf AS h FROM placed
  UNION ALL
  SELECT lvl + 1, g, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM tree WHERE n > 1 GROUP BY lvl, g, idx // 2, n),
subroots AS (SELECT g, h AS subroot, (SELECT count(DISTINCT g) FROM placed) AS m FROM tree WHERE n = 1),
crown AS (
  SELECT 0 AS lvl, g AS idx, m AS n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM crown WHERE n > 1 GROUP BY lvl, idx // 2, n),
climb AS (
  SELECT g, idx AS leaf_idx, 0 AS lvl, idx, n, changed AS h, '' AS proof FROM placed
  UNION ALL
  SELECT c.g, leaf_idx, c.lvl + 1, c.idx // 2, (c.n + 1) // 2,
    sha256(CASE WHEN t.h IS NULL THEN c.h WHEN c.idx % 2 = 0 THEN c.h || t.h ELSE t.h || c.h END), proof || coalesce(t.h, '')
  FROM climb c LEFT JOIN tree t ON t.lvl = c.lvl AND t.g = c.g AND t.idx = xor(c.idx, 1) WHERE c.n > 1),
over AS (
  SELECT c.g, leaf_idx, 0 AS lvl, c.g AS idx, m AS n, h, proof, FALSE AS top FROM climb c JOIN subroots s ON s.g = c.g WHERE n = 1
  UNION ALL
  SELECT o.g, leaf_idx, o.lvl + 1, o.idx // 2, (o.n + 1) // 2,
    sha256(CASE WHEN t.h IS NULL THEN o.h WHEN o.idx % 2 = 0 THEN o.h || t.h ELSE t.h || o.h END), proof || coalesce(t.h, ''), FALSE
  FROM over o LEFT JOIN crown t ON t.lvl = o.lvl AND t.idx = xor(o.idx, 1) WHERE o.n > 1)
SELECT p.doc_id, p.leaf, s.subroot, r.h AS root, sha256(o.proof) AS proof_sha256, o.h AS folded_root, o.h = r.h AS verified
FROM placed p JOIN over o ON o.g = p.g AND o.leaf_idx = p.idx AND o.n = 1 JOIN subroots s ON s.g = p.g JOIN crown r ON r.n = 1
"""

REPEATED_LINES = r"""
WITH split AS (
  SELECT doc_id, lines, range(1, len(lines) + 1) AS spots
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)),
keyed AS (
  SELECT doc_id, spot, line,
    translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(lines) AS line, unnest(spots) AS spot FROM split)),
often AS (SELECT key FROM keyed WHERE key <> '' GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(o.key) AS n_dropped,
  sha256(coalesce(string_agg(CASE WHEN o.key IS NULL THEN line END, chr(10) ORDER BY spot), '')) AS kept_sha256
FROM keyed k LEFT JOIN often o ON o.key = k.key GROUP BY 1
"""

FILTER_AUDIT = r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
worded AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS first_id FROM texts),
judged AS (
  SELECT doc_id, part,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN first_id < doc_id THEN 16 ELSE 0 END AS mask
  FROM worded),
marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels GROUP BY 1),
cells AS (
  SELECT part, mask, bit_count(mask) AS m, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM judged j LEFT JOIN marks l ON l.doc_id = j.doc_id GROUP BY 1, 2),
letter AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(c, bit)),
orders AS (
  SELECT a.c || b.c || c.c || d.c || e.c AS filter_order
  FROM letter a, letter b, letter c, letter d, letter e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND a.bit | b.bit | c.bit | d.bit | e.bit = 31),
steps AS (
  SELECT filter_order, step, max(CASE WHEN substr(filter_order, step, 1) = c THEN bit END) AS f,
    sum(CASE WHEN contains(substr(filter_order, 1, step - 1), c) THEN bit ELSE 0 END)::INTEGER AS before
  FROM (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders), letter GROUP BY 1, 2)
SELECT part, filter_order, step,
  CAST(sum(CASE WHEN mask & (before | f) = 0 THEN n ELSE 0 END) AS BIGINT) AS kept,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN n ELSE 0 END) AS BIGINT) AS removed,
  CAST(sum(CASE WHEN mask & before <> 0 AND mask & f <> 0 THEN n ELSE 0 END) AS BIGINT) AS redundant,
  CAST(sum(CASE WHEN mask = f THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN good ELSE 0 END) AS BIGINT) AS good_lost,
  CAST(sum(CASE WHEN mask & before = 0 AND mask & f <> 0 THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost,
  CAST(sum(CASE WHEN mask & f <> 0 THEN n * (120 // m) ELSE 0 END) AS BIGINT) AS shapley
FROM cells, steps GROUP BY 1, 2, 3
"""

SHARDS = r"""
WITH crc_table AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
    lambda c, turn: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS t),
bytes AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
sized AS (
  SELECT doc_id, CAST(n + 1 AS BIGINT) AS size,
    xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)],
                                list_transform(range(0, n), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))),
                    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) AS text_crc32
  FROM bytes, crc_table),
scores AS (
  SELECT doc_id, s, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || s), 1, 13) AS BIGINT) AS score
  FROM (SELECT DISTINCT doc_id FROM documents), range(0, 17) shards(s)),
placed AS (
  SELECT doc_id, arg_max(s, score) FILTER (WHERE s < 16) AS shard, arg_max(s, score) AS grown_shard FROM scores GROUP BY doc_id),
dealt AS (
  SELECT z.*, p.shard, p.grown_shard,
    CAST('0x' || substr(md5(coalesce(CAST(z.doc_id AS VARCHAR), '') || '|' || size || '|' || text_crc32), 1, 13) AS BIGINT) % 4096 AS part
  FROM sized z JOIN placed p ON p.doc_id IS NOT DISTINCT FROM z.doc_id)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard,
  CAST(row_number() OVER (PARTITION BY shard ORDER BY part, doc_id NULLS FIRST, size, text_crc32) - 1 AS BIGINT) AS slot,
  CAST(grown_shard AS INTEGER) AS grown_shard
FROM dealt
"""

EARLIER_STRINGS = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS string
  FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM texts WHERE n >= 50)),
firsts AS (SELECT string, min(doc_id) AS least FROM strings GROUP BY string HAVING count(*) > 1),
starts AS (
  SELECT r, i, i > coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 50, -1) AS fresh
  FROM strings JOIN firsts USING (string) WHERE doc_id > least),
runs AS (
  SELECT r, min(i) AS lo, max(i) + 50 AS hi
  FROM (SELECT r, i, sum(fresh::INTEGER) OVER (PARTITION BY r ORDER BY i) AS run FROM starts) GROUP BY r, run),
cuts AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS before FROM runs),
kept AS (
  SELECT r, sum(hi - lo) AS n_removed, count(*) AS n_spans, max(hi) AS last,
    string_agg(substr(h, 2 * before + 1, 2 * (lo - before)), '' ORDER BY lo) AS head
  FROM cuts JOIN texts USING (r) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM texts LEFT JOIN kept USING (r)
"""
