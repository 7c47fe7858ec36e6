"""DuckDB SQL for the queries whose results SQL can state by brute force. Rows are told apart by number (op 5: by id and text)."""

from __future__ import annotations

WORD = r"[^\x20\x09-\x0D]+"

OP4_SQL = """
WITH texts AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, hex(coalesce(text, '')) AS bytes, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n_bytes FROM documents
), cuts AS (  -- 1,000 starts each, so that no string is sought in a long text
  SELECT doc, place, least(1000, n_bytes - 199 - place) AS starts, substring(bytes, 2 * place + 1, 2 * 1199) AS bytes
  FROM (SELECT *, unnest(range(0, greatest(n_bytes - 199, 0), 1000)) AS place FROM texts)
), strings AS (
  SELECT doc, place + i AS place, md5_number(substring(bytes, 2 * i + 1, 400)) AS string
  FROM (SELECT *, unnest(range(0, starts)) AS i FROM cuts)
), repeated AS (
  SELECT doc, place FROM strings WHERE string IN (SELECT string FROM strings GROUP BY string HAVING count(*) > 1)
), marked AS (
  SELECT *, CASE WHEN place <= lag(place) OVER (PARTITION BY doc ORDER BY place) + 200 THEN 0 ELSE 1 END AS is_first FROM repeated
), spans AS (
  SELECT doc, min(place) AS a, max(place) + 200 AS b
  FROM (SELECT *, sum(is_first) OVER (PARTITION BY doc ORDER BY place) AS span FROM marked) GROUP BY doc, span
), gaps AS (
  SELECT doc, coalesce(lag(b) OVER w, 0) AS x, a AS y FROM spans WINDOW w AS (PARTITION BY doc ORDER BY a)
  UNION ALL SELECT t.doc, coalesce(max(s.b), 0), any_value(t.n_bytes) FROM texts t LEFT JOIN spans s USING (doc) GROUP BY t.doc
), kept AS (
  SELECT doc, string_agg(substring(bytes, CAST(2 * x + 1 AS BIGINT), CAST(2 * (y - x) AS BIGINT)), '' ORDER BY x) AS bytes
  FROM gaps JOIN texts USING (doc) GROUP BY doc
), removed AS (SELECT doc, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc)
SELECT doc_id, n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(kept.bytes)) AS kept_sha256
FROM texts JOIN kept USING (doc) LEFT JOIN removed USING (doc)
"""

OP5_SQL = f"""
WITH docs AS (
  SELECT doc_id, text, dense_rank() OVER (ORDER BY doc_id NULLS FIRST, text) AS doc FROM documents
), lines AS (
  SELECT doc, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place
  FROM (SELECT DISTINCT doc, text FROM docs WHERE text IS NOT NULL)
), solid AS (
  SELECT doc, place, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS body, len(regexp_extract_all(line, '{WORD}')) AS words,
    row_number() OVER (PARTITION BY doc ORDER BY place) AS n
  FROM lines WHERE regexp_matches(line, '{WORD}')
), placed AS (
  SELECT doc, n, CAST(sum(words) OVER (PARTITION BY doc ORDER BY n) AS BIGINT) AS upto, CAST(upto - words AS BIGINT) AS before,
    CAST(sum(words) OVER (PARTITION BY doc) AS BIGINT) AS total
  FROM solid
), windows AS (  -- the shortest of 50 words or more from each line on, and up to each line
  SELECT doc, n AS x, n - 1 + count(*) OVER (PARTITION BY doc ORDER BY before RANGE BETWEEN CURRENT ROW AND 49 FOLLOWING) AS y
  FROM placed QUALIFY total - before >= 50
  UNION SELECT doc, n + 1 - count(*) OVER (PARTITION BY doc ORDER BY upto RANGE BETWEEN 49 PRECEDING AND CURRENT ROW), n
  FROM placed QUALIFY upto >= 50
), contents AS (
  SELECT w.doc, x, y, string_agg(body, chr(10) ORDER BY n) AS content
  FROM windows w JOIN solid s ON s.doc = w.doc AND s.n BETWEEN x AND y GROUP BY w.doc, x, y
), later AS (
  SELECT doc, x, y FROM contents QUALIFY row_number() OVER (PARTITION BY content ORDER BY doc, x) > 1
), gone AS (
  SELECT DISTINCT s.doc, s.n, s.place FROM solid s JOIN later l ON s.doc = l.doc AND s.n BETWEEN l.x AND l.y
), counts AS (
  SELECT doc, count(*) AS n_deleted, count(*) FILTER (is_first) AS n_runs
  FROM (SELECT doc, n IS DISTINCT FROM lag(n) OVER (PARTITION BY doc ORDER BY n) + 1 AS is_first FROM gone) GROUP BY doc
), kept AS (
  SELECT doc, string_agg(line, chr(10) ORDER BY place) AS body FROM lines ANTI JOIN gone USING (doc, place) GROUP BY doc
), sizes AS (SELECT doc, count(*) AS n_lines FROM solid GROUP BY doc)
SELECT doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_deleted, 0) AS INTEGER) AS n_deleted,
  CAST(coalesce(n_runs, 0) AS INTEGER) AS n_runs, sha256(CASE WHEN n_deleted = n_lines THEN '' ELSE coalesce(body, '') END) AS kept_sha256
FROM docs LEFT JOIN sizes USING (doc) LEFT JOIN counts USING (doc) LEFT JOIN kept USING (doc)
"""

OP8_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS size FROM documents
), weighed AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, count(*) AS n_docs, 3 * CAST(sum(size) AS BIGINT) AS most,
    row_number() OVER (ORDER BY source NULLS LAST) AS nth, CAST([5, 2, 1][(nth - 1) % 3 + 1] AS DOUBLE) AS weight
  FROM sized GROUP BY source
), levels AS (  -- of a unit of weight, if all that fill up sooner are full
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER sooner, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER sooner, 0)) AS level
  FROM weighed WINDOW sooner AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, CASE WHEN most < weight * level THEN CAST(most AS DOUBLE) ELSE weight * max(level) FILTER (most >= weight * level) OVER () END AS target FROM levels
), seats AS (
  SELECT nth, target / (2 * k - 1) AS quotient
  FROM (SELECT nth, target, unnest(range(1, CAST(ceil(most / 16) AS BIGINT) + 1)) AS k FROM targets WHERE target > 0)
), won AS (
  SELECT nth, count(*) AS blocks
  FROM (SELECT nth FROM seats QUALIFY row_number() OVER (ORDER BY quotient DESC, nth) <= (SELECT floor(sum(target) / 16 + 0.5) FROM targets)) GROUP BY nth
), sources AS (
  SELECT t.nth, source, source_size, target, coalesce(blocks, 0) AS blocks, least(greatest(CAST(ceil(n_docs / 64) AS BIGINT), 1), 1048576) AS n_shards
  FROM targets t LEFT JOIN won USING (nth)
), dealt AS (
  SELECT doc_id, size, nth, md5(concat_ws(':', 17, doc_id)) AS key, CAST('0x' || substring(md5(concat_ws(':', 18, doc_id)), 1, 15) AS BIGINT) % n_shards AS shard
  FROM sized JOIN sources ON sized.source IS NOT DISTINCT FROM sources.source
), shards AS (
  SELECT nth, shard, CAST(sum(size) AS BIGINT) AS words FROM dealt GROUP BY nth, shard
), shard_seats AS (
  SELECT nth, shard, words / (2 * k - 1) AS quotient
  FROM (SELECT *, unnest(range(1, CAST(ceil(3 * words / 16) AS BIGINT) + 1)) AS k FROM shards)
), quotas AS (
  SELECT s.nth, s.shard, words, least(16 * coalesce(n, 0), 3 * words) AS quota, greatest(words, 1) AS around,
    16 * (CAST('0x' || substring(md5(concat_ws(':', 19, source, s.shard)), 1, 15) AS BIGINT) % greatest(words // 16, 1)) AS x, quota % around AS over
  FROM shards s JOIN sources USING (nth) LEFT JOIN (
    SELECT nth, shard, count(*) AS n
    FROM (SELECT nth, shard, row_number() OVER (PARTITION BY nth ORDER BY quotient DESC, shard) AS place FROM shard_seats) JOIN sources USING (nth)
    WHERE place <= blocks GROUP BY nth, shard
  ) q ON q.nth = s.nth AND q.shard = s.shard
), laid AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY nth, shard ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM dealt
)
SELECT doc_id, size, source_size, target,
  CAST(quota // around * size + greatest(0, least(a + size, x + over) - greatest(a, x)) + greatest(0, least(a + size, x + over - around) - a) AS BIGINT) AS taken
FROM laid JOIN quotas USING (nth, shard) JOIN sources USING (nth)
"""

OP9_SQL = f"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT row_number() OVER () AS doc, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w
  FROM documents
), shingles AS (
  SELECT DISTINCT doc, md5_number(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) AS shingle
  FROM (SELECT doc, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) > 2)
  UNION ALL SELECT doc, md5_number(array_to_string(w, ' ')) FROM words WHERE len(w) BETWEEN 1 AND 2
), sizes AS (SELECT doc, count(*) AS n FROM shingles GROUP BY doc),
links AS (
  SELECT a, b FROM (
    SELECT x.doc AS a, y.doc AS b, count(*) AS shared FROM shingles x JOIN shingles y ON x.shingle = y.shingle AND x.doc <> y.doc GROUP BY a, b
  ) JOIN sizes sa ON sa.doc = a JOIN sizes sb ON sb.doc = b WHERE 100 * shared >= 90 * (sa.n + sb.n - shared)
), reached AS (
  SELECT doc AS a, doc AS b FROM words WHERE doc_id IS NOT NULL
  UNION SELECT r.a, l.b FROM reached r JOIN links l ON l.a = r.b JOIN words w ON w.doc = l.b WHERE w.doc_id IS NOT NULL
), least AS (
  SELECT a, min(doc_id) AS component_id FROM reached JOIN words ON doc = b GROUP BY a
)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM words LEFT JOIN sizes USING (doc) LEFT JOIN least ON a = doc
"""
