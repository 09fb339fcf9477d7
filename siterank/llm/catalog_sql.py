"""The same results in DuckDB SQL, where SQL can express them."""

from __future__ import annotations

SQL: dict[str, str] = {}

SQL["op5_mix"] = r"""
WITH docs AS (
  SELECT doc_id, source, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS code,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents
), sizes AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source
), weighed AS (
  SELECT *, CAST([3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS DOUBLE) AS weight,
         row_number() OVER (ORDER BY source IS NULL, source) AS nr
  FROM sizes
), ratios AS (
  SELECT *, source_size * 2.0::DOUBLE / weight AS ratio, sum(source_size) OVER () * 1.5::DOUBLE AS budget,
         sum(weight) OVER () AS all_weight
  FROM weighed
), levels AS (
  SELECT *, (budget - coalesce(sum(source_size) OVER w, 0) * 2.0::DOUBLE) / (all_weight - coalesce(sum(weight) OVER w, 0)) AS level
  FROM ratios WINDOW w AS (ORDER BY ratio, nr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT *, least(source_size * 2.0::DOUBLE, max(level) OVER () * weight) AS target
  FROM levels
), wanted AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(round(target) AS BIGINT) // source_size ELSE 0 END AS whole FROM targets
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, t.source_size, t.target,
       CAST(t.whole * d.size + greatest(0, least(d.size, CAST(round(t.target) AS BIGINT) - t.whole * t.source_size
         - (sum(d.size) OVER (PARTITION BY d.source ORDER BY d.code, d.doc_id, d.size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - d.size))) AS BIGINT) AS taken
FROM docs d JOIN wanted t ON d.source IS NOT DISTINCT FROM t.source
"""

SQL["op10_warc_packages"] = r"""
WITH pages AS (
  SELECT page_id, coalesce(html, '') AS html,
         array_to_string(list_transform(string_split(sha1(coalesce(html, '')), ''), lambda c:
           substr('0000000100100011010001010110011110001001101010111100110111101111',
                  strpos('0123456789abcdef', c) * 4 - 3, 4)), '') AS bits
  FROM pages
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS nr,
         first_value(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS head
  FROM pages
)
SELECT page_id, strlen(html) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
         16 * CAST(substr(bits, 5 * i + 1, 1) AS BIGINT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS BIGINT) +
         4 * CAST(substr(bits, 5 * i + 3, 1) AS BIGINT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS BIGINT) +
         CAST(substr(bits, 5 * i + 5, 1) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN nr = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN nr > 1 THEN head END AS refers_to
FROM ranked
"""

SQL["op13_block_search"] = r"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row_key,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents
), sized AS (
  SELECT doc_id, row_key, terms, CAST(len(terms) AS BIGINT) AS n FROM docs WHERE len(terms) > 0
), totals AS (
  SELECT CAST(count(*) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM sized
), tf AS (
  SELECT doc_id, row_key, n, term, CAST(count(*) AS BIGINT) AS tf
  FROM (SELECT doc_id, row_key, n, unnest(terms) AS term FROM sized) GROUP BY ALL
), asked AS (
  SELECT item_id, term, CAST(count(*) AS BIGINT) AS q
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                  '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL
), df AS (
  SELECT term, CAST(count(*) AS BIGINT) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term
), parts AS (
  SELECT tf.row_key, tf.doc_id, tf.term,
         CAST(floor(1000.0 * ln((2.0 * big_n + 2.0) / (2.0 * df.df + 1.0))) AS BIGINT)
         * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * tf.n * big_n) // big_l))) AS c
  FROM tf JOIN df USING (term), totals
), scores AS (
  SELECT a.item_id, p.row_key, p.doc_id, CAST(sum(a.q * p.c) AS BIGINT) AS score
  FROM asked a JOIN parts p USING (term) GROUP BY ALL
), ranked AS (
  SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS FIRST) AS rank
  FROM scores WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""
