"""DuckDB SQL for the queries that SQL can express."""

OP6 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM d),
r AS (SELECT row_number() OVER () AS rid, * FROM w),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM r WHERE len(w) >= 8)),
dup AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
gaps AS (SELECT rid, least(8, coalesce(i - lag(i) OVER (PARTITION BY rid ORDER BY i), 8)) AS c FROM dup),
rep AS (SELECT rid, sum(c) AS n FROM gaps GROUP BY rid),
judged AS (
  SELECT r.rid, doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(l, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) AS n_dup_lines,
    coalesce(rep.n, 0) AS n_repeat_words,
    list_sum(list_transform(list_filter(l, lambda x:
      NOT regexp_matches(x, '[^\x20\x09-\x0D]') OR (
        (regexp_matches(x, '[.!?:;,\x{2026}"''\x{201d}\x{00bb})\]][\x20\x09-\x0D]*$') OR len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) >= 8)
        AND NOT regexp_matches(x, '([|\x{00bb}\x{203a}>][^|\x{00bb}\x{203a}>]*){2,}')
        AND NOT regexp_matches(x, '(?i)(all rights reserved|cookie (policy|settings)|use[s]? cookies|terms of (use|service)|privacy policy|enable javascript|subscribe to|sign (in|up)|log in|click here|read more|share (this|on)|lorem ipsum|powered by|copyright \S* ?[0-9]{4})'))),
      lambda x: len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')))) AS good
  FROM r LEFT JOIN rep ON rep.rid = r.rid)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND 100 * coalesce(good, 0) >= 50 * n_words AS kept
FROM judged
"""

OP7 = r"""
WITH p AS (SELECT page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
q AS (SELECT page_id, url, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(action, host, path) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
j AS (
  SELECT q.*, (SELECT max_by(r.host || r.path, length(r.host || r.path)) FROM rules r WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)) AS rule,
    (SELECT max_by(r.action, length(r.host || r.path)) FROM rules r WHERE (q.host = r.host OR ends_with(q.host, '.' || r.host)) AND starts_with(q.path, r.path)) AS action,
    regexp_matches(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\bcheap-pills\b|\bcasino\b|\bonline-poker\b|\bxxx\b|\bporn\b|\bpayday-loans?\b|\breplica-watches\b|/wp-login\.php\b|[?&]phpsessid=') AS bad
  FROM q)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN bad THEN 'block' ELSE 'allow' END) AS verdict FROM j
"""

OP9 = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS k FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS nth FROM s0),
s2 AS (SELECT *, 1 + nth % 3 AS weight, 3 * source_size AS cap, [3.0, 1.0, 1.0][1 + nth % 3] AS a, [1.0, 1.0, 3.0][1 + nth % 3] AS b FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER o, 0) AS remain, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS share, row_number() OVER (ORDER BY cap / weight, nth) AS rk
  FROM s2 WINDOW o AS (ORDER BY cap / weight, nth ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT rk, remain, share FROM s3 WHERE weight * remain <= cap * share ORDER BY rk LIMIT 1),
t AS (SELECT s3.source, s3.source_size, CAST(s3.a AS DOUBLE) AS a, CAST(s3.b AS DOUBLE) AS b, CASE WHEN s3.rk >= lv.rk THEN CAST(weight * lv.remain AS DOUBLE) / CAST(lv.share AS DOUBLE) ELSE CAST(cap AS DOUBLE) END AS target FROM s3, lv),
g AS (SELECT *, CAST(floor(target) AS BIGINT) AS goal FROM t),
p AS (SELECT d.*, g.source_size, g.target, g.goal, g.a, g.b, CASE WHEN g.source_size > 0 THEN g.goal // g.source_size ELSE 0 END AS rounds,
  CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS st
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source),
q AS (SELECT *, goal - rounds * source_size AS last FROM p),
r AS (SELECT *, rounds * size + greatest(0, least(size, last - st)) AS taken, rounds + CASE WHEN greatest(0, least(size, last - st)) > 0 THEN 1 ELSE 0 END AS times FROM q),
v AS (SELECT *, CAST(st AS DOUBLE) / goal AS u1, CAST(source_size + st AS DOUBLE) / goal AS u2, CAST(2 * source_size + st AS DOUBLE) / goal AS u3 FROM r)
SELECT doc_id, size, source_size, target, CAST(taken AS BIGINT) AS taken,
  CASE WHEN taken > 0 AND times >= 1 THEN CASE WHEN a = b THEN u1 ELSE (sqrt(a * a + (b - a) * (a + b) * u1) - a) / (b - a) END END AS position,
  CASE WHEN taken > 0 AND times >= 2 THEN CASE WHEN a = b THEN u2 ELSE (sqrt(a * a + (b - a) * (a + b) * u2) - a) / (b - a) END END AS position_2,
  CASE WHEN taken > 0 AND times >= 3 THEN CASE WHEN a = b THEN u3 ELSE (sqrt(a * a + (b - a) * (a + b) * u3) - a) / (b - a) END END AS position_3
FROM v
"""
