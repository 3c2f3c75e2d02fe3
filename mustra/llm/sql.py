"""SQL for the operators' queries that SQL can express, as DuckDB runs it over the same tables."""

from __future__ import annotations

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
"""

# budget 2048, history 256; a turn's template is 24 characters long
CHAT = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tokens FROM t
), a AS (
  SELECT *, n = 1 AND role = 'system' AS sys, CASE WHEN n = 1 AND role = 'system' THEN 0 ELSE tokens END AS own,
    length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) + 24 AS chars
  FROM numbered
), b AS (
  SELECT *, coalesce(sum(own) OVER (PARTITION BY conv_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    coalesce(max(CASE WHEN sys THEN tokens END) OVER (PARTITION BY conv_id), 0) AS fixed
  FROM a
), c AS (
  SELECT *, greatest(1, floor((2048 - 256 - fixed) / 2.0)) AS stride FROM b
), d AS (
  SELECT *, NOT sys AND tokens > stride AS long, floor(start / stride) AS step FROM c
), e AS (
  SELECT *, n = 1 OR (NOT lag(sys) OVER w AND (step <> lag(step) OVER w OR long OR lag(long) OVER w)) AS opens
  FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY n)
), f AS (
  SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY n) AS span FROM e
), spans AS (
  SELECT conv_id, span, min(start) AS span_start, greatest(0, least(256, 2048 - max(fixed) - sum(own))) AS allowed FROM f GROUP BY conv_id, span
), again AS (
  SELECT f.conv_id, f.n, count(*) AS times FROM f JOIN spans s
    ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND s.span > f.span AND (f.sys OR s.span_start - f.start <= s.allowed)
  GROUP BY f.conv_id, f.n
), g AS (
  SELECT f.*, 1 + coalesce(again.times, 0) AS times FROM f LEFT JOIN again ON f.conv_id IS NOT DISTINCT FROM again.conv_id AND f.n = again.n
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(chars * times) AS BIGINT) AS formatted_chars
FROM g GROUP BY conv_id
"""

NEAR = r"""
WITH RECURSIVE texts AS (
  SELECT md5(coalesce(text, '')) AS k, any_value(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')) AS w
  FROM documents GROUP BY k
), runs AS (
  SELECT DISTINCT k, array_to_string(w[i : i + 4], ' ') AS run FROM (SELECT k, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM texts WHERE len(w) > 0)
), sizes AS (
  SELECT k, count(*) AS n FROM runs GROUP BY k
), common AS (
  SELECT a.k AS x, b.k AS y, count(*) AS n FROM runs a JOIN runs b ON a.run = b.run AND a.k <> b.k GROUP BY a.k, b.k
), links AS (
  SELECT x, y FROM common JOIN sizes p ON x = p.k JOIN sizes q ON y = q.k WHERE 5 * common.n >= 4 * (p.n + q.n - common.n)
), reach(x, y) AS (
  SELECT k, k FROM texts UNION SELECT reach.x, links.y FROM reach JOIN links ON reach.y = links.x
), docs AS (
  SELECT doc_id, md5(coalesce(text, '')) AS k FROM documents
), classes AS (
  SELECT reach.x AS k, min(doc_id) AS class_id FROM reach JOIN docs ON docs.k = reach.y GROUP BY reach.x
)
SELECT doc_id, class_id FROM docs JOIN classes USING (k)
"""

# scores after 20 steps are the sum of the walks of 0 to 20 steps
URLS = r"""
WITH RECURSIVE cut AS (
  SELECT page_id, html, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, html, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(host, path, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), judged AS (
  SELECT page_id, parts.host, parts.path, html,
    (SELECT arg_max({'rule': r.host || r.path, 'verdict': r.verdict}, length(r.host || r.path)) FROM rules r
     WHERE (parts.host = r.host OR ends_with(parts.host, '.' || r.host)) AND starts_with(parts.path, r.path)) AS found
  FROM parts
), found_links AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*([^"''\s>]+)', 1)) AS link FROM judged
), links AS (
  SELECT src, CASE WHEN regexp_matches(link, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//')
      THEN translate(regexp_extract(link, '(?i)^(?:[a-z][a-z0-9+.-]*:)?//([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')
    WHEN regexp_matches(link, '(?i)^[a-z][a-z0-9+.-]*:') THEN '' ELSE src END AS dst
  FROM found_links
), edges AS (
  SELECT src, dst, count(*) AS n FROM links WHERE src <> '' AND dst <> '' GROUP BY src, dst
), directed AS (
  SELECT 'trust' AS kind, src AS host, dst AS onto, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges
), shares AS (
  SELECT kind, host, onto, n / sum(n) OVER (PARTITION BY kind, host) AS part FROM directed
), walks(step, kind, host, score) AS (
  SELECT 0, CASE found.verdict WHEN 'allow' THEN 'trust' ELSE 'distrust' END, host, count(*) * (1 - CAST(0.85 AS DOUBLE)) FROM judged WHERE found IS NOT NULL GROUP BY ALL
  UNION ALL
  SELECT w.step + 1, w.kind, s.onto, sum(w.score * s.part * CAST(0.85 AS DOUBLE)) FROM walks w JOIN shares s ON w.kind = s.kind AND w.host = s.host WHERE w.step < 20 GROUP BY ALL
), scores AS (
  SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM walks GROUP BY host
)
SELECT page_id, j.host, j.path, found.rule AS rule, coalesce(found.verdict, CASE WHEN distrust > 0.5 * (trust + distrust) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN scores USING (host)
"""

# a target stops at 2 x its source's size: sources in the order in which they stop, each with the words and weights behind it
TARGETS = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS size, CAST([3, 1, 2][1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER)] AS DOUBLE) AS weight FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY size / weight, source NULLS LAST) AS n FROM s
), u AS (
  SELECT n, size, weight, (1.5 * (SELECT sum(size) FROM r) - coalesce(sum(2 * size) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit FROM r
), unit AS (
  SELECT min_by(unit, n) AS unit FROM u WHERE unit * weight <= 2 * size
)
SELECT d.doc_id, CAST(d.size AS BIGINT) AS size, CAST(s.size AS BIGINT) AS source_size, round(least(2 * s.size, unit.unit * s.weight), 3) AS target
FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source, unit
"""

EDITED = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, row_number() OVER (ORDER BY doc_id DESC, text) AS n FROM documents
), next AS (
  SELECT doc_id, text, n, coalesce(lead(text) OVER (ORDER BY n), first_value(text) OVER (ORDER BY n)) AS following FROM d
), e AS (
  SELECT doc_id, text, substr(text, 1, length(text) - length(text) // 3) || substr(following, 1, length(text) // 3) AS edited FROM next
)
SELECT doc_id, length(text) AS n_chars, sha256(edited) AS edited_sha256, text = edited AS same FROM e
"""

FIM = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), u AS (
  SELECT *, regexp_extract_all(text, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
    CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4
  FROM t
), c AS (
  SELECT *, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM u
), p AS (
  SELECT doc_id, text, n, form, array_to_string(units[1:a], '') AS prefix, array_to_string(units[a + 1:b], '') AS middle, array_to_string(units[b + 1:n], '') AS suffix FROM c
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""

SQL: dict[str, str] = {"mixing_targets": TARGETS, "edited_texts": EDITED, "op4_top_k": TOP_K, "op5_chat_format": CHAT, "op6_near_dedup": NEAR, "op8_url_filter": URLS, "op13_fim": FIM}
