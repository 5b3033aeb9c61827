"""DuckDB SQL of operators whose results SQL can express; each is a plain statement of the result, not of the method."""

from __future__ import annotations

from . import quality

OP2_ORACLE = """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT rid, unnest(range(0, len(h) // 2 - 199)) AS p, h FROM d WHERE len(h) >= 400),
k AS (SELECT rid, p, md5_number(substr(h, 2 * p + 1, 400)) AS k FROM w),
s AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY k) AS n FROM k) WHERE n > 1),
e AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 200 THEN 0 ELSE 1 END AS fresh FROM s),
g AS (SELECT rid, p, sum(fresh) OVER (PARTITION BY rid ORDER BY p) AS g FROM e),
r AS (SELECT rid, min(p) AS a, max(p) + 200 AS b FROM g GROUP BY rid, g),
q AS (SELECT rid, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM r),
t AS (SELECT rid, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans, max(b) AS last FROM q GROUP BY rid),
m AS (SELECT q.rid, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM q JOIN d USING (rid) GROUP BY q.rid)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(CASE WHEN t.rid IS NULL THEN h ELSE front || substr(h, 2 * last + 1) END)) AS kept_sha256
FROM d LEFT JOIN t USING (rid) LEFT JOIN m USING (rid)
"""

OP8_ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM d),
i AS (SELECT rid, unnest(range(1, len(words) - 6)) AS p, words FROM w WHERE len(words) >= 9),
g AS (SELECT rid, p, md5(array_to_string(words[p : p + 7], ' ')) AS k FROM i),
f AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, k) AS n FROM g) WHERE n > 1),
c AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest(range(p, p + 8)) AS q FROM f) GROUP BY rid),
m AS (SELECT rid, doc_id, source, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines FROM w LEFT JOIN c USING (rid)),
b AS (SELECT *, n_words < {quality.MIN_WORDS} OR 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words AS base_failed,
    n_symbols > {quality.MAX_SYMBOLS_PER_WORD} * n_words OR n_dup_lines > {quality.MAX_DUP_LINE_SHARE} * n_lines AS other FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed OR other)::DOUBLE AS f FROM b GROUP BY source),
o AS (SELECT sum(n) AS n, sum(f) AS f, count(*) AS hosts, sum(f / n) AS r, sum(f / n * (f / n)) AS rr, sum(1 / n) AS inv FROM h),
p AS (SELECT f / n AS mean, hosts, CASE WHEN hosts >= 2 THEN (rr - r * r / hosts) / (hosts - 1) - f / n * (1 - f / n) * inv / hosts END AS spread FROM o),
s AS (SELECT mean, CASE WHEN hosts < 2 OR mean <= 0 OR mean >= 1 THEN 1.0 WHEN spread > 0 THEN least(1e6, greatest(1.0, mean * (1 - mean) / spread - 1)) ELSE 1e6 END AS strength FROM p),
v AS (SELECT source, (f + mean * strength) / (n + strength) AS host_rate FROM h, s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND (b.source IS NULL OR host_rate <= {quality.HOST_LIMIT}) AS kept, round(host_rate, 9) AS host_rate
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""
