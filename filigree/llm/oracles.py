"""DuckDB SQL for the operators that SQL can express.

op4 (zstandard), op6 (token ids), op8 (markup), op9 (seeded draws) and op10
(gear hashes) are held against plain Python in the tests.
"""

from __future__ import annotations

_WORDS = r"regexp_extract_all(text, '[^\x20\x09-\x0D]+')"

OP1 = """
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '<|im_end|><|im_start|>assistant ok' FROM range(2) r(t)),
o AS (SELECT *, row_number() OVER w AS k, lag(role) OVER w AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
p AS (SELECT *, CASE WHEN k > 1 AND role = before THEN length('<|turn|>') ELSE length('<|im_start|>' || replace(replace(role, '<|', '<||'), chr(10), '<|nl|>')) + 1 + length('<|im_end|>') + 1 END + length(replace(text, '<|', '<||')) AS chars FROM o)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars FROM p GROUP BY conv_id"""

#: Two labels that are a public suffix: a second-level label under a country's two letters (fixed values).
_TWO = "regexp_matches(array_to_string(p[-2:], '.'), '^(ac|asn|co|com|edu|gen|go|gob|gouv|gov|id|info|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch|web)\\.[a-z]{2}$')"


def _strength(table: str) -> str:
    """m and prior strength of one level of groups(n, k)."""
    return f"""(SELECT m, CASE WHEN rho > 0 THEN least(200.0, greatest(1.0, 1 / rho - 1)) ELSE 200.0 END AS c FROM (
  SELECT m, (kk - sk * sk / n - (g - 1) * m * (1 - m)) / CASE WHEN (n - nn / n - (g - 1)) * m * (1 - m) > 0 THEN (n - nn / n - (g - 1)) * m * (1 - m) END AS rho FROM (
  SELECT sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS sk, count(*)::DOUBLE AS g, sum(n * n)::DOUBLE AS nn, sum(k * k / n::DOUBLE) AS kk, (sum(k) + 0.5) / (sum(n) + 1.0)::DOUBLE AS m FROM {table})))"""


#: The normal quantile of the confidence 0.8.
_Z = "0.8416212335729144::DOUBLE"

OP2 = f"""
WITH u AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
l AS (SELECT host, CASE WHEN toxic = 1 OR quality = 0 THEN 1 ELSE 0 END AS bad FROM u JOIN labels ON doc_id = page_id WHERE (toxic = 1 OR quality = 0) IS NOT NULL),
b AS (SELECT host, count(*) AS n, sum(bad) AS k, string_split(regexp_replace(host, '(^.*@)|(:\\d*$)', ''), '.') AS p FROM l GROUP BY host),
h AS (SELECT host, n, k, array_to_string(CASE WHEN {_TWO} THEN p[-3:] ELSE p[-2:] END, '.') AS domain, array_to_string(CASE WHEN {_TWO} THEN p[-2:] ELSE p[-1:] END, '.') AS suffix FROM b),
d AS (SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM h GROUP BY 1, 2),
x AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM d GROUP BY 1),
xm AS (SELECT suffix, (k + c * m) / (n + c) AS sm FROM x, {_strength("x")}),
dm AS (SELECT domain, (k + c * sm) / (n + c) AS dmean FROM d JOIN xm USING (suffix), {_strength("d")}),
ab AS (SELECT host, m, k + c * dmean AS a, n + c - (k + c * dmean) AS b FROM h JOIN dm USING (domain), {_strength("h")}),
g AS (SELECT *, 1 / (9 * a) AS va, 1 / (9 * b) AS vb, 1 - 1 / (9 * a) AS ma, 1 - 1 / (9 * b) AS mb, {_Z} AS z FROM ab),
q AS (SELECT *, ma * ma * vb + mb * mb * va - z * z * va * vb AS under FROM g),
w AS (SELECT *, (ma * mb - z * sqrt(greatest(under, 0.0))) / (mb * mb - z * z * vb) AS ratio FROM q),
r AS (SELECT host, m, a / (a + b) AS bad_mean, CASE WHEN ma > 0 AND mb > 0 AND mb * mb > z * z * vb AND under >= 0 AND ratio > 0 THEN a * ratio ** 3 / (b + a * ratio ** 3) ELSE greatest(0.0, a / (a + b) - z * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1))) END AS bad_low FROM w),
f AS (SELECT u.*, m, bad_mean, bad_low, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM u LEFT JOIN r USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bad_low > least(m, 0.5) THEN 'block' ELSE 'allow' END AS verdict, round(bad_mean, 6) AS bad_mean, round(bad_low, 6) AS bad_low FROM f"""

OP3 = f"""
WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)),
s AS (SELECT doc_id, i, array_to_string(w[i:i + 19], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS k FROM s) WHERE k > 1),
isl AS (SELECT doc_id, min(i) AS a, max(i) + 19 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 20 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
word AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS t FROM word WHERE NOT EXISTS (SELECT 1 FROM isl WHERE isl.doc_id = word.doc_id AND i BETWEEN a AND b) GROUP BY doc_id),
gone AS (SELECT doc_id, sum(b - a + 1) AS n FROM isl GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(gone.n, 0)::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id"""

OP5 = """
WITH d AS MATERIALIZED (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS t FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS first FROM s) WHERE first < doc_id),
isl AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (SELECT *, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit)) GROUP BY doc_id, g),
cut AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM isl),
kept AS (SELECT d.doc_id, string_agg(substring(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) || substring(any_value(h), 2 * max(b) + 1) AS t, sum(b - a) AS n, count(*) AS k FROM cut JOIN d ON d.doc_id = cut.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(k, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(t, h))) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id"""

OP7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)),
s AS MATERIALIZED (SELECT DISTINCT doc_id, t FROM (
  SELECT doc_id, array_to_string(w[i:i + 4], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)
  UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 4)),
n AS (SELECT d.doc_id, count(s.t) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, c) AS (SELECT doc_id, doc_id FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id WHERE r.c < e.b)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, m.c AS component_id, m.c = n.doc_id AS kept FROM n JOIN (SELECT id, min(c) AS c FROM r GROUP BY id) m ON m.id = n.doc_id"""

OP11 = r"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL),
k AS MATERIALIZED (SELECT lang, term FROM t GROUP BY lang, term HAVING count(*) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS MATERIALIZED (SELECT lang, source, coalesce(any_value(v), 0) AS v FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) GROUP BY lang, source),
c AS MATERIALIZED (SELECT g.lang, g.source, term, coalesce(sum(n), 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN t USING (lang, source, term) GROUP BY ALL),
p AS MATERIALIZED (SELECT c.*, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM c JOIN g USING (lang, source)),
q AS (SELECT lang, term, 1 + (1000000000 * (n + 5)) // (sum(n) OVER (PARTITION BY lang) + 5 * v) AS q FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term) JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
r AS (SELECT lang, source, 'pair' AS part, item, value::BIGINT AS value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM pair
  UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT, row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50"""

ORACLES = {"op11_shard_divergence": OP11, "op1_chat_format": OP1, "op2_url_reputation": OP2, "op3_relative_lz_dedup": OP3, "op5_prefix_free_dedup": OP5, "op7_fast_sketch_dedup": OP7}
