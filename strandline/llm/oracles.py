"""DuckDB SQL for the queries of this subpackage that SQL can express."""

ORACLES: dict[str, str] = {}

ORACLES["op6_url_filter"] = r"""
WITH u AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(rhost, rpath, rverdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), numbered AS (SELECT row_number() OVER () AS n, * FROM u),
fit AS (
  SELECT n, rhost || rpath AS rule, rverdict, row_number() OVER (PARTITION BY n ORDER BY length(rhost || rpath) DESC) AS k
  FROM numbered JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(rverdict, 'allow') AS verdict
FROM numbered LEFT JOIN (SELECT * FROM fit WHERE k = 1) USING (n)
"""

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES["op1_decontamination"] = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, item FROM dw JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

# the closure of links is spelled out, which is fine for the few links of small tables
_REACH = "reach(a, b) AS (SELECT id, id FROM nodes UNION SELECT r.a, s.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) s ON r.b = s.a), comp AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY a)"

ORACLES["op2_embedding_dedup"] = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT * FROM v WHERE list_inner_product(e, e) > 0),
nodes AS (SELECT vec_id AS id FROM embeddings),
links AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b FROM w x JOIN w y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.e) = len(y.e) WHERE list_cosine_similarity(x.e, y.e) >= 0.98),
{_REACH},
n AS (SELECT id, count(*) AS k FROM (SELECT a AS id FROM links UNION ALL SELECT b FROM links) GROUP BY id)
SELECT id AS vec_id, CAST(coalesce(k, 0) AS BIGINT) AS n_links, component_id, component_id = id AS kept FROM comp LEFT JOIN n USING (id)
"""

ORACLES["op8_minhash_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id AS id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
nodes AS (SELECT id FROM d),
sh AS MATERIALIZED (SELECT DISTINCT id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
size AS MATERIALIZED (SELECT id, count(*) AS n FROM sh GROUP BY id),
links AS MATERIALIZED (
  SELECT p.a, p.b FROM (SELECT x.id AS a, y.id AS b, count(*) AS k FROM sh x JOIN sh y ON x.g = y.g AND x.id < y.id GROUP BY ALL) p
  JOIN size s ON p.a = s.id JOIN size t ON p.b = t.id WHERE 100 * k >= 85 * (s.n + t.n - k)
),
{_REACH}
SELECT id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, component_id = id AS kept FROM comp LEFT JOIN size USING (id)
"""

ORACLES["op4_suffix_dedup"] = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i, md5(array_slice(b, i, i + 199)) AS h FROM (SELECT doc_id, b, unnest(range(1, n - 198)) AS i FROM d WHERE n >= 200)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
isl AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 0 ELSE 1 END AS fresh FROM rep)),
runs AS MATERIALIZED (SELECT doc_id, min(i) AS a, max(i) + 199 AS e FROM isl GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS s, a - 1 AS t FROM runs
  UNION ALL SELECT doc_id, max(e) + 1 AS s, any_value(n) AS t FROM runs JOIN d USING (doc_id) GROUP BY doc_id
),
kept AS (SELECT doc_id, sha256(unhex(string_agg(hex(array_slice(b, s, t)), '' ORDER BY s))) AS sha FROM pieces JOIN d USING (doc_id) WHERE s <= t GROUP BY doc_id),
sums AS (SELECT doc_id, sum(e - a + 1) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN spans IS NULL THEN sha256(b) ELSE coalesce(sha, sha256('')) END AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

ORACLES["word_counts"] = r"""
WITH d AS (SELECT 'words' AS tokenizer, source, lang, length(coalesce(text, '')) AS n_chars, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens FROM documents)
SELECT tokenizer, source, lang, CAST(grouping(tokenizer, source, lang) AS BIGINT) AS level, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(n_chars) AS BIGINT) AS n_chars, CAST(sum(n_tokens) AS BIGINT) AS n_tokens
FROM d GROUP BY GROUPING SETS ((tokenizer, source, lang), (tokenizer, source), (tokenizer))
"""
