"""SQL (DuckDB) that gives the rows of the queries that SQL can express, straight from their rules.

The learned operators (2's own labels, 4, 8, 10's verdicts) and the tokenizer (3) have none; tests hold
them against brute force, held-out rows and the tokenizers library.  What SQL can express of 2 and 10 are
queries of their own: ``license_base`` and ``url_rules``.
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"
_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP1 = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
     iw AS (SELECT item_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM benchmark),
     g AS (SELECT item_id, w, least(5, len(w)) AS z FROM iw WHERE len(w) > 0),
     i AS (SELECT DISTINCT item_id, array_to_string(w[k:k+z-1], ' ') AS s FROM (SELECT item_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM g)),
     d AS (SELECT DISTINCT doc_id, s FROM (SELECT doc_id, array_to_string(w[k:k+z-1], ' ') AS s FROM
            (SELECT doc_id, w, z, unnest(range(1, len(w) - z + 2)) AS k FROM dw, (SELECT DISTINCT z FROM g) WHERE len(w) >= z)) SEMI JOIN i USING (s)),
     n AS (SELECT item_id, count(*) AS n_item FROM i GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, n_item, count(*)::DOUBLE / n_item AS containment
FROM d JOIN i USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id, n_item HAVING count(*) >= 0.8 * n_item
"""

LICENSE_BASE = f"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_ALNUM}) AS w FROM documents),
     b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
     p AS (SELECT doc_id, k - 1 AS k, label FROM b, (VALUES (['mit', 'license'], 'mit'), (['apache', 'license'], 'apache'), (['general', 'public', 'license'], 'gpl')) AS t(phrase, label)
           WHERE w[k:k+len(phrase)-1] = phrase),
     f AS (SELECT doc_id, count(*) AS n_base, min(k) AS first_word, max(k) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM p GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels FROM w LEFT JOIN f USING (doc_id)
"""

URL_RULES = """
WITH u AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
     h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
     r AS (SELECT * FROM (VALUES ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'), ('example.org/en/1', 'example.org', '/en/1', 'block'),
                                 ('com/fr/', 'com', '/fr/', 'allow'), ('com/de/', 'com', '/de/', 'block')) AS t(rule, name, tail, verdict)),
     f AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS rule_verdict FROM h JOIN r ON (host = name OR ends_with(host, '.' || name)) AND starts_with(path, tail) GROUP BY page_id)
SELECT page_id, host, path, rule, rule_verdict FROM h LEFT JOIN f USING (page_id)
"""

OP5 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INTEGER AS rank, vec_id, score FROM r WHERE n <= 5
"""

OP6 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
     b AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS k FROM d),
     w AS (SELECT doc_id, k, CASE WHEN length(h) >= 2 * k + 200 THEN substr(h, 2 * k + 1, 200) END AS s, substr(h, 2 * k + 1, 2) AS x FROM b),
     r AS (SELECT doc_id, k, x, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, k) > 1 AS again FROM w),
     c AS (SELECT doc_id, k, x, coalesce(max(CASE WHEN again THEN k END) OVER (PARTITION BY doc_id ORDER BY k) >= k - 99, false) AS gone FROM r),
     e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM c),
     g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(x, '' ORDER BY k) FILTER (NOT gone) AS kept FROM e GROUP BY doc_id)
SELECT doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS w FROM documents),
     s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k+3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS k FROM w WHERE len(w) > 0)),
     n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
     p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
     l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
     e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
     r AS (SELECT doc_id, doc_id AS node FROM documents UNION SELECT r.doc_id, e.b FROM r JOIN e ON e.a = r.node)
SELECT doc_id, coalesce(max(n), 0)::BIGINT AS n_shingles, min(node) AS component_id FROM r LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

OP9 = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
     b AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS k FROM w),
     x AS (SELECT doc_id, k, w[k] AS x, CASE WHEN k + 49 <= len(w) THEN array_to_string(w[k:k+49], ' ') END AS s FROM b),
     r AS (SELECT doc_id, k, x, s IS NOT NULL AND min(doc_id) OVER (PARTITION BY s) < doc_id AS again FROM x),
     c AS (SELECT doc_id, k, x, coalesce(max(CASE WHEN again THEN k END) OVER (PARTITION BY doc_id ORDER BY k) >= k - 49, false) AS gone FROM r),
     g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(x, ' ' ORDER BY k) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN g USING (doc_id)
"""

SQL = {"op1_decontaminate": OP1, "op5_vector_search": OP5, "op6_suffix_dedup": OP6, "op7_jaccard_join": OP7, "op9_substring_dedup": OP9, "license_base": LICENSE_BASE, "url_rules": URL_RULES}
