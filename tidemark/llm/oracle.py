"""The same results as plain SQL, by query name."""

ORACLE: dict[str, str] = {}

_PLACES = """
WITH once AS (SELECT query_id, doc_id, max(CASE WHEN NOT isnan(lexical_score) THEN lexical_score END) AS l, max(CASE WHEN NOT isnan(semantic_score) THEN semantic_score END) AS s
  FROM fused_hits WHERE query_id IS NOT NULL AND doc_id IS NOT NULL GROUP BY 1, 2),
placed AS (SELECT query_id, doc_id,
  CASE WHEN l IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY l DESC NULLS LAST, doc_id) END AS lp,
  CASE WHEN s IS NOT NULL THEN row_number() OVER (PARTITION BY query_id ORDER BY s DESC NULLS LAST, doc_id) END AS sp,
  count(l) OVER (PARTITION BY query_id) AS ln, count(s) OVER (PARTITION BY query_id) AS sn FROM once),
fused AS (SELECT *, coalesce(1.0::DOUBLE / (60 + lp), 0) + coalesce(1.0::DOUBLE / (60 + sp), 0) AS rrf,
  least(coalesce(lp::DOUBLE / ln, 1), coalesce(sp::DOUBLE / sn, 1)) AS r1, greatest(coalesce(lp::DOUBLE / ln, 1), coalesce(sp::DOUBLE / sn, 1)) AS r2 FROM placed)
"""

ORACLE["p5_found"] = _PLACES + """
SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, doc_id) AS n FROM fused) WHERE n <= 10
"""

ORACLE["p8_found"] = "SELECT doc_id FROM documents WHERE octet_length(encode(text)) + 1 > 4096"

_P2 = """
WITH recs AS (SELECT DISTINCT _id, headline, short_description, category FROM stored_news),
words AS (SELECT _id, 'headline' AS field_name, unnest(regexp_extract_all(lower(headline), '[\\p{L}\\p{N}]+')) AS term FROM recs
  UNION ALL SELECT _id, 'short_description', unnest(regexp_extract_all(lower(short_description), '[\\p{L}\\p{N}]+')) FROM recs
  UNION ALL SELECT _id, 'category', lower(trim(category)) FROM recs WHERE trim(category) <> ''),
counted AS (SELECT field_name, term, count(*) AS n, count(DISTINCT _id) AS n_records FROM words GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN n_records <= 2 THEN 'rare' WHEN n_records >= 0.05 * (SELECT count(DISTINCT _id) FROM stored_news) THEN 'common' END AS mark FROM counted)
"""
ORACLE["p2_found"] = _P2 + "SELECT field_name, term, mark FROM marked WHERE mark IS NOT NULL"
ORACLE["p2_counts"] = _P2 + "SELECT field_name, term, n, n_records, coalesce(mark, '') AS mark FROM marked"

_P6 = """
WITH recs AS (SELECT DISTINCT _id, headline, short_description FROM stored_news),
words AS (SELECT _id, unnest(regexp_extract_all(lower(headline), '[\\p{L}\\p{N}]+')) AS term FROM recs
  UNION ALL SELECT _id, unnest(regexp_extract_all(lower(short_description), '[\\p{L}\\p{N}]+')) FROM recs),
tfs AS (SELECT _id, term, count(*) AS tf FROM words GROUP BY 1, 2),
dfs AS (SELECT term, count(*) AS df FROM tfs GROUP BY 1),
scored AS (SELECT _id, term, CASE WHEN df > 1 THEN tf * ln((SELECT count(DISTINCT _id) FROM stored_news)::DOUBLE / df) ELSE 0 END AS w FROM tfs JOIN dfs USING (term)),
ordered AS (SELECT *, row_number() OVER (PARTITION BY _id ORDER BY w DESC) AS n, lead(w) OVER (PARTITION BY _id ORDER BY w DESC) AS second FROM scored)
"""
ORACLE["p6_found"] = _P6 + "SELECT _id AS news_id, term FROM ordered WHERE n = 1 AND w > 0 AND w > 1.05 * coalesce(second, 0)"
ORACLE["p6_terms"] = _P6.replace("scored AS (SELECT _id, term,", "scored AS (SELECT _id, term, tf, df,") + "SELECT _id AS news_id, term, tf::INTEGER AS tf, df, round(w, 6) AS weight FROM scored"
ORACLE["p5_significance"] = _PLACES + """
SELECT query_id, doc_id, round(least(1, 2 * least(1 - (1 - r1) * (1 - r1), r2 * r2)), 9) AS rho,
  row_number() OVER (PARTITION BY query_id ORDER BY round(least(1, 2 * least(1 - (1 - r1) * (1 - r1), r2 * r2)), 9), rrf DESC, doc_id) AS rra_place FROM fused
"""

ORACLE["p7_found"] = """
WITH recs AS (SELECT doc_id, min(embedding)::DOUBLE[] AS v FROM news_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
  AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY 1),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, list_cosine_similarity(a.v, b.v) AS c FROM recs a JOIN recs b ON a.doc_id <> b.doc_id),
near AS (SELECT x, y FROM pairs WHERE c >= 0.85 QUALIFY row_number() OVER (PARTITION BY x ORDER BY c DESC, y) <= 5)
SELECT DISTINCT least(x, y) AS doc_a, greatest(x, y) AS doc_b FROM near
"""

ORACLE["p9_found"] = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
e AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM eval_items),
dg AS (SELECT doc_id, substring(t, i, 40) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS i FROM d)),
eg AS (SELECT DISTINCT item_id, substring(t, i, 40) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS i FROM e))
SELECT DISTINCT doc_id, item_id FROM dg JOIN eg USING (g)
"""

ORACLE["p8_pieces"] = """
WITH sizes AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS n FROM documents),
pieces AS (SELECT doc_id, n, unnest(range(0, ((n - 1) // 4096) + 1)) AS piece FROM sizes)
SELECT doc_id, piece::INTEGER AS piece, piece * 4096 AS token_start, least(n, piece * 4096 + 4096) AS token_stop, (least(n, piece * 4096 + 4096) - piece * 4096)::INTEGER AS size, TRUE AS within_capacity FROM pieces
"""

ORACLE["p9_runs"] = """
WITH d AS (SELECT doc_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM documents),
e AS (SELECT item_id, regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g') AS t FROM eval_items),
dg AS (SELECT doc_id, i, substring(t, i, 40) AS g FROM (SELECT doc_id, t, unnest(range(1, length(t) - 38)) AS i FROM d)),
eg AS (SELECT item_id, j, substring(t, j, 40) AS g FROM (SELECT item_id, t, unnest(range(1, length(t) - 38)) AS j FROM e)),
met AS (SELECT doc_id, item_id, i, i - j AS diagonal FROM dg JOIN eg USING (g)),
islands AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS island FROM met),
runs AS (SELECT doc_id, item_id, count(*) + 39 AS run FROM islands GROUP BY doc_id, item_id, diagonal, island)
SELECT doc_id, item_id, max(run)::INTEGER AS run FROM runs GROUP BY 1, 2
"""

ORACLE["p6_models"] = _P6.replace("WITH recs", "WITH RECURSIVE recs").rsplit("scored AS", 1)[0] + """
grounds AS (SELECT term, sum(tf) / (SELECT sum(tf) FROM tfs)::DOUBLE AS bg FROM tfs GROUP BY 1),
em AS (
  SELECT 0 AS round, _id, term, tf::DOUBLE AS tf, bg, tf / sum(tf) OVER (PARTITION BY _id)::DOUBLE AS p, FALSE AS done FROM tfs JOIN grounds USING (term)
  UNION ALL
  SELECT round + 1, _id, term, tf, bg, CASE WHEN done THEN p ELSE fresh END, done OR max(abs(fresh - p)) OVER (PARTITION BY _id) < 1e-6::DOUBLE
  FROM (SELECT *, e / sum(e) OVER (PARTITION BY _id) AS fresh FROM (SELECT *, tf * 0.1::DOUBLE * p / (0.1::DOUBLE * p + 0.9::DOUBLE * bg) AS e FROM em WHERE round < 50)))
SELECT _id AS news_id, term, round(p, 6) AS p FROM em WHERE round = 50
"""

ORACLE["p7_exact"] = """
WITH recs AS (SELECT doc_id, min(embedding)::DOUBLE[] AS v FROM news_vectors WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
  AND list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max') > 0 GROUP BY 1),
pairs AS (SELECT a.doc_id AS doc_id, b.doc_id AS similar_id, list_cosine_similarity(a.v, b.v) AS c FROM recs a JOIN recs b ON a.doc_id <> b.doc_id AND a.doc_id % 50 = 0)
SELECT doc_id, similar_id, round(c, 6) AS cosine, row_number() OVER (PARTITION BY doc_id ORDER BY round(c, 12) DESC, similar_id)::INTEGER AS place FROM pairs QUALIFY place <= 5
"""

ORACLE["p10_cover"] = "SELECT doc_id, length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) AS n_letters FROM documents WHERE regexp_matches(text, '\\S')"
