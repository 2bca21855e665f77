"""The same results as plain SQL, by query name."""

from __future__ import annotations

from .functions.web import DROPPED, LINE_TAGS, _PRIVATE
from .operators.ranking import B, K1

ORACLE: dict[str, str] = {}

# A word, written for RE2 and apart from the engine's pattern: letters (with their marks) that one of ' ’ . : · joins,
# or figures that one of . , ; ' ’ ⁄ joins, run together with any further letters, figures, marks and underscores.
_RUN = "[\\p{L}\\p{M}\\p{Nd}_]"
_WORD = f"(?:{_RUN}*(?:\\p{{L}}\\p{{M}}*(?:[''’.:·]\\p{{L}}\\p{{M}}*)+|\\p{{Nd}}\\p{{M}}*(?:[.,;''’⁄]\\p{{Nd}}\\p{{M}}*)+))+{_RUN}*|{_RUN}+"


def _folded(column: str) -> str:
    """Compatibility folding as far as the test tables need it: sharp s, Thai sara am, and characters that are ignored."""
    return f"regexp_replace(replace(replace(lower(coalesce({column}, '')), 'ß', 'ss'), chr(3635), chr(3661) || chr(3634)), '[\\x{{AD}}\\x{{200B}}-\\x{{200F}}\\x{{2060}}\\x{{FEFF}}]', '', 'g')"


_TOKS = f"""
toks AS (SELECT doc_id, regexp_extract_all({_folded('text')}, '{_WORD}') AS tokens FROM documents WHERE doc_id IS NOT NULL),
lens AS (SELECT doc_id, len(tokens)::INTEGER AS dl FROM toks),
size AS (SELECT count(*) AS n, coalesce(sum(dl), 0)::BIGINT AS total_len, coalesce(sum(dl), 0)::DOUBLE / count(*) AS avgdl, max(doc_id) AS max_doc_id FROM lens),
words AS (SELECT doc_id, unnest(tokens) AS term, unnest(range(len(tokens)))::INTEGER AS position FROM toks),
posts AS (SELECT term, doc_id, count(*)::INTEGER AS tf FROM words GROUP BY 1, 2),
terms AS (SELECT term, count(*) AS df, max(tf) AS max_tf FROM posts GROUP BY 1)
"""
_IDF = "ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE))"
_BM25 = f"({_IDF} * (tf * {K1 + 1}::DOUBLE) / (tf + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * dl / avgdl)))"

ORACLE["tokenize_positions"] = f"WITH {_TOKS} SELECT doc_id, position, term FROM words"
ORACLE["doc_lengths"] = f"WITH {_TOKS} SELECT doc_id, dl FROM lens"
ORACLE["corpus_stats"] = f"WITH {_TOKS} SELECT n, total_len, round(avgdl, 6) AS avgdl, max_doc_id, (SELECT count(*) FROM terms) AS vocab, 128::INTEGER AS block_size FROM size"
ORACLE["postings_build"] = f"WITH {_TOKS} SELECT term, doc_id, count(*)::INTEGER AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM words GROUP BY 1, 2"
ORACLE["term_stats"] = f"WITH {_TOKS} SELECT term, df, max_tf, round({_IDF} * {K1 + 1}::DOUBLE, 6) AS bm25_bound, round(max_tf * {_IDF}, 6) AS tfidf_bound FROM terms, size"
ORACLE["posting_blocks"] = f"""WITH {_TOKS},
numbered AS (SELECT term, doc_id, tf, dl, row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1 AS r FROM posts JOIN lens USING (doc_id)),
blocks AS (SELECT term, (r // 128)::INTEGER AS block_id, min(r) AS "begin", max(r) + 1 AS "end", min(doc_id) AS first_doc, max(doc_id) AS last_doc, max(tf) AS max_tf, min(dl) AS min_dl FROM numbered GROUP BY 1, 2),
bound AS (SELECT b.*, df, n, avgdl, b.max_tf AS tf, b.min_dl AS dl FROM blocks b JOIN terms t USING (term), size)
SELECT term, block_id, "begin", "end", first_doc, last_doc, max_tf, min_dl, round({_BM25}, 6) AS max_score FROM bound"""


def _has(term: str) -> str:
    return f"list_contains(tokens, '{term}')"


def _phrase(a: str, b: str) -> str:
    return f"doc_id IN (SELECT x.doc_id FROM words x JOIN words y ON x.doc_id = y.doc_id AND y.position = x.position + 1 WHERE x.term = '{a}' AND y.term = '{b}')"


_UNIVERSE = "universe AS (SELECT unnest(range(1, (SELECT max_doc_id FROM size) + 1)) AS doc_id)"

ORACLE["bool_and"] = f"WITH {_TOKS} SELECT doc_id FROM toks WHERE {_has('harbour')} INTERSECT SELECT doc_id FROM toks WHERE {_has('election')}"
ORACLE["bool_or"] = f"WITH {_TOKS} SELECT doc_id FROM toks WHERE {_has('lighthouse')} UNION SELECT doc_id FROM toks WHERE {_has('vaccine')}"
ORACLE["bool_not"] = f"WITH {_TOKS}, {_UNIVERSE} SELECT doc_id FROM universe EXCEPT SELECT doc_id FROM toks WHERE {_has('council')}"
ORACLE["bool_nested"] = f"""WITH {_TOKS}, {_UNIVERSE},
a AS (SELECT doc_id FROM toks WHERE {_has('harbour')} OR {_phrase('port', 'authority')}),
b AS (SELECT doc_id FROM toks WHERE {_has('election')} UNION (SELECT doc_id FROM universe EXCEPT SELECT doc_id FROM toks WHERE {_has('council')}))
SELECT doc_id FROM a INTERSECT (SELECT doc_id FROM universe EXCEPT SELECT doc_id FROM b)"""
ORACLE["bool_implicit_and"] = f"WITH {_TOKS} SELECT doc_id FROM toks WHERE {_has('harbour')} AND {_has('council')}"
ORACLE["phrase_match"] = f"WITH {_TOKS} SELECT doc_id FROM toks WHERE {_phrase('water', 'board')}"


def _ranked(query: list[str], part: str, k: int | None = 10, where: str = "TRUE") -> str:
    values = ", ".join(f"({i}, '{t}')" for i, t in enumerate(query))
    scored = f"""WITH {_TOKS}, q(pos, term) AS (VALUES {values}),
parts AS (SELECT doc_id, pos, {part} AS part FROM posts JOIN q USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), size WHERE doc_id IN (SELECT doc_id FROM toks WHERE {where})),
scored AS (SELECT doc_id, sum(part ORDER BY pos) AS score FROM parts GROUP BY 1 HAVING sum(part) > 0)"""
    if k is None:
        return scored + " SELECT doc_id, round(score, 6) AS score FROM scored"
    return scored + f" SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored QUALIFY rank <= {k}"


_FREE = ["port", "authority", "election"]
_RAW = ["election", "harbour", "election"]
ORACLE["phrase_bm25"] = _ranked(["water", "board"], _BM25, where=_phrase("water", "board"))
for _name in ("bm25_topk", "wand_topk", "block_max_wand_topk"):
    ORACLE[_name] = _ranked(_FREE, _BM25)
ORACLE["bm25_all_scores"] = _ranked(_FREE, _BM25, None)
ORACLE["bm25_raw"] = _ranked(_RAW, _BM25)
ORACLE["tfidf_topk"] = _ranked(_FREE, f"tf * {_IDF}")
ORACLE["tfidf_raw"] = _ranked(_RAW, "tf * ln(n::DOUBLE / df)")
ORACLE["bool_ranked"] = _ranked(["harbour", "election"], _BM25, where=f"{_has('harbour')} AND {_has('election')}")
ORACLE["bool_not_ranked"] = _ranked(["election", "harbour"], _BM25, where=f"{_has('election')} OR (doc_id >= 1 AND NOT {_has('harbour')})")
ORACLE["explain_doc"] = f"""WITH {_TOKS}, q(pos, term) AS (VALUES (0, 'port'), (1, 'authority'), (2, 'election'), (3, 'harbour'), (4, 'the')),
parts AS (SELECT pos, term, {_BM25} AS part FROM posts JOIN q USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), size WHERE doc_id = 17)
SELECT doc_id, 'LEXICAL' AS mode, coalesce((SELECT round(sum(part ORDER BY pos), 6) FROM parts), 0) AS lexical_score, 5::INTEGER AS query_terms, (SELECT count(*)::INTEGER FROM parts) AS matched_count,
FALSE AS phrase_match, (SELECT count(*) FROM parts) = 5 AS matched_query, coalesce((SELECT string_agg(term, ',' ORDER BY pos) FROM parts), '') AS matched_terms FROM toks WHERE doc_id = 17"""
ORACLE["retrieval_stats"] = f"""WITH {_TOKS}, hits AS (SELECT * FROM posts WHERE term IN ('port', 'authority', 'election'))
SELECT count(DISTINCT doc_id) AS documents_scored, count(*) AS postings_visited, 3::BIGINT AS query_terms, count(DISTINCT term) AS matched_terms, 0::BIGINT AS candidates_considered, 0::BIGINT AS blocks_skipped FROM hits"""

_BATCH = f"""parts AS (SELECT query_id, doc_id, pos, {_BM25} AS part FROM posts JOIN q USING (term) JOIN terms USING (term) JOIN lens USING (doc_id), size),
scored AS (SELECT query_id, doc_id, sum(part ORDER BY pos) AS score FROM parts GROUP BY 1, 2 HAVING sum(part) > 0)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM scored QUALIFY rank <= 10"""
ORACLE["bm25_batch"] = f"""WITH {_TOKS}, qw AS (SELECT query_id, regexp_extract_all({_folded('query_text')}, '{_WORD}') AS ts FROM search_queries),
qe AS (SELECT query_id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM qw), q AS (SELECT query_id, term, min(pos) AS pos FROM qe GROUP BY 1, 2), {_BATCH}"""

_BUCKETS = """bucketed AS (SELECT term, df, n, CASE WHEN df::DOUBLE / n >= 0.20 THEN 'high_df' WHEN df::DOUBLE / n >= 0.05 THEN 'medium_df' WHEN df::DOUBLE / n >= 0.01 THEN 'low_df' ELSE 'rare_df' END AS bucket FROM terms, size),
placed AS (SELECT bucket, term, df, row_number() OVER (PARTITION BY bucket ORDER BY CASE WHEN bucket = 'rare_df' THEN df ELSE -df END, term)::INTEGER AS place FROM bucketed QUALIFY place <= 8)"""
ORACLE["df_buckets"] = f"WITH {_TOKS}, {_BUCKETS} SELECT bucket, count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS max_df, min(df) AS min_df FROM bucketed GROUP BY 1"
ORACLE["workload_terms"] = f"WITH {_TOKS}, {_BUCKETS} SELECT bucket, place, term, df FROM placed"
ORACLE["workload_batch"] = f"""WITH {_TOKS}, {_BUCKETS}, sized AS (SELECT *, count(*) OVER (PARTITION BY bucket) AS c, CASE bucket WHEN 'high_df' THEN 0 WHEN 'medium_df' THEN 1 WHEN 'low_df' THEN 2 ELSE 3 END AS b FROM placed),
forms AS (SELECT 0 AS f, b, 1 AS form, place - 1 AS spot, term, 0 AS pos FROM sized UNION ALL SELECT 1, b, 2, (place - 1) // 2, term, (place - 1) % 2 FROM sized WHERE place <= c - c % 2
  UNION ALL SELECT 1, b, 4, 0, term, place - 1 FROM sized WHERE c > 3 AND place <= 4),
q AS (SELECT dense_rank() OVER (ORDER BY f, b, form, spot) AS query_id, term, pos FROM forms), {_BATCH}"""

ORACLE["headline_workload_batch"] = ORACLE["workload_batch"].replace("coalesce(text, '')", "coalesce(headline, '')").replace("FROM documents WHERE doc_id IS NOT NULL", "FROM (SELECT DISTINCT _id AS doc_id, headline FROM stored_news)")
ORACLE["term_postings"] = f"WITH {_TOKS} SELECT doc_id, count(*)::INTEGER AS tf, string_agg(position::VARCHAR, ',' ORDER BY position) AS positions FROM words WHERE term = 'harbour' GROUP BY 1"

_QVEC = """vecs AS (SELECT vec_id AS doc_id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))::FLOAT AS norm FROM embeddings),
quant AS (SELECT doc_id, list_transform(embedding, lambda x: greatest(-127, least(127, round(((x / norm)::FLOAT * 127::FLOAT)::FLOAT)))::TINYINT) AS qvec FROM vecs WHERE norm > 0)"""
ORACLE["vector_quantize"] = f"WITH {_QVEC} SELECT doc_id, unnest(range(len(qvec)))::INTEGER AS component, unnest(qvec) AS level FROM quant"
_DOT = "list_dot_product(qvec::DOUBLE[], embedding::DOUBLE[]) / 127.0::DOUBLE / norm::DOUBLE"
ORACLE["vector_topk"] = f"""WITH {_QVEC}, s AS (SELECT quant.doc_id, {_DOT} AS score FROM quant, vecs q WHERE q.doc_id = 3)
SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 20"""
ORACLE["vector_topk_batch"] = f"""WITH {_QVEC}, s AS (SELECT q.doc_id AS query_id, quant.doc_id, {_DOT} AS score FROM quant, vecs q WHERE q.doc_id % 50 = 0)
SELECT query_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 5"""


def _fusion(limit: int) -> str:
    lexical = _ranked(_FREE, _BM25, 100)
    return f"""lex AS ({lexical}), vec AS (WITH {_QVEC}, s AS (SELECT quant.doc_id, {_DOT} AS score FROM quant, vecs q WHERE q.doc_id = 3)
  SELECT doc_id, round(score, 6) AS score, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 100),
fused AS (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, coalesce(1 / (60.0::DOUBLE + l.rank), 0) + coalesce(1 / (60.0::DOUBLE + v.rank), 0) AS score, l.score AS lexical_score, v.score AS semantic_score, l.rank AS lexical_rank, v.rank AS semantic_rank
  FROM (SELECT * FROM lex WHERE doc_id > 0) l FULL JOIN (SELECT * FROM vec WHERE doc_id > 0) v ON l.doc_id = v.doc_id),
best AS (SELECT doc_id, round(score, 9) AS score, lexical_score, semantic_score, lexical_rank, semantic_rank, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id)::INTEGER AS rank FROM fused QUALIFY rank <= {limit})"""


_STORE = "store AS (SELECT DISTINCT _id, headline, short_description, category, authors, date, link FROM stored_news)"
ORACLE["rrf_fusion"] = f"WITH {_fusion(50)} SELECT rank, doc_id, score, coalesce(lexical_score, 0) AS lexical_score, coalesce(semantic_score, 0) AS semantic_score, coalesce(lexical_rank, 0)::INTEGER AS lexical_rank, coalesce(semantic_rank, 0)::INTEGER AS semantic_rank FROM best"
ORACLE["hybrid_hydrated"] = f"WITH {_fusion(20)}, {_STORE} SELECT rank, doc_id, score, headline, category FROM best LEFT JOIN store ON _id = doc_id"
ORACLE["batch_lookup"] = f"WITH {_STORE}, wanted(_id, ordinal) AS (VALUES (40, 0::INTEGER), (7, 1), (999999999, 2), (21, 3), (3, 4)) SELECT ordinal, store._id, headline FROM wanted JOIN store ON store._id = wanted._id"
ORACLE["value_percentiles"] = """SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95,
round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most FROM events GROUP BY 1"""


def _replaced(text: str, steps: list[tuple[str, str]]) -> str:
    for pattern, value in steps:
        text = f"regexp_replace({text}, '{pattern}', {value}, 'g')"
    return text


_NL = "chr(10)"
_PAGE = (
    "concat('<html><head><style>p{}</style></head><body><!-- page --><nav>menu</nav><h1 class=\"t\">', coalesce(category, ''), '</h1><p>', "
    f"replace(replace(coalesce(text, ''), '&', '&amp;'), {_NL} || {_NL}, '</p>' || {_NL} || {_NL} || ' <p>'), '</p><br/>&lt;end&gt; &#8364;&#x41;<script>var a = 1;</script><footer>foot</footer></body></html>')"
)
_READ = _replaced(
    _PAGE,
    [
        ("(?s)<!--.*?-->", "' '"),
        *[(f"(?is)<{t}[^>]*>.*?</{t}\\s*>", "' '") for t in DROPPED],
        (f"(?i)<(?:br|/(?:{'|'.join(LINE_TAGS)}))\\b[^>]*>", _NL),
        ("(?s)<[^>]+>", "' '"),
        ("(?i)&nbsp;", "' '"),
        ("(?i)&amp;", "'&'"),
        ("(?i)&quot;", "'\"'"),
        ("(?i)&#39;|&apos;", "chr(39)"),
        ("(?i)&lt;", "'<'"),
        ("(?i)&gt;", "'>'"),
        ("&#8364;", "'€'"),
        ("&#x41;", "'A'"),
        ("[\\t\\r ]+", "' '"),
        ("\\n\\s+", _NL),
        ("\\n{3,}", f"{_NL} || {_NL}"),
        ("^\\s+|\\s+$", "''"),
    ],
)
ORACLE["html_text"] = f"SELECT doc_id, {_READ} AS text FROM documents"

_STRIP = "regexp_replace(coalesce({}, ''), '^[\\s\\x{{A0}}\\x{{FEFF}}]+|[\\s\\x{{A0}}\\x{{FEFF}}]+$', '', 'g')"
_VALID = f"""(regexp_matches({{0}}, '(?i)^https://[^\\s/?#@]+([/?#]\\S*)?$') AND NOT regexp_matches(regexp_extract({{0}}, '(?i)^https://(\\[[^\\]]*\\]|[^\\s/?#:]+)', 1), '{_PRIVATE.replace("{", "{{").replace("}", "}}")}'))"""
_S = lambda c: _STRIP.format(c)
ORACLE["source_dedup"] = f"""WITH {_STORE}, hits AS (SELECT DISTINCT query_id, hit_rank, doc_id FROM semantic_hits),
rows AS (SELECT query_id, hit_rank, substring(doc_id::VARCHAR, 1, 80) AS id, substring({_S('headline')}, 1, 300) AS headline, substring({_S('link')}, 1, 2048) AS url FROM hits JOIN store ON _id = doc_id),
sound AS (SELECT * FROM rows WHERE headline <> '' AND {_VALID.format('url')}),
firsts AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY hit_rank NULLS LAST, id) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank NULLS LAST, id)::INTEGER AS place, id, headline, url FROM firsts QUALIFY place <= 5"""
ORACLE["address_check"] = f"SELECT feed, coalesce({_VALID.format('link')}, FALSE) AS valid, count(*) AS n_rows FROM stored_news GROUP BY 1, 2"
ORACLE["ndjson_ingest"] = f"""SELECT _id AS source_id, {_S('headline')} AS headline, {_S('short_description')} AS short_description, {_S('category')} AS category, {_S('authors')} AS authors, {_S('date')} AS date, {_S('link')} AS link
FROM stored_news WHERE {_S('headline')} <> ''"""


def _tidy(column: str) -> str:
    return _STRIP.format(f"regexp_replace({column}, '\\r\\n?', chr(10), 'g')")


ORACLE["text_file_stats"] = f"""WITH {_STORE}, files AS (SELECT CASE WHEN length(_id::VARCHAR) < 6 THEN lpad(_id::VARCHAR, 6, '0') ELSE _id::VARCHAR END || '.txt' AS file_name,
  octet_length(encode({_tidy('headline')} || chr(10) || chr(10) || {_tidy('short_description')} || chr(10))) AS n_bytes FROM store WHERE {_S('headline')} <> '')
SELECT count(*) AS files, sum(n_bytes)::BIGINT AS total_bytes, round(avg(n_bytes), 6) AS mean_bytes, max(n_bytes) AS largest_bytes, (SELECT file_name FROM files ORDER BY n_bytes DESC, file_name LIMIT 1) AS largest_file FROM files"""
ORACLE["repeated_queries"] = "SELECT lower(regexp_replace(trim(query_text), '\\s+', ' ', 'g')) AS query_key, count(*) AS n, min(query_id) AS first_id FROM search_queries GROUP BY 1"

ORACLE["set_operators"] = f"""WITH {_TOKS}, {_UNIVERSE}, a AS (SELECT doc_id FROM toks WHERE {_has('harbour')}), b AS (SELECT doc_id FROM toks WHERE {_has('council')}),
nested AS ({ORACLE["bool_nested"]})
SELECT 'term' AS operator, doc_id FROM a UNION ALL (SELECT 'intersect', doc_id FROM (SELECT * FROM a INTERSECT SELECT * FROM b)) UNION ALL (SELECT 'unite', doc_id FROM (SELECT * FROM a UNION SELECT * FROM b))
UNION ALL (SELECT 'complement', doc_id FROM (SELECT * FROM universe EXCEPT SELECT * FROM a)) UNION ALL (SELECT 'and_query', doc_id FROM toks WHERE {_has('harbour')} AND {_has('election')})
UNION ALL (SELECT 'or_query', doc_id FROM toks WHERE {_has('lighthouse')} OR {_has('vaccine')}) UNION ALL (SELECT 'not_query', doc_id FROM (SELECT * FROM universe EXCEPT SELECT doc_id FROM toks WHERE {_has('the')}))
UNION ALL (SELECT 'by_sets', doc_id FROM nested)"""
ORACLE["posting_lookup"] = f"""WITH {_TOKS}, asked(term, doc_id) AS (VALUES ('the', 1::BIGINT), ('harbour', 3), ('council', 17), ('nowhere', 5), ('the', 999999999)),
found AS (SELECT a.term, a.doc_id, count(w.position)::INTEGER AS tf, coalesce(string_agg(w.position::VARCHAR, ',' ORDER BY w.position), '') AS positions FROM asked a LEFT JOIN words w ON w.term = a.term AND w.doc_id = a.doc_id GROUP BY 1, 2)
SELECT f.*, coalesce(df, 0)::BIGINT AS df, coalesce(dl, 0)::INTEGER AS dl FROM found f LEFT JOIN terms ON terms.term = f.term LEFT JOIN lens ON lens.doc_id = f.doc_id"""
ORACLE["repeated_ids"] = "SELECT _id, count(*) AS n FROM stored_news GROUP BY 1 HAVING count(*) > 1"
ORACLE["posting_blocks_64"] = ORACLE["posting_blocks"].replace("r // 128", "r // 64").replace(_BM25, f"tf * {_IDF}")
ORACLE["saved_engine_search"] = ORACLE["bm25_topk"]
ORACLE["phrase_check"] = f"WITH {_TOKS} SELECT d.doc_id, {_phrase('water', 'board').replace('doc_id IN', 'd.doc_id IN')} AS holds FROM (SELECT unnest(range(1, 13)) AS doc_id) d"
ORACLE["parse_errors"] = """SELECT * FROM (VALUES ('', 'query is empty'), ('   ', 'query is empty'), ('cat )', 'unexpected token in query'), ('NOT', 'NOT requires an operand'), ('(cat', 'missing closing parenthesis'),
('AND cat', 'expected query term'), ('cat OR', 'expected query term'), ('"cat', 'unterminated query phrase'), ('cat ""', 'empty query phrase'), ('cat AND dog', '')) AS t(query, error)"""
ORACLE["own_model_topk"] = _ranked(_FREE, f"{_IDF} * tf / (tf + 1.0::DOUBLE)")
ORACLE["vector_dimensions"] = f"WITH {_QVEC} SELECT count(*) AS n, max(len(qvec))::INTEGER AS width FROM quant"
ORACLE["vector_file_topk"] = ORACLE["vector_topk"]
ORACLE["search_modes"] = f"""WITH {_fusion(10)}, lexical AS ({_ranked(_FREE, _BM25, 10)}),
semantic AS ({ORACLE["vector_topk"]} )
SELECT 'HYBRID' AS mode, rank, doc_id, round(score, 6) AS score FROM best UNION ALL SELECT 'LEXICAL', rank, doc_id, round(score, 6) FROM lexical UNION ALL SELECT 'SEMANTIC', rank, doc_id, round(score, 6) FROM semantic WHERE rank <= 10"""
ORACLE["fusion_counts"] = f"WITH {_TOKS} SELECT 'RRF' AS algorithm, 60.0::DOUBLE AS constant, (SELECT least(100, count(DISTINCT doc_id)) FROM posts WHERE term IN ('port', 'authority', 'election')) AS lexical_candidates, (SELECT least(100, count(*)) FROM embeddings) AS semantic_candidates"
ORACLE["ranking_differences"] = f"""WITH a AS ({_ranked(_FREE, _BM25, 50)}), b AS ({_ranked(_FREE, f"tf * {_IDF}", 50)})
SELECT 'models' AS compared, rank, a.doc_id AS doc_a, b.doc_id AS doc_b FROM a FULL JOIN b USING (rank) WHERE a.doc_id IS DISTINCT FROM b.doc_id"""
ORACLE["retrieval_stats_explicit"] = f"""WITH {_TOKS}, found AS ({ORACLE["bool_nested"]}), hits AS (SELECT * FROM posts WHERE term IN ('harbour', 'port', 'authority', 'election', 'council'))
SELECT (SELECT count(DISTINCT doc_id) FROM hits WHERE doc_id IN (SELECT doc_id FROM found)) AS documents_scored, (SELECT count(*) FROM hits) AS postings_visited, 5::BIGINT AS query_terms,
(SELECT count(DISTINCT term) FROM hits) AS matched_terms, (SELECT count(*) FROM found) AS candidates_considered, 0::BIGINT AS blocks_skipped"""
ORACLE["folded_terms"] = """SELECT place::INTEGER AS place, folded, term FROM (VALUES (0, 'strasse', 'strasse'), (1, 'abc', 'abc'), (2, 'fine', 'fine'), (3, 'e-mail', ''), (4, 'viii', 'viii'), (5, 'café', 'café'), (6, '!!!', ''),
(7, 'two words', ''), (8, 'don’t', 'don’t'), (9, '3.14', '3.14')) AS t(place, folded, term)"""
_SHOWN = "query_id * query_id * 977"
ORACLE["scalar_functions"] = f"""SELECT query_id, coalesce(query_text, '') AS decoded, 'malformed' AS refused, CASE WHEN query_id % 5 <> 0 THEN top_n::BIGINT ELSE -1 END AS size, CASE WHEN query_id % 7 = 0 THEN -1.0::DOUBLE ELSE query_id - 2.5::DOUBLE END AS vector_sum,
CASE WHEN {_SHOWN} < 1024 THEN ({_SHOWN})::VARCHAR || ' B' WHEN {_SHOWN} < 1048576 THEN printf('%.2f', ({_SHOWN}) / 1024.0::DOUBLE) || ' KB' WHEN {_SHOWN} < 1073741824 THEN printf('%.2f', ({_SHOWN}) / 1048576.0::DOUBLE) || ' MB'
ELSE printf('%.2f', ({_SHOWN}) / 1073741824.0::DOUBLE) || ' GB' END AS shown FROM search_queries"""
ORACLE["readable_pages"] = f"WITH pages AS (SELECT doc_id, {_READ} AS content FROM documents WHERE news_id IS NOT NULL) SELECT doc_id, least(length(content), 9000)::INTEGER AS n_chars, substring(content, 1, 60) AS opening FROM pages WHERE length(content) >= 250"
ORACLE["source_blocks"] = f"""WITH {_STORE}, hits AS (SELECT DISTINCT query_id, hit_rank, doc_id FROM semantic_hits),
rows AS (SELECT query_id, hit_rank, substring(doc_id::VARCHAR, 1, 80) AS id, substring({_S('headline')}, 1, 300) AS headline, substring({_S('link')}, 1, 2048) AS url, substring(coalesce(short_description, ''), 1, 700) AS content FROM hits JOIN store ON _id = doc_id),
sound AS (SELECT * FROM rows WHERE headline <> '' AND {_VALID.format('url')}),
firsts AS (SELECT * FROM sound QUALIFY row_number() OVER (PARTITION BY query_id, url ORDER BY hit_rank NULLS LAST, id) = 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit_rank NULLS LAST, id) AS place FROM firsts QUALIFY place <= 5)
SELECT query_id, string_agg('SOURCE ' || place || {_NL} || 'ID: ' || id || {_NL} || 'HEADLINE: ' || headline || {_NL} || 'URL: ' || url || {_NL} || 'ARTICLE TEXT:' || {_NL} || content, {_NL} || {_NL} || '---' || {_NL} || {_NL} ORDER BY place) AS block FROM placed GROUP BY 1"""
ORACLE["ndjson_documents"] = f"""WITH {_STORE} SELECT row_number() OVER (ORDER BY _id) AS doc_id, (length({_S('headline')}) + 1 + length({_S('short_description')}))::INTEGER AS n_chars FROM store WHERE {_S('headline')} <> ''"""
ORACLE["ndjson_faults"] = f"WITH {_STORE} SELECT count(*) + count(*) FILTER (_id % 10 = 0) AS lines, count(*) FILTER (_id % 10 = 0) AS invalid FROM store"
ORACLE["headline_corpus"] = f"WITH {_STORE}, worded AS (SELECT _id, coalesce(headline, '') AS text FROM store WHERE regexp_matches({_folded('headline')}, '{_WORD}')) SELECT row_number() OVER (ORDER BY _id) - 1 AS doc_id, text FROM worded"
ORACLE["vector_ingest"] = f"""WITH {_STORE}, inputs AS (SELECT row_number() OVER (ORDER BY _id) AS doc_id FROM store WHERE {_S('headline')} <> ''),
given AS (SELECT doc_id, count(*) AS n, any_value(embedding) AS v FROM news_vectors GROUP BY 1),
judged AS (SELECT CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' WHEN v IS NULL OR len(v) <> 64 THEN 'length'
  WHEN len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) > 0 OR len(list_filter(v, lambda x: x <> 0)) = 0 THEN 'value' ELSE 'usable' END AS state FROM inputs LEFT JOIN given USING (doc_id))
SELECT state, count(*) AS n FROM judged GROUP BY 1"""
ORACLE["text_folder"] = f"""WITH {_STORE}, files AS (SELECT CASE WHEN length(_id::VARCHAR) < 6 THEN lpad(_id::VARCHAR, 6, '0') ELSE _id::VARCHAR END || '.txt' AS file_name,
  {_tidy('headline')} || chr(10) || chr(10) || {_tidy('short_description')} || chr(10) AS content FROM store WHERE {_S('headline')} <> '')
SELECT row_number() OVER (ORDER BY file_name) AS doc_id, file_name, length(content)::INTEGER AS n_chars FROM files"""
ORACLE["store_roundtrip"] = f"WITH {_STORE} SELECT category, count(*) AS n, sum(length(concat(headline, authors, link)))::BIGINT AS n_chars FROM store GROUP BY 1"
