import math

import numpy as np
import pytest

from tidemark import queries as core_queries
from tidemark.engine import RequestError, SearchEngine
from tidemark.operators import boolean, ranking
from tidemark.operators.index import Index, InvalidIndex, build_index, check_unique, posting_blocks
from tidemark.operators.ranking import Ranking, Strategy
from tidemark.plans.query import QueryError, parse

TINY = {1: "Distributed systems use consensus algorithms.", 2: "Databases use transactions and consensus.", 3: "Machine learning uses neural networks.", 4: "Distributed databases are interesting."}
MIXED = {1: "cat dog", 2: "cat cat cat", 3: "dog bird", 4: "cat bird", 5: "cat dog bird", 6: "bird"}


def docs(spark, texts):
    return spark.createDataFrame(list(texts.items()) if isinstance(texts, dict) else texts, "doc_id long, text string")


def index(spark, texts, block_size=128):
    return build_index(docs(spark, texts), block_size=block_size)


def ids(df):
    return sorted(r[0] for r in df.select("doc_id").collect())


def ranked(df):
    return [r["doc_id"] for r in df.orderBy("rank").collect()]


def matches(spark, texts, query):
    return ids(boolean.evaluate(index(spark, texts), parse(query)))


def test_tokens(spark):
    rows = {1: "Orbit ORBIT", 2: "Orbit, version 2.0!", 3: "東京 systems", 4: "one two three", 5: "Straße e-mail don’t", 6: None, 7: "", 8: "x" * 100_000}
    words = {r.doc_id: r.tokens for r in index(spark, rows).tokens.collect()}
    assert words[1] == ["orbit", "orbit"]
    assert words[2] == ["orbit", "version", "2.0"]
    assert words[3][-1] == "systems" and len(words[3]) > 1
    assert words[4] == ["one", "two", "three"]
    assert words[5] == ["strasse", "e", "mail", "don’t"]
    assert words[6] == words[7] == []
    assert words[8] == ["x" * 100_000]


def test_compatible_folding(spark):
    rows = build_index(docs(spark, {1: "ﬁne ＡＢＣ", 2: "café", 3: "cafe\u0301"}))
    words = {r.doc_id: r.tokens for r in rows.tokens.collect()}
    assert words[1] == ["fine", "abc"] and words[2] == words[3]


def test_statistics(spark):
    i = index(spark, {1: "cat cat dog", 2: "cat bird", 3: "dog bird bird bird"})
    row = i.corpus.first()
    assert (row.n, row.total_len, row.avgdl, row.max_doc_id, row.vocab) == (3, 9, 3.0, 3, 3)
    assert {r.term: (r.df, r.max_tf) for r in i.terms.collect()} == {"cat": (2, 2), "dog": (2, 1), "bird": (2, 3)}
    assert {r.doc_id: r.dl for r in i.doc_stats.collect()} == {1: 3, 2: 2, 3: 4}
    empty = index(spark, []).corpus.first()
    assert (empty.n, empty.avgdl, empty.vocab, empty.max_doc_id) == (0, 0.0, 0, 0)
    blank = index(spark, {1: ""}).corpus.first()
    assert (blank.n, blank.vocab, blank.avgdl) == (1, 0, 0.0)


def test_lookups(spark, tmp_path):
    i = index(spark, {1: "cat cat dog", 2: "cat bird", 3: ""}, 2)
    i.save(f"file://{tmp_path}/look")
    for x in (i, Index.load(spark, f"file://{tmp_path}/look")):
        assert [tuple(r) for r in x.postings_of("cat").collect()] == [(1, 2, [0, 1]), (2, 1, [0])]
        assert (x.term_frequency("cat", 1), x.term_frequency("cat", 3), x.term_frequency("x", 1)) == (2, 0, 0)
        assert (x.term_positions("dog", 1), x.term_positions("dog", 2)) == ([2], [])
        assert (x.document_frequency("cat"), x.document_length(1), x.document_length(9)) == (2, 3, 0)
        assert x.blocks_of("cat").count() == 1
    assert ids(boolean.and_query(i, "cat", "dog")) == [1] and ids(boolean.or_query(i, "dog", "bird")) == [1, 2]
    assert ids(boolean.not_query(i, "cat")) == [3] and ids(boolean.not_query(i, "CAT")) == [1, 2, 3]
    assert boolean.matches_phrase(i, 1, ["cat", "dog"]) and not boolean.matches_phrase(i, 2, ["cat", "dog"])


def test_blocks(spark):
    i = index(spark, {1: "cat cat", 2: "cat dog", 3: "cat cat cat"}, 2)
    cat = [tuple(r)[1:] for r in i.blocks.where("term = 'cat'").orderBy("block_id").select("term", "block_id", "begin", "end", "first_doc", "last_doc", "max_tf", "min_dl").collect()]
    assert cat == [(0, 0, 2, 1, 2, 2, 2), (1, 2, 3, 3, 3, 3, 3)]
    with pytest.raises(InvalidIndex):
        index(spark, {1: "a"}, 0)


def test_hot_terms_get_the_same_blocks(spark):
    i = index(spark, {d: "cat " * (1 + d % 5) for d in range(1, 300, 3)}, 8)
    rows = i.term_counts
    assert sorted(map(tuple, posting_blocks(rows, 8, hot=40).collect())) == sorted(map(tuple, posting_blocks(rows, 8).collect()))


def test_block_bounds_hold_for_every_posting(spark):
    i = index(spark, {d: " ".join(["cat"] * (d % 4) + ["dog"] * (d % 7) + ["x"] * (d % 3)) for d in range(1, 60)}, 4)
    for model in Ranking:
        bounds = {(r.term, d): r.max_score for r in ranking.block_bounds(i, model).collect() for d in range(r.first_doc, r.last_doc + 1)}
        for t in ("cat", "dog", "x"):
            for r in ranking.score(i, [t], model).collect():
                assert r.score <= bounds[t, r.doc_id] + 1e-12


@pytest.mark.parametrize(
    "texts, query, want",
    [
        (TINY, "distributed", [1, 4]),
        ({1: "cat dog", 2: "cat bird", 3: "dog bird", 4: "cat dog bird"}, "cat AND dog", [1, 4]),
        ({1: "cat dog", 2: "cat bird", 3: "dog bird", 4: "cat dog bird"}, "(cat OR dog) AND NOT bird", [1]),
        ({1: "cat", 2: "dog", 3: "cat dog", 4: "bird"}, "NOT cat", [2, 4]),
        ({1: "cat", 2: "dog", 3: "dog bird", 4: "cat bird"}, "cat OR dog AND bird", [1, 3, 4]),
        ({1: "cat", 5: "dog"}, "NOT cat", [2, 3, 4, 5]),
        ({0: "dog", 2: "cat"}, "NOT cat", [1]),
        ({0: "cat", 2: "cat dog"}, "cat", [0, 2]),
        ({1: "e mail", 2: "x"}, "e-mail", []),
        ({1: "e mail", 3: "x"}, "NOT e-mail", [1, 2, 3]),
        ({1: "the the cat", 2: "the cat the"}, '"the the"', [1]),
        ({1: "a b c", 2: "a c b", 3: "b"}, '"a b" OR "b"', [1, 2, 3]),
        ({1: "Tata electric cars", 2: "Tata electric vehicles", 3: "electric cars"}, 'Tata "electric cars"', [1]),
    ],
)
def test_boolean(spark, texts, query, want):
    i = index(spark, texts)
    assert ids(boolean.evaluate(i, parse(query))) == want
    assert ids(boolean.evaluate_by_sets(i, parse(query))) == want


def test_de_morgan(spark):
    left, right = "NOT (cat OR dog)", "NOT cat AND NOT dog"
    assert matches(spark, MIXED, left) == matches(spark, MIXED, right) == [6]


def test_scores(spark):
    i = index(spark, TINY)
    found = {r.doc_id: r.score for r in ranking.score(i, ["distributed", "consensus"]).collect()}
    assert found == pytest.approx({1: 1.357075, 4: 0.741012, 2: 0.678538}, abs=1e-6)
    assert ranked(ranking.search(i, "distributed consensus", 10, Ranking.TFIDF)) == [1, 2, 4]
    j = index(spark, {1: "Cat dog cat", 2: "cat bird", 3: "dog bird"})
    idf = math.log(1 + 1.5 / 2.5)
    assert {r.doc_id: r.score for r in ranking.score(j, ["cat"], Ranking.TFIDF).collect()} == pytest.approx({1: 2 * idf, 2: idf})
    assert {r.doc_id: r.score for r in ranking.score(j, ["cat"], Ranking.TFIDF, raw=True).collect()} == pytest.approx({1: 2 * math.log(1.5), 2: math.log(1.5)})
    bound = {r.term: r for r in ranking.term_bounds(j, Ranking.TFIDF).collect()}["cat"]
    assert (bound.df, bound.max_tf) == (2, 2) and bound.max_score == pytest.approx(2 * idf)


def test_repeated_terms_count_in_the_raw_form_only(spark):
    i = index(spark, TINY)
    once = {r.doc_id: r.score for r in ranking.score(i, ["consensus"]).collect()}
    twice = {r.doc_id: r.score for r in ranking.score(i, ["consensus", "consensus"], raw=True).collect()}
    assert twice == pytest.approx({d: 2 * s for d, s in once.items()})
    assert ranked(ranking.search(i, "consensus Consensus", 5)) == ranked(ranking.search(i, "consensus", 5))


def test_free_text_is_disjunctive_and_ties_go_to_the_smaller_id(spark):
    texts = {1: "Tata recently announced several new passenger cars", 2: "Tata Motors", 3: "electric cars"}
    assert sorted(ranked(ranking.search(index(spark, texts), "Tata cars", 10))) == [1, 2, 3]
    assert ranked(ranking.search(index(spark, {2: "consensus", 5: "consensus", 7: "database"}), "consensus", 1)) == [2]


@pytest.mark.parametrize("model", list(Ranking))
@pytest.mark.parametrize("k", [1, 3, 10])
def test_strategies_agree(spark, model, k):
    texts = {d: "background document" + (" consensus" * (1 + d % 3) + " distributed" if d in (3, 130, 260) or d % 17 == 0 else "") + " filler" * (d % 5) for d in range(1, 402)}
    i = index(spark, texts).persist()
    want = [tuple(r) for r in ranking.search(i, "consensus distributed", k, model).collect()]
    for strategy in (Strategy.WAND, Strategy.BLOCK_MAX_WAND):
        assert [tuple(r) for r in ranking.search(i, "consensus distributed", k, model, strategy).collect()] == want
    many = spark.createDataFrame([(7, ["consensus", "distributed"]), (8, ["absent"])], "query_id long, terms array<string>")
    assert [tuple(r)[1:] for r in ranking.search_many(i, many, k, model).orderBy("rank").collect()] == want


def test_batches_in_parts_and_with_nothing_to_find(spark, monkeypatch):
    i = index(spark, {d: " ".join(["cat"] * (d % 4) + ["dog"] * (d % 3) + ["x"]) for d in range(60)})
    rows = [(q, ["cat", "dog"] if q % 2 else ["dog"]) for q in range(9)] + [(100, ["absent"]), (101, [])]
    queries = spark.createDataFrame(rows, "query_id long, terms array<string>")
    want = sorted(map(tuple, ranking.search_many(i, queries, 4).collect()))
    monkeypatch.setattr(ranking, "BATCH_WORDS", 3)
    monkeypatch.setattr(ranking, "BATCH_PARTS", 7)
    assert sorted(map(tuple, ranking.search_many(i, queries, 4).collect())) == want
    assert {r[0] for r in want} == set(range(9))
    assert ranking.search_many(i, queries.where("query_id > 99"), 4).count() == 0
    assert ranking.search_many(index(spark, []), queries, 4).count() == 0


def test_explicit_queries_rank_by_all_their_terms(spark):
    i = index(spark, MIXED)
    assert ranked(ranking.search(i, "NOT cat", 10)) == []
    assert set(ranked(ranking.search(i, "dog OR NOT cat", 10))) == {1, 3, 5}
    assert ranked(ranking.search(i, '"cat dog"', 10, strategy=Strategy.BOOLEAN)) == [1, 5]


def test_edges_of_search(spark):
    i = index(spark, MIXED)
    assert ranking.search(i, "((", 0).count() == 0
    assert ranking.search(i, "  ", 5).count() == 0
    assert ranking.search(i, "?!", 5).count() == 0
    assert ranking.search(index(spark, []), "cat", 5).count() == 0
    with pytest.raises(QueryError):
        ranking.search(i, "cat", 5, strategy=Strategy.BOOLEAN)
    with pytest.raises(QueryError):
        ranking.search(i, "(cat", 5)


def test_phrase_search(spark):
    i = index(spark, {1: "Tata cars", 2: "Tata makes cars", 3: "cars"})
    assert ranked(ranking.search_phrase(i, "tata CARS", 5)) == [1]
    assert sorted(ranked(ranking.search_phrase(i, "cars", 5))) == [1, 2, 3]
    assert ranked(ranking.search_phrase(i, "", 5)) == []


def test_explain(spark):
    i = index(spark, {1: "Tata makes electric cars", 2: "Electric vehicles"})
    row = ranking.explain(i, "Tata electric cars", 1).first()
    assert (row["mode"], row.query_terms, row.matched_count, row.matched_query, row.phrase_match) == ("LEXICAL", 3, 3, True, False)
    assert row.matched_terms == ["tata", "electric", "cars"] and row.frequencies == [1, 1, 1]
    assert row.lexical_score == row.final_score > 0
    row = ranking.explain(i, '"electric cars"', 1).first()
    assert (row["mode"], row.phrase_match, row.matched_query) == ("PHRASE", True, True)
    row = ranking.explain(i, "NOT electric", 2).first()
    assert (row["mode"], row.matched_query) == ("BOOLEAN", False)
    with pytest.raises(QueryError):
        ranking.explain(i, " ", 1)


def test_counters(spark):
    i = index(spark, MIXED)
    assert tuple(ranking.retrieval_stats(i, "cat dog absent").first()) == (5, 7, 3, 2, 0, 0)
    assert tuple(ranking.retrieval_stats(i, "cat AND dog").first()) == (2, 7, 2, 2, 2, 0)


def test_save_load_validate(spark, tmp_path):
    at = f"file://{tmp_path}/index"
    i = index(spark, MIXED, 2)
    first = i.save(at)
    loaded = Index.load(spark, at)
    assert loaded.block_size == 2
    for name in ("postings", "terms", "blocks", "doc_stats"):
        mine, theirs = getattr(i, name), getattr(loaded, name)
        assert sorted(map(str, mine.select(*sorted(mine.columns)).collect())) == sorted(map(str, theirs.select(*sorted(mine.columns)).collect()))
    assert [tuple(r) for r in ranking.search(i, "cat dog", 6).collect()] == [tuple(r) for r in ranking.search(loaded, "cat dog", 6).collect()]
    second = index(spark, TINY).save(at)
    assert first != second and Index.load(spark, at, validate=True).corpus.first().n == 4
    # a damaged table is refused
    version = f"{at}/{second}"
    spark.read.parquet(f"{version}/terms").selectExpr("term", "df + 1 AS df", "max_tf").coalesce(1).write.parquet(f"{version}/terms2")
    import shutil

    shutil.rmtree(f"{tmp_path}/index/{second}/terms")
    shutil.move(f"{tmp_path}/index/{second}/terms2", f"{tmp_path}/index/{second}/terms")
    assert Index.load(spark, at).saved
    with pytest.raises(InvalidIndex, match="term statistics"):
        Index.load(spark, at, validate=True)
    with pytest.raises(InvalidIndex, match="no readable index"):
        Index.load(spark, f"file://{tmp_path}/nothing")


def test_engine(spark, tmp_path):
    engine = SearchEngine(spark).add(docs(spark, {1: "cat dog"})).add(docs(spark, {2: "cat bird"}))
    assert ids(engine.matches("cat")) == [1, 2]
    assert engine.finalize() is engine.finalize()
    with pytest.raises(InvalidIndex):
        engine.add(docs(spark, {3: "x"}))
    at = f"file://{tmp_path}/e"
    engine.save(at)
    other = SearchEngine(spark).load(at)
    assert ids(other.matches("cat NOT bird")) == [1]
    with pytest.raises(InvalidIndex):
        other.load(at)
    with pytest.raises(InvalidIndex):
        SearchEngine(spark).add(docs(spark, [(1, "a"), (1, "b")])).finalize()
    check_unique(docs(spark, {1: "a"}))


def test_requests(spark):
    from tidemark.operators.vector import build_vectors

    store = spark.createDataFrame([(1, "One"), (3, "Three")], "_id long, headline string")
    vectors = build_vectors(spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<float>"), "id", "v")
    engine = SearchEngine(spark, vectors=vectors, documents=store).add(docs(spark, {1: "cat", 2: "cat dog"}))
    rows = engine.request("cat", 5, "HYBRID", [1.0, 0.1]).collect()
    assert [r.doc_id for r in rows] == [1, 2] and rows[0].document.headline == "One" and rows[1].document is None
    assert [r.doc_id for r in engine.request("dog", 5, "LEXICAL").collect()] == [2]
    assert [r.doc_id for r in engine.request("dog", 1, "SEMANTIC", [0.0, 1.0]).collect()] == [2]
    for bad in (dict(query=" "), dict(query="x", limit=0), dict(query="x", limit=101), dict(query="x", limit=True), dict(query="x", mode="ALL"), dict(query="x", mode="SEMANTIC")):
        with pytest.raises(RequestError):
            engine.request(**bad)


def generated(spark, n=400):
    return index(spark, {d: " ".join(["common"] * (1 + d % 3) + ["seldom"] * (d % 11 == 0) + ["rare"] * (d % 37 == 0) * (1 + d % 2) + ["filler"] * (d % 7)) for d in range(1, n)}, 16)


@pytest.mark.parametrize("model", list(Ranking))
@pytest.mark.parametrize("by_block", [False, True])
def test_pruning_reads_postings_and_blocks_and_changes_nothing(spark, tmp_path, model, by_block):
    generated(spark).save(f"file://{tmp_path}/g")
    i = Index.load(spark, f"file://{tmp_path}/g", validate=True)
    for k in (1, 3, 10):
        want = [tuple(r) for r in ranking.top(ranking.score(i, ["common", "seldom", "rare"], model), k).collect()]
        got = ranking.top(ranking.pruned(i, ["common", "seldom", "rare"], k, model, by_block, prune_from=0), k)
        assert [tuple(r) for r in got.collect()] == want


def test_queries_on_a_saved_index_read_the_postings_of_their_terms_only(spark, tmp_path):
    generated(spark).save(f"file://{tmp_path}/g")
    i = Index.load(spark, f"file://{tmp_path}/g")
    for df in (
        ranking.search(i, "seldom rare", 5),
        ranking.search(i, '"seldom rare" OR filler', 5),
        boolean.evaluate(i, parse("seldom AND rare")),
        boolean.evaluate(i, parse('"common rare"')),
        ranking.search_phrase(i, "common filler", 3),
    ):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "tokens" not in plan and plan.count("FileScan") == plan.count("In(term")


def test_an_own_model(spark):
    i = index(spark, MIXED).persist()
    coordination = ranking.Model(lambda idf, tf, dl, avgdl: tf * 0.0 + 1.0, lambda n, df: 1.0)
    found = {r.doc_id: r.score for r in ranking.score(i, ["cat", "dog"], coordination).collect()}
    assert found == {1: 2.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 2.0}
    many = spark.createDataFrame([(7, ["cat", "dog"])], "query_id long, terms array<string>")
    assert [(r.doc_id, r.score) for r in ranking.search_many(i, many, 2, coordination).orderBy("rank").collect()] == [(1, 2.0), (5, 2.0)]
    assert ranked(ranking.search(i, "cat dog", 2, coordination, Strategy.WAND)) == [1, 5]
    i.unpersist()


def test_batches_over_postings_and_over_tokens_agree(spark, monkeypatch):
    held, plain = generated(spark).persist(), generated(spark)
    rows = [(q, [["common", "rare"], ["seldom"], ["rare", "seldom", "filler"]][q % 3]) for q in range(7)]
    queries = spark.createDataFrame(rows, "query_id long, terms array<string>")
    want = sorted(map(tuple, ranking.search_many(plain, queries, 6).collect()))
    for cost in (0, 1e9):
        monkeypatch.setattr(ranking, "POSTING_COST", cost)
        assert sorted(map(tuple, ranking.search_many(held, queries, 6).collect())) == want
    monkeypatch.setattr(ranking, "POSTING_COST", 0)
    monkeypatch.setattr(ranking, "NAMED_TERMS", 1)
    assert sorted(map(tuple, ranking.search_many(held, queries, 6).collect())) == want
    held.unpersist()


def test_one_folding_for_documents_and_queries(spark, tmp_path):
    i = index(spark, {1: "ﬁne ＡＢＣ", 2: "café", 3: "café", 4: "towar­ds ½"})
    assert ranked(ranking.search(i, "fine", 5)) == ranked(ranking.search(i, "ﬁne", 5)) == [1]
    assert ranked(ranking.search(i, "CAFÉ", 5)) == [2, 3] and ranked(ranking.search(i, "towards", 5)) == [4]
    i.save(f"file://{tmp_path}/f")
    pointer = tmp_path / "f" / "CURRENT"
    pointer.write_text(pointer.read_text().replace("nfkc_casefold", "lower"))
    for crc in (tmp_path / "f").glob(".CURRENT*"):
        crc.unlink()
    with pytest.raises(InvalidIndex, match="folded"):
        Index.load(spark, f"file://{tmp_path}/f")


def test_not_is_refused_where_ids_are_hashed(spark):
    i = index(spark, {1: "cat", 1 << 62: "dog"})
    with pytest.raises(QueryError, match="number the documents"):
        boolean.evaluate(i, parse("NOT cat"))
    assert ids(boolean.evaluate(i, parse("dog AND NOT cat"))) == [1 << 62]


def test_old_versions_are_removed_on_request(spark, tmp_path):
    at = f"file://{tmp_path}/v"
    for n in range(3):
        index(spark, {1: f"word{n}"}).save(at, keep=2)
    assert len([p for p in (tmp_path / "v").iterdir() if p.is_dir()]) == 2
    assert ids(boolean.evaluate(Index.load(spark, at), parse("word2"))) == [1]


def test_a_batch_scores_repeated_queries_once_and_leaves_out_what_cannot_be_among_the_best(spark):
    words = ["the", *[f"w{i}" for i in range(30)]]
    i = index(spark, {d: " ".join(["the"] * (1 + d % 5) + [words[1 + (d * j) % 30] for j in (1, 7, 11) if d % j == 0] + ["lake"] * (d % 40 == 3) + ["pad"] * (d % 9)) for d in range(600)})
    rows = [["the", "lake"], ["lake", "the", "w3"], ["w7", "the"], ["the"], ["w1", "w2", "w3", "w4"], ["pad", "absent", "w5"], ["the", "pad"]]

    def part(idf, tf, dl, avgdl):
        return idf * (tf * 2.2) / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    queries = spark.createDataFrame([(q, rows[q % len(rows)]) for q in range(700)], "query_id long, terms array<string>")
    for k in (1, 5, 1000):
        found = ranking.search_many(i, queries, k, ranking.Model(part))
        got = {}
        for r in found.orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.doc_id, r.score, r["rank"]))
        for q, terms in enumerate(rows):
            want = [tuple(r) for r in ranking.search(i, " ".join(terms), k).orderBy("rank").collect()]
            assert all(got[at] == want for at in range(q, 700, len(rows)))
    assert "postings" not in i.held
    asked = [[0, 1]] * 3
    term, doc = np.repeat([0, 1], [1000, 20]), np.r_[np.arange(1000), np.arange(0, 1000, 50)]
    q, d, s = ranking._best_of(asked, term, doc, np.r_[np.full(1000, 0.1), np.arange(20) + 5.0], 1000, 3, np.zeros(3))
    assert d.tolist() == [850, 900, 950] * 3 and len(s) == 9  # not the 1,000 that match
    q, d, s = ranking._best_of(asked[:1], term, doc, np.r_[np.full(1000, 0.1), np.arange(20) + 5.0], 1000, 3, np.array([30.0]))
    assert not len(d)


def test_the_recorded_searches_need_no_inverted_index(spark, small, monkeypatch):
    monkeypatch.setattr(Index, "persist", lambda self: pytest.fail("the index is held"))
    monkeypatch.setattr(Index, "postings", property(lambda self: pytest.fail("the index is inverted")))
    monkeypatch.setattr(core_queries, "_held", {})
    assert core_queries.bm25_batch(spark, small).count() > 0
