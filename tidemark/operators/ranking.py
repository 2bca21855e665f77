"""Ranked retrieval: BM25, TF-IDF or a model of one's own over the postings of a query's terms.

A query's terms are few and known on the driver. One small job looks up their document frequencies; then their
postings, and no others, are read, gathered by document with counts combined before the shuffle, scored by one
expression, and the best k are kept by every task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from enum import Enum
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.query import Kind, Node, QueryError, free_terms, is_explicit, leaves, parse, phrase, scoring_terms
from ..functions.text import tokenise
from ..runtime import cut
from .boolean import condition, evaluate, has_phrase, tree_terms
from .index import Facts, Index, by_document

K1, B = 1.2, 0.75


class Ranking(Enum):
    BM25 = "BM25"
    TFIDF = "TFIDF"


class Strategy(Enum):
    """How the best k are found. All give the same result; WAND and BLOCK_MAX_WAND prune by upper bounds first."""

    TOP_K = "TOP_K"
    WAND = "WAND"
    BLOCK_MAX_WAND = "BLOCK_MAX_WAND"
    BOOLEAN = "BOOLEAN"


def prepared_idf(n: Column, df: Column) -> Column:
    """Always positive; 0 for a term in no document."""
    return F.when(df > 0, F.ln(1.0 + (n - df + 0.5) / (df + 0.5))).otherwise(0.0)


def plain_idf(n: Column, df: Column) -> Column:
    return F.when(df > 0, F.ln(n / df)).otherwise(0.0)


def bm25(idf: Column, tf: Column, dl: Column, avgdl: Column, k1: float = K1, b: float = B) -> Column:
    """A term's part of the score; 0 where the term or every document is empty."""
    below = tf + k1 * (1.0 - b + b * dl / avgdl)
    return F.when((tf > 0) & (avgdl > 0) & (below > 0), idf * (tf * (k1 + 1.0)) / below).otherwise(0.0)


def tfidf(idf: Column, tf: Column) -> Column:
    return F.when(tf > 0, tf * idf).otherwise(0.0)


def _idf(n: int, df: int) -> float:
    return math.log(1.0 + (n - df + 0.5) / (df + 0.5))


@dataclass(frozen=True)
class Model:
    """A ranking model: a document's score is the sum of `part(idf, tf, dl, avgdl)` over the query's terms.

    `part` is written with plain operators, so that it serves columns and numpy arrays alike, and must not be negative;
    `idf` takes numbers (n, df). `bound(idf, max_tf, avgdl)` is the most a term can add to any document; without it
    the pruning strategies read everything.
    """

    part: Callable[[Any, Any, Any, Any], Any]
    idf: Callable[[int, int], float] = _idf
    bound: Callable[[float, int, float], float] | None = None
    block_bound: Callable[[Column, Column, Column, float], Column] | None = None


def bm25_model(k1: float = K1, b: float = B) -> Model:
    def part(idf: Any, tf: Any, dl: Any, avgdl: Any) -> Any:
        return idf * (tf * (k1 + 1.0)) / (tf + k1 * (1.0 - b + b * dl / avgdl))

    return Model(part, bound=lambda idf, max_tf, avgdl: idf * (k1 + 1.0), block_bound=lambda idf, tf, dl, avgdl: bm25(idf, tf, dl, F.lit(avgdl), k1, b))


def tfidf_model(raw: bool = False) -> Model:
    return Model(
        lambda idf, tf, dl, avgdl: tf * idf,
        (lambda n, df: math.log(n / df)) if raw else _idf,
        lambda idf, max_tf, avgdl: max_tf * idf,
        lambda idf, tf, dl, avgdl: tfidf(idf, tf),
    )


def model_of(ranking: Ranking | Model, raw: bool = False, k1: float = K1, b: float = B) -> Model:
    if isinstance(ranking, Model):
        return ranking
    return bm25_model(k1, b) if ranking is Ranking.BM25 else tfidf_model(raw)


def _scored(rows: DataFrame, each: Sequence[str], terms: Sequence[str], model: Model, facts: Facts) -> DataFrame:
    """doc_id, score (above 0) of gathered rows of `each`; parts are added in the order of `terms`."""
    parts = []
    for t in terms:
        if t not in facts.df:
            continue
        tf = F.col(f"tf{each.index(t)}")
        part = model.part(F.lit(model.idf(facts.n, facts.df[t])), tf, F.col("dl"), F.lit(float(facts.avgdl)))
        parts.append(F.when(tf > 0, part).otherwise(0.0))
    return rows.select("doc_id", reduce(lambda x, y: x + y, parts, F.lit(0.0)).alias("score")).where("score > 0")


def _nothing(index: Index) -> DataFrame:
    return index.tokens.where("false").select("doc_id", F.lit(0.0).alias("score"))


def score(index: Index, terms: Sequence[str], ranking: Ranking | Model = Ranking.BM25, raw: bool = False, k1: float = K1, b: float = B, among: Node | None = None, facts: Facts | None = None) -> DataFrame:
    """doc_id, score of every document with a positive score.

    `raw` takes TF-IDF with the plain idf (BM25 has one idf). `terms` are used as given: repeated ones count
    repeatedly, so callers of the prepared form pass each term once. `among` limits the documents to those a tree
    matches, not the statistics. Parts are added in the order of the terms. No terms, no rows. `facts` are those of
    the terms, where the caller has looked them up.
    """
    if not terms:
        return _nothing(index)
    facts, each = facts or index.facts(terms), list(dict.fromkeys(terms))
    if not facts.df:
        return _nothing(index)
    model = model_of(ranking, raw, k1, b)
    if among is None:
        each = [t for t in each if t in facts.df]
        return _scored(index.gathered(each), each, terms, model, facts)
    more, placed = tree_terms(among)
    each = list(dict.fromkeys([*each, *more]))
    return _scored(index.gathered(each, placed).where(condition(among, each)), each, terms, model, facts)


def top(scored: DataFrame, k: int) -> DataFrame:
    """The k best by score (to 9 decimals, so that sums in another order tie alike), then doc_id, with their rank."""
    best = scored.orderBy(F.round("score", 9).desc(), "doc_id").limit(max(0, k))
    rank = F.row_number().over(Window.orderBy(F.round("score", 9).desc(), "doc_id"))  # over k rows
    return best.select("doc_id", F.round("score", 6).alias("score"), rank.alias("rank"))


def search(index: Index, query: str, k: int, ranking: Ranking | Model = Ranking.BM25, strategy: Strategy = Strategy.TOP_K) -> DataFrame:
    """doc_id, score, rank of the best k.

    Free text is disjunctive. A query with explicit syntax is parsed (QueryError where malformed), its matches are
    ranked by all its terms, those below NOT included, and the strategy does not matter. k = 0 gives nothing, before
    anything is parsed; blank free text gives nothing; free text with the BOOLEAN strategy is refused.
    """
    if k <= 0:
        return top(_nothing(index), 0)
    if is_explicit(query):
        return top(rank_candidates(index, parse(query), ranking), k)
    terms = free_terms(query)
    if not terms:
        return top(_nothing(index), 0)
    if strategy is Strategy.BOOLEAN:
        raise QueryError("BOOLEAN retrieval needs explicit query syntax")
    if strategy is Strategy.TOP_K:
        return top(score(index, terms, ranking), k)
    return top(pruned(index, terms, k, ranking, by_block=strategy is Strategy.BLOCK_MAX_WAND), k)


def rank_candidates(index: Index, node: Node, ranking: Ranking | Model = Ranking.BM25) -> DataFrame:
    return score(index, scoring_terms(node), ranking, among=node)


def search_phrase(index: Index, text: str, k: int) -> DataFrame:
    """Documents with the words of `text` one after the other, ranked by BM25."""
    return top(score(index, list(dict.fromkeys(tokenise(text))), among=phrase(text)), k)


def term_bounds(index: Index, ranking: Ranking = Ranking.BM25, raw: bool = False, k1: float = K1) -> DataFrame:
    """term, df, max_tf, max_score: the most a term can add to any document's score."""
    rows = index.terms.withColumn("n", F.lit(index.whole.n))
    if ranking is Ranking.BM25:
        most = prepared_idf(F.col("n"), F.col("df")) * (k1 + 1.0)
    else:
        most = F.col("max_tf") * (plain_idf if raw else prepared_idf)(F.col("n"), F.col("df"))
    return rows.select("term", "df", "max_tf", most.alias("max_score"))


def block_bounds(index: Index, ranking: Ranking = Ranking.BM25, k1: float = K1, b: float = B) -> DataFrame:
    """The blocks with max_score: no posting of a block adds more than that."""
    rows = index.blocks.join(index.terms.select("term", "df"), "term").withColumns({"n": F.lit(index.whole.n), "avgdl": F.lit(float(index.whole.avgdl))})
    idf = prepared_idf(F.col("n"), F.col("df"))
    most = bm25(idf, F.col("max_tf"), F.col("min_dl"), F.col("avgdl"), k1, b) if ranking is Ranking.BM25 else tfidf(idf, F.col("max_tf"))
    return rows.select("term", "block_id", "begin", "end", "first_doc", "last_doc", "max_tf", "min_dl", most.alias("max_score"))


#: Postings of a query from which pruning is worth its extra jobs; below, all of them are scored at once.
PRUNE_FROM = 5_000_000
#: Ranges of documents for block bounds; what is broadcast is at most so many numbers.
RANGES = 65_536


def pruned(index: Index, terms: Sequence[str], k: int, ranking: Ranking | Model = Ranking.BM25, by_block: bool = False, prune_from: int = PRUNE_FROM) -> DataFrame:
    """`score` without the documents that cannot be among the best k.

    The k-th best part of the rarest term that k documents hold is a threshold: the k-th best score is no lower. Terms
    whose bounds add up to less than it are optional: a document that holds no other term can't reach it, so their
    postings are read only for documents of the other terms. `by_block` first drops the ranges of documents in which
    the bounds of the blocks of all terms add up to less. The result is that of `score`; with fewer postings than
    `prune_from` it is `score`, as reading them costs less than finding out which to leave.
    """
    facts, model = index.facts(terms), model_of(ranking)
    present = [t for t in dict.fromkeys(terms) if t in facts.df]
    full = [t for t in present if facts.df[t] >= k]
    if not full or model.bound is None or not index.inverted or sum(facts.df[t] for t in present) < prune_from:
        return score(index, terms, ranking, facts=facts)
    idf = {t: model.idf(facts.n, facts.df[t]) for t in present}
    rarest = min(full, key=lambda t: (facts.df[t], t))
    parts = _scored(index.gathered([rarest]), [rarest], [rarest], model, facts)
    theta = parts.orderBy(F.desc("score")).limit(k).agg(F.min("score")).first()[0] * (1.0 - 1e-9)
    bound = {t: model.bound(idf[t], facts.max_tf[t], facts.avgdl) for t in present}
    optional, total = [], 0.0
    for t in sorted(present, key=lambda t: bound[t]):
        total += bound[t]
        if total >= theta:
            break
        optional.append(t)
    rows = index.postings.where(F.col("term").isin(present)).select("term", "doc_id", "tf", "dl")
    if by_block and model.block_bound is not None:
        rows = _in_ranges(index, rows, present, model, facts, idf, theta)
    if optional:
        needed = rows.where(~F.col("term").isin(optional))
        rows = needed.unionByName(rows.where(F.col("term").isin(optional)).join(needed.select("doc_id").distinct(), "doc_id", "left_semi"))
    return _scored(by_document(rows, present), present, terms, model, facts)


def _in_ranges(index: Index, rows: DataFrame, terms: list[str], model: Model, facts: Facts, idf: dict[str, float], theta: float) -> DataFrame:
    """`rows` without the ranges of documents whose block bounds add up to less than `theta`.

    The blocks of a term don't overlap, so they meet at most RANGES ranges more than there are blocks.
    """
    width = max(index.block_size, -(-(facts.max_doc_id + 1) // RANGES))
    known = F.create_map(*[F.lit(x) for t in terms for x in (t, idf[t])])
    blocks = index.blocks.where(F.col("term").isin(terms))
    most = model.block_bound(known[F.col("term")], F.col("max_tf"), F.col("min_dl"), float(facts.avgdl))
    reach = F.sequence(F.floor(F.col("first_doc") / width), F.floor(F.col("last_doc") / width))
    each = blocks.select("term", F.explode(reach).alias("span"), most.alias("most")).groupBy("span", "term").agg(F.max("most").alias("most"))
    kept = each.groupBy("span").agg(F.sum("most").alias("all")).where(F.col("all") * (1.0 + 1e-9) >= theta).select("span")
    return rows.withColumn("span", F.floor(F.col("doc_id") / width)).join(F.broadcast(kept), "span", "left_semi").drop("span")


#: Words of a batch that are broadcast at once, and postings that a task scores at once.
BATCH_WORDS, BATCH_PARTS = 500_000, 4_000_000


def search_many(index: Index, queries: DataFrame, k: int, ranking: Ranking | Model = Ranking.BM25, k1: float = K1, b: float = B) -> DataFrame:
    """query_id, doc_id, score, rank for a batch of `queries` (query_id, terms ARRAY<STRING>, each term once).

    Queries of the same terms are scored once. A document's words of the batch are in one row, so each task scores its
    documents for all queries by itself and keeps its own best k of each: only tasks * queries * k rows meet, however
    many documents a query matches. Where the batch's terms make up a small part of an inverted index, their postings
    are gathered by document; else one pass over the tokens is cheaper. An index that isn't inverted is not inverted
    for a batch: that pass keeps the batch's words of each document in the shared folder, and what scoring needs to
    know is counted from them. Batches beyond BATCH_WORDS words are worked in groups of queries.
    """
    spark, model, found = index.spark, model_of(ranking, k1=k1, b=b), None
    alike = queries.groupBy("terms").agg(F.min("query_id").cast("bigint").alias("lead"))
    words = alike.select("lead", F.posexplode("terms").alias("pos", "term"))
    if index.inverted:
        words = words.join(index.terms.select("term", "df"), "term")
    first = words.limit(BATCH_WORDS + 1).toPandas() if k > 0 else None
    groups: list = [first] if k > 0 else []
    if k > 0 and len(first) > BATCH_WORDS:
        words = cut(words)
        n = -(-words.count() // BATCH_WORDS)
        groups = [words.where(F.pmod(F.xxhash64("lead"), F.lit(n)) == g) for g in range(n)]
    for group in groups:
        prepared = group if isinstance(group, type(first)) else group.toPandas()
        if prepared.empty:
            continue
        terms, term_at = np.unique(prepared["term"].to_numpy(dtype=object), return_inverse=True)
        known = spark.sparkContext.broadcast(terms.tolist())
        if index.inverted:
            whole, dfs = index.whole, np.zeros(len(terms), np.int64)
            dfs[term_at] = prepared["df"]
            if dfs.sum() * POSTING_COST < whole.n * whole.avgdl:
                rows = _batch_postings(index, terms.tolist())
            else:
                rows = _batch_tokens(index)
            coded = rows.mapInArrow(_coder(known), CODED)
        else:
            coded = cut(_batch_tokens(index).mapInArrow(_coder(known), CODED))
            whole, dfs = _batch_facts(coded, len(terms))
            coded = coded.coalesce(max(spark.sparkContext.defaultParallelism, -(-int(dfs.sum()) // BATCH_PARTS)))
        order = np.lexsort((prepared["pos"].to_numpy(np.int64), leads := prepared["lead"].to_numpy(np.int64)))
        ids, starts = np.unique(leads[order], return_index=True)
        idf = np.array([model.idf(whole.n, df) if df else 0.0 for df in dfs.tolist()])
        plan = spark.sparkContext.broadcast((ids, np.r_[starts, len(order)], term_at[order].astype(np.int32), idf))
        part = coded.mapInArrow(_scorer(plan, k, model, whole.avgdl), "lead long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    best = Window.partitionBy("lead").orderBy(F.round("score", 9).desc(), "doc_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    asked = queries.select(F.col("query_id").cast("bigint").alias("query_id"), "terms").join(alike, "terms").select("query_id", "lead")
    return asked.join(ranked, "lead").select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


#: How much dearer a posting is to gather than a token is to pass over.
POSTING_COST = 3
#: Terms that are named in the scan's filter; more are joined.
NAMED_TERMS = 1000


def _batch_postings(index: Index, terms: list[str]) -> DataFrame:
    """doc_id, dl, words, tfs: the documents with any of `terms`, with the words they hold."""
    rows = index.postings.select("term", "doc_id", "tf", "dl")
    if len(terms) <= NAMED_TERMS:
        rows = rows.where(F.col("term").isin(terms))
    else:
        rows = rows.join(index.spark.createDataFrame([(t,) for t in terms], "term string"), "term", "left_semi")
    return rows.groupBy("doc_id").agg(F.max("dl").alias("dl"), F.collect_list(F.struct("term", "tf")).alias("w")).select("doc_id", "dl", F.col("w.term").alias("words"), F.col("w.tf").alias("tfs"))


def _batch_tokens(index: Index) -> DataFrame:
    """doc_id, dl, words, tfs: every document with its words as they stand, to be counted."""
    return index.tokens.select("doc_id", "dl", F.col("tokens").alias("words"), F.lit(None).cast("array<int>").alias("tfs"))


CODED = "doc_id long, dl int, at array<int>, tfs array<int>"


def _coder(known) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """doc_id, dl, at, tfs of rows (doc_id, dl, words, tfs): places of a document's words in `known`, others left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(known.value, pa.string())
        for batch in batches:
            lists = batch.column(2)
            at = pc.index_in(pc.list_flatten(lists), value_set=wanted)
            hit = np.flatnonzero(pc.is_valid(at).to_numpy(zero_copy_only=False))
            doc = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)[hit].astype(np.int64)
            pair = doc * len(wanted) + pc.fill_null(at, 0).to_numpy(zero_copy_only=False)[hit]
            if batch.column(3).null_count:
                pair, tf = np.unique(pair, return_counts=True)
            else:
                turn = np.argsort(pair, kind="stable")
                pair, tf = pair[turn], pc.list_flatten(batch.column(3)).to_numpy(zero_copy_only=False)[hit][turn]
            ends = pa.array(np.searchsorted(pair, np.arange(batch.num_rows + 1) * len(wanted)).astype(np.int32))
            at, tfs = (pa.ListArray.from_arrays(ends, pa.array(x.astype(np.int32))) for x in (pair % len(wanted), tf))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), at, tfs], names=["doc_id", "dl", "at", "tfs"])

    return run


def _batch_facts(coded: DataFrame, n_terms: int) -> tuple[Facts, np.ndarray]:
    """Facts of all documents and the document frequency of each of a batch's terms (at most BATCH_WORDS)."""
    whole, dfs = Index(coded).whole, np.zeros(n_terms, np.int64)
    counts = coded.select(F.explode("at").alias("at")).groupBy("at").agg(F.count("*").alias("df")).toPandas()
    dfs[counts["at"].to_numpy(np.int64)] = counts["df"]
    return whole, dfs


#: Sums of the same parts in another order differ by less; scores are ordered after rounding to 9 decimals.
SLACK = 3e-9


def _slack(score: float) -> float:
    """The least a sum may be for its score to come up to `score` after rounding."""
    return score - SLACK - 1e-12 * score


def _scorer(plan, k: int, model: Model, avgdl: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """lead, doc_id, score: the best k of a task's documents (CODED rows) for each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, starts, terms, idf = plan.value
        asked = [terms[a:b].tolist() for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, document, score
        theta = np.zeros(len(ids))  # the k-th best score so far
        held: list[tuple[np.ndarray, ...]] = []

        def settle() -> None:
            nonlocal best
            keys, sizes, dl, at, tf = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            doc = np.repeat(np.arange(len(keys), dtype=np.int32), sizes)
            part = model.part(idf[at], tf.astype(np.float64), dl[doc].astype(np.float64), avgdl)
            found = _best_of(asked, at, doc, part, len(keys), k, theta)
            q, d, s = (np.concatenate([x, y]) for x, y in zip(best, (found[0], keys[found[1]], found[2]), strict=True))
            by = np.lexsort((d, -np.round(s, 9), q))
            q, d, s = q[by], d[by], s[by]
            first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, np.int64)
            place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
            best = q[place < k], d[place < k], s[place < k]
            theta[q[place == k - 1]] = s[place == k - 1]

        n = 0
        for batch in batches:
            at, tfs = (pc.list_flatten(batch.column(c)).to_numpy(zero_copy_only=False) for c in (2, 3))
            if not len(at):
                continue
            held.append((batch.column(0).to_numpy(), pc.list_value_length(batch.column(2)).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(), at, tfs))
            n += len(at)
            if n >= BATCH_PARTS:
                settle()
                n = 0
        if held:
            settle()
        for at in range(0, len(best[0]), 65_536):
            q, d, s = (x[at : at + 65_536] for x in best)
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(d), pa.array(s)], names=["lead", "doc_id", "score"])

    return run


def _best_of(asked: list[list[int]], term: np.ndarray, doc: np.ndarray, part: np.ndarray, n_docs: int, k: int, theta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query, document, score: what may be among the best k of each query (the terms of each in `asked`), exactly.

    `doc` rises and `part` is what a posting adds to a score; `theta` are scores that a document must reach. The k-th
    best part of a term is such a score, too. Terms whose greatest parts add up to less than it are optional: documents
    are taken from the postings of the others, and looked up in those of the optional ones while they can still reach
    it. Scores of what is left are added up in the order of the query's terms.
    """
    turn = np.argsort(term, kind="stable")
    term, doc, part = term[turn], doc[turn], part[turn]
    used, first = np.unique(term, return_index=True)
    docs: dict[int, np.ndarray] = {}
    parts: dict[int, np.ndarray] = {}
    most: dict[int, float] = {}
    kth: dict[int, float] = {}
    for t, a, b in zip(used.tolist(), first.tolist(), [*first[1:].tolist(), len(term)], strict=True):
        docs[t], parts[t] = doc[a:b], (p := part[a:b])
        most[t] = float(p.max())
        kth[t] = float(np.partition(p, len(p) - k)[len(p) - k]) if len(p) >= k else 0.0

    def found_in(t: int, rows: np.ndarray) -> np.ndarray:
        spot = np.minimum(docs[t].searchsorted(rows), len(docs[t]) - 1)
        return np.where(docs[t][spot] == rows, parts[t][spot], 0.0)

    sums = np.zeros(n_docs)
    out: list[tuple[int, np.ndarray, np.ndarray]] = []
    for q, terms in enumerate(asked):
        present = [t for t in terms if t in most]
        if not present:
            continue
        by = sorted(present, key=most.__getitem__)
        bar = _slack(max(float(theta[q]), *(kth[t] for t in present)))
        rest, optional = 0.0, 0
        while optional < len(by) and rest + most[by[optional]] < bar:
            rest += most[by[optional]]
            optional += 1
        needed = by[optional:]
        if not needed:
            continue
        if len(needed) == 1:
            rows, scores = docs[needed[0]], parts[needed[0]]
        else:
            for t in needed:
                sums[docs[t]] += parts[t]
            if sum(len(docs[t]) for t in needed) > n_docs // 16:
                rows = np.flatnonzero(sums)
            else:
                rows = np.unique(np.concatenate([docs[t] for t in needed]))
            scores = sums[rows]
            sums[rows] = 0.0
        for t in [*by[:optional][::-1], -1]:
            if len(rows) > k:
                bar = max(bar, _slack(float(np.partition(scores, len(rows) - k)[len(rows) - k])))
            kept = np.flatnonzero(scores + rest >= bar)
            if len(kept) < len(rows):
                rows, scores = rows[kept], scores[kept]
            if t >= 0 and len(rows):
                scores = scores + found_in(t, rows)
                rest = max(0.0, rest - most[t]) + 1e-12 * rest
        if len(present) > 1 and len(rows):
            scores = np.zeros(len(rows))
            for t in present:
                scores += found_in(t, rows)
        above = scores > 0
        out.append((q, rows[above], scores[above]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return np.repeat([q for q, _, _ in out], [len(r) for _, r, _ in out]).astype(np.int64), np.concatenate([r for _, r, _ in out]).astype(np.int64), np.concatenate([s for _, _, s in out])


def explain(index: Index, query: str, doc_id: int, ranking: Ranking | Model = Ranking.BM25) -> DataFrame:
    """One row: how `doc_id` scores for `query`, which is always parsed, free text too.

    matched_terms, frequencies and idfs are in query order; phrase_match is set by any phrase of the query that the
    document holds; matched_query by membership (explicit) or by all terms matching (free text).
    """
    node = parse(query)
    terms = scoring_terms(node)
    more, placed = tree_terms(node)
    each = list(dict.fromkeys([*terms, *more]))
    n_terms, facts, model = len(terms), index.facts(each), model_of(ranking)
    doc = index.doc_stats_of(doc_id)  # one row
    if each:
        rows = index.gathered(each, placed, among=F.col("doc_id") == doc_id).drop("dl")
        doc = doc.join(rows, "doc_id", "left").fillna(0, [f"tf{i}" for i in range(len(each))])
    entries = []
    for t in terms:
        tf, idf = F.col(f"tf{each.index(t)}"), F.lit(model.idf(facts.n, facts.df[t]) if t in facts.df else 0.0)
        part = F.when(tf > 0, model.part(idf, tf, F.col("dl"), F.lit(float(facts.avgdl)))).otherwise(0.0)
        entries.append(F.struct(F.lit(t).alias("term"), tf.alias("tf"), idf.alias("idf"), part.alias("part")))
    empty = F.array().cast("array<struct<term:string,tf:int,idf:double,part:double>>")
    matched = F.filter(F.array(*entries), lambda e: e["tf"] > 0) if entries else empty
    phrases = [has_phrase(tokenise(leaf.text), each) for leaf in leaves(node) if leaf.kind is Kind.PHRASE]
    phrased = reduce(lambda x, y: x | y, phrases) if phrases else F.lit(False)
    explicit = is_explicit(query)
    row = doc.select("doc_id", matched.alias("m"), phrased.alias("phrase_match"), (condition(node, each) if explicit else F.size(matched) == n_terms).alias("matched_query"))
    mode = F.when(F.col("phrase_match"), "PHRASE").otherwise("BOOLEAN" if explicit else "LEXICAL")
    total = F.round(F.aggregate("m", F.lit(0.0), lambda s, e: s + e["part"]), 6)
    return row.select(
        "doc_id",
        mode.alias("mode"),
        total.alias("lexical_score"),
        total.alias("final_score"),
        F.lit(n_terms).alias("query_terms"),
        F.size("m").alias("matched_count"),
        "phrase_match",
        "matched_query",
        F.transform("m", lambda e: e["term"]).alias("matched_terms"),
        F.transform("m", lambda e: e["tf"]).alias("frequencies"),
        F.transform("m", lambda e: F.round(e["idf"], 6)).alias("idfs"),
    )


def retrieval_stats(index: Index, query: str) -> DataFrame:
    """One row of counters of an exhaustive search: documents_scored, postings_visited, query_terms, matched_terms,
    candidates_considered (explicit queries only) and blocks_skipped (always 0)."""
    explicit = is_explicit(query)
    node = parse(query) if explicit else None
    terms = scoring_terms(node) if node else free_terms(query)
    facts = index.facts(terms)
    among = score(index, terms, among=node) if node else score(index, terms)
    candidates = evaluate(index, node).agg(F.count("*").alias("candidates_considered")) if node else None
    rows = among.agg(F.count("*").alias("documents_scored")).select(
        "documents_scored",
        F.lit(sum(facts.df.values())).cast("bigint").alias("postings_visited"),
        F.lit(len(terms)).cast("bigint").alias("query_terms"),
        F.lit(len(facts.df)).cast("bigint").alias("matched_terms"),
    )
    rows = rows.crossJoin(candidates) if candidates is not None else rows.withColumn("candidates_considered", F.lit(0).cast("bigint"))  # one row by one row
    return rows.withColumn("blocks_skipped", F.lit(0).cast("bigint"))
