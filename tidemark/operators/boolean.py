"""Boolean and phrase retrieval: a query tree compiled to one condition on the gathered postings of its terms.

`Index.gathered` gives a row per document that holds any term of the tree, with the terms' frequencies and, for
phrases, their positions; the tree is a condition on that row. Documents that hold none of the terms all fare alike,
so they are never read: where NOT lets them match, the result is the universe without the rows that fail. The set
operators at the end do the same on sets of documents, for callers that hold such sets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import normal_term, tokenise
from ..plans.query import Kind, Node, QueryError, leaves
from .index import Index

#: NOT lists the ids from 1 to the largest, also those without a document; it is refused where the largest id exceeds
#: this many times the number of documents (and a million), as with hashed ids.
SPARSE = 1000


def tree_terms(node: Node) -> tuple[list[str], list[str]]:
    """The terms of all leaves, each once, and those of them that stand in phrases of several words."""
    every: dict[str, None] = {}
    placed: dict[str, None] = {}
    for leaf in leaves(node):
        words = tokenise(leaf.text) if leaf.kind is Kind.PHRASE else [t] if (t := normal_term(leaf.text)) is not None else []
        every.update(dict.fromkeys(words))
        if len(words) > 1:
            placed.update(dict.fromkeys(words))
    return list(every), list(placed)


def has_phrase(words: list[str], terms: list[str]) -> Column:
    """The words stand one after the other in a gathered row of `terms`; one word is a presence test, none is never true."""
    if not words:
        return F.lit(False)
    at = [terms.index(w) for w in words]
    present = reduce(lambda x, y: x & y, [F.col(f"tf{i}") > 0 for i in dict.fromkeys(at)])
    if len(words) == 1:
        return present

    def starts(i: int, offset: int) -> Column:
        return F.transform(f"p{i}", lambda p: p - offset)

    met = reduce(F.array_intersect, [starts(i, offset) for offset, i in enumerate(at)])
    return present & F.coalesce(F.size(met) > 0, F.lit(False))


def condition(node: Node, terms: list[str]) -> Column:
    """The tree as a condition on a gathered row of `terms`.

    A word that is not exactly one term matches nothing. NOT ranges over the ids 1, 2, ... only.
    """
    if node.kind is Kind.TERM:
        t = normal_term(node.text)
        return F.col(f"tf{terms.index(t)}") > 0 if t is not None else F.lit(False)
    if node.kind is Kind.PHRASE:
        return has_phrase(tokenise(node.text), terms)
    parts = [condition(p, terms) for p in node.parts]
    if node.kind is Kind.AND:
        return parts[0] & parts[1]
    if node.kind is Kind.OR:
        return parts[0] | parts[1]
    return (F.col("doc_id") >= 1) & ~parts[0]


def holds_for_nothing(node: Node) -> bool:
    """Whether an id (above 0) without any term of the tree is in the result."""
    if node.kind in (Kind.TERM, Kind.PHRASE):
        return False
    parts = [holds_for_nothing(p) for p in node.parts]
    return all(parts) if node.kind is Kind.AND else any(parts) if node.kind is Kind.OR else not parts[0]


def universe(index: Index) -> DataFrame:
    """The ids 1 to the largest; QueryError where they are too sparse to list."""
    whole = index.whole
    if whole.max_doc_id > max(SPARSE * whole.n, 1_000_000):
        raise QueryError(f"NOT would list {whole.max_doc_id} ids for {whole.n} documents; number the documents first")
    return index.spark.range(1, whole.max_doc_id + 1).withColumnRenamed("id", "doc_id")


def evaluate(index: Index, node: Node) -> DataFrame:
    """doc_id of the documents a tree matches; NOT takes the ids 1 to the largest, also where no document has one."""
    terms, placed = tree_terms(node)
    everywhere = holds_for_nothing(node)
    if not terms:
        return universe(index) if everywhere else index.tokens.where("false").select("doc_id")
    rows = index.gathered(terms, placed)
    test = condition(node, terms)
    if not everywhere:
        return rows.where(test).select("doc_id")
    # a row of id 0 matches by its terms alone, a row above it fails by them
    split = rows.select("doc_id", test.alias("holds"))
    failing = split.where("doc_id >= 1 and not holds").select("doc_id")
    return universe(index).join(failing, "doc_id", "left_anti").unionByName(split.where("doc_id < 1 and holds").select("doc_id"))


def phrase_documents(index: Index, terms: list[str]) -> DataFrame:
    """Documents with the terms (as they are) one after the other."""
    each = list(dict.fromkeys(terms))
    if not each:
        return index.tokens.where("false").select("doc_id")
    return index.gathered(each, each if len(terms) > 1 else ()).where(has_phrase(terms, each)).select("doc_id")


def term_documents(index: Index, term: str) -> DataFrame:
    """Documents with exactly this term (not normalised)."""
    if index.inverted:
        return index.postings.where(F.col("term") == term).select("doc_id")
    return index.tokens.where(F.array_contains("tokens", term)).select("doc_id")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").intersect(b.select("doc_id"))


def unite(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("doc_id").union(b.select("doc_id")).distinct()


def complement(index: Index, a: DataFrame) -> DataFrame:
    """The ids 1 to the largest that are not in `a`."""
    return universe(index).join(a.select("doc_id"), "doc_id", "left_anti")


def evaluate_by_sets(index: Index, node: Node) -> DataFrame:
    """`evaluate` by set operators, leaf by leaf: the plain form the compiled one is tested against."""
    if node.kind is Kind.TERM:
        t = normal_term(node.text)
        return term_documents(index, t) if t is not None else index.tokens.where("false").select("doc_id")
    if node.kind is Kind.PHRASE:
        return phrase_documents(index, tokenise(node.text))
    parts = [evaluate_by_sets(index, p) for p in node.parts]
    if node.kind is Kind.AND:
        return intersect(*parts)
    return unite(*parts) if node.kind is Kind.OR else complement(index, parts[0])


def and_query(index: Index, a: str, b: str) -> DataFrame:
    """Documents with both terms (terms as they are, not normalised)."""
    return intersect(term_documents(index, a), term_documents(index, b))


def or_query(index: Index, a: str, b: str) -> DataFrame:
    return unite(term_documents(index, a), term_documents(index, b))


def not_query(index: Index, a: str) -> DataFrame:
    return complement(index, term_documents(index, a))


def matches_phrase(index: Index, doc_id: int, terms: list[str]) -> bool:
    return phrase_documents(index, terms).where(F.col("doc_id") == doc_id).limit(1).count() > 0
