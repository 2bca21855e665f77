"""The search engine: documents in, ranked and hydrated results out, as DataFrames."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import boolean, fusion, ranking, vector
from .operators.index import BLOCK_SIZE, Index, InvalidIndex, build_index, check_unique
from .operators.ranking import Model, Ranking, Strategy
from .plans.query import parse

MODES = ("HYBRID", "LEXICAL", "SEMANTIC")


class RequestError(ValueError):
    """A search request breaks the rules of the interface."""


@dataclass
class SearchEngine:
    """Add documents, finalize, search; or load a saved index. Searching before finalize is allowed."""

    spark: SparkSession
    block_size: int = BLOCK_SIZE
    vectors: DataFrame | None = None
    documents: DataFrame | None = None
    _added: list[DataFrame] = field(default_factory=list)
    _index: Index | None = None
    _final: bool = False

    def add(self, docs: DataFrame, key: str = "doc_id", text: str = "text") -> SearchEngine:
        if self._final:
            raise InvalidIndex("the index is final")
        self._added.append(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")))
        self._index = None
        return self

    @property
    def index(self) -> Index:
        if self._index is None:
            docs = self._added[0] if self._added else self.spark.createDataFrame([], "doc_id long, text string")
            for more in self._added[1:]:
                docs = docs.unionByName(more)
            self._index = build_index(docs, block_size=self.block_size)
        return self._index

    def finalize(self) -> SearchEngine:
        """Check the ids and keep the tokens; a second call changes nothing."""
        if not self._final:
            check_unique(self.index.tokens)
            self._index = self.index.persist()
            self._final = True
        return self

    def save(self, folder: str, keep: int | None = None) -> str:
        return self.index.save(folder, keep)

    def load(self, folder: str, validate: bool = False) -> SearchEngine:
        """Take over a saved index, whose tables are checked first (all invariants with `validate`); a failure leaves
        the engine as it was."""
        if self._final:
            raise InvalidIndex("the index is final")
        self._index = Index.load(self.spark, folder, validate)
        self._final = True
        return self

    def matches(self, query: str) -> DataFrame:
        """doc_id of a Boolean query; words without an operator between them are joined by AND."""
        return boolean.evaluate(self.index, parse(query))

    def search(self, query: str, k: int = 10, ranking_model: Ranking | Model = Ranking.BM25, strategy: Strategy = Strategy.TOP_K) -> DataFrame:
        return ranking.search(self.index, query, k, ranking_model, strategy)

    def search_phrase(self, text: str, k: int = 10) -> DataFrame:
        return ranking.search_phrase(self.index, text, k)

    def explain(self, query: str, doc_id: int, ranking_model: Ranking | Model = Ranking.BM25) -> DataFrame:
        return ranking.explain(self.index, query, doc_id, ranking_model)

    def stats(self, query: str) -> DataFrame:
        return ranking.retrieval_stats(self.index, query)

    def corpus(self) -> DataFrame:
        return self.index.corpus

    def request(self, query: str, limit: int = 10, mode: str = "HYBRID", embedding: Sequence[float] | None = None) -> DataFrame:
        """The public search: validated arguments, one of MODES, results hydrated with the stored documents.

        HYBRID and SEMANTIC need the query's embedding, which is an input here.
        """
        if not isinstance(query, str) or not query.strip():
            raise RequestError("query must be a non-empty string")
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 100:
            raise RequestError("limit must be a whole number from 1 to 100")
        if mode not in MODES:
            raise RequestError(f"mode must be one of {', '.join(MODES)}")
        if mode != "LEXICAL" and (embedding is None or self.vectors is None):
            raise RequestError(f"{mode} needs vectors and the query's embedding")
        depth = limit if mode != "HYBRID" else fusion.candidate_depth(limit)
        if mode == "LEXICAL":
            hits = self.search(query.strip(), depth)
        elif mode == "SEMANTIC":
            hits = vector.search(self.vectors, embedding, depth)
        else:
            hits = fusion.fuse(self.search(query.strip(), depth), vector.search(self.vectors, embedding, depth), limit)
        return (fusion.hydrate(hits, self.documents) if self.documents is not None else hits).orderBy("rank")
