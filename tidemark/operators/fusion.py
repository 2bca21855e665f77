"""Hybrid results: reciprocal rank fusion of two ranked lists, and hydration with stored documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

CONSTANT = 60.0
#: Each list goes this deep at least before fusion.
CANDIDATES = 100
LARGEST_ID = 2**53 - 1


def candidate_depth(limit: int) -> int:
    return max(limit, CANDIDATES)


def fuse(lexical: DataFrame, semantic: DataFrame, limit: int, constant: float = CONSTANT) -> DataFrame:
    """doc_id, score, lexical_score, semantic_score, lexical_rank, semantic_rank, rank of the best `limit`.

    The inputs have doc_id, score and rank (from 1). An id that is not a positive safe integer is left out, though it
    keeps its place. Ties go to the smaller id.
    """
    sound = f"doc_id > 0 and doc_id <= {LARGEST_ID}"
    a = lexical.where(sound).select("doc_id", F.col("score").cast("double").alias("lexical_score"), F.col("rank").cast("int").alias("lexical_rank"))
    b = semantic.where(sound).select("doc_id", F.col("score").cast("double").alias("semantic_score"), F.col("rank").cast("int").alias("semantic_rank"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    both = a.join(b, "doc_id", "full").withColumn("score", part("lexical_rank") + part("semantic_rank"))
    best = both.orderBy(F.round("score", 12).desc(), "doc_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.round("score", 12).desc(), "doc_id"))  # over `limit` rows
    return best.select("doc_id", F.round("score", 9).alias("score"), "lexical_score", "semantic_score", "lexical_rank", "semantic_rank", rank.alias("rank"))


def hydrate(hits: DataFrame, documents: DataFrame, key: str = "_id") -> DataFrame:
    """Hits with the stored document of the same id as `document`; null where there is none. Hits are few: they are
    materialised once and broadcast, and the documents stream past them. Clashing names are kept apart in the struct."""
    hits = cut(hits)
    fields = F.struct(*[F.col(c) for c in documents.columns])
    stored = documents.select(F.col(key).cast("bigint").alias("_key"), fields.alias("document"))
    found = stored.join(F.broadcast(hits.select(F.col("doc_id").alias("_key"))), "_key", "left_semi")
    return hits.join(found, hits["doc_id"] == found["_key"], "left").drop("_key")


def lookup(documents: DataFrame, ids: Sequence[int], key: str = "_id") -> DataFrame:
    """The documents of `ids` in that order, with their `ordinal` (from 0); unknown ids are left out."""
    schema = T.StructType([T.StructField("_key", T.LongType()), T.StructField("ordinal", T.IntegerType())])
    wanted = documents.sparkSession.createDataFrame([(int(i), n) for n, i in enumerate(ids)], schema)
    return documents.join(F.broadcast(wanted), documents[key] == wanted["_key"]).drop("_key").orderBy("ordinal")


def fusion_stats(lexical: DataFrame, semantic: DataFrame, constant: float = CONSTANT) -> DataFrame:
    """One row: algorithm, constant, lexical_candidates, semantic_candidates."""
    a, b = lexical.agg(F.count("*").alias("lexical_candidates")), semantic.agg(F.count("*").alias("semantic_candidates"))
    return a.crossJoin(b).select(F.lit("RRF").alias("algorithm"), F.lit(constant).alias("constant"), "lexical_candidates", "semantic_candidates")
