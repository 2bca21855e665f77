"""Exact vector search over 8-bit quantised unit vectors.

    vectors : doc_id BIGINT, qvec ARRAY<TINYINT>
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 127.0


class InvalidVector(ValueError):
    """A vector is empty, of another length, not finite or zero."""


def usable(vector: Column, width: int | None = None) -> Column:
    """Not empty, finite, not all zero, and of `width` components where given."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    length = F.size(v) == width if width is not None else F.size(v) > 0
    return F.coalesce(length & fine, F.lit(False))


def quantise(vector: Column) -> Column:
    """Components over the norm, times 127, rounded half away from zero; in single precision, as the norm's sum is in
    double. The sum runs over the components in order."""
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))).cast("float")
    scaled = F.transform(vector, lambda x: ((x.cast("float") / norm).cast("float") * F.lit(LEVELS).cast("float")).cast("float"))
    return F.transform(scaled, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), F.round(x))).cast("tinyint"))


def build_vectors(df: DataFrame, key: str, vector: str, width: int | None = None, strict: bool = False) -> DataFrame:
    """doc_id, qvec of the usable vectors; `strict` raises InvalidVector at the first unusable one instead."""
    fine = usable(F.col(vector), width)
    if strict and (bad := df.where(~fine).select(key).first()) is not None:
        raise InvalidVector(f"vector of {bad[0]} is empty, of another length, not finite or zero")
    return df.where(fine).select(F.col(key).cast("bigint").alias("doc_id"), quantise(F.col(vector)).alias("qvec"))


def dimensions(vectors: DataFrame) -> DataFrame:
    """One row: n, width (null for no vectors)."""
    return vectors.agg(F.count("*").alias("n"), F.max(F.size("qvec")).alias("width"))


def _checked(query: Sequence[float]) -> np.ndarray:
    q = np.asarray(query, dtype=np.float32)
    if not np.isfinite(q).all() or not np.any(q):
        raise InvalidVector("the query is not finite or zero")
    return q


def search(vectors: DataFrame, query: Sequence[float], k: int) -> DataFrame:
    """doc_id, score, rank of the k most similar; negative scores stay. An empty query, k = 0 and no vectors give
    nothing; a query of another length than the vectors raises when it runs."""
    if not len(query) or k <= 0:
        return vectors.where("false").select("doc_id", F.lit(0.0).cast("float").alias("score"), F.lit(0).alias("rank"))
    q = _checked(query)
    norm = float(np.float32(math.sqrt(float(np.sum(q.astype(np.float64) ** 2)))))
    literal = F.array(*[F.lit(float(x)) for x in q])
    dot = F.aggregate(F.zip_with(F.col("qvec"), literal, lambda d, x: d * x), F.lit(0.0), lambda s, x: s + x)
    fits = F.when(F.size("qvec") == len(q), dot).otherwise(F.raise_error(F.lit("query and vectors differ in length")).cast("double"))
    scored = vectors.select("doc_id", (fits / LEVELS / norm).alias("score"))
    order = [F.round("score", 9).desc(), F.col("doc_id")]
    best = scored.orderBy(*order).limit(k)
    return best.select("doc_id", F.round("score", 6).alias("score"), F.row_number().over(Window.orderBy(*order)).alias("rank"))  # k rows


#: Query components that are broadcast at once (8 bytes each).
BATCH = 8_000_000


def search_many(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, doc_id, score, rank for every usable query of `queries` (query_id, vector).

    Queries are taken in groups of a bounded size; each task multiplies its vectors with a group's matrix and keeps
    its own k best per query, so only tasks * queries * k rows are shuffled. Vectors of another length than a query
    are not compared with it.
    """
    rows = queries.where(usable(F.col("vector"))).select(F.col("query_id").cast("bigint").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    groups: list[tuple[list[int], list[list[float]]]] = []
    held = BATCH
    for r in rows.toLocalIterator():
        if held + len(r["vector"]) > BATCH:
            groups.append(([], []))
            held = 0
        groups[-1][0].append(r["query_id"])
        groups[-1][1].append(r["vector"])
        held += len(r["vector"])
    spark = vectors.sparkSession
    found = None
    for ids, of in groups:
        part = vectors.select("doc_id", "qvec").mapInArrow(_matcher(spark.sparkContext.broadcast((ids, of)), k), "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        return spark.createDataFrame([], "query_id long, doc_id long, score double, rank int")
    order = [F.round("score", 9).desc(), F.col("doc_id")]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= k)
    return ranked.select("query_id", "doc_id", F.round("score", 6).alias("score"), "rank")


def _matcher(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, of = shared.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(of):
            by_width.setdefault(len(v), []).append(i)
        matrices = {}
        for width, rows in by_width.items():
            q = np.array([of[i] for i in rows], dtype=np.float32).astype(np.float64)
            norms = np.sqrt((q**2).sum(axis=1)).astype(np.float32).astype(np.float64)
            matrices[width] = (rows, q / LEVELS / norms[:, None])
        for batch in batches:
            vecs = batch.column(1)
            sizes = vecs.value_lengths().to_numpy(zero_copy_only=False)
            flat, ends = vecs.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.cumsum(sizes)
            keys = batch.column(0).to_numpy()
            for width, (rows, q) in matrices.items():
                pick = np.flatnonzero(sizes == width)
                if not len(pick):
                    continue
                v = flat[(ends[pick] - width)[:, None] + np.arange(width)]
                for low in range(0, len(rows), 1024):
                    sims = np.round(q[low : low + 1024] @ v.T, 9)
                    for j, row in enumerate(sims):
                        names, scores = keys[pick], row
                        if rows[low + j] in best:
                            names, scores = np.concatenate([best[rows[low + j]][0], names]), np.concatenate([best[rows[low + j]][1], scores])
                        order = np.lexsort((names, -scores))[:k]
                        best[rows[low + j]] = (names[order], scores[order])
        for i, (names, scores) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([ids[i]] * len(names), pa.int64()), pa.array(names), pa.array(scores)], names=["query_id", "doc_id", "score"])

    return run
