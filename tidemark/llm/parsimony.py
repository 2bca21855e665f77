"""How distinctive a term is per record: parsimonious language models.

A record's text is explained as a mixture of the background (all records) and the record's own model. Expectation-
maximisation moves the mass of terms that the background explains well out of the record's model:

    e(t) = tf(t) * l * p(t) / (l * p(t) + (1 - l) * bg(t)),    p(t) = e(t) / sum of e

starting from p(t) = tf(t) / length. The converged p(t) ranks the record's terms: common terms end near 0.

Background counts are exact. The most frequent terms, at most HEAD of them, are broadcast; records that hold other
terms get those counts by a join on the term, so nothing broadcast grows with the collection.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut
from .termfreq import RECORDS, TERM, distinct_records, partial_counts

#: Terms whose background counts are broadcast: about 8 MB, whatever the collection.
HEAD = 100_000
#: Weight of the record's own model, and when to stop.
MIX, ROUNDS, EPS = 0.1, 50, 1e-6
#: Share of records that have stopped from which they are left out of further rounds.
SETTLED = 0.3

TERMS = "key long, term string, tf int, df long, p double, weight double"


def fit(tf: np.ndarray, bg: np.ndarray, starts: np.ndarray, mix: float = MIX, rounds: int = ROUNDS, eps: float = EPS) -> np.ndarray:
    """Converged p of every term; `starts` are the offsets of the records in the flat arrays (none empty).

    Each record stops by itself, once its own largest move is below `eps`, so its model doesn't depend on which records
    are worked together.
    """
    lengths = np.diff(np.append(starts, len(tf)))
    p = tf / np.repeat(np.add.reduceat(tf, starts), lengths)
    out = np.empty_like(p)
    at, ratio = np.arange(len(tf)), (1.0 - mix) / mix * bg
    done = np.zeros(len(starts), dtype=bool)
    for _ in range(rounds):
        e = tf * p / (p + ratio)
        new = e / np.repeat(np.maximum(np.add.reduceat(e, starts), 1e-300), lengths)
        settled = (np.maximum.reduceat(np.abs(new - p), starts) < eps) & ~done
        p = new
        if not settled.any():
            continue
        mine = np.repeat(settled, lengths)
        out[at[mine]] = p[mine]
        done |= settled
        if done.mean() > SETTLED:  # the rest goes on without those that are done
            still = np.repeat(~done, lengths)
            at, tf, ratio, p, lengths = at[still], tf[still], ratio[still], p[still], lengths[~done]
            if not len(at):
                return out
            starts, done = np.cumsum(lengths) - lengths, np.zeros(len(lengths), dtype=bool)
    mine = np.repeat(~done, lengths)
    out[at[mine]] = p[mine]
    return out


def background(records: DataFrame, texts: list[str]) -> DataFrame:
    """term, n (occurrences), n_records over all records; one row under RECORDS holds their number."""
    return cut(partial_counts(records, texts, [], joint=True).groupBy("field_name", "term").agg(F.sum("n").alias("n"), F.sum("n_records").alias("n_records")))


def distinctive_terms(df: DataFrame, key: str, texts: list[str], head: int = HEAD, best_only: float | None = None) -> DataFrame:
    """key, term, tf, df, p (converged record model), weight = tf * ln(N / df), 0 where df is 1.

    One row per record and term over all `texts` together. With `best_only` = m, just each record's term whose weight
    is above 0 and above m times that of every other term of the record, where there is one. Null and empty texts hold
    no term; a record without terms gives no row; records delivered again count once. `key` must be BIGINT.
    """
    spark = df.sparkSession
    given = df.select(F.col(key).cast("long").alias("key"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(texts)])
    texts = [f"t{i}" for i in range(len(texts))]
    records = cut(distinct_records(given, "key", texts))
    counts = background(records, texts)
    sums = counts.groupBy((F.col("field_name") == RECORDS).alias("all")).agg(F.sum("n").alias("n"), F.count("*").alias("terms")).collect()  # two rows
    n_records = next((r["n"] for r in sums if r["all"]), 0)
    n_tokens, n_terms = next(((r["n"], r["terms"]) for r in sums if not r["all"]), (0, 0))
    vocabulary = counts.where(F.col("field_name") != RECORDS).select("term", "n", "n_records")
    known = _head(vocabulary, n_terms, head).toPandas()
    shared = spark.sparkContext.broadcast(dict(zip(known["term"], zip(known["n"].tolist(), known["n_records"].tolist(), strict=True), strict=True)))
    rows = records.withColumn("extra", F.lit(None).cast("map<string,struct<n:bigint,r:bigint>>"))
    if n_terms > head:  # the same counts by a join, for the records that need them
        rows = records.join(_tail(records, texts, vocabulary, shared), "key", "left")
    k = len(texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            terms, tf, counts_, owner, starts, at = [], [], [], [], [], 0
            more = batch.column(k).to_pylist() if batch.column(k).null_count < batch.num_rows else None
            for i, row in enumerate(zip(*(batch.column(j).to_pylist() for j in range(k)), strict=True)):
                mine: dict[str, int] = {}
                for t in chain.from_iterable(TERM.findall(x.lower()) for x in row if x):
                    mine[t] = mine.get(t, 0) + 1
                if not mine:
                    continue
                terms.extend(mine)
                tf.extend(mine.values())
                if more is not None and more[i]:
                    own = {t: (c["n"], c["r"]) for t, c in more[i]}
                    counts_.extend(lookup.get(t) or own[t] for t in mine)
                else:
                    counts_.extend(map(lookup.__getitem__, mine))
                owner.append(i)
                starts.append(at)
                at += len(mine)
            if not terms:
                continue
            start = np.array(starts)
            counted = np.array(counts_, dtype=np.float64)
            df_ = counted[:, 1]
            tf_ = np.array(tf, dtype=np.float64)
            p = fit(tf_, counted[:, 0] / max(n_tokens, 1), start)
            weight = np.where(df_ > 1, tf_ * np.log(n_records / df_), 0.0)
            size = np.diff(np.append(start, len(tf_)))
            source = np.repeat(np.array(owner), size)
            if best_only is None:
                keep = np.arange(len(tf_))
            else:
                top = np.maximum.reduceat(weight, start)
                is_top = weight == np.repeat(top, size)
                rest = np.maximum.reduceat(np.where(is_top, -1.0, weight), start)
                single = (np.add.reduceat(is_top.astype(np.int64), start) == 1) & (top > 0) & (top > best_only * rest)
                keep = np.flatnonzero(is_top & np.repeat(single, size))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(k + 1).take(pa.array(source[keep])),
                    pa.array([terms[j] for j in keep], pa.string()),
                    pa.array(tf_[keep].astype(np.int32)),
                    pa.array(df_[keep].astype(np.int64)),
                    pa.array(p[keep]),
                    pa.array(weight[keep]),
                ],
                names=["key", "term", "tf", "df", "p", "weight"],
            )

    return rows.select(*texts, "extra", "key").mapInArrow(run, TERMS).withColumnRenamed("key", key)


def _head(vocabulary: DataFrame, n_terms: int, head: int) -> DataFrame:
    """At most `head` of the terms in most records: those above a frequency step, so that only they leave the tasks."""
    if n_terms <= head:
        return vocabulary
    step = F.floor(F.log2("n_records") * 8).cast("int")
    left, least = head, None
    for r in sorted(vocabulary.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):  # some hundred steps
        if r["count"] > left:
            break
        left, least = left - r["count"], r["step"]
    return vocabulary.where(step >= least) if least is not None else vocabulary.where("false")


def _tail(records: DataFrame, texts: list[str], vocabulary: DataFrame, shared) -> DataFrame:
    """key, extra: the counts of each record's terms that are not broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = shared.value
        for batch in batches:
            source, terms = [], []
            for i, row in enumerate(zip(*(batch.column(j + 1).to_pylist() for j in range(len(texts))), strict=True)):
                for t in {t for x in row if x for t in TERM.findall(x.lower())}:
                    if t not in lookup:
                        source.append(i)
                        terms.append(t)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(source, pa.int32())), pa.array(terms, pa.string())], names=["key", "term"])

    rare = records.select("key", *texts).mapInArrow(run, "key long, term string")
    entry = F.struct("term", F.struct("n", F.col("n_records").alias("r")))
    # every term here is outside the HEAD most frequent, so no join key is hot
    return rare.join(vocabulary, "term").groupBy("key").agg(F.map_from_entries(F.collect_list(entry)).alias("extra"))
