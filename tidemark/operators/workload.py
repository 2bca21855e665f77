"""Benchmark workloads from a corpus, and summaries of measured times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .index import Index

# Document-frequency buckets as (name, least share, share below).
BUCKETS = (("high_df", 0.20, 1.01), ("medium_df", 0.05, 0.20), ("low_df", 0.01, 0.05), ("rare_df", 0.0, 0.01))
PER_BUCKET = 8


def bucket_of(share: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, low, high in BUCKETS[::-1]:
        out = F.when((share > 0) & (share >= low) & (share < high), name).otherwise(out)
    return out


def df_buckets(index: Index) -> DataFrame:
    """bucket, term, df, n: every term with the bucket of its share of documents."""
    rows = index.terms.select("term", "df", F.lit(index.whole.n).cast("bigint").alias("n"))
    return rows.withColumn("bucket", bucket_of(F.col("df") / F.col("n"))).where("bucket is not null").select("bucket", "term", "df", "n")


def bucket_summary(index: Index) -> DataFrame:
    """bucket, terms, postings, max_df, min_df."""
    return df_buckets(index).groupBy("bucket").agg(F.count("*").alias("terms"), F.sum("df").alias("postings"), F.max("df").alias("max_df"), F.min("df").alias("min_df"))


def workload_terms(index: Index, per_bucket: int = PER_BUCKET) -> DataFrame:
    """bucket, place, term, df: the most frequent terms of each bucket, of the rare one the rarest; ties by term.

    Spark keeps each task's own first terms before the shuffle (WindowGroupLimit), so no bucket is gathered whole.
    """
    key = F.when(F.col("bucket") == "rare_df", F.col("df")).otherwise(-F.col("df"))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy(key, "term"))
    return df_buckets(index).withColumn("place", place).where(F.col("place") <= per_bucket).select("bucket", "place", "term", "df")


def workload(index: Index, per_bucket: int = PER_BUCKET) -> DataFrame:
    """query_id, name, bucket, terms: every workload term by itself, consecutive disjoint pairs, and the first four
    terms of each bucket as one query. A bucket too small for a form goes without it."""
    terms = workload_terms(index, per_bucket).groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "term"))), lambda x: x["term"]).alias("terms"))
    forms = F.concat(
        F.transform("terms", lambda t, i: F.struct(F.lit(1).alias("form"), i.alias("at"), F.array(t).alias("terms"))),
        F.when(F.size("terms") > 1, F.transform(F.sequence(F.lit(0), F.floor(F.size("terms") / 2).cast("int") - 1), lambda i: F.struct(F.lit(2).alias("form"), i.alias("at"), F.slice("terms", i * 2 + 1, 2).alias("terms")))).otherwise(F.array().cast("array<struct<form:int,at:int,terms:array<string>>>")),
        F.when(F.size("terms") > 3, F.array(F.struct(F.lit(4).alias("form"), F.lit(0).alias("at"), F.slice("terms", 1, 4).alias("terms")))).otherwise(F.array().cast("array<struct<form:int,at:int,terms:array<string>>>")),
    )
    rows = terms.select("bucket", F.explode(forms).alias("q")).select("bucket", "q.*")
    position = F.expr("CASE bucket WHEN 'high_df' THEN 0 WHEN 'medium_df' THEN 1 WHEN 'low_df' THEN 2 ELSE 3 END")
    name = F.concat_ws("_", "bucket", F.concat("form", F.lit("term")), "at")
    order = Window.orderBy(F.when(F.col("form") == 1, 0).otherwise(1), position, "form", "at")  # a few dozen rows
    return rows.select(F.row_number().over(order).cast("bigint").alias("query_id"), name.alias("name"), "bucket", "terms")


def percentiles(df: DataFrame, value: str, group: list[str], shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact percentiles with linear interpolation at share * (n - 1), with n, mean and the extremes."""
    cols = [F.round(F.percentile(F.col(value), F.lit(p)), 6).alias(f"p{int(p * 100)}") for p in shares]
    return df.groupBy(*group).agg(F.count(value).alias("n"), F.round(F.avg(value), 6).alias("mean"), *cols, F.min(value).alias("least"), F.max(value).alias("most"))


def differences(a: DataFrame, b: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Places at which two rankings (rank, doc_id, score) differ in document or by more than `tolerance` in score."""
    x = a.select("rank", F.col("doc_id").alias("doc_a"), F.col("score").alias("score_a"))
    y = b.select("rank", F.col("doc_id").alias("doc_b"), F.col("score").alias("score_b"))
    same = F.col("doc_a").eqNullSafe(F.col("doc_b")) & (F.abs(F.col("score_a") - F.col("score_b")) <= tolerance)
    return x.join(y, "rank", "full").where(~F.coalesce(same, F.lit(False)))
