"""The registered queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import read_table
from .leakage import RUN, leaks
from .names import name_clusters, name_variants
from .neighbours import nearest
from .packing import CAPACITY, pack_items
from .parsimony import distinctive_terms
from .rankagg import aggregate_ranks, top_by
from .sentences import split_sentences
from .termfreq import term_counts
from .truncation import THRESHOLD, fit_model, truncated_copies


def _p1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the stored descriptions, by feed, and of their delivered copies, by worker."""
    news = read_table(spark, sf_dir, "stored_news").select("_id", "feed", "short_description").where("short_description <> ''")
    hits = read_table(spark, sf_dir, "semantic_hits").select("hit_id", "doc_id", "worker", "short_description").where("short_description <> ''")
    stored = news.selectExpr("'stored_news' AS tbl", "feed AS source", "_id AS row_id", "short_description AS text")
    copies = hits.selectExpr("'semantic_hits' AS tbl", "worker AS source", "hit_id AS row_id", "short_description AS text", "doc_id")
    model = fit_model(stored.unionByName(copies.drop("doc_id")))
    return truncated_copies(stored, copies.withColumnRenamed("doc_id", "parent_id"), model)


def p1_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the rows found fall to the model alone and to the stored record a copy is held against."""
    rows = _p1(spark, sf_dir).groupBy("tbl", "row_id").agg(F.max("cut").alias("cut"), F.max("p").alias("p"))
    by_model = F.col("p") >= THRESHOLD
    return rows.groupBy("tbl").agg(F.count("*").alias("n_rows"), F.count_if("cut").alias("n_cut"), F.count_if(F.col("cut") & by_model).alias("n_cut_by_model"), F.count_if(~F.col("cut") & by_model).alias("n_overruled"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose description breaks off."""
    return _p1(spark, sf_dir).where("cut").select("tbl", "row_id").distinct()


def p1_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the descriptions of each feed and worker break off; a row delivered again counts once."""
    rows = _p1(spark, sf_dir).groupBy("tbl", "source", "row_id").agg(F.max("cut").alias("cut"))
    return rows.groupBy("tbl", "source").agg(F.count("*").alias("n_rows"), F.count_if("cut").alias("n_cut"), F.round(F.avg(F.col("cut").cast("double")), 6).alias("cut_rate"))


def _p2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_counts(read_table(spark, sf_dir, "stored_news"), "_id", ["headline", "short_description"], ["category"])


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms and categories that are too rare or too common to be useful."""
    return _p2(spark, sf_dir).where("mark is not null").select("field_name", "term", "mark")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term and category with its occurrences, records and mark."""
    return _p2(spark, sf_dir).withColumn("mark", F.coalesce("mark", F.lit("")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of spellings in `authors` that denote the same person or organisation."""
    return name_variants(read_table(spark, sf_dir, "stored_news"), "authors", read_table(spark, sf_dir, "given_names"))


def p4_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every spelling with the entity it denotes."""
    return name_clusters(read_table(spark, sf_dir, "stored_news"), "authors", read_table(spark, sf_dir, "given_names"))


def _p5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate_ranks(read_table(spark, sf_dir, "fused_hits"), "query_id", "doc_id", ["lexical_score", "semantic_score"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first ten documents of each query by the reciprocal-rank sum of the operator's places."""
    return top_by(_p5(spark, sf_dir), "query_id", "doc_id", "rrf", 10).select("query_id", "doc_id")


def p5_significance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hit with its rho and its place by significance."""
    ranked = _p5(spark, sf_dir)
    return ranked.select("query_id", "doc_id", F.round("rho", 9).alias("rho"), "rra_place")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best term of each record, where it stands clear of the others."""
    best = distinctive_terms(read_table(spark, sf_dir, "stored_news"), "_id", ["headline", "short_description"], best_only=1.05)
    return best.selectExpr("_id AS news_id", "term")


def p6_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term of every record with its counts and its weight (the part of the result that SQL can state)."""
    terms = distinctive_terms(read_table(spark, sf_dir, "stored_news"), "_id", ["headline", "short_description"])
    return terms.selectExpr("_id AS news_id", "term", "tf", "df", "round(weight, 6) AS weight")


def p6_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every term with its converged share of the record's own model."""
    terms = distinctive_terms(read_table(spark, sf_dir, "stored_news"), "_id", ["headline", "short_description"])
    return terms.selectExpr("_id AS news_id", "term", "round(p, 6) AS p")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.85 or more where one is among the five most similar to the other."""
    near = nearest(read_table(spark, sf_dir, "news_vectors"), "doc_id", "embedding", 5, least=0.85, recall=0.9995)
    return near.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b")).distinct()


def _p7(spark: SparkSession, sf_dir: str, exact: bool) -> DataFrame:
    near = nearest(read_table(spark, sf_dir, "news_vectors"), "doc_id", "embedding", 5, asking="key % 50 = 0", exact=exact)
    return near.select(F.col("a").alias("doc_id"), F.col("b").alias("similar_id"), F.round("cosine", 6).alias("cosine"), "place")


def p7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five most similar records found for every record whose id is divisible by 50, against all records."""
    return _p7(spark, sf_dir, False)


def p7_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by comparing every asking record with all records, in blocks."""
    return _p7(spark, sf_dir, True)


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: the neighbours there are, how many of them hashing found, and the share."""
    truth, found = p7_exact(spark, sf_dir), p7_neighbours(spark, sf_dir).select("doc_id", "similar_id", F.lit(1).alias("hit"))
    one = truth.join(found, ["doc_id", "similar_id"], "left").agg(F.count("*").alias("n"), F.count("hit").alias("n_found"))
    return one.withColumn("recall", F.round(F.col("n_found") / F.col("n"), 4))


def _p8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("tokens"))
    return pack_items(docs, "doc_id", "tokens", CAPACITY)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents the packer had to split: those with a piece that starts after the first token."""
    return _p8(spark, sf_dir).where("start > 0").select("doc_id").distinct()


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its container."""
    return _p8(spark, sf_dir).withColumnRenamed("start", "token_start").withColumnRenamed("stop", "token_stop")


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document and the fill of their containers as figures: full, more than full, or neither."""
    rows = _p8(spark, sf_dir)
    sums = rows.where("container is not null").groupBy("container").agg(F.sum("size").alias("content"), F.max("used").alias("used"))
    checked = rows.join(sums.select("container", "content"), "container", "left")
    sound = (F.col("content") <= CAPACITY) & (F.col("content") == F.col("used"))
    return checked.select("doc_id", "piece", F.col("start").alias("token_start"), F.col("stop").alias("token_stop"), "size", sound.alias("within_capacity"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: containers used, the fewest there could be, tokens, and the share of the room that is filled."""
    rows = _p8(spark, sf_dir).where("container is not null")
    one = rows.agg(F.count_distinct("container").alias("containers"), F.sum("size").alias("tokens"))
    fewest = F.ceil(F.col("tokens") / CAPACITY).cast("bigint")
    return one.select("containers", fewest.alias("fewest"), "tokens", F.round(F.col("tokens") / (F.col("containers") * CAPACITY), 6).alias("filled"))


def _p9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "eval_items")
    return leaks(docs, "doc_id", "text", items, "item_id", "text")


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the items of which they hold at least 40 consecutive letters or digits."""
    return _p9(spark, sf_dir).where(f"run >= {RUN}").select("doc_id", "item_id")


def p9_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest common run of each document and item that share at least 40 letters or digits."""
    return _p9(spark, sf_dir).where(f"run >= {RUN}").select("doc_id", "item_id", "run")


def p9_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item with a similar window: matched windows, best similarity, longest run, similarity of the whole item."""
    return _p9(spark, sf_dir)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every document with its place."""
    return split_sentences(read_table(spark, sf_dir, "documents"), "doc_id", "text")


def p10_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The letters and digits of every document that its sentences hold: all of them, each once."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    held = docs.join(split_sentences(docs, "doc_id", "text"), "doc_id")
    part = F.expr("length(regexp_replace(substring(text, start_pos + 1, end_pos - start_pos), '[^\\\\p{L}\\\\p{N}]', ''))")
    return held.groupBy("doc_id").agg(F.sum(part).alias("n_letters"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_rates": p1_rates,
    "p1_model": p1_model,
    "p2_found": p2_found,
    "p2_counts": p2_counts,
    "p4_found": p4_found,
    "p4_clusters": p4_clusters,
    "p5_found": p5_found,
    "p5_significance": p5_significance,
    "p6_found": p6_found,
    "p6_terms": p6_terms,
    "p6_models": p6_models,
    "p7_found": p7_found,
    "p7_neighbours": p7_neighbours,
    "p7_exact": p7_exact,
    "p7_recall": p7_recall,
    "p8_found": p8_found,
    "p8_containers": p8_containers,
    "p8_pieces": p8_pieces,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_runs": p9_runs,
    "p9_leaks": p9_leaks,
    "p10_found": p10_found,
    "p10_cover": p10_cover,
}
