"""Sources for a written answer: validation, de-duplication, text gate and the numbered source block."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip
from ..functions.web import html_to_text, valid_address

# The most sources of an answer, and how long their fields may be.
MOST = 5
FIELD = {"id": 80, "headline": 300, "url": 2048, "description": 700}
SHORTEST, LONGEST = 250, 9000
SEPARATOR = "\n\n---\n\n"


def usable_sources(df: DataFrame, group: str, order: str, most: int | None = MOST) -> DataFrame:
    """The sources (group, order, id, headline, url, description) fit to be fetched, with place within the group.

    Fields are trimmed and cut; a source without a headline or with an address that may not be fetched is left out,
    and of one address only the first by `order` (nulls last) stays. `most` per group, None for all.
    """
    rows = df.select(
        group,
        order,
        F.substring(F.coalesce(F.col("id").cast("string"), F.lit("")), 1, FIELD["id"]).alias("id"),
        F.substring(strip(F.col("headline")), 1, FIELD["headline"]).alias("headline"),
        F.substring(strip(F.col("url")), 1, FIELD["url"]).alias("url"),
        F.substring(F.coalesce("description", F.lit("")), 1, FIELD["description"]).alias("description"),
    ).where((F.col("headline") != "") & valid_address(F.col("url")))
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy(group, "url").orderBy(F.col(order).asc_nulls_last(), "id"))).where("_n = 1").drop("_n")
    placed = first.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.col(order).asc_nulls_last(), "id")))
    return placed if most is None else placed.where(F.col("place") <= most)


def readable(df: DataFrame, markup: str) -> DataFrame:
    """`df` with `content`, the page's text up to LONGEST characters; pages with less than SHORTEST are left out."""
    return df.withColumn("content", html_to_text(F.col(markup))).where(F.length("content") >= SHORTEST).withColumn("content", F.substring("content", 1, LONGEST))


def source_block(df: DataFrame, group: str) -> DataFrame:
    """group, block: the group's sources (place, id, headline, url, content), at most MOST, numbered and joined."""
    kept = df.where(F.col("place") <= MOST)
    number = F.col("place").cast("string")
    label = F.when(F.col("id") != "", F.col("id")).otherwise(number)
    text = F.concat(F.lit("SOURCE "), number, F.lit("\nID: "), label, F.lit("\nHEADLINE: "), F.col("headline"), F.lit("\nURL: "), F.col("url"), F.lit("\nARTICLE TEXT:\n"), F.col("content"))
    parts = kept.select(group, F.struct("place", text.alias("text")).alias("part")).groupBy(group).agg(F.array_sort(F.collect_list("part")).alias("parts"))
    return parts.select(group, F.array_join(F.transform("parts", lambda p: p["text"]), SEPARATOR).alias("block"))
