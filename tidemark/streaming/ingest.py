"""Incremental ingestion: new documents become postings as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import tokens


def stream_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, tokens, dl of a streaming DataFrame; stateless."""
    cut = docs.select(F.col(key).cast("bigint").alias("doc_id"), tokens(F.col(text)).alias("tokens"))
    return cut.select("doc_id", "tokens", F.size("tokens").alias("dl"))


def append_tokens(docs: DataFrame, folder: str, checkpoint: str, key: str = "doc_id", text: str = "text", once: bool = True) -> StreamingQuery:
    """Append the tokens of arriving documents to a Parquet table below `folder`, exactly once per input."""
    writer = stream_tokens(docs, key, text).writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def arrivals(docs: DataFrame, event_time: str, key: str, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Documents per window of `event_time`; rows later than `late` are not counted."""
    kept = docs.withWatermark(event_time, late)
    return kept.groupBy(F.window(event_time, window).alias("w")).agg(F.count(key).alias("n_docs")).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n_docs")
