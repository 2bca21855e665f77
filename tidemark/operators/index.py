"""The positional inverted index as DataFrames.

    tokens    : doc_id, tokens ARRAY<STRING>, dl INT        one row per document, empty ones included
    postings  : term, doc_id, tf INT, dl INT, positions ARRAY<INT>       sorted by (term, doc_id)
    terms     : term, df BIGINT, max_tf INT
    doc_stats : doc_id, dl INT
    corpus    : n, total_len, avgdl, max_doc_id, vocab, block_size     one row
    blocks    : term, block_id INT, begin BIGINT, end BIGINT, first_doc, last_doc, max_tf INT, min_dl INT

A saved or held index is inverted: queries read the postings of their terms, which are sorted by term, so that row
groups (or cached batches) of other terms are skipped by their statistics. An index that is neither has no postings
yet; `gathered` then takes the same rows from the tokens, document by document, without a shuffle.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..runtime import drop_path, spread

BLOCK_SIZE = 128
TABLES = ("tokens", "postings", "terms", "doc_stats", "corpus", "blocks")


class InvalidIndex(ValueError):
    """Documents or index tables break an invariant."""


#: How words are folded; an index made with another folding can't answer queries.
FOLDING = "nfkc_casefold"


@dataclass(frozen=True)
class Facts:
    """What scoring needs to know of the whole index and of a query's terms."""

    n: int
    avgdl: float
    max_doc_id: int
    df: dict[str, int] = field(default_factory=dict)
    max_tf: dict[str, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Index:
    """An index over documents; immutable, like the DataFrames it is made of."""

    tokens: DataFrame
    block_size: int = BLOCK_SIZE
    saved: str | None = None
    held: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def spark(self) -> SparkSession:
        return self.tokens.sparkSession

    @property
    def inverted(self) -> bool:
        return self.saved is not None or "postings" in self.held

    def _stored(self, name: str) -> DataFrame | None:
        if name in self.held:
            return self.held[name]
        return self.spark.read.parquet(f"{self.saved}/{name}") if self.saved else None

    @property
    def positions(self) -> DataFrame:
        return self.tokens.select("doc_id", F.posexplode("tokens").alias("position", "term"))

    @property
    def postings(self) -> DataFrame:
        """Per-document counting needs one shuffle on (term, doc_id); a hot term is spread over its documents."""
        if (stored := self._stored("postings")) is not None:
            return stored
        words = self.tokens.select("doc_id", "dl", F.posexplode("tokens").alias("position", "term"))
        grouped = words.groupBy("term", "doc_id", "dl").agg(F.array_sort(F.collect_list("position")).alias("positions"))
        return grouped.select("term", "doc_id", F.size("positions").alias("tf"), "dl", "positions")

    @property
    def term_counts(self) -> DataFrame:
        """term, doc_id, tf, dl without positions: counts combine before the shuffle."""
        if (stored := self._stored("postings")) is not None:
            return stored.select("term", "doc_id", "tf", "dl")
        words = self.tokens.select("doc_id", "dl", F.explode("tokens").alias("term"))
        return words.groupBy("term", "doc_id", "dl").agg(F.count("*").cast("int").alias("tf")).select("term", "doc_id", "tf", "dl")

    @property
    def terms(self) -> DataFrame:
        if (stored := self._stored("terms")) is not None:
            return stored
        return self.term_counts.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))

    @property
    def doc_stats(self) -> DataFrame:
        return self.tokens.select("doc_id", "dl")

    @cached_property
    def whole(self) -> Facts:
        """n, avgdl and max_doc_id, read once."""
        row = (self._stored("corpus") if self.saved else self.size).first()
        return Facts(row["n"], row["avgdl"], row["max_doc_id"])

    def facts(self, terms: Sequence[str]) -> Facts:
        """`whole` with the document frequency and largest frequency of each of `terms` that occurs: one small job."""
        each = list(dict.fromkeys(terms))
        if not each:
            return self.whole
        if self.inverted:
            rows = [tuple(r) for r in self.terms.where(F.col("term").isin(each)).select("term", "df", "max_tf").collect()]
            whole = self.whole
        else:
            dfs = [F.count_if(F.array_contains("tokens", t)).alias(f"df{i}") for i, t in enumerate(each)]
            most = [F.max(frequency(t)).alias(f"tf{i}") for i, t in enumerate(each)]
            row = self.tokens.agg(*_sizes(), *dfs, *most).first()
            rows = [(t, row[f"df{i}"], row[f"tf{i}"]) for i, t in enumerate(each) if row[f"df{i}"]]
            whole = Facts(row["n"], row["avgdl"], row["max_doc_id"])
        return Facts(whole.n, whole.avgdl, whole.max_doc_id, {t: df for t, df, _ in rows}, {t: tf for t, _, tf in rows})

    def gathered(self, terms: Sequence[str], placed: Sequence[str] = (), among: Column | None = None) -> DataFrame:
        """doc_id, dl, tf0, tf1, ... (0 where a term is missing) of the documents with any of `terms`, one row each.

        For terms in `placed` their positions come along as p0, p1, ... (null where missing). `among` is a condition
        on doc_id.
        """
        each = list(terms)
        if not self.inverted:
            has = F.arrays_overlap("tokens", F.array(*map(F.lit, each)))
            docs = self.tokens.where(has if among is None else has & among)
            spots = [F.when(F.array_contains("tokens", t), spots_of(t)).alias(f"p{i}") for i, t in enumerate(each) if t in placed]
            return docs.select("doc_id", "dl", *[frequency(t).alias(f"tf{i}") for i, t in enumerate(each)], *spots)
        rows = self.postings.where(F.col("term").isin(each))
        rows = (rows if among is None else rows.where(among)).select("term", "doc_id", "tf", "dl", *(["positions"] if placed else []))
        return by_document(rows, each, placed)

    def doc_stats_of(self, doc_id: int) -> DataFrame:
        return self.doc_stats.where(F.col("doc_id") == doc_id)

    @property
    def size(self) -> DataFrame:
        """One row: n, total_len, avgdl, max_doc_id (0 for an empty index)."""
        return self.tokens.agg(*_sizes())

    @property
    def corpus(self) -> DataFrame:
        if (stored := self._stored("corpus")) is not None:
            return stored
        words = self.tokens.select(F.explode(F.array_distinct("tokens")).alias("term")).agg(F.count_distinct("term").alias("vocab"))
        return self.size.crossJoin(words).withColumn("block_size", F.lit(self.block_size))  # one row by one row

    @property
    def blocks(self) -> DataFrame:
        """Runs of `block_size` postings of a term in document order.

        Positions within a term come from a window on the term. Terms in more documents than HOT_TERM first count
        their postings by ranges of documents, so that no task sorts more than one range of one term.
        """
        if (stored := self._stored("blocks")) is not None:
            return stored
        return posting_blocks(self.term_counts, self.block_size)

    def postings_of(self, term: str) -> DataFrame:
        """doc_id, tf, positions of one term in document order; the stored table is sorted by term, so row groups are
        skipped by their statistics."""
        if (stored := self._stored("postings")) is not None:
            return stored.where(F.col("term") == term).select("doc_id", "tf", "positions").orderBy("doc_id")
        found = self.tokens.where(F.array_contains("tokens", term)).select("doc_id", spots_of(term).alias("positions"))
        return found.select("doc_id", F.size("positions").alias("tf"), "positions").orderBy("doc_id")

    def blocks_of(self, term: str) -> DataFrame:
        return self.blocks.where(F.col("term") == term).orderBy("block_id")

    def term_frequency(self, term: str, doc_id: int) -> int:
        """0 where the term or the document is unknown."""
        row = self.postings_of(term).where(F.col("doc_id") == doc_id).select("tf").first()
        return row[0] if row else 0

    def term_positions(self, term: str, doc_id: int) -> list[int]:
        row = self.postings_of(term).where(F.col("doc_id") == doc_id).select("positions").first()
        return row[0] if row else []

    def document_frequency(self, term: str) -> int:
        return self.facts([term]).df.get(term, 0)

    def document_length(self, doc_id: int) -> int:
        row = self.tokens.where(F.col("doc_id") == doc_id).select("dl").first()
        return row[0] if row else 0

    def save(self, folder: str, keep: int | None = None) -> str:
        """Write every table below a new version of `folder`, then point CURRENT to it; returns the version.

        CURRENT is replaced by one atomic rename, so readers see the old version or the new one, and a failure at any
        time leaves the version that was current untouched. The pointer holds the number of rows of each table. With
        `keep`, all but the newest `keep` versions are removed after publishing.
        """
        version = uuid.uuid4().hex
        at = f"{folder}/{version}"
        self.tokens.write.parquet(f"{at}/tokens")
        held = self.spark.read.parquet(f"{at}/tokens")
        fresh = Index(held, self.block_size)
        by_term(fresh.postings).write.parquet(f"{at}/postings")
        counts = self.spark.read.parquet(f"{at}/postings").select("term", "doc_id", "tf", "dl")
        terms = counts.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.parquet(f"{at}/terms")
        fresh.doc_stats.write.parquet(f"{at}/doc_stats")
        posting_blocks(counts, self.block_size).repartitionByRange("term", "block_id").sortWithinPartitions("term", "block_id").write.parquet(f"{at}/blocks")
        vocab = self.spark.read.parquet(f"{at}/terms").agg(F.count("*").alias("vocab"))
        fresh.size.crossJoin(vocab).withColumn("block_size", F.lit(self.block_size)).write.parquet(f"{at}/corpus")
        rows = {t: self.spark.read.parquet(f"{at}/{t}").count() for t in TABLES}  # read from the files' footers
        _write_pointer(self.spark, f"{folder}/CURRENT", json.dumps({"version": version, "folding": FOLDING, "rows": rows}))
        if keep is not None:
            _drop_versions(self.spark, folder, version, keep)
        return version

    @staticmethod
    def load(spark: SparkSession, folder: str, validate: bool = False) -> Index:
        """The current version of a saved index; InvalidIndex where it is missing, incomplete or breaks an invariant.

        The number of rows of each table is compared with the pointer's (footers only). `validate` checks every
        invariant besides, which reads all tables.
        """
        try:
            pointer = json.loads(spark.read.text(f"{folder}/CURRENT", wholetext=True).first()[0])
            at = f"{folder}/{pointer['version']}"
            held = spark.read.parquet(f"{at}/tokens")
            block_size = spark.read.parquet(f"{at}/corpus").first()["block_size"]
            rows = {t: spark.read.parquet(f"{at}/{t}").count() for t in TABLES}
        except Exception as e:
            raise InvalidIndex(f"no readable index at {folder}") from e
        if pointer.get("folding") != FOLDING:
            raise InvalidIndex(f"words of the index are folded by {pointer.get('folding')}, not {FOLDING}")
        if rows != pointer.get("rows"):
            raise InvalidIndex("a table has not the rows it was published with")
        index = Index(held, block_size, at)
        if validate and (wrong := violations(index)):
            raise InvalidIndex("; ".join(wrong))
        return index

    def persist(self) -> Index:
        """The index with its tokens, postings and term statistics kept by the executors (memory, then disk)."""
        level = StorageLevel.MEMORY_AND_DISK
        base = Index(self.tokens.persist(level), self.block_size, self.saved)
        postings = by_term(base.postings).persist(level)
        terms = Index(base.tokens, self.block_size, None, {"postings": postings}).terms
        return Index(base.tokens, self.block_size, self.saved, {"postings": postings, "terms": terms.persist(level)})

    def unpersist(self) -> None:
        for table in (self.tokens, *self.held.values()):
            table.unpersist()


def _sizes() -> list[Column]:
    total = F.coalesce(F.sum("dl"), F.lit(0)).cast("bigint")
    n = F.count("*")
    average = F.when(n > 0, total / n).otherwise(0.0)
    return [n.alias("n"), total.alias("total_len"), average.alias("avgdl"), F.coalesce(F.max("doc_id"), F.lit(0)).cast("bigint").alias("max_doc_id")]


def frequency(term: str) -> Column:
    """How often `term` occurs in a document's tokens."""
    return F.size(F.filter("tokens", lambda x: x == F.lit(term)))


def spots_of(term: str) -> Column:
    """Where `term` stands in a document's tokens."""
    marked = F.transform("tokens", lambda x, i: F.when(x == F.lit(term), i))
    return F.filter(marked, lambda i: i.isNotNull())


def by_term(postings: DataFrame) -> DataFrame:
    """Postings in the order they are stored in: ranges of (term, doc_id), so a hot term covers several partitions."""
    return postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def by_document(rows: DataFrame, terms: Sequence[str], placed: Sequence[str] = ()) -> DataFrame:
    """Postings (term, doc_id, tf, dl, positions) of `terms` as one row per document; counts combine before the shuffle."""
    tfs = [F.coalesce(F.max(F.when(F.col("term") == t, F.col("tf"))), F.lit(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
    spots = [F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"p{i}") for i, t in enumerate(terms) if t in placed]
    return rows.groupBy("doc_id").agg(F.max("dl").alias("dl"), *tfs, *spots)


def _write_pointer(spark: SparkSession, path: str, text: str) -> None:
    """Write beside, then rename over `path` in one step, on whatever file system it lies."""
    jvm, sc = spark.sparkContext._jvm, spark.sparkContext
    conf = sc._jsc.hadoopConfiguration()
    target, beside = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + "." + uuid.uuid4().hex[:8])
    fs = target.getFileSystem(conf)
    target, beside = fs.makeQualified(target), fs.makeQualified(beside)
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    over = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    over[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "OVERWRITE")
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(beside, target, over)


def _drop_versions(spark: SparkSession, folder: str, current: str, keep: int) -> None:
    """Remove versions of a saved index but the newest `keep`; the current one always stays."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(at)
    old = sorted(((f.getModificationTime(), f.getPath().getName()) for f in found if f.isDirectory() and f.getPath().getName() != current), reverse=True)
    for _, name in old[max(0, keep - 1) :]:
        drop_path(spark, f"{folder}/{name}")


def build_index(docs: DataFrame, key: str = "doc_id", text: str = "text", block_size: int = BLOCK_SIZE) -> Index:
    """The index of (key, text) rows. Null texts are empty documents; rows with a null key are left out."""
    if block_size < 1:
        raise InvalidIndex("block size must be positive")
    rows = spread(docs.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text")).where("doc_id is not null"))
    cut = rows.select("doc_id", tokens(F.col("text")).alias("tokens"))
    return Index(cut.select("doc_id", "tokens", F.size("tokens").alias("dl")), block_size)


def duplicate_ids(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keys that name several documents; an index needs unique ones."""
    return docs.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")


def check_unique(docs: DataFrame, key: str = "doc_id") -> None:
    if (row := duplicate_ids(docs, key).first()) is not None:
        raise InvalidIndex(f"document id {row[0]} occurs {row['n']} times")


#: Terms in more documents than this are numbered by ranges of documents.
HOT_TERM = 1_000_000


def posting_blocks(rows: DataFrame, size: int, hot: int = HOT_TERM) -> DataFrame:
    """Blocks of `rows` (term, doc_id, tf, dl)."""
    span = max(1, hot // 4)
    share = F.floor(F.col("doc_id") / span).cast("bigint")
    counts = rows.groupBy("term", share.alias("span")).agg(F.count("*").alias("here"))
    before = F.coalesce(F.sum("here").over(Window.partitionBy("term").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("term", "span", before.alias("before"))
    local = F.row_number().over(Window.partitionBy("term", "span").orderBy("doc_id")) - 1
    placed = rows.withColumn("span", share).withColumn("local", local).join(offsets, ["term", "span"]).withColumn("rank", F.col("before") + F.col("local"))
    return (
        placed.withColumn("block_id", F.floor(F.col("rank") / size).cast("int"))
        .groupBy("term", "block_id")
        .agg(
            F.min("rank").cast("bigint").alias("begin"),
            (F.max("rank") + 1).cast("bigint").alias("end"),
            F.min("doc_id").alias("first_doc"),
            F.max("doc_id").alias("last_doc"),
            F.max("tf").alias("max_tf"),
            F.min("dl").alias("min_dl"),
        )
    )


def violations(index: Index) -> list[str]:
    """What is wrong with the tables of a saved index; each rule is one distributed query with at most one row back."""
    postings, stats, terms, blocks = index.postings, index._stored("doc_stats"), index.terms, index.blocks
    corpus = index.corpus.first()
    wrong = []

    def rule(name: str, bad: DataFrame) -> None:
        if bad.limit(1).count():
            wrong.append(name)

    rule("block size is not positive", index.corpus.where("block_size < 1"))
    rule("a document occurs twice", stats.groupBy("doc_id").count().where("count > 1"))
    rule("a term is empty or occurs twice", terms.groupBy("term").count().where("count > 1 or term = ''"))
    rule("a posting occurs twice", postings.groupBy("term", "doc_id").count().where("count > 1"))
    rule("a posting's positions do not fit its frequency", postings.where("tf < 1 or size(positions) <> tf"))
    rising = F.forall(F.sequence(F.lit(1), F.size("positions") - 1), lambda i: F.get("positions", i - 1) < F.get("positions", i))
    rule("positions do not rise", postings.where((F.size("positions") > 1) & ~rising))
    known = stats.select("doc_id", F.col("dl").alias("known"))
    rule("a posting's document is unknown or has another length", postings.select("doc_id", "dl").join(known, "doc_id", "left").where("known is null or known <> dl"))
    counted = postings.groupBy("term").agg(F.count("*").alias("df"), F.max("tf").alias("max_tf"))
    rule("term statistics differ from the postings", counted.exceptAll(terms.select("term", "df", "max_tf")).unionByName(terms.select("term", "df", "max_tf").exceptAll(counted)))
    lengths = postings.groupBy("doc_id").agg(F.sum("tf").alias("sum_tf")).join(stats, "doc_id", "right")
    rule("document lengths differ from the postings", lengths.where("coalesce(sum_tf, 0) <> dl"))
    again = posting_blocks(postings.select("term", "doc_id", "tf", "dl"), index.block_size)
    rule("blocks differ from the postings", again.exceptAll(blocks.select(*again.columns)).unionByName(blocks.select(*again.columns).exceptAll(again)))
    real = Index(stats, index.block_size).size.first()
    if (corpus["n"], corpus["total_len"], corpus["max_doc_id"]) != (real["n"], real["total_len"], real["max_doc_id"]):
        wrong.append("corpus statistics differ from the documents")
    return wrong
