"""News as JSON lines, folders of text files, and the stored documents made of them.

Line order decides ids where a format has none: lines are numbered within their input partition and the partitions'
counts are added, so numbering is distributed and exact.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import strip, unify_newlines
from ..runtime import cut, local_part, spread

FIELDS = ("headline", "short_description", "category", "authors", "date", "link")
RECORD = T.StructType([*[T.StructField(f, T.StringType()) for f in FIELDS], T.StructField("_bad", T.StringType())])


class SourceError(ValueError):
    """A source is missing or cannot give what was asked for."""


def numbered(rows: DataFrame, name: str, start: int = 1, settle: bool = False) -> DataFrame:
    """`rows` with `name`, consecutive numbers in their present order (as read, or as sorted).

    Rows are numbered within their partition, and the rows of earlier partitions (one count per partition) are added;
    with `settle` the marked rows are materialised first, so the numbers are made once, whatever a plan does to the
    scan or the sort above it.
    """
    mark = F.monotonically_increasing_id()
    marked = rows.withColumn("_mark", mark).withColumn("_part", F.shiftright("_mark", 33)).withColumn("_at", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
    if settle:
        marked = cut(marked)
    counts = sorted((r["_part"], r["count"]) for r in marked.groupBy("_part").count().collect())
    before, offsets = start, []
    for part, n in counts:
        offsets.append((part, before))
        before += n
    table = F.broadcast(rows.sparkSession.createDataFrame(offsets, "_part long, _before long"))
    return marked.join(table, "_part").withColumn(name, F.col("_at") + F.col("_before")).drop("_mark", "_part", "_at", "_before")


def parse_lines(lines: DataFrame) -> DataFrame:
    """`lines` (value, line_no) without blank ones as r (the record), valid, line_no."""
    line = F.regexp_replace(F.col("value"), r"^\s+|\s+$", "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}
    rows = lines.where(line != "").select(F.from_json(line, RECORD, options).alias("r"), line.rlike(r"(?s)^\{.*\}$").alias("object"), "line_no")
    return rows.select("r", F.expr("object and r is not null and r._bad is null").alias("valid"), "line_no")


def records_of(lines: DataFrame, keep_blank_headlines: bool = False) -> DataFrame:
    """line_no and the FIELDS of every valid record: trimmed, '' where absent; records without a headline left out."""
    records = parse_lines(lines).where("valid").select("line_no", *[strip(F.col(f"r.{f}")).alias(f) for f in FIELDS])
    return records if keep_blank_headlines else records.where("headline <> ''")


def read_ndjson(spark: SparkSession, path: str, keep_blank_headlines: bool = False) -> DataFrame:
    """`records_of` the lines of text files, numbered in the order they are read."""
    return records_of(numbered(spark.read.text(path), "line_no", settle=True), keep_blank_headlines)


def count_invalid(spark: SparkSession, path: str) -> DataFrame:
    """One row: lines, invalid (blank lines are neither)."""
    rows = parse_lines(spark.read.text(path).withColumn("line_no", F.lit(0)))
    return rows.agg(F.count("*").alias("lines"), F.count_if(~F.col("valid")).alias("invalid"))


def with_ids(records: DataFrame, name: str = "_id", start: int = 1) -> DataFrame:
    """Records numbered by line order, without gaps."""
    return numbered(records.orderBy("line_no"), name, start, settle=True).drop("line_no")


def stored_documents(records: DataFrame) -> DataFrame:
    """The document store: _id BIGINT and the FIELDS."""
    return with_ids(records).select("_id", *FIELDS)


def search_text(headline: Column, description: Column) -> Column:
    """The text a record is indexed under."""
    return F.concat(F.coalesce(headline, F.lit("")), F.lit("\n"), F.coalesce(description, F.lit("")))


def index_documents(records: DataFrame) -> DataFrame:
    """doc_id, text for the index."""
    return with_ids(records, "doc_id").select("doc_id", search_text(F.col("headline"), F.col("short_description")).alias("text"))


def headline_corpus(records: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id (from 0), text: headlines that hold a word; SourceError where `limit` asks for more than there are."""
    from ..functions.text import tokens

    worded = records.where(F.size(tokens(F.col("headline"))) > 0)
    if limit is not None:
        worded = worded.orderBy("line_no").limit(limit)
        if (n := worded.count()) < limit:
            raise SourceError(f"{limit} documents asked for, {n} found")
    return with_ids(worded, "doc_id", 0).select("doc_id", F.col("headline").alias("text"))


def read_folder(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, path, text of the files right in `folder`, numbered from 1 by path; SourceError where it is missing.

    A task lists the folder, and the tasks that read the files know them by their paths, so the driver holds no names.
    """
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(folder)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at) or not fs.getFileStatus(at).isDirectory():
        raise SourceError(f"no folder {folder}")
    base = fs.makeQualified(at).toString()
    paths = spark.range(0, 1, 1, 1).mapInArrow(_lister(base), "path string")
    ids = spread(numbered(paths.orderBy("path"), "doc_id", settle=True).select("doc_id", "path"))
    files = ids.mapInArrow(_reader(base), "doc_id long, path string, content binary")
    return files.select("doc_id", "path", F.decode("content", "UTF-8").alias("text"))


#: Paths that go into a batch at once, and bytes of files.
LISTED, READ = 10_000, 1 << 24


def _lister(base: str):
    def names() -> Iterator[str]:
        if (here := local_part(base)) is not None:
            with os.scandir(here) as found:  # a name at a time, however many there are
                yield from (f.name for f in found if f.is_file())
        else:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(base)
            yield from (f.base_name for f in where.get_file_info(fs.FileSelector(at)) if f.is_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _ in batches:
            shown = (f"{base.rstrip('/')}/{n}" for n in names() if not n.startswith((".", "_")))  # others are hidden, as for Spark
            while some := list(islice(shown, LISTED)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.string())], names=["path"])

    return run


def _reader(base: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = _opened(base)
        for batch in batches:
            paths, begin, size, contents = batch.column(1).to_pylist(), 0, 0, []
            for n, path in enumerate(paths, 1):
                contents.append(read(path))
                size += len(contents[-1])
                if size >= READ or n == len(paths):
                    yield pa.RecordBatch.from_arrays([batch.column(0)[begin:n], batch.column(1)[begin:n], pa.array(contents, pa.binary())], names=["doc_id", "path", "content"])
                    begin, size, contents = n, 0, []

    return run


def _opened(base: str):
    """What reads a file right in `base` by its path."""
    if local_part(base) is not None:

        def read(path: str) -> bytes:
            with open(local_part(path), "rb", buffering=0) as f:
                return f.readall()

        return read
    from pyarrow import fs

    where, at = fs.FileSystem.from_uri(base)

    def fetch(path: str) -> bytes:
        with where.open_input_stream(f"{at.rstrip('/')}/{path.rpartition('/')[2]}") as f:
            return f.read()

    return fetch


def drop_files(spark: SparkSession, folder: str) -> None:
    """Remove the files right in `folder` by a task, one name at a time on a mounted file system; what removes a
    folder as a whole lists it in the driver first."""

    def drop(_) -> None:
        if (here := local_part(folder)) is not None:
            with os.scandir(here) as found:
                for f in found:
                    if not f.is_dir(follow_symlinks=False):
                        os.unlink(f.path)
        else:
            from pyarrow import fs

            where, at = fs.FileSystem.from_uri(folder)
            for f in where.get_file_info(fs.FileSelector(at)):
                if f.is_file:
                    where.delete_file(f.path)

    spark.sparkContext.parallelize([0], 1).foreach(drop)


def text_files(documents: DataFrame) -> DataFrame:
    """file_name, content, n_bytes of each record as a text file: headline, blank line, description."""
    tidy = lambda c: strip(unify_newlines(F.coalesce(F.col(c), F.lit(""))))
    content = F.concat(tidy("headline"), F.lit("\n\n"), tidy("short_description"), F.lit("\n"))
    name = F.concat(F.when(F.length(F.col("_id").cast("string")) < 6, F.lpad(F.col("_id").cast("string"), 6, "0")).otherwise(F.col("_id").cast("string")), F.lit(".txt"))
    return documents.select(name.alias("file_name"), content.alias("content")).withColumn("n_bytes", F.octet_length("content").cast("bigint"))


def file_stats(files: DataFrame) -> DataFrame:
    """One row: files, total_bytes, mean_bytes, largest_bytes, largest_file."""
    return files.agg(
        F.count("*").alias("files"),
        F.coalesce(F.sum("n_bytes"), F.lit(0)).cast("bigint").alias("total_bytes"),
        F.round(F.avg("n_bytes"), 6).alias("mean_bytes"),
        F.max("n_bytes").alias("largest_bytes"),
        F.min_by("file_name", F.struct(-F.col("n_bytes"), "file_name")).alias("largest_file"),
    )


def write_files(files: DataFrame, folder: str) -> None:
    """One text file per record below `folder`, written by the tasks on any file system that Arrow has a driver for
    (mounted folders, HDFS, object stores); each file appears whole."""
    files.select("file_name", "content").foreachPartition(_writer(folder))


def _writer(folder: str):
    def write(rows) -> None:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        own = f"{at}/.{uuid.uuid4().hex}"  # tasks that create files in one folder wait for each other
        where.create_dir(own)
        mounted = isinstance(where, fs.LocalFileSystem)
        try:
            for r in rows:
                beside, content = f"{own}/{r['file_name']}", r["content"].encode("utf-8")
                if mounted:
                    with open(beside, "wb") as f:
                        f.write(content)
                    os.replace(beside, f"{at}/{r['file_name']}")
                else:
                    with where.open_output_stream(beside) as f:
                        f.write(content)
                    where.move(beside, f"{at}/{r['file_name']}")
        finally:
            where.delete_dir(own)

    return write


def vector_inputs(records: DataFrame, limit: int | None = None) -> DataFrame:
    """doc_id (from 1), text: what is embedded of each record with a headline, the first `limit` of them."""
    found = with_ids(records, "doc_id").select("doc_id", search_text(F.col("headline"), F.col("short_description")).alias("text"))
    return found if limit is None else found.where(F.col("doc_id") <= limit)


def checked_embeddings(inputs: DataFrame, embeddings: DataFrame, width: int, key: str = "doc_id", vector: str = "embedding") -> DataFrame:
    """doc_id, embedding, fault: every input with its embedding, or null and why there is none that can be used.

    `fault` is missing, repeated, length (other than `width`) or value (null, infinite, NaN or all zero).
    """
    from ..operators.vector import usable

    found = embeddings.groupBy(F.col(key).cast("bigint").alias("doc_id")).agg(F.count("*").alias("n"), F.first(vector).alias("v"))
    rows = inputs.select("doc_id").join(found, "doc_id", "left")
    fault = F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "repeated").when(F.col("v").isNull() | (F.size("v") != width), "length").when(~usable(F.col("v"), width), "value")
    rows = rows.select("doc_id", "v", fault.alias("fault"))
    return rows.select("doc_id", F.when(F.col("fault").isNull(), F.col("v")).alias("embedding"), "fault")


def write_store(documents: DataFrame, path: str, by: str | None = None) -> None:
    """The document store as Parquet, replaced as a whole; `by` partitions it for filters on that column."""
    writer = documents.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
