"""How often every distinct value or term occurs, and in how many records: recursive radix spilling.

1. Each task tokenises its records and adds up (field, term, occurrences, records); a full table is flushed, so a
   task's memory is bounded however many terms it meets.
2. The partial counts are written to the shared folder, partitioned by the top bits of the term's hash.
3. A radix partition with too many rows is split further by the next bits, again and again, until every leaf fits.
4. Each leaf is aggregated by DuckDB under a memory limit, out of core where the shared folder is a mounted path.

All partial counts of one term have one hash and at most one row per flush, so a term that a third of all records
hold is no larger than any other.
"""

from __future__ import annotations

import os
import re
import uuid
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, drop_path, local_part, scratch

#: A term is a longest run of letters and digits after lower-casing.
TERM = re.compile(r"[^\W_]+")
#: Distinct terms a task holds before it flushes its counts.
FLUSH = 400_000
#: Hash bits of the first spill and of each further split.
FIRST_BITS, MORE_BITS = 5, 4
#: Partial rows in a leaf; about 100 bytes each in DuckDB.
LEAF_ROWS = 2_000_000
LEAF_MEMORY, UNSPILLED_MEMORY = "256MB", "1GB"

PARTIAL = "field_name string, term string, n long, n_records long"
#: Under this field name the number of records travels with the counts.
RECORDS = "#records"


def terms_of(text: str) -> list[str]:
    return TERM.findall(text.lower())


def distinct_records(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """`key` and `columns`, each record once; a record delivered again has the same content.

    Where rows of one key differ after all, each distinct content stays. Rows with a null key are dropped.
    """
    return df.select(key, *columns).where(F.col(key).isNotNull()).distinct()


def partial_counts(records: DataFrame, texts: list[str], values: list[str], joint: bool = False) -> DataFrame:
    """Unmerged counts of each task. `texts` are split into terms, `values` trimmed and lower-cased as a whole.

    With `joint` all texts of a record are counted together under the field name "".
    """
    columns = [*texts, *values]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [""] if joint else columns
        tables = {f: (Counter(), Counter()) for f in names}

        def flush() -> Iterator[pa.RecordBatch]:
            for f, (n, r) in tables.items():
                terms = list(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array([n[t] for t in terms], pa.int64()), pa.array([r[t] for t in terms], pa.int64())],
                    names=["field_name", "term", "n", "n_records"],
                )
                n.clear()
                r.clear()

        seen = 0
        for batch in batches:
            seen += batch.num_rows
            if joint:
                n, r = tables[""]
                for row in zip(*(batch.column(i).to_pylist() for i in range(len(texts))), strict=True):
                    found = [t for x in row if x for t in TERM.findall(x.lower())]
                    n.update(found)
                    r.update(set(found))
            else:
                for i, f in enumerate(columns):
                    n, r = tables[f]
                    whole = i >= len(texts)
                    for x in batch.column(i).to_pylist():
                        if x:
                            if whole:
                                found = [v] if (v := x.strip().lower()) else []
                            else:
                                found = TERM.findall(x.lower())
                            n.update(found)
                            r.update(set(found))
            if sum(len(n) for n, _ in tables.values()) > FLUSH:
                yield from flush()
        yield from flush()
        yield pa.RecordBatch.from_arrays([pa.array([RECORDS]), pa.array([""]), pa.array([seen], pa.int64()), pa.array([seen], pa.int64())], names=["field_name", "term", "n", "n_records"])

    return records.select(*columns).mapInArrow(run, PARTIAL)


def _spill(rows: DataFrame, bits: int, path: str) -> None:
    """Write `rows` by the top `bits` of their hash. Rows of a partition come together first, in eight shares, so a
    partition has a few files however many tasks made its rows."""
    parted = rows.withColumn("radix", F.shiftrightunsigned("h", 64 - bits))
    parted.repartition(F.col("radix"), F.pmod("h", F.lit(8))).write.partitionBy("radix").parquet(path)


def merge_counts(partial: DataFrame, first_bits: int = FIRST_BITS, more_bits: int = MORE_BITS, leaf_rows: int = LEAF_ROWS) -> DataFrame:
    """Sums of `partial` by (field_name, term), by recursive radix spilling and DuckDB in each leaf."""
    spark = partial.sparkSession
    spill = scratch(spark, "radix")
    hashed = partial.withColumn("h", F.xxhash64("field_name", "term"))
    depth = first_bits
    _spill(hashed, depth, f"{spill}/0")
    level, leaves = 0, []
    while True:
        here = spark.read.schema(f"{PARTIAL}, h long, radix long").parquet(f"{spill}/{level}")
        # at most 2^bits counts per oversized parent come to the driver
        large = [r["radix"] for r in here.groupBy("radix").count().where(F.col("count") > leaf_rows).collect()]
        if not large or depth + more_bits > 62:
            leaves.append(here)
            break
        leaves.append(here.where(~F.col("radix").isin(large)))
        depth += more_bits
        _spill(here.where(F.col("radix").isin(large)), depth, f"{spill}/{level + 1}")
        level += 1
    folder = local_part(spill)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        leaf, held = None, []

        def merge() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            # each leaf has a folder of its own to spill to; without a mounted one a leaf, which is bounded, stays in memory
            room = {"memory_limit": LEAF_MEMORY, "temp_directory": os.path.join(folder, "duckdb", uuid.uuid4().hex)} if folder else {"memory_limit": UNSPILLED_MEMORY, "temp_directory": ""}
            con = duckdb.connect(config={"threads": 1} | room)
            part = pa.Table.from_batches(held)  # noqa: F841 (read by name below)
            got = con.sql("SELECT field_name, term, sum(n)::BIGINT AS n, sum(n_records)::BIGINT AS n_records FROM part GROUP BY ALL").to_arrow_table()
            con.close()
            held.clear()
            yield from got.to_batches()

        for batch in batches:
            at = batch.column(4).to_pylist()
            start = 0
            for i, value in enumerate(at):
                if value != leaf:
                    if i > start:
                        held.append(batch.slice(start, i - start).select([0, 1, 2, 3]))
                    yield from merge()
                    start, leaf = i, value
            if len(at) > start:
                held.append(batch.slice(start).select([0, 1, 2, 3]))
        yield from merge()

    merged = None
    for n, part in enumerate(leaves):
        part = part.withColumn("leaf", F.concat(F.lit(f"{n}-"), F.col("radix").cast("string"))).select("field_name", "term", "n", "n_records", "leaf")
        merged = part if merged is None else merged.unionByName(part)
    counts = cut(merged.repartition(F.col("leaf")).sortWithinPartitions("leaf").mapInArrow(run, PARTIAL))
    drop_path(spark, spill)
    return counts


def term_counts(df: DataFrame, key: str, texts: list[str], values: list[str], rare: int = 2, common: float = 0.05) -> DataFrame:
    """field_name, term, n (occurrences), n_records, mark: 'rare', 'common' or null.

    `rare`: in at most that many records. `common`: in at least that share of all records, whether or not they hold
    anything. A term that is both (in a tiny collection) is rare. Null, empty and blank fields hold no term; records
    delivered again count once; an empty table gives no row.
    """
    counts = merge_counts(partial_counts(distinct_records(df, key, [*texts, *values]), texts, values))
    total = counts.where(F.col("field_name") == RECORDS).agg(F.sum("n").alias("total"))  # one row
    marked = counts.where(F.col("field_name") != RECORDS).crossJoin(F.broadcast(total))
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") >= F.col("total") * common, "common")
    return marked.select("field_name", "term", "n", "n_records", mark.alias("mark"))


