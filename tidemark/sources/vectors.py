"""Vector files: quantised vectors as Parquet, and the legacy binary layouts.

Layouts (little endian): 8 bytes of magic, version u32, dimensions u32, count u64, ids u32[count], then row by row
int8 (version 2) or float32 (version 1, quantised when read) components.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import InvalidVector

# Fixed values of the file format.
MAGIC = b"ATLVEC01"
HEADER = struct.Struct("<8sIIQ")


def quantise_rows(rows: np.ndarray) -> np.ndarray:
    """Rows of float32 as unit vectors in 8 bits, rounded half away from zero."""
    if not np.isfinite(rows).all():
        raise InvalidVector("a vector is not finite")
    norm = np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).astype(np.float32)
    if (norm == 0).any():
        raise InvalidVector("a vector is zero")
    scaled = rows / norm[:, None] * np.float32(127.0)
    return np.clip(np.trunc(scaled + np.copysign(np.float32(0.5), scaled)), -127, 127).astype(np.int8)


def decode(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(ids, int8 rows) of a vector file; InvalidVector where it is damaged."""
    if len(content) < HEADER.size:
        raise InvalidVector("the file ends in its header")
    magic, version, width, count = HEADER.unpack_from(content)
    if magic != MAGIC or version not in (1, 2) or not width:
        raise InvalidVector("not a vector file of a known version")
    cell = 4 if version == 1 else 1
    if len(content) != HEADER.size + count * (4 + width * cell):
        raise InvalidVector("the file's size does not fit its header")
    ids = np.frombuffer(content, "<u4", count, HEADER.size)
    rows = np.frombuffer(content, "<f4" if version == 1 else np.int8, count * width, HEADER.size + 4 * count).reshape(count, width)
    if version == 1:
        return ids, quantise_rows(rows)
    if (rows == -128).any():
        raise InvalidVector("a component is out of range")
    return ids, rows


def encode(ids: np.ndarray, rows: np.ndarray) -> bytes:
    """A version 2 file."""
    return HEADER.pack(MAGIC, 2, rows.shape[1], len(ids)) + ids.astype("<u4").tobytes() + rows.astype(np.int8).tobytes()


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, qvec of one or many binary files, one task per file."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                ids, rows = decode(content)
                for low in range(0, len(ids), 10_000):
                    yield pd.DataFrame({"doc_id": ids[low : low + 10_000].astype(np.int64), "qvec": list(rows[low : low + 10_000])})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "doc_id long, qvec array<tinyint>")


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.select("doc_id", "qvec").write.mode("overwrite").parquet(path)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Quantised vectors from Parquet; InvalidVector when a component out of range is read."""
    rows = spark.read.parquet(path).select("doc_id", "qvec")
    sound = F.forall("qvec", lambda x: x != -128)
    return rows.select("doc_id", F.when(sound, F.col("qvec")).otherwise(F.raise_error(F.lit("a component is out of range")).cast("array<tinyint>")).alias("qvec"))


def write_binary(vectors: DataFrame, folder: str) -> None:
    """The quantised vectors as version 2 files below `folder`, one per task, on any file system Arrow has a driver for.
    Ids must fit 32 bits; a task's vectors are in memory at once."""
    vectors.select("doc_id", "qvec").foreachPartition(_binary_writer(folder))


def _binary_writer(folder: str):
    def write(rows) -> None:
        import uuid

        from pyarrow import fs

        found = list(rows)
        if not found:
            return
        ids = np.array([r["doc_id"] for r in found], dtype=np.int64)
        if ids.min() < 0 or ids.max() >= 1 << 32:
            raise InvalidVector("an id does not fit 32 bits")
        where, at = fs.FileSystem.from_uri(folder)
        where.create_dir(at, recursive=True)
        name = uuid.uuid4().hex
        with where.open_output_stream(f"{at}/.{name}.part") as f:
            f.write(encode(ids, np.array([r["qvec"] for r in found], dtype=np.int8)))
        where.move(f"{at}/.{name}.part", f"{at}/{name}.bin")

    return write


def convert(spark: SparkSession, source: str, target: str) -> None:
    """Binary files of either version as Parquet; float32 vectors are quantised on the way."""
    write_vectors(read_binary(spark, source), target)
