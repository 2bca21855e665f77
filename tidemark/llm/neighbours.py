"""Most similar vectors for every vector: cross-polytope hashing with multiprobe and exact reranking.

1. Unusable vectors are left out; equal directions form a class with one representative, so copies cost nothing.
2. Each of several tables rotates a unit vector by three rounds of random signs and a fast Hadamard transform, and
   takes the axis with the largest component and its sign; `digits` independent rotations make one bucket key.
3. A vector lies in its own bucket and also probes buckets that are next best by the margin between the best and
   another axis of one digit. How many digits, probes and tables there are is planned: for every choice the chance that
   two vectors of the cosine at hand meet in a table is measured on random pairs, the tables follow from it and the
   recall asked for, and the cheapest choice at the number of vectors is taken. So recall does not depend on the size.
   Buckets above HOT members are split by further digits, several times over so that pairs are not lost, before their
   rows meet; what a digit does not part well is compared in blocks, exactly.
4. Within a bucket 8-bit copies of the vectors select candidates: all that can be among the k best, given the proven
   error of the estimates; only (id, id) pairs leave the bucket. A row with more than PAIRS of them, such as one amid
   near copies, is compared with the exact vectors of its candidates, bucket by bucket.
5. Distinct pairs are joined with the exact vectors and reranked in double precision.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

#: Members of a bucket that are compared in one task.
HOT = 4096
#: Recall of pairs at the planned cosine. Above the lower bound COSINE that bound is planned for; below it, the cosine
#: that all but a share FAR of the last neighbours reach, measured on SAMPLE asking rows against all rows.
RECALL, COSINE, FAR, SAMPLE = 0.95, 0.6, 0.1, 64
#: Choices of the plan, and its costs in seconds: of an entry that is shuffled, of a comparison, of a digit.
DIGITS, PROBES = (1, 2, 3, 4), (0, 1, 2, 4, 8, 16)
ENTRY, PAIR, HASH = 6e-6, 1.2e-8, 2e-6
#: Candidates of a row in a bucket that leave it as pairs; with more, the exact vectors decide.
PAIRS = 64
SEED = 20240229
#: Vectors up to this width are rotated by a matrix product.
DENSE = 256
#: Digits from here on are used to split hot buckets, so they never repeat those of the bucket keys.
DIGIT = 64
#: How often hot buckets are split by a digit before they are compared in blocks.
LEVELS = 3
#: Share of the pairs that a split of a hot bucket keeps together, and the most repeats that are worth it.
SPLIT, REPEATS = 0.95, 4
#: A digit must leave at most this share of a hot bucket together to be worth taking.
PARTED = 0.5


def hadamard(x: np.ndarray) -> np.ndarray:
    """The fast Walsh-Hadamard transform of the rows, normalised; the width is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d, dtype=x.dtype)


def rotation_signs(table: int, digit: int, width: int) -> np.ndarray:
    """Three rows of random signs, the same on every executor."""
    return np.random.default_rng((SEED, table, digit)).choice(np.array([-1.0, 1.0], np.float32), size=(3, width))


@lru_cache(maxsize=1024)
def rotation(table: int, digit: int, width: int) -> np.ndarray:
    """The same rotation as a matrix: the transform of the unit vectors. For narrow vectors one product with it is
    faster than the transform's passes over memory."""
    x = np.eye(width, dtype=np.float32)
    for signs in rotation_signs(table, digit, width):
        x = hadamard(x * signs)
    return x


def cross_polytope(x: np.ndarray, table: int, digit: int, more: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the best vertex and the `more` next ones, and by how much those are shorter; vertex = 2 * axis + sign."""
    if x.shape[1] <= DENSE:
        x = x @ rotation(table, digit, x.shape[1])
    else:
        for signs in rotation_signs(table, digit, x.shape[1]):
            x = hadamard(x * signs)
    size = np.abs(x)
    more = min(more, x.shape[1] - 1)
    if not more:
        at = size.argmax(axis=1)[:, None]
        return 2 * at + (np.take_along_axis(x, at, 1) < 0), np.zeros((len(x), 0), x.dtype)
    at = np.argpartition(size, -more - 1, axis=1)[:, -more - 1 :]
    tall = np.take_along_axis(size, at, 1)
    order = np.argsort(-tall, axis=1, kind="stable")
    at, tall = np.take_along_axis(at, order, 1), np.take_along_axis(tall, order, 1)
    return 2 * at + (np.take_along_axis(x, at, 1) < 0), tall[:, :1] - tall[:, 1:]


def matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length as the unit rows of a matrix, in double precision."""
    x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1).astype(np.float64)
    x /= np.maximum(np.abs(x).max(axis=1, keepdims=True), 1e-300)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def padded(x: np.ndarray) -> np.ndarray:
    """Rows widened with zeros to the next power of two."""
    width = 1 << max(1, (x.shape[1] - 1).bit_length())
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, v (the vector as given, single precision where it came so), norm, c1, c2 (two hashes of the unit vector,
    rounded to 6 decimals): each key once, in the most frequent length, finite and not zero.

    Of several rows of one key, the smallest usable vector counts (they are equal as delivered).
    """
    kind = "float" if isinstance(df.schema[vector].dataType, T.ArrayType) and isinstance(df.schema[vector].dataType.elementType, T.FloatType) else "double"
    rows = df.select(F.col(key).cast("long").alias("key"), F.col(vector).cast(f"array<{kind}>").alias("v")).where("key is not null and v is not null and size(v) > 0")
    unit = rows.mapInArrow(_unit_rows, f"key long, v array<{kind}>, norm double, c1 long, c2 long, n int")
    top = unit.groupBy("n").count().orderBy(F.col("count").desc(), "n").limit(1).collect()  # one row
    if not top:
        return unit.drop("n")
    return unit.where(F.col("n") == top[0]["n"]).groupBy("key").agg(F.min(F.struct("v", "norm", "c1", "c2")).alias("m")).select("key", "m.*")


def _unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, vector, norm, two hashes of the unit vector and length of the rows (key, v) that are finite and not zero."""
    for batch in batches:
        lists = batch.column(1)
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        starts = np.cumsum(sizes) - sizes
        given = lists.flatten().to_numpy(zero_copy_only=False)  # null components become NaN
        x = given.astype(np.float64)
        if not len(x):
            continue
        with np.errstate(divide="ignore", invalid="ignore"):
            tall = np.maximum.reduceat(np.abs(x), starts)
            fine = np.isfinite(tall) & (tall > 0)
            x = x / np.repeat(tall, sizes)  # so that squares stay in range
            length = np.sqrt(np.add.reduceat(x * x, starts))
            x /= np.repeat(length, sizes)
            norm = (length * tall)[fine]
        mine = np.repeat(fine, sizes)
        kept, given = x[mine], given[mine]
        sizes = sizes[fine]
        edges = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        if not len(sizes):
            continue
        place = np.arange(len(kept)) - np.repeat(edges[:-1], sizes)
        cells = np.rint(kept * 1e6).astype(np.int64).view(np.uint64)
        hashes = []
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            mixed = (cells + (place.astype(np.uint64) + np.uint64(1)) * np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            hashes.append(pa.array(np.add.reduceat(mixed ^ (mixed >> np.uint64(32)), edges[:-1]).view(np.int64)))
        lists = pa.ListArray.from_arrays(pa.array(edges), pa.array(given))
        yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(fine)), lists, pa.array(norm), *hashes, pa.array(sizes.astype(np.int32))], names=["key", "v", "norm", "c1", "c2", "n"])


ENTRIES = "tbl int, bucket long, key long, code binary, own boolean, ask boolean"


Parts = list[tuple[np.ndarray, np.ndarray]]


def combined(parts: Parts, radix: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its own bucket by all digits (`parts`), and the `probes` next best ones by what they cost in margin."""
    own = np.zeros(len(parts[0][0]), dtype=np.int64)
    for at, _ in parts:
        own = own * radix + at[:, 0]
    if not probes:
        return own, np.zeros((len(own), 0), dtype=np.int64)
    costs = np.concatenate([cost[:, :probes] for _, cost in parts], axis=1)
    steps = np.concatenate([(at[:, 1 : probes + 1] - at[:, :1]) * np.int64(radix) ** (len(parts) - 1 - g) for g, (at, _) in enumerate(parts)], axis=1)
    order = np.argsort(costs, axis=1, kind="stable")[:, :probes]
    return own, own[:, None] + np.take_along_axis(steps, order, 1)


def buckets(wide: np.ndarray, table: int, digits: int, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """`combined` of rows (padded) in a table."""
    return combined([cross_polytope(wide, table, g, probes) for g in range(digits)], 2 * wide.shape[1], probes)


@lru_cache(maxsize=64)
def meeting(width: int, cosine: float, both: bool, pairs: int = 1000, tables: int = 4) -> dict[tuple[int, int], float]:
    """(digits, probes) -> the chance that two vectors of that cosine meet in one table, measured on random pairs (the
    same every time); `both`: each probes, else the first alone."""
    rng = np.random.default_rng((SEED, width))
    x, y = rng.standard_normal((2, pairs, width))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = cosine * x + np.sqrt(max(0.0, 1.0 - cosine * cosine)) * y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-12)
    x, y = padded(x.astype(np.float32)), padded(y.astype(np.float32))
    radix = 2 * x.shape[1]
    met = dict.fromkeys([(g, p) for g in DIGITS for p in PROBES], 0)
    for t in range(tables):
        parts = [[cross_polytope(v, t, g, max(PROBES)) for g in range(max(DIGITS))] for v in (x, y)]
        for g, p in met:
            (a, pa_), (b, pb) = (combined(of[:g], radix, p) for of in parts)
            met[g, p] += int(((a == b) | (pa_ == b[:, None]).any(axis=1) | (both & (pb == a[:, None]).any(axis=1))).sum())
    trials = pairs * tables
    # two standard errors less than measured, as the cheapest choice would otherwise be one that was measured too high
    return {choice: max(0.0, n / trials - 2 * np.sqrt(max(n, 1) * (1 - n / trials)) / trials) for choice, n in met.items()}


def tables_for(chance: float, recall: float) -> int:
    """Tables in which a pair that meets with `chance` in each meets somewhere with the chance `recall`."""
    return 1 if chance >= recall else int(np.ceil(np.log(1.0 - recall) / np.log(1.0 - chance)))


@dataclass(frozen=True)
class Plan:
    tables: int
    digits: int
    probes: int
    repeats: int


def plan_for(n: int, width: int, cosine: float, recall: float, ask: float = 1.0, digits: tuple[int, ...] = DIGITS) -> Plan:
    """The cheapest tables, digits and probes for `n` vectors of which a share `ask` asks; see the module's text."""
    cosine = round(min(max(cosine, 0.1), 0.999), 2)
    radix = 2 * (1 << max(1, (width - 1).bit_length()))
    best, choice, chances = np.inf, None, meeting(width, cosine, ask >= 1.0)
    for g in digits:
        for p in PROBES:
            chance = chances[g, p]
            if chance < 1e-3:
                continue
            tables = tables_for(chance, recall)
            cost = tables * ((1 + ask * p) * ENTRY + ask * (1 + p) * n / radix**g * PAIR + g * HASH)
            if cost < best:
                best, choice = cost, (tables, g, p)
    if choice is None:  # the cosine is too low for hashing to help
        choice = (tables_for(1e-3, recall), digits[0], PROBES[-1])
    return Plan(*choice, tables_for(max(chances[1, 1], 1e-3), SPLIT))


def _hash_rows(tables: int, digits: int, probes: int):
    """A row of (key, ask, v) becomes one entry per table in its own bucket and, where `ask`, the probing entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = matrix(batch.column(2)).astype(np.float32)
            code = np.clip(np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127), -127, 127).astype(np.int8)
            packed = pa.array([r.tobytes() for r in code], pa.binary())
            wide, keys, ask = padded(x), batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            asking = np.flatnonzero(ask)
            rows = pa.array(asking)
            for t in range(tables):
                bucket, probing = buckets(wide, t, digits, probes if len(asking) else 0)
                yield _entries(t, bucket, keys, packed, True, ask)
                for rank in range(probing.shape[1]):
                    yield _entries(t, probing[asking, rank], keys.take(rows), packed.take(rows), False, np.ones(len(asking), bool))

    return run


def usual_cosine(rows: DataFrame, k: int, sample: int = SAMPLE, far: float = FAR) -> float:
    """The cosine that all but a share `far` of the k-th neighbours reach: `sample` asking rows of (key, ask, v), chosen
    by hash, against all rows. Each task keeps its own k best of each."""
    chosen = rows.where("ask").orderBy(F.xxhash64("key"), "key").limit(sample).select("key", "v").collect()
    if not chosen:
        return COSINE
    shared = rows.sparkSession.sparkContext.broadcast((np.array([r["key"] for r in chosen]), matrix(pa.array([r["v"] for r in chosen], pa.list_(pa.float64())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, asked = shared.value
        best = np.full((len(keys), 0), -2.0)
        for batch in batches:
            if batch.num_rows:
                s = asked @ matrix(batch.column(1)).T
                s[keys[:, None] == batch.column(0).to_numpy()[None, :]] = -2.0
                best = np.concatenate([best, s], axis=1)
                best = np.partition(best, -k, axis=1)[:, -k:] if best.shape[1] > k else best
        q, c = np.nonzero(best > -1.5)
        yield pa.RecordBatch.from_arrays([pa.array(keys[q]), pa.array(best[q, c])], names=["q", "cosine"])

    found = rows.select("key", "v").mapInArrow(run, "q long, cosine double")
    kth = found.groupBy("q").agg(F.slice(F.sort_array(F.collect_list("cosine"), asc=False), 1, k).alias("c"))  # tasks * k of each
    return float(np.quantile([r["low"] for r in kth.select(F.element_at("c", -1).alias("low")).collect()] or [COSINE], far))


def _one_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every row of (key, ask, v) as an entry of one bucket."""
    for batch in batches:
        if batch.num_rows:
            x = matrix(batch.column(2)).astype(np.float32)
            code = np.clip(np.rint(x / np.abs(x).max(axis=1, keepdims=True) * 127), -127, 127).astype(np.int8)
            packed = pa.array([r.tobytes() for r in code], pa.binary())
            yield _entries(0, np.zeros(len(x), np.int64), batch.column(0), packed, True, batch.column(1).to_numpy(zero_copy_only=False))


def _entries(table: int, bucket: np.ndarray, keys: pa.Array, packed: pa.Array, own: bool, ask: np.ndarray) -> pa.RecordBatch:
    n = len(bucket)
    columns = [pa.array(np.full(n, table, np.int32)), pa.array(bucket), keys, packed, pa.array(np.full(n, own)), pa.array(ask.astype(bool))]
    return pa.RecordBatch.from_arrays(columns, names=["tbl", "bucket", "key", "code", "own", "ask"])


def code_error(code: np.ndarray) -> np.ndarray:
    """How far the unit vector of each 8-bit code (float rows) can be from the vector it stands for.

    Rounding moves a component by half a step at most, so the sine of the angle is at most half the root of the width
    over the code's length; the cosine of two codes is off by the sum of their errors at most.
    """
    sine = np.minimum(0.5 * np.sqrt(code.shape[1]) / np.maximum(np.linalg.norm(code, axis=1), 1e-9), 1.0)
    return (sine / np.sqrt((1 + np.sqrt(1 - sine * sine)) / 2) + 1e-5).astype(np.float32)


def _bucket_pairs(key: np.ndarray, code: np.ndarray, own: np.ndarray, ask: np.ndarray, k: int, least: float, most: int = PAIRS) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(asking keys, candidate keys, False): every pair of the bucket that can reach `least` and be among the row's k best.

    Rows with more than `most` candidates come as (their keys, the keys of all their candidates, True).
    """
    if not own.any() or not ask.any() or len(key) < 2:
        return
    unit = code.astype(np.float32)
    error = code_error(unit)
    unit /= np.maximum(np.linalg.norm(unit, axis=1, keepdims=True), 1e-9)
    base, asking = np.flatnonzero(own), np.flatnonzero(ask)
    slack = least - float(error[base].max())
    step = int(np.clip((1 << 22) // len(base), 16, 1024))
    held = unit[base].T.copy()
    for low in range(0, len(asking), step):
        rows = asking[low : low + step]
        near = unit[rows] @ held
        # first what passes with the largest error of the block, in one look at the products; then each with its own
        r, c = np.nonzero(near >= slack - float(error[rows].max()))
        fine = (near[r, c] + error[rows[r]] + error[base[c]] >= least) & (key[rows[r]] != key[base[c]])
        r, c = r[fine], c[fine]
        n = np.bincount(r, minlength=len(rows))
        many = np.flatnonzero(n > most)
        if len(many):
            # of rows with many candidates: the k-th best lower bound; what can't reach it is not among the k best
            high = near[many] + error[rows[many]][:, None] + error[base]
            high[key[rows[many]][:, None] == key[base][None, :]] = -9.0
            kth = np.partition(high - 2 * error[base], -k, axis=1)[:, -k] - 2 * error[rows[many]]
            keep = (high >= kth[:, None]) & (high >= max(least, -5.0))
            tied = keep.sum(axis=1) > most
            if tied.any():
                yield key[rows[many[tied]]], key[base[keep[tied].any(axis=0)]], True
                keep[tied] = False
            few = n[r] <= most
            mr, mc = np.nonzero(keep)
            r, c = np.concatenate([r[few], many[mr]]), np.concatenate([c[few], mc])
        yield key[rows[r]], key[base[c]], False


def _deeper(level: int, repeats: int, probing: bool = True):
    """Entries with one more digit in their bucket, `repeats` times by different ones; asking rows also probe their
    second-best vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            tbl, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            code = np.frombuffer(b"".join(batch.column(3).to_pylist()), dtype=np.int8).reshape(n, -1)
            unit = padded(code.astype(np.float32))
            asking = np.flatnonzero(batch.column(5).to_numpy(zero_copy_only=False))
            for r in range(repeats):
                at = np.zeros((n, 2), dtype=np.int64)
                for t in np.unique(tbl):
                    rows = np.flatnonzero(tbl == t)
                    at[rows] = cross_polytope(unit[rows], int(t), DIGIT + 64 * level + r, 1)[0]
                mixed = (bucket[:, None] ^ ((at + 1 + 4096 * r) * np.int64(0x9E3779B97F4A7C1))) * np.int64(0x2545F4914F6CDD1D)
                yield batch.set_column(1, "bucket", pa.array(mixed[:, 0]))
                if probing:
                    probes = batch.take(pa.array(asking))
                    yield probes.set_column(1, "bucket", pa.array(mixed[asking, 1])).set_column(4, "own", pa.array(np.zeros(len(asking), bool)))

    return run


def _bucket_counts(tables: int, digits: int):
    """How many rows of each batch (key, ask, v) lie in each bucket: tbl, bucket, members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                wide = padded(matrix(batch.column(2)).astype(np.float32))
                for t in range(tables):
                    bucket, n = np.unique(buckets(wide, t, digits, 0)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), t, np.int32)), pa.array(bucket), pa.array(n.astype(np.int64))], names=["tbl", "bucket", "members"])

    return run


def _largest(entries: DataFrame) -> int:
    return entries.groupBy("tbl", "bucket").count().agg(F.max("count")).first()[0]


def _cooled(entries: DataFrame, counts: DataFrame, hot: int, repeats: int) -> DataFrame:
    """`entries` with every bucket of more than `hot` own rows split before the rows of a bucket meet in a task.

    Hot buckets get a further digit, `repeats` times over. Where a digit hardly parts them, or after LEVELS of them,
    their own rows and their asking rows are dealt into blocks, and each block meets each: whatever is left is
    compared exactly, in tasks of bounded size. `counts` (tbl, bucket, members) are the rows of the buckets' own, in
    parts.
    """
    parts = []
    for level in range(LEVELS + 1):
        # at most entries / hot buckets
        table = cut(counts.groupBy("tbl", "bucket").agg(F.sum("members").alias("members")).where(F.col("members") > hot))
        most = table.agg(F.max("members")).first()[0]
        if most is None:
            parts.append(entries)
            break
        parts.append(entries.join(table, ["tbl", "bucket"], "left_anti"))
        rows = cut(entries.join(table, ["tbl", "bucket"], "left_semi").select("tbl", "bucket", "key", "code", "own", "ask"))
        if level == LEVELS or repeats > REPEATS or _largest(rows.where("own").mapInArrow(_deeper(level, 1, False), ENTRIES)) > PARTED * most:
            parts.append(_blocks(rows, hot))
            break
        entries = cut(rows.mapInArrow(_deeper(level, repeats), ENTRIES))
        counts = entries.where("own").select("tbl", "bucket", F.lit(1).cast("bigint").alias("members"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _blocks(rows: DataFrame, hot: int) -> DataFrame:
    """Every block of own rows of a bucket with every block of its asking rows, as buckets of their own."""
    sizes = rows.groupBy("tbl", "bucket").agg(F.count_if("own").alias("n_own"), F.count_if("ask").alias("n_ask"))
    number = lambda n: F.greatest(F.ceil(F.col(n) / hot), F.lit(1)).cast("int")
    dealt = rows.join(sizes.select("tbl", "bucket", number("n_own").alias("ni"), number("n_ask").alias("nj")), ["tbl", "bucket"])
    mine = lambda n: F.pmod(F.xxhash64("key"), F.col(n).cast("bigint")).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    bucket = F.xxhash64(F.lit("block"), F.col("bucket"), F.col("i"), F.col("j")).alias("bucket")
    held = dealt.where("own").withColumn("i", mine("ni")).withColumn("j", every("nj")).select("tbl", bucket, "key", "code", F.lit(True).alias("own"), F.lit(False).alias("ask"))
    asked = dealt.where("ask").withColumn("j", mine("nj")).withColumn("i", every("ni")).select("tbl", bucket, "key", "code", F.lit(False).alias("own"), F.lit(True).alias("ask"))
    return held.unionByName(asked)


def _by_group(columns: list[str], emit):
    """`emit` of the rows of each group of equal `columns`; rows of one group come one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []  # of the last group, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy() for c in columns]
            other = np.flatnonzero(np.logical_or.reduce([c != c[-1] for c in cols]))
            at = int(other[-1]) + 1 if len(other) else 0
            if rest and (at or any(rest[-1].column(name)[-1].as_py() != c[0] for name, c in zip(columns, cols, strict=True))):
                yield from emit(pa.Table.from_batches([*rest, batch.slice(0, at)]))
                rest = []
            elif at:
                yield from emit(pa.Table.from_batches([batch.slice(0, at)]))
            rest.append(batch.slice(at))
        if rest:
            yield from emit(pa.Table.from_batches(rest))

    return run


#: A pair (a, b), or where `g` is given, an asking row `a` or a candidate `b` of a group that the exact vectors decide.
MATCHES = "a long, b long, g long"


def _matches(k: int, least: float, most: int = PAIRS):
    """Candidate pairs of each bucket, and the groups of rows with too many of them."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        tbl, bucket, key = (table[c].to_numpy() for c in ("tbl", "bucket", "key"))
        own, ask = (table[c].to_numpy(zero_copy_only=False) for c in ("own", "ask"))
        code = np.frombuffer(b"".join(table["code"].to_pylist()), dtype=np.int8).reshape(len(key), -1)
        edges = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(tbl) != 0)) + 1
        pairs, groups = [], []
        for low, high in zip([0, *edges], [*edges, len(key)], strict=True):
            if high - low > 1:
                for a, b, tied in _bucket_pairs(key[low:high], code[low:high], own[low:high], ask[low:high], k, least, most):
                    if tied:
                        # groups whose numbers meet are decided together, which costs time only
                        g = (int(bucket[low]) * 31 + int(tbl[low]) + 0x9E3779B97F4A7C15) % (1 << 63)
                        groups.append((a, b, g))
                    else:
                        pairs.append((a, b))
        if pairs:
            a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], names=["a", "b", "g"])
        for a, b, g in groups:
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64()), pa.array(np.full(len(a), g, np.int64))], names=["a", "b", "g"])
            yield pa.RecordBatch.from_arrays([pa.nulls(len(b), pa.int64()), pa.array(b), pa.array(np.full(len(b), g, np.int64))], names=["a", "b", "g"])

    return _by_group(["tbl", "bucket"], emit)


def _decided(k: int):
    """The 2 k + 6 best candidates of each asking row of a group (g, key, ask, v), by the exact vectors."""

    def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
        every = table["g"].to_numpy()
        edges = np.flatnonzero(np.diff(every)) + 1
        for low, high in zip([0, *edges], [*edges, len(every)], strict=True):
            part = table.slice(low, high - low).combine_chunks()
            key, ask = part["key"].to_numpy(), part["ask"].to_numpy(zero_copy_only=False)
            v = matrix(part["v"].combine_chunks())
            base, asking = np.flatnonzero(~ask), np.flatnonzero(ask)
            step = int(np.clip((1 << 22) // max(1, len(base)), 16, 1024))
            for at in range(0, len(asking) if len(base) else 0, step):
                rows = asking[at : at + step]
                s = v[rows] @ v[base].T
                s[key[rows][:, None] == key[base][None, :]] = -2.0
                n = min(2 * k + 6, len(base))
                best = np.argpartition(s, -n, axis=1)[:, -n:]
                r, c = np.nonzero(np.take_along_axis(s, best, 1) > -1.5)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows[r]]), pa.array(key[base[best[r, c]]])], names=["a", "b"])

    return _by_group(["g"], emit)


def nearest(
    df: DataFrame, key: str, vector: str, k: int, least: float = -1.0, asking: str | None = None, recall: float = RECALL, cosine: float | None = None, exact: bool = False, hot: int = HOT, digits: tuple[int, ...] = DIGITS
) -> DataFrame:
    """a, b, cosine, place: for each key its `k` most similar other keys with cosine >= `least`, as far as found.

    A pair of the cosine `cosine` is found with the chance `recall`, a closer pair more often; it is `least` by default
    or, where that is below COSINE, where the k-th neighbours usually are (`usual_cosine`). `exact` compares all asking rows with all rows, in blocks, and finds them all.
    `asking` is a SQL condition on the BIGINT `key` (named "key") for the vectors that ask; all are asked for. Cosines
    equal to 12 decimals are ordered by key. Null, empty, zero and non-finite vectors and those of another length take no part;
    repeated rows of one key count once; other columns are ignored; an empty table gives no row.

    Vectors of equal direction (to 6 decimals) are one class: the neighbours of a class are found once, and a member
    of a class of more than k has its neighbours among the class's first k + 1 members, so copies cost k rows each.
    """
    unit = usable(df, key, vector)
    unit = cut(unit.select("key", "v", "norm", "c1", "c2"))
    cls = ["c1", "c2"]
    first = Window.partitionBy(*cls).orderBy("key")
    few = unit.select("key", *cls).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)
    reps = unit.select("key", "v", "norm", *cls).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
    delegates = few.groupBy(*cls).agg(F.sort_array(F.collect_list("key")).alias("some"))
    sizes = unit.groupBy(*cls).agg(F.count("*").alias("members"), F.max(F.expr(asking or "true")).alias("ask"))
    classes = reps.join(sizes, cls).join(delegates, cls)  # all by class: the vectors travel once
    # a class of more than k members needs no neighbours but its own
    classes = cut(classes.withColumn("ask", F.col("ask") & (F.col("members") <= k)))
    facts = classes.agg(F.count("*").alias("n"), F.count_if("ask").alias("asks"), F.max(F.size("v")).alias("width")).first()
    rows = classes.select("key", "ask", "v")
    if exact:
        entries = _blocks(cut(rows.mapInArrow(_one_bucket, ENTRIES)), hot)
    else:
        if cosine is None:
            cosine = least if least >= COSINE else max(least, usual_cosine(rows, k))
        plan = plan_for(facts["n"], facts["width"] or 1, cosine, recall, facts["asks"] / max(1, facts["n"]), digits)
        entries = rows.mapInArrow(_hash_rows(plan.tables, plan.digits, plan.probes), ENTRIES)
        counts = rows.mapInArrow(_bucket_counts(plan.tables, plan.digits), "tbl int, bucket long, members long")
        entries = _cooled(entries, counts, hot, plan.repeats)
    entries = entries.repartition("tbl", "bucket").sortWithinPartitions("tbl", "bucket")
    matches = cut(entries.mapInArrow(_matches(k, least), MATCHES))
    members = matches.where("g is not null").select("g", F.coalesce("a", "b").alias("key"), F.col("a").isNotNull().alias("ask")).distinct()
    tied = members.join(classes.select("key", "v"), "key").select("g", "key", "ask", "v").repartition("g").sortWithinPartitions("g")
    pairs = matches.where("g is null").select("a", "b").unionByName(tied.mapInArrow(_decided(k), "a long, b long")).distinct()
    va, vb = classes.select(F.col("key").alias("a"), F.col("v").alias("va"), F.col("norm").alias("na")), classes.select(F.col("key").alias("b"), F.col("v").alias("vb"), F.col("norm").alias("nb"), F.col("some").alias("b_some"))
    dot = F.aggregate(F.zip_with("va", "vb", lambda x, y: (x.cast("double") / F.col("na")) * (y.cast("double") / F.col("nb"))), F.lit(0.0), lambda s, x: s + x)
    scored = pairs.join(va, "a").join(vb, "b").select("a", "b_some", dot.alias("cosine")).where(F.col("cosine") >= least)
    # members: neighbours in other classes, then in their own
    mine = unit.select("key", *cls).where(F.expr(asking or "true")).join(classes.select(F.col("key").alias("a"), *cls, "some", "members"), cls)
    outer = mine.where(F.col("members") <= k).select("key", "a").join(scored, "a").select("key", F.explode("b_some").alias("b"), "cosine")
    inner = mine.where("members > 1").select("key", F.explode("some").alias("b"), F.lit(1.0).alias("cosine")).where("key <> b")
    both = outer.unionByName(inner.where(F.col("cosine") >= least))
    best = Window.partitionBy("key").orderBy(F.round("cosine", 12).desc(), "b")
    return both.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select(F.col("key").alias("a"), "b", "cosine", "place")
