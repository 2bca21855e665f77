"""One ranking from several differently scaled scores (robust rank aggregation).

Every score list of a group is turned into places and normalised ranks, so scales vanish. For each item the
normalised ranks over the m lists are sorted; under chance the k-th smallest of m uniform ranks follows a beta
distribution, so P(k) = sum over j >= k of C(m, j) r^j (1-r)^(m-j) says how surprising the item's k-th best rank is.
rho is the smallest P(k) corrected for m looks, and items are ordered by it. An item missing from a list has
normalised rank 1 there. The same rows carry the reciprocal-rank score for consumers that are bound to that formula.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import cut

#: Groups above this many items are ordered by range-partitioned tasks instead of one window task.
HOT_GROUP = 200_000


def _numbered(rows: DataFrame, group: str, order: list[Column], tasks: int) -> DataFrame:
    """`rows` with `place`, its position within `group`, without gathering a group into one task.

    Rows are range-partitioned on (group, order); each task numbers its own rows and the counts of earlier tasks
    (one number per task and group) are added.
    """
    spread = rows.repartitionByRange(tasks, F.col(group), *order).sortWithinPartitions(F.col(group), *order)
    schema = T.StructType([*rows.schema.fields, T.StructField("_task", T.IntegerType()), T.StructField("_local", T.LongType())])
    at = rows.columns.index(group)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        last, n = object(), 0
        for batch in batches:
            local = []
            for g in batch.column(at).to_pylist():
                n = n + 1 if g == last else 1
                last = g
                local.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(local), pa.int32()), pa.array(local, pa.int64())], names=[*batch.schema.names, "_task", "_local"])

    done = cut(spread.mapInArrow(number, schema))
    counts = done.groupBy(group, "_task").agg(F.max("_local").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return done.join(before.drop("_n"), [group, "_task"]).withColumn("place", F.col("_local") + F.col("_before")).drop("_task", "_local", "_before")


def places(rows: DataFrame, group: str, order: list[Column], hot_group: int = HOT_GROUP) -> DataFrame:
    """`rows` with `place` (BIGINT from 1 within `group` by `order`); groups above `hot_group` rows are spread."""
    hot = rows.groupBy(group).count().where(F.col("count") > hot_group).select(group)
    window = Window.partitionBy(group).orderBy(*order)
    if hot.isEmpty():
        return rows.withColumn("place", F.row_number().over(window).cast("bigint"))
    hot = cut(hot)  # at most rows / hot_group rows, and no more than that is ever joined
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mild = rows.join(hot, group, "left_anti").withColumn("place", F.row_number().over(window).cast("bigint"))
    return mild.unionByName(_numbered(rows.join(hot, group, "left_semi"), group, order, tasks))


def beta_tail(k: int, m: int, r: Column) -> Column:
    """P(the k-th smallest of m uniform values <= r)."""
    return reduce(lambda a, b: a + b, [F.lit(float(comb(m, j))) * F.pow(r, F.lit(float(j))) * F.pow(1.0 - r, F.lit(float(m - j))) for j in range(k, m + 1)])


def aggregate_ranks(df: DataFrame, group: str, item: str, scores: list[str], constant: float = 60.0, hot_group: int = HOT_GROUP) -> DataFrame:
    """One row per group and item: place_i and rank_i of every score, rho, rra_place, rrf.

    Repeated rows count once, with the largest score delivered. Null and NaN scores mean "not in that list"; an item
    in no list keeps rho 1 and rrf 0. Equal scores are ordered by item. Rows with a null group or item are dropped,
    as they name no item. Columns of `df` other than those named are ignored; an empty input gives no row.
    """
    clean = [F.when(~F.isnan(F.col(s).cast("double")), F.col(s).cast("double")) for s in scores]
    once = df.select(F.col(group).alias("_g"), F.col(item).alias("_i"), *[c.alias(f"_s{n}") for n, c in enumerate(clean)])
    once = once.where("_g is not null and _i is not null").groupBy("_g", "_i").agg(*[F.max(f"_s{n}").alias(f"_s{n}") for n in range(len(scores))])
    m = len(scores)
    sizes = once.groupBy("_g").agg(*[F.count(f"_s{n}").alias(f"_n{n}") for n in range(m)], F.count("*").alias("_all"))
    hot = not sizes.where(F.col("_all") > hot_group).isEmpty()
    if not hot:
        w = Window.partitionBy("_g")
        for n in range(m):
            put = F.row_number().over(w.orderBy(F.col(f"_s{n}").desc_nulls_last(), F.col("_i")))
            once = once.withColumn(f"_p{n}", F.when(F.col(f"_s{n}").isNotNull(), put).cast("bigint")).withColumn(f"_n{n}", F.count(f"_s{n}").over(w))
    else:
        for n in range(m):
            listed = places(once.where(F.col(f"_s{n}").isNotNull()), "_g", [F.col(f"_s{n}").desc(), F.col("_i")], hot_group).withColumnRenamed("place", f"_p{n}")
            once = listed.unionByName(once.where(F.col(f"_s{n}").isNull()).withColumn(f"_p{n}", F.lit(None).cast("bigint")))
        once = once.join(sizes.drop("_all"), "_g")
    ranks = F.array_sort(F.array(*[F.coalesce(F.col(f"_p{n}") / F.col(f"_n{n}"), F.lit(1.0)) for n in range(m)]))
    once = once.withColumn("_r", ranks)
    best = F.least(*[beta_tail(k, m, F.element_at("_r", k)) for k in range(1, m + 1)]) if m > 1 else F.element_at("_r", 1)
    once = once.withColumn("rho", F.round(F.least(F.lit(1.0), best * float(m)), 9))
    rrf = reduce(lambda a, b: a + b, [F.coalesce(1.0 / (constant + F.col(f"_p{n}")), F.lit(0.0)) for n in range(m)])
    once = once.withColumn("rrf", rrf)
    ranked = places(once, "_g", [F.col("rho"), F.col("rrf").desc(), F.col("_i")], hot_group).withColumnRenamed("place", "rra_place") if hot else once.withColumn(
        "rra_place", F.row_number().over(Window.partitionBy("_g").orderBy("rho", F.col("rrf").desc(), "_i")).cast("bigint")
    )
    named = [c for n, s in enumerate(scores) for c in (F.col(f"_p{n}").alias(f"{s}_place"), F.element_at("_r", n + 1).alias(f"rank_{n + 1}"))]
    return ranked.select(F.col("_g").alias(group), F.col("_i").alias(item), *named, "rho", "rra_place", "rrf")


def top_by(df: DataFrame, group: str, item: str, score: str, k: int) -> DataFrame:
    """The first `k` items of each group by `score` descending, then `item`.

    Each task keeps its own first k per salted share of a group, so a hot group is never gathered: only
    k rows per share meet in the last window.
    """
    order = [F.col(score).desc(), F.col(item)]
    shares = df.withColumn("_share", F.pmod(F.xxhash64(item), F.lit(32)))
    kept = shares.withColumn("_n", F.row_number().over(Window.partitionBy(group, "_share").orderBy(*order))).where(F.col("_n") <= k)
    return kept.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("_n") <= k).drop("_share", "_n")
