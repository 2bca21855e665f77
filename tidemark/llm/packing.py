"""Fill fixed-capacity containers with items of varying length: minimum bin slack.

Oversized items are cut into full containers and one remainder. The remaining pieces are dealt at random into
windows of a bounded number of pieces. Within a window one container is filled at a time: the largest piece left
opens it, then a subset-sum table over the multiset of remaining lengths (one big integer per length, bit s = "sum s
can be reached") finds the fill closest to capacity, and walking back through the tables gives how many pieces of
each length to take. Containers that stay loosely filled give their pieces to a second round of windows.

Only ids and lengths travel; texts stay where they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut

#: Tokens a container holds.
CAPACITY = 4096
#: Pieces per window: a window's work is bounded whatever the corpus.
WINDOW = 512
#: Containers filled below this share go to the second round.
LOOSE = 0.98

#: Windows that one task fills at most, where the session's number of shuffle partitions would give it more.
TASK_WINDOWS = 2000

PIECES = "row long, item long, piece int, start long, stop long, size int"


def fill_window(sizes: list[int], capacity: int) -> list[int]:
    """Container number (from 0) of each piece; every size is between 1 and `capacity`."""
    stacks: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        stacks.setdefault(s, []).append(i)
    put = [0] * len(sizes)
    bin_no = 0
    while stacks:
        first = max(stacks)
        put[stacks[first].pop()] = bin_no
        if not stacks[first]:
            del stacks[first]
        room = capacity - first
        lengths = sorted((s for s in stacks if s <= room), reverse=True)
        # tables[j]: sums reachable with the first j (length, count) parts; counts go in binary parts
        mask, reach, steps = (1 << (room + 1)) - 1, 1, []
        full = 1 << room
        for s in lengths:
            left, part = min(len(stacks[s]), room // s), 1
            while left > 0 and not reach & full:
                take = min(part, left)
                steps.append((s, take, reach))
                reach |= (reach << (s * take)) & mask
                left -= take
                part *= 2
            if reach & full:
                break
        at = reach.bit_length() - 1
        for s, take, before in reversed(steps):
            if not before >> at & 1:
                at -= s * take
                for _ in range(take):
                    put[stacks[s].pop()] = bin_no
                if not stacks[s]:
                    del stacks[s]
        bin_no += 1
    return put


def _fill(pieces: DataFrame, capacity: int, window: int, seed: int, name: str) -> DataFrame:
    """`pieces` with `container` (unique string) and `used` (size of its content)."""
    spark = pieces.sparkSession
    n = pieces.count()
    windows = max(1, -(-n // window))
    tasks = max(1, min(windows, int(spark.conf.get("spark.sql.shuffle.partitions"))), windows // TASK_WINDOWS)
    dealt = pieces.withColumn("_w", F.pmod(F.xxhash64("row", "piece", F.lit(seed)), F.lit(windows)))
    dealt = dealt.repartition(tasks, "_w").sortWithinPartitions("_w", "row", "piece")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for frame in frames:
            frame = frame if rest is None else pd.concat([rest, frame])
            last = frame["_w"].iloc[-1] if len(frame) else None
            rest = frame[frame["_w"] == last]
            for _, part in frame[frame["_w"] != last].groupby("_w", sort=False):
                yield pack(part)
        if rest is not None and len(rest):
            yield pack(rest)

    def pack(part: pd.DataFrame) -> pd.DataFrame:
        put = fill_window(part["size"].tolist(), capacity)
        out = part.drop(columns="_w").assign(_c=put)
        out["used"] = out.groupby("_c")["size"].transform("sum").astype("int32")
        out["container"] = [f"{name}{w}-{c}" for w, c in zip(part["_w"], put, strict=True)]
        return out.drop(columns="_c")

    return dealt.mapInPandas(run, f"{PIECES}, used int, container string")


def pack_items(df: DataFrame, key: str, size: str, capacity: int = CAPACITY, window: int = WINDOW, loose: float = LOOSE) -> DataFrame:
    """One row per piece: `key`, piece (from 0), start, stop, size, container, used.

    `size` is the item's length; [start, stop) is the part of it in this container. Items within `capacity` are one
    piece. A null or negative size counts as 0 and an item of size 0 gets a row with no container (there is nothing to
    store). Repeated rows are separate items: rows are numbered once, in a checkpoint, and containers are named and
    dealt by that number, so equal keys neither share a container by name nor crowd a window. `key` must be BIGINT.
    """
    total = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    given = cut(df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("item"), total.alias("total")))
    cuts = F.when(F.col("total") > 0, F.sequence(F.lit(0), ((F.col("total") - 1) / capacity).cast("int"))).otherwise(F.array(F.lit(0)))
    pieces = given.select("row", "item", "total", F.explode(cuts).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece").cast("long") * capacity).withColumn("stop", F.least("total", F.col("start") + capacity))
    pieces = pieces.select("row", "item", "piece", "start", "stop", (F.col("stop") - F.col("start")).cast("int").alias("size"))
    whole = pieces.where(F.col("size") == capacity).select("*", F.col("size").alias("used"), F.concat(F.lit("full-"), F.col("row").cast("string"), F.lit("-"), F.col("piece").cast("string")).alias("container"))
    none = pieces.where(F.col("size") == 0).select("*", F.lit(0).alias("used"), F.lit(None).cast("string").alias("container"))
    open_ = pieces.where((F.col("size") > 0) & (F.col("size") < capacity))
    first = cut(_fill(open_, capacity, window, 1, "a"))
    tight = F.col("used") >= int(loose * capacity)
    second = _fill(first.where(~tight).drop("used", "container"), capacity, window, 2, "b")
    packed = first.where(tight).unionByName(second).unionByName(whole).unionByName(none)
    return packed.drop("row").withColumnRenamed("item", key)
