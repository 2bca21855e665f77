import random
from math import comb

import pytest
from pyspark.sql import functions as F

from tidemark.llm.rankagg import aggregate_ranks, places, top_by


def brute(rows, m=2):
    best = {}
    for g, i, *s in rows:
        if g is None or i is None:
            continue
        old = best.setdefault((g, i), [None] * m)
        for n, x in enumerate(s):
            if x is not None and x == x and (old[n] is None or x > old[n]):
                old[n] = x
    out = {}
    for g in {k[0] for k in best}:
        items = {i: s for (h, i), s in best.items() if h == g}
        place = [{i: p for p, i in enumerate(sorted((i for i in items if items[i][n] is not None), key=lambda i: (-items[i][n], i)), 1)} for n in range(m)]
        for i in items:
            r = sorted(place[n][i] / len(place[n]) if i in place[n] else 1.0 for n in range(m))
            p = min(sum(comb(m, j) * r[k - 1] ** j * (1 - r[k - 1]) ** (m - j) for j in range(k, m + 1)) for k in range(1, m + 1))
            out[g, i] = (min(1.0, m * p), sum(1 / (60 + place[n][i]) for n in range(m) if i in place[n]))
    return out


def sample(spark):
    rng = random.Random(3)
    rows = [(g, i, None if rng.random() < 0.3 else rng.choice([1.0, 2.0, 900.0, rng.random()]), None if rng.random() < 0.3 else rng.random() / 50) for g in range(6) for i in range(1 + 9 * g)]
    rows += rows[:20] + [(None, 1, 1.0, 1.0), (1, None, 1.0, 1.0), (7, 1, None, None), (8, 1, float("nan"), 0.5)]
    return rows, spark.createDataFrame([(*r, 0.0, 1) for r in rows], "g long, i long, a double, b double, rho double, place int")


@pytest.mark.parametrize("hot", [1_000_000, 5])
def test_equals_brute_force_with_and_without_hot_groups(spark, hot):
    rows, df = sample(spark)
    want = brute(rows)
    got = {(r.g, r.i): (r.rho, r.rrf, r.rra_place) for r in aggregate_ranks(df, "g", "i", ["a", "b"], hot_group=hot).collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k][0] == pytest.approx(want[k][0], abs=2e-9) and got[k][1] == pytest.approx(want[k][1], abs=1e-12)
    for g in {k[0] for k in want}:
        order = sorted((i for h, i in want if h == g), key=lambda i: (round(got[g, i][0], 9), -got[g, i][1], i))
        assert [got[g, i][2] for i in order] == list(range(1, len(order) + 1))


def test_no_score_drowns_the_other(spark):
    rows = [(1, i, 1000.0 * i, 0.001 * (10 - i)) for i in range(1, 10)]
    got = {r.i: r.rho for r in aggregate_ranks(spark.createDataFrame(rows, "g long, i long, a double, b double"), "g", "i", ["a", "b"]).collect()}
    assert got[1] == got[9]


def test_top_and_places(spark):
    df = spark.createDataFrame([(g, i, float(i % 4)) for g in (1, 2) for i in range(300)], "g long, i long, s double")
    assert [(r.g, r.i) for r in top_by(df, "g", "i", "s", 3).orderBy("g", "i").collect()] == [(g, i) for g in (1, 2) for i in (3, 7, 11)]
    order = [F.col("s").desc(), F.col("i")]
    assert sorted(map(tuple, places(df, "g", order, 10).collect())) == sorted(map(tuple, places(df, "g", order).collect()))
    empty = df.limit(0).withColumn("t", F.col("s"))
    assert aggregate_ranks(empty, "g", "i", ["s", "t"]).count() == 0 and top_by(df.limit(0), "g", "i", "s", 3).count() == 0
