import random
from itertools import combinations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.packing import fill_window, pack_items


def frame(spark, sizes):
    return spark.createDataFrame([(i, s, "x", 1) for i, s in enumerate(sizes)], "id long, n long, container string, size int")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 30), min_size=1, max_size=12))
def test_each_container_is_filled_as_well_as_its_first_piece_allows(sizes):
    put = fill_window(sizes, 30)
    left = list(range(len(sizes)))
    for c in range(max(put) + 1):
        mine = [i for i in left if put[i] == c]
        assert sum(sizes[i] for i in mine) <= 30
        first = max(left, key=lambda i: sizes[i])
        rest = [sizes[i] for i in left if i != first]
        best = max(sum(x) for r in range(len(rest) + 1) for x in combinations(rest, r) if sum(x) <= 30 - sizes[first])
        assert sum(sizes[i] for i in mine) == sizes[first] + best
        left = [i for i in left if put[i] != c]
    assert not left


def test_nothing_is_lost_split_or_overfilled(spark):
    rng = random.Random(1)
    sizes = [min(5000, int(rng.expovariate(1 / 200)) + 1) for _ in range(3000)] + [1000, 1001, 2000, 2500, 10_000]
    rows = pack_items(frame(spark, sizes), "id", "n", 1000, window=64).collect()
    whole = {}
    for r in rows:
        assert r.stop - r.start == r.size <= 1000
        whole.setdefault(r.id, []).append((r.start, r.stop))
    for i, s in enumerate(sizes):
        parts = sorted(whole[i])
        assert parts[0][0] == 0 and parts[-1][1] == s and all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert len(parts) == 1 if s <= 1000 else all(b - a == 1000 for a, b in parts[:-1])
    used = {}
    for r in rows:
        used.setdefault(r.container, []).append(r)
    assert all(sum(r.size for r in v) == v[0].used <= 1000 for v in used.values())
    assert sum(sizes) / (1000 * len(used)) > 0.97


def test_dirty_sizes(spark):
    df = spark.createDataFrame([(1, None), (2, 0), (3, -5), (4, 7), (4, 7), (5, 10), (6, 11)], "id long, n long")
    rows = pack_items(df, "id", "n", 10).collect()
    assert sorted((r.id, r.size) for r in rows) == [(1, 0), (2, 0), (3, 0), (4, 7), (4, 7), (5, 10), (6, 1), (6, 10)]
    assert all((r.container is None) == (r.size == 0) for r in rows)
    assert pack_items(df.limit(0), "id", "n", 10).count() == 0


@pytest.mark.parametrize("n", [1, 513])
def test_equal_sizes(spark, n):
    rows = pack_items(frame(spark, [5] * n), "id", "n", 10).collect()
    assert len({r.container for r in rows}) <= n // 2 + 2


def test_repeated_rows_are_items_of_their_own(spark):
    df = spark.createDataFrame([(1, 10), (1, 10), (2, 25), (2, 25), (2, 25)] + [(3, 4)] * 900, "id long, n long")
    rows = pack_items(df, "id", "n", 10, window=16).collect()
    used = {}
    for r in rows:
        used[r.container] = used.get(r.container, 0) + r.size
    assert max(used.values()) <= 10
    assert sum(used.values()) == 20 + 75 + 3600
    assert all(used[r.container] == r.used for r in rows)
