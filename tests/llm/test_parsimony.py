import math
from collections import Counter

import numpy as np
import pytest

from tidemark.llm.parsimony import distinctive_terms, fit
from tidemark.llm.termfreq import terms_of

TEXTS = {1: ("the cat sat", "the cat"), 2: ("the dog", None), 3: (None, None), 4: ("", "the the unique words"), 5: ("dog dog cat", "the"), 6: ("the", ""), 7: ("w" * 50_000 + " the " * 3000, None), 8: ("dog the", "")}


def frame(spark):
    rows = [(k, a, b, "key", "term") for k, (a, b) in TEXTS.items()]
    return spark.createDataFrame(rows + rows[:2] + [(None, "the", "cat", "", "")], "id long, key string, t0 string, term string, tf string")


def brute():
    tf = {k: Counter(terms_of(a or "") + terms_of(b or "")) for k, (a, b) in TEXTS.items()}
    df = Counter(t for c in tf.values() for t in c)
    return {(k, t): (n, df[t], n * math.log(len(TEXTS) / df[t]) if df[t] > 1 else 0.0) for k, c in tf.items() for t, n in c.items()}


@pytest.mark.parametrize("head", [100_000, 2, 0])
def test_counts_and_weights_with_broadcast_and_joined_background(spark, head):
    got = {(r.id, r.term): r for r in distinctive_terms(frame(spark), "id", ["key", "t0"], head=head).collect()}
    want = brute()
    assert got.keys() == want.keys()
    for k, (tf, df, weight) in want.items():
        assert (got[k].tf, got[k].df) == (tf, df) and got[k].weight == pytest.approx(weight)
    for record in {k[0] for k in want}:
        assert sum(r.p for k, r in got.items() if k[0] == record) == pytest.approx(1.0)


def test_common_terms_lose_their_mass(spark):
    got = {r.term: r.p for r in distinctive_terms(frame(spark), "id", ["key", "t0"]).where("id = 1").collect()}
    assert got["cat"] > got["the"] and got["sat"] > got["the"]


def test_best_terms(spark):
    want = {}
    for (k, t), (_, _, w) in brute().items():
        want.setdefault(k, []).append((w, t))
    best = {k: max(v)[1] for k, v in want.items() if max(v)[0] > 0 and all(max(v)[0] > 1.05 * w for w, t in v if t != max(v)[1])}
    assert {r.id: r.term for r in distinctive_terms(frame(spark), "id", ["key", "t0"], best_only=1.05).collect()} == best


def test_expectation_maximisation_matches_a_plain_loop():
    tf, bg = np.array([3.0, 1.0, 2.0, 5.0]), np.array([0.2, 0.001, 0.05, 0.3])
    p = tf[:3] / 6
    for _ in range(200):
        e = tf[:3] * 0.1 * p / (0.1 * p + 0.9 * bg[:3])
        p = e / e.sum()
    assert fit(tf, bg, np.array([0, 3]), rounds=200, eps=0)[:3] == pytest.approx(p)
    assert fit(tf, bg, np.array([0, 3]))[3] == pytest.approx(1.0)


def test_empty_tables(spark):
    assert distinctive_terms(frame(spark).limit(0), "id", ["key", "t0"]).count() == 0
    assert distinctive_terms(frame(spark).where("id = 3"), "id", ["key", "t0"]).count() == 0
