import numpy as np
import pytest

from tidemark.llm.neighbours import buckets, code_error, hadamard, nearest, padded, plan_for

WIDTH = 12


def clustered(n, seed=1, spread=0.12):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 4, WIDTH))
    v = centres[np.arange(n) % len(centres)] + spread * rng.normal(size=(n, WIDTH))
    return {int(i * 3): (v[i] * rng.uniform(0.1, 9)).tolist() for i in range(n)}


def brute(vectors, k, least=-1.0):
    ids = sorted(vectors)
    m = np.array([vectors[i] for i in ids])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    s = m @ m.T
    out = {}
    for a, i in enumerate(ids):
        order = sorted((x for x in range(len(ids)) if x != a and s[a, x] >= least), key=lambda x: (-round(s[a, x], 12), ids[x]))[:k]
        out[i] = [ids[x] for x in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(k, v, "x", 1.0) for k, v in rows], "id long, v array<float>, a string, cosine double")


def recall(got, want):
    hit = sum(len(set(want[i]) & got.get(i, set())) for i in want)
    return hit / max(1, sum(map(len, want.values())))


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.a, set()).add(r.b)
    return out


@pytest.mark.parametrize("n, least, hot", [(300, 0.9, 4096), (300, 0.9, 16), (40, -1.0, 4096)])
def test_recall(spark, n, least, hot):
    vectors = clustered(n)
    near = nearest(frame(spark, vectors.items()), "id", "v", 5, least=least, hot=hot)
    assert recall(found(near), brute(vectors, 5, least)) >= 0.9
    assert near.where("place > 5 or cosine < %f" % least).count() == 0


def test_unusable_and_repeated_rows_and_other_columns(spark):
    vectors = clustered(60)
    bad = [(1001, None), (1002, []), (1003, [0.0] * WIDTH), (1004, [1.0] * (WIDTH - 1)), (1005, [float("nan")] * WIDTH), (1006, [float("inf")] + [0.0] * (WIDTH - 1)), (None, [1.0] * WIDTH)]
    plain = sorted(map(tuple, nearest(frame(spark, vectors.items()), "id", "v", 3, least=0.8).collect()))
    dirty = sorted(map(tuple, nearest(frame(spark, [*vectors.items(), *bad, *list(vectors.items())[:9]]), "id", "v", 3, least=0.8).collect()))
    assert plain == dirty


def test_copies_cost_k_rows_each(spark):
    same = np.random.default_rng(5).normal(size=WIDTH)
    vectors = clustered(40) | {5000 + i: (same * (i + 1)).tolist() for i in range(200)}
    near = nearest(frame(spark, vectors.items()), "id", "v", 5, least=0.9)
    got = found(near.where("a >= 5000"))
    assert got[5000] == {5001, 5002, 5003, 5004, 5005} and got[5199] == {5000, 5001, 5002, 5003, 5004}
    assert near.where("a >= 5000").count() == 1000


def test_asking_rows_only(spark):
    vectors = clustered(200)
    near = nearest(frame(spark, vectors.items()), "id", "v", 5, least=0.9, asking="key % 50 = 0")
    want = {i: b for i, b in brute(vectors, 5, 0.9).items() if i % 50 == 0}
    assert set(found(near)) <= set(want) and recall(found(near), want) >= 0.9


def test_empty_tables(spark):
    assert nearest(frame(spark, [(1, None)]).limit(0), "id", "v", 5).count() == 0
    assert nearest(frame(spark, [(1, None), (2, [0.0])]), "id", "v", 5).count() == 0
    assert nearest(frame(spark, [(1, [1.0, 2.0])]), "id", "v", 5).count() == 0


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 16))
    assert np.linalg.norm(hadamard(x), axis=1) == pytest.approx(np.linalg.norm(x, axis=1))
    assert hadamard(hadamard(x)) == pytest.approx(x)


@pytest.mark.parametrize("spread", [1e-3, 0.2])
def test_a_bucket_that_holds_a_third_of_all_rows(spark, spread):
    rng = np.random.default_rng(9)
    base = rng.normal(size=WIDTH)
    vectors = clustered(200) | {9000 + i: (base + spread * rng.normal(size=WIDTH)).tolist() for i in range(100)}
    near = nearest(frame(spark, vectors.items()), "id", "v", 5, least=0.9, hot=12)
    want = {i: b for i, b in brute(vectors, 5, 0.9).items() if i >= 9000}
    assert recall(found(near.where("a >= 9000")), want) >= 0.9


@pytest.mark.parametrize("hot", [4096, 60])
def test_a_third_of_all_rows_are_jittered_near_copies(spark, hot):
    """They differ above 6 decimals and below the 8-bit step, so their codes are equal."""
    rng = np.random.default_rng(11)
    base = rng.normal(size=WIDTH)
    near = {9000 + i: (base + 1e-4 * rng.normal(size=WIDTH)).tolist() for i in range(300)}
    vectors = {i: np.float32(v).tolist() for i, v in (clustered(600) | near).items()}
    got = found(nearest(frame(spark, vectors.items()), "id", "v", 5, least=0.9, hot=hot).where("a >= 9000"))
    want = {i: b for i, b in brute(vectors, 5, 0.9).items() if i >= 9000}
    assert recall(got, want) >= 0.99


def test_the_error_of_the_codes_is_bounded():
    rng = np.random.default_rng(3)
    for v in (rng.normal(size=(400, 64)), rng.normal(size=(400, 64)) ** 7):
        v /= np.linalg.norm(v, axis=1, keepdims=True)
        code = np.rint(v / np.abs(v).max(axis=1, keepdims=True) * 127)
        unit = code / np.linalg.norm(code, axis=1, keepdims=True)
        error = code_error(code)
        assert (np.abs(unit @ unit.T - v @ v.T) <= error[:, None] + error).all()


@pytest.mark.parametrize("n", [10_000, 3_000_000, 400_000_000, 10**11])
@pytest.mark.parametrize("cosine, recall", [(0.85, 0.99), (0.6, 0.9)])
def test_planned_tables_reach_the_recall_at_every_size(n, cosine, recall):
    """Pairs of just that cosine, made apart from those the plan is measured on, meet in some table of the plan."""
    plan = plan_for(n, 64, cosine, recall)
    rng = np.random.default_rng(77)
    x, y = rng.normal(size=(2, 1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= x * (x * y).sum(axis=1, keepdims=True)
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    x, y = padded(x.astype(np.float32)), padded(y.astype(np.float32))
    met = np.zeros(1500, bool)
    for t in range(plan.tables):
        (a, pa_), (b, pb) = buckets(x, t, plan.digits, plan.probes), buckets(y, t, plan.digits, plan.probes)
        met |= (a == b) | (pa_ == b[:, None]).any(axis=1) | (pb == a[:, None]).any(axis=1)
    assert met.mean() >= recall - 0.02


@pytest.mark.parametrize("digits", [(1,), (2,), (3,), (4,)])
def test_recall_with_any_number_of_digits(spark, digits):
    vectors = clustered(400)
    near = nearest(frame(spark, vectors.items()), "id", "v", 5, least=0.85, digits=digits)
    assert recall(found(near), brute(vectors, 5, 0.85)) >= 0.9


def test_all_rows_asking_without_a_bound(spark):
    vectors = clustered(600, spread=0.4)
    assert recall(found(nearest(frame(spark, vectors.items()), "id", "v", 5)), brute(vectors, 5)) >= 0.9


@pytest.mark.parametrize("hot", [4096, 30])
def test_exact_neighbours_are_those_of_brute_force(spark, hot):
    vectors = clustered(150, spread=0.5)
    near = nearest(frame(spark, vectors.items()), "id", "v", 4, exact=True, asking="key % 6 = 0", hot=hot)
    assert {a: sorted(b) for a, b in found(near).items()} == {i: sorted(b) for i, b in brute(vectors, 4).items() if i % 6 == 0}
