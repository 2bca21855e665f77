import random
import resource

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.llm.leakage import RADIUS, SIZE, STRIDE, Index, fingerprints, leaks, longest_run, matches, normal, weighted_similarity

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdefghij") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def text(n):
    return " ".join(RNG.choice(WORDS) for _ in range(n))


def brute(docs, items, run=40):
    grams = {}
    for k, t in items:
        t = normal(t or "")
        for i in range(len(t) - run + 1):
            grams.setdefault(t[i : i + run], set()).add(k)
    return {(k, j) for k, t in docs for t in [normal(t or "")] for i in range(len(t) - run + 1) for j in grams.get(t[i : i + run], ())}


def corpus():
    items = [(i, text(30)) for i in range(20)] + [(50, None), (51, "short"), (52, ""), (53, "北京" * 30)]
    docs = []
    for d in range(120):
        t = text(40)
        kind = d % 6
        source = items[d % 20][1]
        if kind == 1:
            t += " " + source + " " + text(20)
        elif kind == 2:
            t += " " + source[10:75].upper().replace(" ", "\n-- ") + " " + text(9)
        elif kind == 3:
            at = RNG.randrange(0, 60)
            t += " " + source[at : at + 48] + " " + text(5)
        docs.append((d, t))
    docs += [(500, None), (501, ""), (502, "x" * 100_000), (503, text(20_000) + items[3][1]), (504, "在" + "北京" * 25)]
    return docs, items


@pytest.mark.parametrize("group", [2_000_000, 500])
def test_every_exact_run_is_found(spark, group):
    docs, items = corpus()
    d = spark.createDataFrame([(k, t, "x") for k, t in docs + docs[:9]], "id long, body string, item_key string")
    i = spark.createDataFrame(items + items[:3], "item long, body string")
    found = leaks(d, "id", "body", i, "item", "body", group_chars=group)
    rows = found.collect()
    assert {(r.id, r["item"]) for r in rows if r.run >= 40} == brute(docs, items)
    assert len({(r.id, r["item"]) for r in rows}) == len(rows)
    assert all(r.similarity >= 0.8 for r in rows)


def test_altered_passages_are_found_by_similarity(spark):
    item = text(30)
    altered = " ".join(w if n % 9 else w[:-1] + "z" for n, w in enumerate(item.split()))
    d = spark.createDataFrame([(1, text(50) + " " + altered), (2, text(80))], "id long, t string")
    rows = leaks(d, "id", "t", spark.createDataFrame([(9, item)], "id long, t string"), "id", "t").toDF("d", "i", "windows", "similarity", "run", "whole").collect()
    assert [(r.d, r.i) for r in rows] == [(1, 9)]


def test_blocks_find_all_fingerprints_within_the_radius():
    rng = np.random.default_rng(1)
    index = Index([(1, "".join(RNG.choice("abcdefgh") for _ in range(3000)))])
    for n in range(RADIUS + 3):
        prints = index.prints[::7].copy()
        for i in range(len(prints)):
            for bit in rng.choice(64, n, replace=False):
                prints[i] ^= np.uint64(1) << np.uint64(bit)
        q, w = index.near(prints)
        exact = {(a, b) for a in range(len(prints)) for b in range(len(index.prints)) if bin(int(prints[a] ^ index.prints[b])).count("1") <= RADIUS}
        assert set(zip(q.tolist(), w.tolist())) == exact


def test_strided_windows_are_every_seventh():
    t = normal(text(40_000))
    assert (fingerprints(t, STRIDE) == fingerprints(t, 1)[::STRIDE]).all()
    assert len(fingerprints("a" * (SIZE - 1), STRIDE)) == 0 and len(fingerprints("a" * SIZE, STRIDE)) == 1


def brute_run(a, b):
    best, last = 0, [0] * (len(b) + 1)
    for x in a:
        now = [0] * (len(b) + 1)
        for j, y in enumerate(b, 1):
            if x == y:
                now[j] = last[j - 1] + 1
        best, last = max(best, *now), now
    return best


@settings(max_examples=150, deadline=None)
@given(st.text("ab", max_size=90), st.text("abc", max_size=60))
def test_longest_run_is_the_longest_common_substring(a, b):
    assert longest_run(a, b) == brute_run(a, b)


SHARED = normal(text(40))[:120]


@pytest.mark.parametrize(
    "doc, item",
    [
        (SHARED[:39], SHARED[:39]),
        (SHARED[:38] + "0123", SHARED[:38]),
        ("ab" * 200, "ab" * 60),
        ("0" * 60, "0" * 50),
        ("xy" + SHARED[:45] + "#" + SHARED[46:], SHARED),
        ("9" * 10 + SHARED, SHARED + "8"),
        (SHARED + "77", "5" + SHARED),
        (SHARED[60:] + "00" + SHARED[:60], SHARED),
        ("1234567" * 3 + SHARED[:41], SHARED[:41] + "w"),
    ],
)
def test_runs_of_short_periodic_and_aligned_texts(doc, item):
    found = list(matches([normal(doc)], Index([(1, normal(item))])))
    assert [f[4] for f in found] == [brute_run(normal(doc), normal(item))]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 40), st.integers(0, 80), st.integers(20, 80), st.integers(0, 30))
def test_runs_of_forty_and_no_others_are_reported_as_such(before, at, size, after):
    item = SHARED
    part = item[at : at + size]
    doc = "Q" * before + part + "R" * after
    doc = normal(doc)
    runs = [f[4] for f in matches([doc], Index([(1, item)]))]
    want = brute_run(doc, item)
    assert (runs == [want]) if want >= SIZE + STRIDE - 1 else all(r == want for r in runs)


def test_long_repetitive_texts_need_little_memory():
    index = Index([(1, "0" * 3000), (2, "01" * 2000), (3, SHARED)])
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    found = {f[1]: f[4] for f in matches(["0" * 1_000_000 + "01" * 2000 + SHARED], index)}
    assert found == {0: 3000, 1: 4000, 2: 120}
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 500_000  # KB


def test_altered_passages_of_similarity_0_8_are_found():
    rng = random.Random(8)
    items = [(i, normal(text(rng.randint(25, 60)))) for i in range(40)]
    index = Index(items)
    total = found = 0
    for n in range(400):
        key, item = items[n % 40]
        letters = list(item)
        for _ in range(rng.randint(1, 6)):
            letters[rng.randrange(len(letters))] = rng.choice("klmnopqrst")
        altered = "".join(letters)
        if weighted_similarity(altered, item) < 0.8:
            continue
        total += 1
        hits = {index.keys[f[1]]: f[5] for f in matches([normal(text(40)) + altered + normal(text(40))], index)}
        found += hits.get(key, 0) >= 0.7
    assert total > 150 and found >= 0.98 * total, (found, total)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, text(30))], "id long, t string")
    assert leaks(d.limit(0), "id", "t", d, "id", "t").count() == 0
    assert leaks(d, "id", "t", d.limit(0), "id", "t").count() == 0


def test_the_longest_run_is_found_behind_a_substituted_letter(spark):
    item = normal("".join(RNG.choice(WORDS) for _ in range(90)))[:246]
    leaked = item[:45] + ("z" if item[45] != "z" else "y") + item[46:]
    d = spark.createDataFrame([(1, "0123456" + leaked + "987")], "id long, t string")
    rows = leaks(d, "id", "t", spark.createDataFrame([(9, item)], "id long, t string"), "id", "t").toDF("d", "i", "windows", "similarity", "run", "whole").collect()
    assert [(r.d, r.i, r.run) for r in rows] == [(1, 9, 200)]


def test_texts_looked_up_together_give_what_each_gives_alone():
    docs, items = corpus()
    index = Index([(k, t) for k, t in ((k, normal(t or "")) for k, t in items) if len(t) >= SIZE])
    texts = [normal(t or "") for _, t in docs if len(t or "") < 50_000]
    together = sorted(matches(texts, index))
    alone = sorted((i, *f[1:]) for i, t in enumerate(texts) for f in matches([t], index))
    assert together == alone and len(alone) > 50
