import random

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm.truncation import features, fit_model, source_limits, truncate, truncated, truncated_copies

RNG = random.Random(8)
NOUNS = "harbour bridge market tunnel school library garden vaccine border ferry census museum".split()
VERBS = "opened closed praised delayed moved ignored".split()


def sentence():
    return f"The {RNG.choice(NOUNS)} near {RNG.choice('ABCDEFGH')}{RNG.choice(['ton', 'ville', 'burg'])} {RNG.choice(VERBS)} the {RNG.choice(NOUNS)} after {RNG.randint(2, 99)} days."


def text():
    kind = RNG.random()
    if kind < 0.15:
        return f"Photographs of {RNG.choice('ABCDEFGH')}ton in {RNG.choice(['May', 'June', 'July'])}"
    body = " ".join(sentence() for _ in range(RNG.randint(1, 4)))
    return body[:-1] if kind < 0.2 else body


def corpus(n=4000):
    rows, cut = [], set()
    for i in range(n):
        t = text()
        source = RNG.choice(["limited", "whole", "marked"])
        if source == "limited" and len(t) > 100:
            short = t[:100]
            if short.rstrip() != t.rstrip() and not short.endswith("."):
                t = short
                cut.add(i)
        elif source == "marked" and len(t) > 90 and RNG.random() < 0.3:
            t = t[: t[:88].rfind(" ")] + "…"
            cut.add(i)
        rows.append(("t", source, i, t, None))
    return rows, cut


SCHEMA = "tbl string, source string, row_id long, text string, parent string"


def test_held_out_accuracy(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    fitted = df.where("row_id % 2 = 0")
    model = fit_model(fitted, sample=3000)
    assert set(model.limits.get("limited", {})) == {100}
    got = {r.row_id for r in truncated(df.where("row_id % 2 = 1"), model).where("cut").collect()}
    want = {i for i in truth if i % 2}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.9


def test_a_parent_that_goes_on_proves_the_cut(spark):
    rows, _ = corpus(600)
    df = spark.createDataFrame(rows, SCHEMA)
    model = fit_model(df)
    odd = [
        ("c", "w", 1, "It ended here.", "It ended here. But went on."),
        ("c", "w", 2, "It ended here.", "It ended here."),
        ("c", None, 3, "It ended here.", None),
        ("c", "w", 4, None, "x"),
        ("c", "w", 5, "", "x"),
        ("c", "w", 6, " \n", "x"),
        ("c", "w", 7, "It ended here.", "It ended here.  "),
        ("c", "w", 8, "word " * 40_000 + "end.", None),
    ]
    got = {r.row_id: r.cut for r in truncated(spark.createDataFrame(odd, SCHEMA), model).collect()}
    assert got.keys() == {1, 2, 3, 7, 8} and got[1] and not got[2] and not got[3] and not got[7]


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = fit_model(empty)
    assert truncated(empty, model).count() == 0
    one = spark.createDataFrame([("t", "s", 1, "One finished text here.", None)], SCHEMA)
    assert truncated(one, fit_model(one)).count() == 1
    assert truncated(one.withColumn("text", F.lit(None).cast("string")), model).count() == 0


def test_limits_are_piles_of_lengths():
    even = [("s", n, 10) for n in range(40, 100)]
    assert source_limits(even) == {}
    assert set(source_limits([*even, ("s", 100, 300)])["s"]) == {100}


def test_artificial_cuts_are_proper_prefixes():
    rng = np.random.default_rng(1)
    whole = " ".join(sentence() for _ in range(3))
    for _ in range(300):
        if (short := truncate(whole, [60, 90], rng)) is not None:
            body = short.replace("…", "").removesuffix("...").rstrip()
            assert whole.startswith(body) and len(body) < len(whole) - 1
    assert truncate("too short", [], rng) is None


def test_features_of_odd_texts():
    for t in (" ", "\ud800", "…", "a" * 100_000, "(“"):
        assert len(features(t, {})) == len(features("x", {}))


def test_whole_words_are_those_of_all_rows_not_of_the_sample(spark):
    rows, _ = corpus(2000)
    rare = [("t", "whole", 5000 + i, f"The seldom{'abcdefghij'[i // 3]} gate near Aton opened the bridge.", None) for i in range(30)]
    df = spark.createDataFrame(rows + rare, SCHEMA)
    broadcast, joined = fit_model(df, sample=300), fit_model(df, sample=300, most_words=5)
    assert {f"seldom{c}" for c in "abcdefghij"} <= broadcast.words_known
    assert joined.words is not None and {r.word for r in joined.words.collect()} == broadcast.words_known
    assert (broadcast.weights == joined.weights).all()
    scores = [sorted((r.row_id, r.p, r.cut) for r in truncated(df, m).collect()) for m in (broadcast, joined)]
    assert scores[0] == scores[1]


def test_copies_share_the_verdict_of_their_record(spark):
    rows, _ = corpus(1500)
    model = fit_model(spark.createDataFrame(rows, SCHEMA))
    stored = spark.createDataFrame([("c", "f", i, t) for i, t in enumerate(sorted({r[3] for r in rows if r[3] and r[3].strip()})[:300])] * 2, "tbl string, source string, row_id long, text string")
    copies = stored.selectExpr("'d' AS tbl", "'worker' AS source", "row_id + 10000 AS row_id", "text", "row_id AS parent_id").where("row_id % 3 <> 0")
    cuts = spark.createDataFrame([("d", "worker", 99999, "It ended her", 1_000_000)], copies.schema)
    long = spark.createDataFrame([("c", "f", 1_000_000, "It ended here in the end.")], stored.schema)
    got = {(r.tbl, r.row_id): r.cut for r in truncated_copies(stored.unionByName(long), copies.unionByName(cuts), model).collect()}
    assert got["d", 99999]
    mine = {i: c for (t, i), c in got.items() if t == "c"}
    assert any(mine.values()) and not all(mine.values())
    assert all(c == mine[i - 10000] for (t, i), c in got.items() if t == "d" and i != 99999)
