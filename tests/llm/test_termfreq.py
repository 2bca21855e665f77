from collections import Counter

from pyspark.sql import functions as F

from tidemark.llm.termfreq import merge_counts, partial_counts, term_counts, terms_of

SCHEMA = "id long, head string, body string, kind string, term string, n string"


def rows(spark):
    data = [(i, f"Common word{i} x", None if i % 3 else "Ünïcode 3½ x", " News " if i % 2 else "", "t", "n") for i in range(40)]
    data += [(1, *data[1][1:]), (None, "lost", "lost", "lost", "t", "n"), (99, "", "", None, "t", "n"), (100, "long " * 50_000, "", "  ", "t", "n")]
    return spark.createDataFrame(data, SCHEMA), [r for r in dict.fromkeys(data) if r[0] is not None]


def brute(data):
    n, r = Counter(), Counter()
    for row in data:
        for field, text in (("head", row[1]), ("body", row[2])):
            words = terms_of(text or "")
            n.update((field, w) for w in words)
            r.update({(field, w) for w in words})
        if row[3] and row[3].strip():
            n["kind", row[3].strip().lower()] += 1
            r["kind", row[3].strip().lower()] += 1
    total = len(data)
    mark = lambda k: "rare" if r[k] <= 2 else "common" if r[k] >= 0.05 * total else None
    return {(*k, n[k], r[k], mark(k)) for k in n}


def test_counts_equal_brute_force(spark):
    df, data = rows(spark)
    got = term_counts(df, "id", ["head", "body"], ["kind"])
    assert got.columns == ["field_name", "term", "n", "n_records", "mark"]
    assert set(map(tuple, got.collect())) == brute(data)


def test_splitting_oversized_partitions_changes_nothing(spark):
    df, _ = rows(spark)
    partial = partial_counts(df.select("id", "head", "body", "kind"), ["head", "body"], ["kind"])
    want = set(map(tuple, merge_counts(partial).collect()))
    for leaf in (1, 3):
        assert set(map(tuple, merge_counts(partial.repartition(7), 1, 2, leaf).collect())) == want


def test_empty_and_blank_tables(spark):
    df, _ = rows(spark)
    assert term_counts(df.limit(0), "id", ["head"], ["kind"]).count() == 0
    blank = df.withColumn("head", F.lit(None).cast("string")).withColumn("kind", F.lit(" "))
    assert term_counts(blank, "id", ["head"], ["kind"]).count() == 0


def test_terms_are_runs_of_letters_and_figures():
    assert terms_of("Don't_stop 2½x É́a 東京-tower") == ["don", "t", "stop", "2½x", "é", "a", "東京", "tower"]
