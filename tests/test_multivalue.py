import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.operators.multivalue import packed_values, parse_values, split_values

CASES = {
    "Ann Lee": ["Ann Lee"],
    "Ann Lee, Bo Ray and Cy Poe": ["Ann Lee", "Bo Ray", "Cy Poe"],
    "Ann Lee; and Bo Ray": ["Ann Lee", "Bo Ray"],
    "Ann Lee AND Bo Ray with Cy": ["Ann Lee", "Bo Ray", "Cy"],
    "Ann / Bo | Cy & Di\nEd": ["Ann", "Bo", "Cy", "Di", "Ed"],
    '"Lee, Ann"; Bo': ["Lee, Ann", "Bo"],
    "'Founder & Director', Bo": ["Founder & Director", "Bo"],
    '"Ann ""Nan"" Lee" | Bo': ['Ann "Nan" Lee', "Bo"],
    '"Ann \\"Nan\\" Lee" and Bo': ['Ann "Nan" Lee', "Bo"],
    "Rosa O'Neil, 'Lee, A.'": ["Rosa O'Neil", "Lee, A."],
    "[x, y]; (a and b) | z": ["x, y", "a and b", "z"],
    ", Ann ,; Bo,": ["Ann", "Bo"],
    "Andy Sandand, Mandy Withers": ["Andy Sandand", "Mandy Withers"],
    "Ann and": ["Ann"],
    "and": [],
    ' "" , \'\' ,': [],
    "Ann Lee  Ray,Bo": ["Ann Lee  Ray", "Bo"],
}


@pytest.mark.parametrize("text", CASES)
def test_values(text):
    assert [v for v, _ in parse_values(text)] == CASES[text]


def test_malformed_quotes_are_read_again_as_bare_text_and_flagged():
    assert parse_values('"Lee, Ann') == [('"Lee', "malformed_quote"), ("Ann", "")]
    assert parse_values('"a" b, c') == [('"a" b', "malformed_quote"), ("c", "")]
    assert parse_values("(a, b") == [("(a", "malformed_bracket"), ("b", "")]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab ,;&|/'\"\\\n", min_size=1).map(str.strip).filter(bool), min_size=1, max_size=5), st.sampled_from([", ", ";", " | ", " and ", "\n", "; and "]))
def test_quoted_values_come_back(values, separator):
    packed = separator.join('"' + v.replace("\\", "\\\\").replace('"', '""') + '"' for v in values)
    assert parse_values(packed) == [(v, "") for v in values]


@settings(max_examples=200, deadline=None)
@given(st.text("ab ,;&|/'\"[](){}\\\nandwith", max_size=40))
def test_any_text_is_read_to_its_end(text):
    assert all(v == v.strip() and v for v, _ in parse_values(text))


@pytest.mark.parametrize("piece", ["'a,", "(a,", '"a""', '"x"",', "a   ", "[", "'a''", "x" + " " * 50])
def test_long_malformed_fields_take_linear_time(piece):
    text = piece * 40_000
    start = time.monotonic()
    assert len(parse_values(text + ",z")) >= 1
    assert time.monotonic() - start < 5


def test_no_packed_field_is_passed_over(spark):
    rows = [(1, "Ann Lee\u00a0and\u00a0Bob Ray"), (2, "a\x1cand\x1cb"), (3, "c\u2003WITH\u2003d"), (4, "Sandy Andrews")]
    found = packed_values(spark.createDataFrame(rows, "id long, who string"), "id", "who")
    assert sorted((r.id, r.item) for r in found.collect()) == [(1, "Ann Lee"), (1, "Bob Ray"), (2, "a"), (2, "b"), (3, "c"), (3, "d")]


def test_rows(spark):
    rows = [(1, "a, b", "x"), (1, "a, b", "x"), (2, None, "x"), (3, "", "x"), (4, "c", "x"), (5, " ; ", "x"), (6, "d and " * 20000 + "e", "x")]
    df = spark.createDataFrame(rows, "id long, who string, item string")
    every = split_values(df, "id", "who")
    assert every.columns == ["id", "item_pos", "item", "flag", "n_items"]
    assert sorted((r.id, r.item_pos, r.item) for r in every.where("id < 6").collect()) == [(1, 1, "a"), (1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (4, 1, "c")]
    assert every.where("id = 6").count() == 20001
    packed = packed_values(df, "id", "who")
    assert sorted((r.id, r.item_pos, r.item) for r in packed.where("id < 6").collect()) == [(1, 1, "a"), (1, 2, "b")]
    assert packed_values(df.limit(0), "id", "who").count() == 0


def test_string_keys(spark):
    df = spark.createDataFrame([("k", "a|b")], "key string, v string")
    assert [tuple(r) for r in split_values(df, "key", "v").orderBy("item_pos").collect()] == [("k", 1, "a", "", 2), ("k", 2, "b", "", 2)]
