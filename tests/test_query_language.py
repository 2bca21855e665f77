import pytest

from tidemark.plans.query import QueryError, both, either, free_terms, is_explicit, negated, parse, phrase, scoring_terms, term

a, b, c = term("a"), term("b"), term("c")


@pytest.mark.parametrize(
    "text, tree",
    [
        ("a", a),
        ("a AND b", both(a, b)),
        ("a and b or c", either(both(a, b), c)),
        ("a OR b AND c", either(a, both(b, c))),
        ("NOT a AND b", both(negated(a), b)),
        ("NOT NOT a", negated(negated(a))),
        ("(a OR b) AND NOT c", both(either(a, b), negated(c))),
        ("a b", both(a, b)),
        ('a "b c"', both(a, phrase("b c"))),
        ("a NOT b", both(a, negated(b))),
        ("a OR b OR c", either(either(a, b), c)),
        ("((a))", a),
        ("a(b)", both(a, b)),
        ('foo"bar baz"', both(term('foo"bar'), term('baz"'))),
    ],
)
def test_trees(text, tree):
    assert parse(text) == tree


@pytest.mark.parametrize(
    "text, message",
    [
        ("", "query is empty"),
        ("  \t", "query is empty"),
        ("a AND", "expected query term"),
        ("OR a", "expected query term"),
        ("NOT", "NOT requires an operand"),
        ("(a", "missing closing parenthesis"),
        ("a)", "unexpected token in query"),
        ('"a b', "unterminated query phrase"),
        ('a ""', "empty query phrase"),
    ],
)
def test_errors(text, message):
    with pytest.raises(QueryError, match=message):
        parse(text)


@pytest.mark.parametrize("text, explicit", [("rock and roll", True), ("rock And roll", False), ('say "x"', True), ("f(x)", True), ("band ordinary", False), ("a NOT b", True), ("", False)])
def test_explicit_syntax(text, explicit):
    assert is_explicit(text) is explicit


def test_scoring_terms_come_from_all_leaves_once():
    assert scoring_terms(parse('Dog OR NOT cat AND "cat bird" dog e-mail')) == ["dog", "cat", "bird"]
    assert free_terms("CAT cat Dog e-mail") == ["cat", "dog", "e", "mail"]
