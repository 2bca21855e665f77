"""The query language: words, "phrases", AND, OR, NOT and parentheses; neighbours without an operator mean AND.

    either  <- both (OR both)*
    both    <- prefix (AND? prefix)*
    prefix  <- NOT prefix / atom
    atom    <- word / phrase / '(' either ')'
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from enum import Enum

from ..functions.text import normal_term, tokenise


class QueryError(ValueError):
    """The query text is malformed."""


class Kind(Enum):
    TERM = "TERM"
    PHRASE = "PHRASE"
    AND = "AND"
    OR = "OR"
    NOT = "NOT"


@dataclass(frozen=True)
class Node:
    kind: Kind
    text: str = ""
    parts: tuple[Node, ...] = ()


def term(text: str) -> Node:
    return Node(Kind.TERM, text)


def phrase(text: str) -> Node:
    return Node(Kind.PHRASE, text)


def both(a: Node, b: Node) -> Node:
    return Node(Kind.AND, parts=(a, b))


def either(a: Node, b: Node) -> Node:
    return Node(Kind.OR, parts=(a, b))


def negated(a: Node) -> Node:
    return Node(Kind.NOT, parts=(a,))


_BLANK = " \t\n\v\f\r"


def lex(text: str) -> Iterator[tuple[str, str]]:
    """(kind, text) of each token; kind is TERM, PHRASE, AND, OR, NOT, ( or )."""
    at, end = 0, len(text)
    while at < end:
        ch = text[at]
        if ch in _BLANK:
            at += 1
        elif ch in "()":
            yield ch, ch
            at += 1
        elif ch == '"':
            close = text.find('"', at + 1)
            if close < 0:
                raise QueryError("unterminated query phrase")
            if close == at + 1:
                raise QueryError("empty query phrase")
            yield "PHRASE", text[at + 1 : close]
            at = close + 1
        else:
            stop = at
            while stop < end and text[stop] not in _BLANK and text[stop] not in "()":
                stop += 1
            word = text[at:stop]
            yield (word.upper() if word.upper() in ("AND", "OR", "NOT") else "TERM"), word
            at = stop


def parse(text: str) -> Node:
    """The tree of a query; QueryError where it is malformed."""
    toks = list(lex(text))
    if not toks:
        raise QueryError("query is empty")
    node, at = _either(toks, 0)
    if at < len(toks):
        raise QueryError("unexpected token in query")
    return node


def _kind(toks: list[tuple[str, str]], at: int) -> str:
    return toks[at][0] if at < len(toks) else ""


def _either(toks: list[tuple[str, str]], at: int) -> tuple[Node, int]:
    node, at = _both(toks, at)
    while _kind(toks, at) == "OR":
        right, at = _both(toks, at + 1)
        node = either(node, right)
    return node, at


def _both(toks: list[tuple[str, str]], at: int) -> tuple[Node, int]:
    node, at = _prefix(toks, at)
    while (kind := _kind(toks, at)) in ("AND", "TERM", "PHRASE", "NOT", "("):
        right, at = _prefix(toks, at + (kind == "AND"))
        node = both(node, right)
    return node, at


def _prefix(toks: list[tuple[str, str]], at: int) -> tuple[Node, int]:
    if _kind(toks, at) == "NOT":
        if at + 1 >= len(toks):
            raise QueryError("NOT requires an operand")
        node, at = _prefix(toks, at + 1)
        return negated(node), at
    return _atom(toks, at)


def _atom(toks: list[tuple[str, str]], at: int) -> tuple[Node, int]:
    kind = _kind(toks, at)
    if kind == "TERM":
        return term(toks[at][1]), at + 1
    if kind == "PHRASE":
        return phrase(toks[at][1]), at + 1
    if kind == "(":
        node, at = _either(toks, at + 1)
        if _kind(toks, at) != ")":
            raise QueryError("missing closing parenthesis")
        return node, at + 1
    raise QueryError("expected query term")


def is_explicit(text: str) -> bool:
    """A quote or parenthesis anywhere, or an operator in all capitals or all small letters as a word of its own."""
    return any(c in text for c in '"()') or any(w in ("AND", "OR", "NOT", "and", "or", "not") for w in text.split())


def leaves(node: Node) -> Iterator[Node]:
    """TERM and PHRASE nodes from left to right, those below NOT included."""
    if node.kind in (Kind.TERM, Kind.PHRASE):
        yield node
    for part in node.parts:
        yield from leaves(part)


def scoring_terms(node: Node) -> list[str]:
    """The terms a tree is ranked by: single-term words and the words of phrases, each once, in order."""
    found: dict[str, None] = {}
    for leaf in leaves(node):
        if leaf.kind is Kind.TERM:
            if (t := normal_term(leaf.text)) is not None:
                found[t] = None
        else:
            found.update(dict.fromkeys(tokenise(leaf.text)))
    return list(found)


def free_terms(text: str) -> list[str]:
    """The terms of free text, each once, in order."""
    return list(dict.fromkeys(tokenise(text)))
