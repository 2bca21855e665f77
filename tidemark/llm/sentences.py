"""Sentence boundaries across languages and scripts.

A text is cut at blank lines into blocks, and a block into sentences by the script most of its letters belong to.

Spaced scripts: every run of terminators with its closing marks is a node of a lattice, and an edge between two nodes
is a sentence. A node costs what its surroundings say against a boundary (abbreviations, initials, ordinals, a small
letter or figure next, a reporting clause after a quotation); an edge costs more when it leaves a quotation or bracket
open, and passes over the nodes inside an open quotation for nothing. The cheapest path from the start of the block to
its end is the segmentation.

Scripts without spaces (Chinese, Japanese, Thai): each gap - a terminator, or in Thai a blank - is classified from the
word that ends before it and the word that opens after it. The words come from a lattice over a dictionary; its best
path has the fewest characters outside the dictionary and then the fewest words. There are dictionaries for these
three only. Khmer, Burmese and Tibetan are cut at their own terminators, and Lao at the common ones, like a spaced
script: a blank alone parts no sentences there.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from . import lexicon as lex

BLANK_LINE = re.compile(r"\r?\n(?:[^\S\n]*\n)++|[\u2029\f]+")
OPENERS = "“‘«„‚「『《〈【（([{¿¡\"'‹"
CLOSERS = "”’»」』》〉】）)]}\"'›"
_PAIR = {"”": "“„", "’": "‘‚", "»": "«", "」": "「", "』": "『", "》": "《", "】": "【", "）": "（", ")": "(", "]": "[", "}": "{", "›": "‹"}
_CLOSE = re.escape(CLOSERS)
#: Terminators of spaced scripts; a stop between letters or figures without a blank is none.
_END = ".!?…‽؟۔।॥։።፧។៕။།༎"
#: Thin and hard blanks, which French puts before its marks.
_HARD = "\u00a0\u202f"
#: Every loop is possessive and a node starts where a run of terminators starts, so long runs are read once.
_NODE = re.compile(
    rf"(?<![{_END}])[{_END}]++(?:[{_HARD} ][!?]++)*+(?:[{_HARD}]?[{_CLOSE}]++)*+(?=\s|$|[{re.escape('“«„¿¡—–')}])"
    rf"|(?<![{_END}])[!?؟।॥…]++(?:[{_HARD}]?[{_CLOSE}])++(?=\w)"
    rf"|(?<![{_END}])[।॥؟។៕။།༎]++(?=\w)"
    rf"|(?<=\w\w)[.!?]++(?:[{_CLOSE}]++)?+(?=[^\W\d_])"
)
_WORD_BEFORE = re.compile(r"(?:[^\W\d_][̀-ͯऀ-ॿ]*|[\d\-ªº]|(?<=\w)\.(?=\s?\w))+$")
_CJK_NODE = re.compile(rf"(?:[。！？!?｡…]|\.(?=\s|$|[{_CLOSE}]))+(?:[{_CLOSE}]+)?")
_CJK_OPEN = re.compile(r"[“「『\"]")
_SCRIPTS = (
    ("thai", re.compile(r"[฀-๿]")),
    ("kana", re.compile(r"[぀-ヿㇰ-ㇿ]")),
    ("han", re.compile(r"[㐀-䶿一-鿿豈-﫿]")),
)
_LETTER = re.compile(r"[^\W\d_]")

#: Costs of the lattice. A boundary pays CUT when it is surely one; from STAY on it is taken for inner punctuation.
CUT, DOUBT, STAY, NEVER, OPEN = 0.0, 0.8, 2.5, 50.0, 1.2
#: A reporting word follows a quotation within so many characters, the speaker's name between them.
SPEAKER = 24
#: Passing over a node that could be a boundary.
SKIP = 1.0


class Trie:
    """A dictionary for lattices: the lengths of the words that start at a place."""

    def __init__(self, words: list[str]) -> None:
        self.root: dict = {}
        for w in words:
            node = self.root
            for ch in w:
                node = node.setdefault(ch, {})
            node[""] = True

    def lengths(self, text: str, at: int, end: int) -> list[int]:
        node, out = self.root, []
        for i in range(at, end):
            node = node.get(text[i])
            if node is None:
                break
            if "" in node:
                out.append(i - at + 1)
        return out


def lattice(text: str, low: int, high: int, trie: Trie) -> list[tuple[int, int, bool]]:
    """Best path through the word lattice of text[low:high]: (start, stop, in the dictionary)."""
    n = high - low
    best: list[tuple[int, int]] = [(0, 0)] + [(1 << 30, 0)] * n
    back: list[tuple[int, bool]] = [(0, False)] * (n + 1)
    for i in range(n):
        unknown, words = best[i]
        for step in trie.lengths(text, low + i, high):
            cost = (unknown, words + 1)
            if cost < best[i + step]:
                best[i + step], back[i + step] = cost, (i, True)
        cost = (unknown + 1, words + (not (i and not back[i][1])))
        if cost < best[i + 1]:
            best[i + 1], back[i + 1] = cost, (i, False)
    path, i = [], n
    while i:
        j, known = back[i]
        if not known:
            while j and not back[j][1]:
                j = back[j][0]
        path.append((low + j, low + i, known))
        i = j
    return path[::-1]


_THAI = Trie([*lex.THAI_OPEN, *lex.THAI_CLOSE, *lex.THAI_SINCE, *lex.THAI_JOIN, *lex.THAI_AHEAD, *lex.THAI_FINAL, *lex.THAI_VERBS, *lex.THAI_WORDS])
_KANA = Trie(lex.JAPANESE_WORDS)
_HAN = Trie(lex.CHINESE_WORDS)


def _next_char(text: str, at: int, end: int) -> int:
    while at < end and text[at].isspace():
        at += 1
    return at


def _may_open(text: str, at: int, end: int) -> bool:
    """A sentence may open here: a capital, a letter without case, an opening mark, or a brand such as eVolta."""
    while at < end and text[at] in OPENERS + "—–-• ":
        at += 1
    if at >= end:
        return True
    ch = text[at]
    if ch.isalpha():
        return not ch.islower() or (at + 1 < end and text[at + 1].isupper())
    return False


#: No part of an abbreviation of several parts is longer.
LONGEST_PART = 3
_ABBREVIATED = lex.INSIDE | lex.BEFORE_NAME | lex.BEFORE_NUMBER | lex.MAY_END
_PARTS_BEFORE = re.compile(r"((?:[^\W\d_]{1,3}\.\s?)+)$")
_BLANKS = re.compile(r"\s")
_PART_END = re.compile(r"[.\s]")


def _quoted_before(text: str, low: int, at: int, stop: int) -> bool:
    """The terminators in [at, stop) are followed by a mark that closes a quotation."""
    return any(c in "”’»\"'›“" for c in text[at:stop])


def node_cost(text: str, low: int, at: int, stop: int, high: int, caseless: bool = False) -> float:
    """How much speaks against a boundary after the terminators text[at:stop]; in a `caseless` block small letters say nothing."""
    nxt = _next_char(text, stop, high)
    if nxt >= high:
        return CUT
    if nxt == stop and text[at] in ".!?" and text[nxt].isalpha():
        return _unspaced(text, at, nxt, high)
    marks, ch = text[at:stop], text[nxt]
    lower = ch.islower() and not (nxt + 1 < high and text[nxt + 1].isupper())
    if caseless and lower and stop - at == 1 and marks in ".?!" and text[max(low, at - 3) : at].isalpha() and _WORD_BEFORE.search(text, max(low, at - 24), at).group() not in lex.MAY_END | lex.INSIDE | lex.BEFORE_NAME:
        return CUT
    if _quoted_before(text, low, at, stop):
        if lower or ch in ",;:،؛" or ch in "—–":
            return NEVER
        if nxt == stop and ch.isalnum():
            return STAY
        return _after_quotation(text, low, at, stop, nxt, high)
    if ch in ",;:،؛)":
        return NEVER
    if ch in "—–":
        after = _next_char(text, nxt + 1, high)
        return STAY if after < high and text[after].islower() else DOUBT
    if marks.startswith(("…", "...")) or marks[0] == "…":
        return CUT if _may_open(text, nxt, high) and text[at - 1 : at].strip() and ch.isupper() else STAY
    if marks[0] == ".":
        b = at
        while b > low and text[b - 1].isalpha():
            b -= 1
        if at - b > LONGEST_PART and (b == low or text[b - 1].isspace()) and text[b:at].lower() not in _ABBREVIATED:
            return CUT if _may_open(text, nxt, high) else STAY if lower else DOUBT if ch.isdigit() else STAY  # a common word
        word_at = _WORD_BEFORE.search(text, max(low, at - 24), at)
        word = word_at.group() if word_at else ""
        key = _BLANKS.sub("", word).lower().lstrip("-")
        last = _PART_END.split(key)[-1]
        opens = _may_open(text, nxt, high)
        if word_at and stop - at == 1:
            spaced = _spaced_key(text, low, word_at.start(), key)
            if spaced in lex.INSIDE or key in lex.INSIDE:
                return NEVER
            if key in lex.BEFORE_NAME and (len(key) > 1 or not key.isascii()) or key in ("m", "d") and word[0].isupper():
                return NEVER
            if key in lex.BEFORE_NUMBER and spaced not in lex.MAY_END:
                return NEVER if ch.isdigit() or ch == "#" or not opens else STAY if len(last) == 1 else CUT
            if key in lex.MAY_END or spaced in lex.MAY_END:
                return CUT if opens and not (last in ("г", "в", "млн", "тыс", "млрд", "руб") and not ch.isupper()) else NEVER
            if len(last) == 1 and last.isalpha() and (word[-1].isupper() or not last.isascii() and not last.isupper() and not last.islower()):
                return NEVER  # an initial
            if len(last) == 1 and last.isalpha() and last.islower() and word_at.start() > low:
                return STAY
            if word.isdigit() and len(word) <= 2 and _ordinal(text, word_at.start(), nxt, low, high):
                return NEVER
            if word.isdigit() and _only_number(text, low, word_at.start()):
                return NEVER  # the number of a list line
        return CUT if opens else STAY if lower else DOUBT if ch.isdigit() else STAY
    return STAY if lower else CUT


def _unspaced(text: str, at: int, nxt: int, high: int) -> float:
    """A terminator with no blank behind it parts sentences only between a small letter or figure and a capital."""
    before, ch, after = text[at - 1], text[nxt], text[nxt + 1 : nxt + 2]
    if ch.isupper():
        return CUT if (not before.isupper()) and (not after or after.islower() or after in "'’. ") else NEVER
    if ch.islower():
        return CUT if after.isupper() and not before.isupper() else NEVER
    return CUT if not before.isascii() and text[at - 3 : at].isalnum() else NEVER


def _spaced_key(text: str, low: int, start: int, key: str) -> str:
    """`key` together with the abbreviations before it: "т. д" and "p. ex" become "т.д" and "p.ex"."""
    m = _PARTS_BEFORE.search(text[max(low, start - 8) : start])
    if not m or (b := max(low, start - 8) + m.start()) > low and text[b - 1].isalnum():
        return key
    return _BLANKS.sub("", m.group(1)).lower() + key


def _ordinal(text: str, start: int, nxt: int, low: int, high: int) -> bool:
    """A day before a German month name, or any figure after "Am"/"Der" before a capital."""
    m = re.compile(r"[^\W\d_]+").match(text, nxt, high)
    return bool(m) and m.group().lower() in lex.MONTHS_DE


def _only_number(text: str, low: int, start: int) -> bool:
    return not text[low:start].strip(" \t-•*(")


def _after_quotation(text: str, low: int, at: int, stop: int, nxt: int, high: int) -> float:
    """A quotation closed right after its terminator and no small letter follows.

    It ends the sentence where another quotation opens, where a reporting clause or a colon came before it, or where
    more than a bare quotation precedes; a name and a reporting word after it (in scripts without capitals) keep it in.
    """
    ch = text[nxt]
    if ch in "“«„‘‹\"¿¡":
        return CUT
    if ch.isupper() or ch.isdigit():
        return CUT
    if ch.isalpha():  # no case: look for a clause up to the next terminator that is closed by no quotation mark
        openers = _openers(text, low, high)
        i = bisect_left(openers, at)
        b = openers[i - 1] if i else low
        while b > low and text[b - 1].isspace():
            b -= 1
        return STAY if not i or b == low or text[b - 1] not in ",:،" else CUT
    return DOUBT


@lru_cache(maxsize=4)
def _openers(text: str, low: int, high: int) -> list[int]:
    """Places of the marks of a block that may open a quotation."""
    return [low + m.start() for m in re.finditer("[“«„\"‘]", text[low:high])]


_BALANCED = re.compile("[“”„«»「」『』《》【】（）()\\[\\]{}‹›\"]")
#: Marks open at once, beyond which the outermost one is taken for a slip.
DEEP = 8


def _marks(text: str, low: int, high: int) -> list[tuple[int, str, str]]:
    """(place, mark, role) of the quotation marks and brackets of a block; role: "(" opens, ")" closes, "|" either.

    Guillemets may point inwards, and a mark that has no partner in the block may stand on both sides. A straight mark
    opens after a blank and closes before one.
    """
    found = [(m.start(), m.group()) for m in _BALANCED.finditer(text, low, high)]
    kinds = {ch for _, ch in found}
    inwards = next((ch for _, ch in found if ch in "«»"), "") == "»"
    out = []
    for at, ch in found:
        if ch == '"':
            before, after = at == low or text[at - 1].isspace() or text[at - 1] in OPENERS + "—–-", at + 1 >= high or text[at + 1].isspace()
            role = "|" if before == after else "(" if before else ")"
        elif ch == "”" and not kinds & {"“", "„"} or ch == "»" and inwards and "«" not in kinds:
            role = "|"
        elif ch in "«»" and inwards:
            role = "(" if ch == "»" else ")"
        elif ch == "“":
            role = "|" if "„" in kinds else "("
        else:
            role = "(" if ch in "„«「『《【（([{‹" else ")"
        out.append((at, ch, role))
    return out


_INWARDS = {"«": "»"}


def _step(stack: tuple[str, ...], ch: str, role: str) -> tuple[tuple[str, ...], int]:
    """The open marks after `ch`, and 1 where it closes nothing or drops an outermost mark."""
    if role != "(":
        partners = ch if role == "|" and ch != "“" else "„" if role == "|" else _PAIR.get(ch, ch) + _INWARDS.get(ch, "")
        at = len(stack)
        while at and stack[at - 1] in "([{" and stack[at - 1] not in partners:
            at -= 1
        if at and stack[at - 1] in partners:
            return stack[: at - 1], 0
        if role == ")":
            return stack, int(ch not in ")’")
    stack = (*stack, ch)
    return (stack[1:], int(stack[0] not in "([{")) if len(stack) > DEEP else (stack, 0)


def spaced(text: str, low: int, high: int) -> list[tuple[int, int]]:
    """Sentences of a block in a script with spaces: the cheapest path through its terminator lattice."""
    nodes = []
    caseless = text[low:high].islower()
    for m in _NODE.finditer(text, low, high):
        cost = node_cost(text, low, m.start(), m.end(), high, caseless)
        if cost < NEVER:
            nodes.append((m.end(), cost))
    if not nodes or nodes[-1][0] < high:
        nodes.append((high, 0.0))
    nodes[-1] = (nodes[-1][0], 0.0)
    if all(c == CUT for _, c in nodes) and not _BALANCED.search(text, low, high):
        cuts = [e for e, _ in nodes]
    else:
        cuts = _cheapest(text, low, nodes)
    out = []
    for end in cuts:
        low = _next_char(text, low, end)
        stop = end
        while stop > low and text[stop - 1].isspace():
            stop -= 1
        if stop > low:
            out.append((low, stop))
        low = end
    return out


def _cheapest(text: str, low: int, nodes: list[tuple[int, float]]) -> list[int]:
    """Ends of the sentences on the cheapest path; of equal paths, the one that passes over the fewest nodes.

    The marks open since the last boundary are the state of a path. Nodes inside an open quotation are passed over for
    nothing, however many; what a boundary leaves open, and what closes without opening, costs OPEN each.
    """
    marks = _marks(text, low, nodes[-1][0])
    at = 0
    paths: dict[tuple[str, ...], tuple[float, int, tuple | None]] = {(): (0.0, 0, None)}
    for end, node in nodes:
        first = at
        while at < len(marks) and marks[at][0] < end:
            at += 1
        after: dict[tuple[str, ...], tuple[float, int, tuple | None]] = {}
        cut: tuple[float, int, tuple | None] | None = None
        for stack, (cost, passed, cuts) in paths.items():
            for _, ch, role in marks[first:at]:
                stack, wrong = _step(stack, ch, role)
                cost += OPEN * wrong
            left = sum(d not in "([{" for d in stack)
            here = (round(cost + node + OPEN * left, 6), passed, (end, cuts))
            if cut is None or here[:2] < cut[:2]:
                cut = here
            on = (round(cost + (0.0 if left else max(0.0, SKIP * 2 - node)), 6), passed + 1, cuts)
            if stack not in after or on[:2] < after[stack][:2]:
                after[stack] = on
        # a path that is dearer than a boundary here by all it has open can't become cheaper again
        paths = {s: p for s, p in after.items() if p[0] < cut[0] + OPEN * len(s)}
        if () not in paths or cut[:2] < paths[()][:2]:
            paths[()] = cut
    out, cuts = [], cut[2]
    while cuts:
        out.append(cuts[0])
        cuts = cuts[1]
    return out[::-1]


def _cjk_inside(text: str, low: int, at: int, stop: int, high: int, kana: bool, start: int) -> bool:
    """The terminators text[at:stop] belong inside a sentence; `start` is the last opening mark before them, or -1."""
    nxt = _next_char(text, stop, high)
    if nxt >= high:
        return False
    marks, ch = text[at:stop], text[nxt]
    closed = any(c in "”’」』\"》" for c in marks)
    if set(marks) <= {"…", "."} and not closed:
        return marks[0] == "…" and ch not in "“「『"
    if not closed:
        return marks[0] == "." and ch.isdigit()
    if ch in "，、,；;：:":
        return True
    if ch in "“「『‘\"《":
        return False
    b = start
    while b > low and text[b - 1].isspace():
        b -= 1
    if b > low and text[b - 1] in "：:，,、":
        return False
    if kana:  # a quoting particle carries on
        first = next(iter(lattice(text, nxt, min(high, nxt + 8), _KANA)), None)
        return bool(first and first[2] and text[first[0] : first[1]].startswith(lex.JAPANESE_AFTER))
    # a speaker and a reporting word before the next stop carry on
    m = re.compile(r"[^。！？!?，,；;“「]*").match(text, nxt, high)
    clause = lattice(text, nxt, min(m.end(), nxt + SPEAKER), _HAN)
    return any(known and text[a:b].startswith(lex.CHINESE_SAID) for a, b, known in clause)


def cjk(text: str, low: int, high: int, kana: bool) -> list[tuple[int, int]]:
    """Sentences of a block of Chinese or Japanese: terminators that may end one are nodes of the same lattice."""
    nodes, opener = [], -1
    opens = _CJK_OPEN.finditer(text, low, high)
    ahead = next(opens, None)
    for m in _CJK_NODE.finditer(text, low, high):
        while ahead and ahead.start() < m.start():
            opener, ahead = ahead.start(), next(opens, None)
        if not _cjk_inside(text, low, m.start(), m.end(), high, kana, opener):
            nodes.append((m.end(), CUT))
    if not nodes or nodes[-1][0] < high:
        nodes.append((high, 0.0))
    out, start = [], low
    for end in _cheapest(text, low, nodes):
        _take(text, start, end, out)
        start = end
    return out


def _take(text: str, low: int, high: int, out: list[tuple[int, int]]) -> None:
    while low < high and text[low].isspace():
        low += 1
    while high > low and text[high - 1].isspace():
        high -= 1
    if high > low:
        out.append((low, high))


_THAI_GAP = re.compile(r"[.!?…]+[\"'”’)]*(?=\s|$)|[^\S\n]*\n[^\S\n]*|[^\S\n]+")
_OPENS, _CLOSES, _SINCE, _JOIN, _AHEAD, _FINAL, _VERBS = (frozenset(x) for x in (lex.THAI_OPEN, lex.THAI_CLOSE, lex.THAI_SINCE, lex.THAI_JOIN, lex.THAI_AHEAD, lex.THAI_FINAL, lex.THAI_VERBS))
#: A stretch of so many characters without a blank is taken for a clause, whatever its words.
CLAUSE = 40
#: What a missing clause on the left and on the right of a blank costs, and what an opening or closing word takes off.
NO_LEFT, NO_RIGHT, SIGN = 2, 1, 1


def _clause(text: str, low: int, high: int) -> bool:
    """The stretch text[low:high] is long or holds a verb."""
    return high - low >= CLAUSE or any(known and text[a:b] in _VERBS for a, b, known in lattice(text, low, high, _THAI))


def _thai_boundary(text: str, low: int, at: int, stop: int, end: int, high: int, clause: bool) -> bool:
    """The gap text[at:stop] parts two sentences; `clause`: there is one on its left. The next stretch stops at `end`."""
    if at <= low or stop >= high:
        return False
    left, right = text[at - 1], text[stop]
    if right in "ๆฯ,;:)]”’" or left in "([“‘,;:":
        return False
    first = next(iter(lattice(text, stop, min(high, stop + 16), _THAI)), None)
    opener = text[first[0] : first[1]] if first and first[2] else ""
    if opener in _JOIN:
        return False
    opens = opener in _OPENS
    if left.isdigit() or right.isdigit():
        head = text[low:at].split()[0] if left.isdigit() else ""
        return opens and left.isdigit() and not head.startswith(tuple(_SINCE)) and not right.isdigit()
    if left.isascii() and left.isalpha() or right.isascii() and right.isalpha():
        return opens
    if left in "\"'”’)":
        return True
    tail = max(low, at - 16)
    last = lattice(text, tail, at, _THAI)[-1]
    closer = text[last[0] : last[1]] if last[2] else ""
    if closer in _FINAL:
        return True
    if closer in _AHEAD:
        return False
    # a sentence has a clause on either side of the blank; an opening word or one that often closes stands in for a doubt
    cost = NO_LEFT * (not clause) + NO_RIGHT * (not _clause(text, stop, end)) - SIGN * (opens or closer in _CLOSES)
    return cost <= 0


def thai(text: str, low: int, high: int) -> list[tuple[int, int]]:
    out, start = [], low
    clause, since = False, low  # a stretch since the last boundary is a clause; where the stretch at hand starts
    gaps = [*_THAI_GAP.finditer(text, low, high)]
    for m, after in zip(gaps, [*gaps[1:], None], strict=False):
        clause = clause or _clause(text, since, m.start())
        since = m.end()
        if text[m.start()].isspace():
            end = after.start() if after else high
            if m.start() > start and text[m.start() : m.end()].strip() == "" and "\n" not in m.group() and _thai_boundary(text, start, m.start(), m.end(), end, high, clause):
                _take(text, start, m.start(), out)
                start, clause = m.end(), False
        elif not (m.end() - m.start() == 1 and m.start() > low and text[m.start() - 1 : m.start()].isascii() and not text[m.start() - 1].isdigit() and text[m.start()] == "."):
            if text[m.start()] != "." or not re.search(r"(?:^|\s)\S{1,3}$", text[start : m.start()]):
                _take(text, start, m.end(), out)
                start, clause = m.end(), False
    _take(text, start, high, out)
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """(start, stop) of every sentence of `text`, in characters."""
    out: list[tuple[int, int]] = []
    at = 0
    for m in [*BLANK_LINE.finditer(text), None]:
        end = m.start() if m else len(text)
        low, high = at, end
        while low < high and text[low].isspace():
            low += 1
        while high > low and text[high - 1].isspace():
            high -= 1
        if high > low:
            out += _block(text, low, high)
        at = m.end() if m else end
    return out


def _block(text: str, low: int, high: int) -> list[tuple[int, int]]:
    block = text[low:high]
    if block.isascii():
        return spaced(text, low, high)
    counts = {name: len(pattern.findall(block)) for name, pattern in _SCRIPTS}
    letters = len(_LETTER.findall(block))
    if counts["thai"] * 2 > letters:
        return thai(text, low, high)
    if (counts["kana"] + counts["han"]) * 2 > letters:
        return cjk(text, low, high, counts["kana"] > 0)
    return spaced(text, low, high)


def split_sentences(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, start_pos, end_pos (INT, characters from 0) of every sentence of `text`.

    Null, empty and blank texts have none. Rows are split one by one (repeated rows repeatedly), so there is no
    shuffle and no skew; other columns are ignored. `key` must be BIGINT. Long texts are split block by block.
    """
    rows = spread(df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("text is not null and text <> ''"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, start, stop = [], [], []
            for i, value in enumerate(batch.column(1).to_pylist()):
                for a, b in sentences(value):
                    source.append(i)
                    start.append(a)
                    stop.append(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(source, pa.int32())), pa.array(start, pa.int32()), pa.array(stop, pa.int32())], names=["key", "start_pos", "end_pos"]
            )

    return rows.mapInArrow(run, "key long, start_pos int, end_pos int").withColumnRenamed("key", key)
