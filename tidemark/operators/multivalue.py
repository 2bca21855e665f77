"""Several values packed in one field: split free-form lists into one value per row.

The field is read with a parsing expression grammar. Alternatives are tried in the order written, and a failed one
leaves the position where it was:

    field     <- gap* (value gap*)* !.
    value     <- quoted / bracketed / bare
    quoted    <- dquoted &stop / squoted &stop
    dquoted   <- '"' ( '\\' . / '""' / !'"' . )* '"'
    squoted   <- "'" ( '\\' . / "''" / !("'" &stop) . )* "'"
    bracketed <- '[' ... ']' / '(' ... ')' / '{' ... '}'     (balanced, then &stop)
    bare      <- ( !separator . )+
    stop      <- blank* ( !. / mark / word )
    separator <- blank* ( mark / word / !. )
    mark      <- [,;|/&] / line break
    word      <- ('and' / 'with', in lower or upper case) between blanks
    gap       <- blank / mark / word

A quote that opens a value but never closes before a stop makes `quoted` fail; the value is then read again as bare
text and flagged `malformed_quote`. Nothing inside quotes or brackets is split, doubled and back-slashed quotes are
restored, and an empty piece takes no position.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Separators between packed values.
MARKS = ",;|/&\n\r"
WORDS = ("and", "with")
BRACKETS = {"[": "]", "(": ")", "{": "}"}

_WORD = "(?:" + "|".join(f"{w}|{w.upper()}" for w in WORDS) + ")"
_MARK = f"[{re.escape(MARKS)}]"
# every run of blanks is read from its start and at once, so long runs are read once
_BLANK = r"[^\S\n\r]"
_STOP = re.compile(rf"{_BLANK}*+(?:\Z|{_MARK})|{_BLANK}++{_WORD}(?=\s|\Z)")
_NEXT_STOP = re.compile(rf"(?<!{_BLANK})(?:{_BLANK}*+(?:\Z|{_MARK})|{_BLANK}++{_WORD}(?=\s|\Z))")
_GAP = re.compile(rf"(?:\s|{_MARK}|{_WORD}(?=\s|\Z))*+")
_DQUOTED = re.compile(r'"((?:[^"\\]|\\.|"")*+)"', re.S)
#: A field of this shape holds one bare value; most fields do, and need no grammar.
_PLAIN = re.compile(rf"[^\s{re.escape(MARKS)}\"'\[({{][^{re.escape(MARKS)}\"\[({{]*")
_HAS_WORD = re.compile(rf"(?:^|\s){_WORD}(?=\s|$)")


class _Field:
    """What parsing one field remembers: results of the alternatives that look far ahead, so that a field full of
    openers that never close is still read in linear time."""

    def __init__(self, text: str) -> None:
        self.text = text
        self._single: dict[int, int] = {}
        self._brackets: dict[int, int] | None = None

    def single_end(self, at: int) -> int:
        """Where the closing mark of a single-quoted value stands whose text begins at `at`, or -1."""
        text, known, path = self.text, self._single, []
        while at not in known:
            path.append(at)
            if at >= len(text):
                known[at] = -1
            elif text[at] == "\\" and at + 1 < len(text) or text.startswith("''", at):
                at += 2
            elif text[at] == "'" and _STOP.match(text, at + 1):
                known[at] = at
            else:
                at += 1
        for p in path:
            known[p] = known[at]
        return known[at]

    def bracket_end(self, at: int) -> int:
        """Where the bracket that opens at `at` is closed, or -1."""
        if self._brackets is None:
            self._brackets, open_ = {}, []
            for i, ch in enumerate(self.text):
                if ch in BRACKETS:
                    open_.append(i)
                elif open_ and ch == BRACKETS[self.text[open_[-1]]]:
                    self._brackets[open_.pop()] = i
        return self._brackets.get(at, -1)


def _quoted(field: _Field, at: int) -> tuple[str, int] | None:
    text = field.text
    if text[at] == '"':
        m = _DQUOTED.match(text, at)
        if m and _STOP.match(text, m.end()):
            return re.sub(r'\\(.)|""', lambda q: q.group(1) or '"', m.group(1), flags=re.S), m.end()
        return None
    end = field.single_end(at + 1)
    if end < 0:
        return None
    return re.sub(r"\\(.)|''", lambda q: q.group(1) or "'", text[at + 1 : end], flags=re.S), end + 1


def _bracketed(field: _Field, at: int) -> tuple[str, int] | None:
    end = field.bracket_end(at)
    return (field.text[at + 1 : end], end + 1) if end >= 0 and _STOP.match(field.text, end + 1) else None


def parse_values(text: str) -> list[tuple[str, str]]:
    """(value, flag) of each value in order; flag is '' or 'malformed_quote' or 'malformed_bracket'."""
    if _PLAIN.fullmatch(text) and not _HAS_WORD.search(text):
        value = text.strip()
        return [(value, "")] if value else []
    out: list[tuple[str, str]] = []
    field = _Field(text)
    at = _GAP.match(text).end()
    while at < len(text):
        ch, flag, got = text[at], "", None
        if ch in "\"'":
            got = _quoted(field, at)
            flag = "" if got else "malformed_quote"
        elif ch in BRACKETS:
            got = _bracketed(field, at)
            flag = "" if got else "malformed_bracket"
        if got is None:
            end = _NEXT_STOP.search(text, at + 1).start()
            got = (text[at:end], end)
        value = got[0].strip()
        if value:
            out.append((value, flag))
        at = _GAP.match(text, got[1]).end()
    return out


VALUES = T.StructType(
    [T.StructField("item_pos", T.IntegerType()), T.StructField("item", T.StringType()), T.StructField("flag", T.StringType()), T.StructField("n_items", T.IntegerType())]
)


def split_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """One row per value of `column`: `key`, item_pos (from 1), item, flag, n_items (values in the field).

    Null, empty and separator-only fields give no row. Repeated rows are split as often as they occur; other columns
    of `df` are not carried (join on `key` where they are needed), so names can't clash. Work is row by row, without
    a shuffle, so skewed keys cost nothing.
    """
    kind = df.schema[key].dataType
    schema = T.StructType([T.StructField("key", kind), *VALUES.fields])
    rows = df.select(F.col(key).alias("key"), F.col(column).alias("field")).where("field is not null and field <> ''")
    key_type = T.StructType([T.StructField("key", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow_key = to_arrow_schema(key_type).field(0).type
        for batch in batches:
            src, pos, item, flag, total = [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = parse_values(text)
                n = len(found)
                for p, (value, what) in enumerate(found, 1):
                    src.append(i)
                    pos.append(p)
                    item.append(value)
                    flag.append(what)
                    total.append(n)
            keys = batch.column(0).take(pa.array(src, pa.int32())).cast(arrow_key)
            yield pa.RecordBatch.from_arrays(
                [keys, pa.array(pos, pa.int32()), pa.array(item, pa.string()), pa.array(flag, pa.string()), pa.array(total, pa.int32())],
                names=["key", "item_pos", "item", "flag", "n_items"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


#: A field without any of these holds one value at most; Spark skips it before the rows reach Python. No blanks are
#: asked for around the words, as the JVM and Python differ in what a blank is.
_MAY_PACK = "|".join([f"[{MARKS}]", *(v for w in WORDS for v in (w, w.upper()))])


def packed_values(df: DataFrame, key: str, column: str) -> DataFrame:
    """The values of the fields that hold two or more, each record once.

    Rows repeated with the same key and field count once; where one key has different fields, all are split.
    """
    once = df.select(F.col(key), F.col(column)).where(F.col(column).rlike(_MAY_PACK)).distinct()
    return split_values(once, key, column).where(F.col("n_items") > 1)
