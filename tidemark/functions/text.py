"""Text analysis: case folding, word segmentation and normalisation as Spark columns, and the same for query text."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most joins in a word; the JVM's matcher needs stack for each.
JOINS = 500


def word_pattern(times: str = f"{{1,{JOINS}}}") -> str:
    """A word: a run of letters, figures, marks and underscores, with letters joined by one set of marks and figures by
    another inside it, `times` as often. Without look-around, so the JVM, Python and RE2 agree on it (RE2 needs "+");
    plain runs are single loops, so long words need no stack."""
    letters = rf"\p{{L}}\p{{M}}*(?:['’.:·]\p{{L}}\p{{M}}*){times}"
    figures = rf"\p{{Nd}}\p{{M}}*(?:[.,;'’⁄]\p{{Nd}}\p{{M}}*){times}"
    run = r"[\p{L}\p{Nd}\p{M}_]"
    return rf"(?:{run}*(?:{letters}|{figures})){times}{run}*|{run}+"


WORD = word_pattern()
_WORD = regex.compile(WORD)
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}+")


def full_fold(text: str) -> str:
    """Compatibility folding: NFKC with case folding, ignorable characters dropped."""
    return _IGNORABLE.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def _plain_class() -> str:
    """The characters of common scripts that the JVM's lower case folds fully, as a character class: letters and marks
    that stand alone, neither combine with a neighbour nor have a compatibility form."""
    blocks = [(0x00, 0x250), (0x400, 0x482), (0x48A, 0x530), (0x531, 0x557), (0x5D0, 0x5EB), (0x620, 0x64B), (0x660, 0x66E), (0x2010, 0x2017), (0x2018, 0x2024)]
    blocks += [(0x3001, 0x3004), (0x3008, 0x3012), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0x9FFD)]
    plain = [c for low, high in blocks for c in range(low, high) if full_fold(chr(c)) == chr(c).lower().replace("ß", "ss")]
    ends = [c for c, before in zip(plain, [-2, *plain], strict=False) if c != before + 1], [c for c, after in zip(plain, [*plain[1:], -1], strict=True) if after != c + 1]
    return "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in zip(*ends, strict=True))


_PLAIN = f"^[{_plain_class()}]*$"


@F.pandas_udf(T.StringType())
def nfkc_casefold(text: pd.Series) -> pd.Series:
    """`full_fold` in Arrow batches; null stays null."""
    return text.map(full_fold, na_action="ignore")


def fold(text: Column) -> Column:
    """Compatibility folding (NFKC, case folding, ignorable characters dropped); null counts as empty.

    Texts made of plain characters only are folded in the JVM; the others alone reach Python.
    """
    given = F.coalesce(text, F.lit(""))
    plain = given.rlike(_PLAIN)
    lower = F.regexp_replace(F.lower(given), "ß", "ss")
    return F.coalesce(nfkc_casefold(F.when(~plain, given)), lower)


def tokens(text: Column) -> Column:
    """The words of `text` in order, folded; a word's place in the array is its position."""
    return F.regexp_extract_all(fold(text), F.lit(WORD), F.lit(0))


def tokenise(text: str) -> list[str]:
    """`tokens` for a string on the driver (query text)."""
    return _WORD.findall(full_fold(text))


def normal_term(text: str) -> str | None:
    """The single term `text` stands for, or None where it holds no word or several."""
    found = tokenise(text)
    return found[0] if len(found) == 1 else None


def normal_terms(texts: list[str]) -> list[str]:
    """Single terms in order of first occurrence, each once."""
    return list(dict.fromkeys(t for t in map(normal_term, texts) if t is not None))


def positions(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, position (from 0), term: one row per word. Null and empty texts have none."""
    return docs.select(F.col(key), F.posexplode(tokens(F.col(text))).alias("position", "term"))


def strip(text: Column) -> Column:
    """Without white space of any kind at either end; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[\s\x{A0}\x{FEFF}]+|[\s\x{A0}\x{FEFF}]+$", "")


def unify_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def cache_key(text: Column) -> Column:
    """Lower case with single blanks, the form under which repeated queries meet."""
    return F.lower(F.regexp_replace(F.trim(text), r"\s+", " "))


def percent_decode(text: Column) -> Column:
    """%XX decoded as UTF-8 ('+' stays); null where an escape is malformed."""
    good = ~text.rlike(r"%(?![0-9A-Fa-f]{2})")
    return F.when(good, F.try_url_decode(F.regexp_replace(text, r"\+", "%2B")))


def parse_size(text: Column) -> Column:
    """A non-negative BIGINT of digits only, else null (also on overflow)."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint"))


def parse_vector(text: Column) -> Column:
    """ARRAY<FLOAT> of finite numbers parted by white space; null where empty or malformed."""
    parts = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    numbers = F.transform(parts, lambda x: x.try_cast("float"))
    sound = F.forall(numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(F.coalesce(sound, F.lit(False)), numbers)


def format_bytes(size: Column) -> Column:
    """Size with two decimals in B, KB, MB or GB."""
    step = lambda n, unit: F.concat(F.format_number(size / float(1024**n), 2), F.lit(unit))
    return F.when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024**2, step(1, " KB")).when(size < 1024**3, step(2, " MB")).otherwise(step(3, " GB"))
