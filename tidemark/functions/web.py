"""HTML to text, entities and address rules."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Blocks that are dropped whole, tags that end a line, named entities in the order they are replaced.
DROPPED = ("script", "style", "noscript", "svg", "nav", "footer", "header", "form")
LINE_TAGS = ("p", "div", "article", "section", "h[1-6]", "li", "tr")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&quot;", '"'), ("&#39;|&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"))


def named_entities(text: Column) -> Column:
    """Named entities decoded one after the other, `&amp;` before the others that may follow from it."""
    for name, value in ENTITIES:
        text = F.regexp_replace(text, f"(?i){name}", value)
    return text


_REFERENCE = re.compile(r"&#(?:[xX]([0-9a-fA-F]+)|([0-9]+));")


def _character(m: re.Match) -> str:
    code = min(int(m.group(1), 16) if m.group(1) else int(m.group(2)), 0x10FFFF)
    return "\ufffd" if 0xD800 <= code <= 0xDFFF else chr(code)


@F.pandas_udf(T.StringType())
def numeric_entities(text: pd.Series) -> pd.Series:
    """Decimal and hexadecimal character references decoded; those beyond the last code point count as it."""
    return text.map(lambda x: _REFERENCE.sub(_character, x) if x and "&#" in x else x)


def html_to_text(markup: Column, numeric: bool = True) -> Column:
    """The readable text of a page: comments and `DROPPED` blocks removed, line tags as line breaks, other tags as
    blanks, entities decoded (`numeric` ones too), white space evened out. Null counts as empty."""
    text = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?s)<!--.*?-->", " ")
    for tag in DROPPED:
        text = F.regexp_replace(text, rf"(?is)<{tag}[^>]*>.*?</{tag}\s*>", " ")
    text = F.regexp_replace(text, rf"(?i)<(?:br|/(?:{'|'.join(LINE_TAGS)}))\b[^>]*>", "\n")
    text = named_entities(F.regexp_replace(text, r"(?s)<[^>]+>", " "))
    if numeric:
        text = numeric_entities(text)
    text = F.regexp_replace(text, r"[\t\r ]+", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"\n\s+", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(text, r"^\s+|\s+$", "")


#: Hosts that are never fetched: private names, private and special numbers of either kind.
_PRIVATE = (
    r"(?i)^(localhost|.*\.localhost|.*\.local|.*\.internal|\[?::1\]?|\[?f[cd].*|\[?fe80:.*"
    r"|(0|10|127|22[4-9]|2[3-9][0-9]|[3-9][0-9][0-9])(\.[0-9]{1,3}){3}|169\.254(\.[0-9]{1,3}){2}|192\.168(\.[0-9]{1,3}){2}"
    r"|172\.(1[6-9]|2[0-9]|3[01])(\.[0-9]{1,3}){2}|100\.(6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])(\.[0-9]{1,3}){2})$"
)


def _plain_host(host: Column) -> Column:
    """`host` with a number in any of the forms that browsers take for an IPv4 address (one to four parts, decimal,
    octal or hexadecimal) as four decimal parts; null where such a number is too large."""
    parts = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    n = F.size(parts)
    numeric = host.rlike(r"(?i)^(?:0x[0-9a-f]*|[0-9]+)(?:\.(?:0x[0-9a-f]*|[0-9]+)){0,3}\.?$")
    value = lambda p: (
        F.when(F.length(p) > 14, F.lit(None).cast("string")).when(p.rlike("(?i)^0x$"), F.lit("0")).when(p.rlike("(?i)^0x"), F.conv(F.substring(p, 3, 64), 16, 10)).when(p.rlike("^0[0-7]+$"), F.conv(p, 8, 10)).otherwise(p).try_cast("bigint")
    )
    values = F.transform(parts, value)
    head = F.aggregate(F.slice(values, 1, n - 1), F.lit(0).cast("bigint"), lambda s, x: s * 256 + F.when(x < 256, x))
    last = F.element_at(values, -1)
    room = F.pow(F.lit(256.0), 5 - n).cast("bigint")
    number = head * room + F.when(last < room, last)
    dotted = F.concat_ws(".", *[F.pmod(F.shiftright(number, shift), F.lit(256)).cast("string") for shift in (24, 16, 8, 0)])
    return F.when(numeric, F.when(number.isNotNull(), dotted)).otherwise(host)


def valid_address(url: Column) -> Column:
    """True for https addresses without credentials whose host is not a private name or number, in whatever form."""
    sound = url.rlike(r"(?i)^https://[^\s/?#@]+([/?#]\S*)?$")
    host = _plain_host(F.regexp_extract(url, r"(?i)^https://(\[[^\]]*\]|[^\s/?#:]+)", 1))
    return F.coalesce(sound & ~host.rlike(_PRIVATE) & (host != ""), F.lit(False))
