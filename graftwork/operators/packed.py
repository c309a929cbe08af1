"""Several values packed in one text field: one row per value, with its place.

Everything stays in built-in expressions. Quoted spans are cut out of the cell and replaced by indexed placeholders,
the rest is split at the delimiters, and the spans are put back by array lookup. A literal placeholder mark in a cell is
cut out like a quoted span, so no cell can collide with the placeholders.

Defined cases: a null, empty or blank cell and a cell of void members only give no values; repeats stay; a quote that is
never closed, and an apostrophe inside a word, are ordinary characters; a cell that is a JSON list is read with JSON's
escapes; in other cells a doubled quote or a backslash before a quote stands for the quote.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graftwork.functions.predicates import BLANKS, clean_tokens, strip

#: The delimiters in use.
DELIMITERS = ",;|、，；\t\n\r"
#: Quotes that can wrap a whole value.
QUOTES = (('"', '"'), ("'", "'"), ("「", "」"), ("『", "』"))
MARK = "\x01"


def _span_pattern(delimiters: str, quotes: tuple[tuple[str, str], ...]) -> str:
    ends = "".join("\\" + c if c in "|[]^-\\" else c for c in delimiters)
    pad = "[" + "".join(c for c in BLANKS if c not in delimiters) + "]*+"
    forms = []
    for left, right in quotes:
        if left == right:  # quotes that can be escaped; the second form is for stray quotes inside
            forms.append(rf"{left}(?:[^{left}\\]|{left}{left}|\\.)*+{left}(?={pad}(?:\z|[{ends}]))")
            forms.append(rf"{left}[^\n{ends}]*?{left}(?={pad}(?:\z|[{ends}]))")
        else:
            forms.append(rf"{left}[^{right}]*+{right}(?={pad}(?:\z|[{ends}]))")
    return rf"(?s)(?<=\A|[{ends}]){pad}(?:{'|'.join(forms)}){pad}|{MARK}"


def _unquoted(span: Column, quotes: tuple[tuple[str, str], ...]) -> Column:
    text = strip(span)
    inner = F.substring(text, F.lit(2), F.length(text) - 2)
    out = F.when(F.length(text) < 2, text)
    for left, right in quotes:
        body = inner
        if left == right:
            body = F.regexp_replace(inner, rf"{left}({left})|\\([{left}\\])", "$1$2")
        out = out.when(text.startswith(left) & text.endswith(right), body)
    return out.otherwise(text)


def packed_values(
    cell: Column, delimiters: str = DELIMITERS, quotes: tuple[tuple[str, str], ...] = QUOTES
) -> Column:
    """The non-void values of one cell as an array of text, in order. For wide use prefer ``unpack``."""
    pattern = _span_pattern(delimiters, quotes)
    text = strip(cell)
    as_json = F.when(text.startswith("["), F.try_parse_json(text).isNotNull()).otherwise(F.lit(False))
    listed = text.rlike(r"(?s)^\[\s*'.*'\s*\]$")  # a list as Python writes it
    body = F.when(as_json | listed, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(text)
    json_pattern = r'(?s)"(?:[^"\\]|\\.)*+"'
    cut = lambda f: F.when(as_json, f(json_pattern)).otherwise(f(pattern))
    spans = cut(lambda p: F.regexp_extract_all(body, F.lit(p), F.lit(0)))
    pieces = cut(lambda p: F.split(body, p, -1))
    restored = F.when(
        as_json, F.from_json(F.concat(F.lit("["), F.array_join(spans, ","), F.lit("]")), "array<string>")
    ).otherwise(F.transform(spans, lambda s: _unquoted(s, quotes)))
    marked = F.array_join(
        F.transform(
            pieces,
            lambda p, i: F.when(i > 0, F.concat(F.lit(MARK), (i - 1).cast("string"), F.lit(MARK), p)).otherwise(p),
        ),
        "",
    )
    items = F.split(marked, "[" + re.escape(delimiters) + "]", -1)

    def put_back(item: Column) -> Column:
        return F.array_join(
            F.transform(
                F.split(item, MARK, -1),
                lambda p, i: F.when(i % 2 == 1, F.get(restored, p.cast("int"))).otherwise(p),
            ),
            "",
        )

    return clean_tokens(F.transform(items, put_back))


def unpack(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """(keys..., field, pos, value): a row per non-void value of the given text columns; pos counts from 1.

    Narrow: one pass over ``df``, no shuffle. Count each key once before, if rows can be re-sent.
    """
    cells = df.select(
        *keys, F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("cell")) for f in fields])).alias("c")
    ).select(*keys, "c.field", F.col("c.cell").alias("cell"))
    return (
        cells.filter(strip(F.col("cell")) != "")
        .select(*keys, "field", F.posexplode(packed_values(F.col("cell"))).alias("at", "value"))
        .select(*keys, "field", (F.col("at") + 1).alias("pos"), "value")
    )
