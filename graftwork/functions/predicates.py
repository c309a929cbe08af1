"""The null rules of the data, each a column function of its own.

They differ on purpose: ``present`` keeps 0 and false, ``valid_identity`` and ``is_void`` reject them as text,
``meaningful`` counts numbers only above zero, ``filled_leaf`` counts every leaf that is neither null nor empty.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character of the Unicode property White_Space.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0                　"
#: What stands for "no value" in identity and token fields, in any letter case.
VOID_WORDS = ("", "0", "0.0", "none", "null", "nan")


def strip(c: Column) -> Column:
    """Without surrounding blanks, wide ones too."""
    return F.btrim(c, F.lit(BLANKS))


def is_void(c: Column) -> Column:
    """True for null, blank and the void words; never null."""
    return F.coalesce(F.lower(strip(c)).isin(*VOID_WORDS), F.lit(True))


def valid_identity(c: Column) -> Column:
    return ~is_void(c)


def first_valid(*cs: Column) -> Column:
    """The first valid identity, stripped; null if there is none."""
    return F.coalesce(*[F.when(valid_identity(c), strip(c)) for c in cs])


def first_present(*cs: Column) -> Column:
    """The first value that is neither null nor empty, as text; else the empty text."""
    return F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in cs], F.lit(""))


def present(c: Column) -> Column:
    """Not null and not empty text; 0 and false are present."""
    return F.coalesce(c.cast("string") != "", F.lit(False))


def present_list(c: Column) -> Column:
    return F.coalesce(F.size(c) > 0, F.lit(False))


def clean_tokens(c: Column) -> Column:
    """The elements of an array of text that are not void, stripped, in order."""
    return F.filter(F.transform(c, strip), lambda x: ~is_void(x))


def meaningful(c: Column) -> Column:
    """A number above zero, or a text that is not blank and not void."""
    n = c.try_cast("double")
    return F.coalesce(F.when(n.isNotNull() & ~F.isnan(n), n > 0).otherwise(~is_void(c.cast("string"))), F.lit(False))


def filled_leaf(c: Column) -> Column:
    """1 for a leaf that is neither null nor empty text, else 0."""
    return F.coalesce((c.cast("string") != "").cast("int"), F.lit(0))


def list_values(c: Column, delimiter: str = ",") -> Column:
    """The values of a plainly delimited text, each cut at its first bracket, stripped, without void ones; null for null."""
    return clean_tokens(F.transform(F.split(c, delimiter, -1), lambda x: F.substring_index(x, "(", 1)))
