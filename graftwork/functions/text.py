"""Text functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_WHITE = r"(?U)\s+"


def squeezed(c: Column) -> Column:
    """Without any white space, wide blanks too."""
    return F.regexp_replace(c, _WHITE, "")


def canonical_name(c: Column) -> Column:
    """A product name without a leading tag in brackets, digits of any script, white space and edge punctuation."""
    name = F.regexp_replace(c, r"^\s*[\[【(（「][^\]】)）」]*[\]】)）」]", "")
    name = F.regexp_replace(name, r"\p{Nd}+", "")
    return F.regexp_replace(squeezed(name), r"^[^\p{L}\p{M}]+|[^\p{L}\p{M}]+$", "")


def code_points(c: Column) -> Column:
    """The set of lower-case characters that are no white space."""
    return F.array_distinct(F.filter(F.split(squeezed(F.lower(c)), ""), lambda x: x != ""))


def overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of the character sets of two texts; 0 if either is empty or null."""
    x, y = code_points(F.coalesce(a, F.lit(""))), code_points(F.coalesce(b, F.lit("")))
    common = F.size(F.array_intersect(x, y))
    total = F.size(x) + F.size(y) - common
    return F.when((F.size(x) > 0) & (F.size(y) > 0), common / total).otherwise(F.lit(0.0))


def safe_name(c: Column, fallback: str = "node") -> Column:
    """A name fit for a path: separators become underscores, leading dots go, an empty name becomes ``fallback``."""
    name = F.regexp_replace(F.translate(F.trim(c), "/\\:", "___"), r"^\.+", "")
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(fallback)).otherwise(name)


def redacted(c: Column, cap: int | None = None) -> Column:
    """Keys and tokens, mail addresses, and runs of 3 digits and more masked; at most ``cap`` characters, if given."""
    masked = F.regexp_replace(c, r"(?i)\b(?:bearer|token|secret|api[_-]?key|sk)[ :=_-]+[A-Za-z0-9._-]{8,}", "<key>")
    masked = F.regexp_replace(masked, r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+", "<mail>")
    masked = F.regexp_replace(masked, r"[0-9]{3,}", "<n>")
    return masked if cap is None else F.left(masked, F.lit(cap))


def has_any(c: Column, terms: list[str]) -> Column:
    """Whether any of the literal terms occurs, in any letter case."""
    low = F.lower(c)
    found = F.lit(False)
    for t in terms:
        found = found | F.contains(low, F.lit(t.lower()))
    return F.coalesce(found, F.lit(False))


def signature(values: Column, fallback: str = "unknown") -> Column:
    """Sorted distinct values joined by commas."""
    kept = F.array_sort(F.array_distinct(F.filter(values, lambda x: x.isNotNull() & (x != ""))))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) == 0, F.lit(fallback)).otherwise(F.array_join(kept, ","))


def elapsed(seconds: Column) -> Column:
    """mm:ss, or hh:mm:ss from an hour on."""
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    short, long = F.format_string("%02d:%02d", m, r), F.format_string("%02d:%02d:%02d", h, m, r)
    return F.when(s >= 3600, long).otherwise(short)


def first_rule(c: Column, rules: list[tuple[str, str]], otherwise: str) -> Column:
    """The name of the first (name, pattern) that the text holds."""
    out = F.when(F.lit(False), F.lit(otherwise))
    for name, pattern in rules:
        out = out.when(c.rlike(pattern), F.lit(name))
    return out.otherwise(F.lit(otherwise))


def mapped(c: Column, words: dict) -> Column:
    """The word of a code; null for codes without one."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), c)


def overlaps_or_any(values: Column, wanted: list[str]) -> Column:
    """Whether a list is empty or null, which matches all, or shares a member with ``wanted``."""
    some = F.arrays_overlap(values, F.array(*map(F.lit, wanted)))
    return (F.coalesce(F.size(values), F.lit(0)) <= 0) | F.coalesce(some, F.lit(False))


def canonical_category(c: Column, negatives: list[str], aliases: dict[str, str], patterns: dict[str, str], part: str) -> Column:
    """The class of a name: none for a negative one; by alias; by a pattern for the whole name; or ``part`` where that is
    one of the parts of a composed name. White space does not count."""
    name = squeezed(c)
    out = F.when(name.isin(*negatives), F.lit(None).cast("string"))
    for alias, category in aliases.items():
        out = out.when(name == alias, F.lit(category))
    for category, pattern in patterns.items():
        out = out.when(name.rlike(f"^(?:{pattern})$"), F.lit(category))
    return out.when(F.array_contains(F.split(c, r"[/／、,，\s]+"), part), F.lit(part))
