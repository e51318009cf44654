"""Column functions on text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(c: Column) -> Column:
    """Lower-cased runs of ASCII letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9_]+"), F.lit(0))


def bigrams(t: Column) -> Column:
    """Different neighbours of an array of tokens, as text."""
    n = F.size(t)
    return F.when(n >= 2, F.array_distinct(F.zip_with(F.slice(t, F.lit(1), n - 1), F.slice(t, F.lit(2), n - 1), lambda a, b: F.concat_ws(" ", a, b)))).otherwise(F.array().cast("array<string>"))


def contains_any(c: Column, terms: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(t) for t in terms])


def count_terms(c: Column, terms: list[str]) -> Column:
    """How many of the terms the text contains."""
    return reduce(lambda a, b: a + b, [c.contains(t).cast("int") for t in terms])


def matches_any(c: Column, patterns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.rlike(p) for p in patterns])


def ladder(pairs: list[tuple[Column, object]], default: object) -> Column:
    """The value of the first condition that holds."""
    out = None
    for cond, value in pairs:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(cond, value) if out is None else out.when(cond, value)
    return out.otherwise(default if isinstance(default, Column) else F.lit(default))


def lookup(c: Column, table: dict, default: object = None) -> Column:
    """A literal table as a conditional."""
    return ladder([(c == k, v) for k, v in table.items()], default)


def word_tokens(c: Column) -> Column:
    """Estimated model tokens: words / 0.75, truncated."""
    return F.floor(F.size(F.regexp_extract_all(c, F.lit(r"\S+"), F.lit(0))) / 0.75).cast("long")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def basename(path: Column) -> Column:
    return F.element_at(F.split(F.translate(path, "\\", "/"), "/"), -1)


def collection_name(path: Column, lower: bool = True) -> Column:
    """The collection of a project: the last part of its path, spaces as underscores."""
    name = F.replace(basename(F.rtrim(F.translate(path, "\\", "/"), F.lit("/"))), F.lit(" "), F.lit("_"))
    return F.lower(name) if lower else name


def hit_key(file: Column, name: Column, lines: Column) -> Column:
    """What a hit is known by when lists of hits are merged."""
    return F.sha2(F.concat_ws(":", file, name, lines), 256)
