"""Tokens, names, identifiers and paths as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: words that say nothing in a community's name.
STOP_WORDS = [
    "the", "a", "of", "and", "for", "to", "in", "with", "on", "from",
    "class", "classes", "variants", "core", "implementation", "declarations",
    "pattern", "module", "support", "management", "handling", "generation",
]
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
#: What a generated, hence uncurated, name contains.
DEFAULT_MARK = "Community "
NAME_SEPARATOR = " / "


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def token_estimate(text: Column | str) -> Column:
    """Words and single marks of punctuation, counted."""
    return F.size(F.regexp_extract_all(F.coalesce(column(text), F.lit("")), F.lit(TOKEN), F.lit(0))).cast("long")


def word_count(text: Column | str) -> Column:
    return F.size(F.filter(F.split(F.trim(F.coalesce(column(text), F.lit(""))), r"\s+"), lambda w: w != "")).cast("long")


def name_tokens(text: Column | str) -> Column:
    """Lower-case runs of ASCII letters and digits, three characters or more, without stop words; repeats stay."""
    parts = F.split(F.lower(F.coalesce(column(text), F.lit(""))), "[^a-z0-9]+")
    return F.filter(parts, lambda t: (F.length(t) >= 3) & ~t.isin(STOP_WORDS))


def name_signature(text: Column | str) -> Column:
    """The sorted distinct words of four letters or more: equal for near-duplicate names."""
    found = F.regexp_extract_all(F.lower(column(text)), F.lit("[a-z]{4,}"), F.lit(0))
    return F.array_join(F.array_sort(F.array_distinct(found)), " ")


def first_filled(*options: Column | str) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(column(o), F.lit("")) for o in options], F.lit(""))


def is_curated(name: Column | str) -> Column:
    return (column(name) != "") & ~F.contains(column(name), F.lit(DEFAULT_MARK))


def names_of(name: Column | str) -> Column:
    return F.split(column(name), NAME_SEPARATOR)


def extension(path: Column | str) -> Column:
    """The suffix of the last part, with its dot; '' without one. A leading dot alone makes no suffix."""
    return F.lower(F.regexp_extract(column(path), r"[^/]+(\.[^./]+)$", 1))


def without_extension(path: Column | str) -> Column:
    return F.regexp_replace(column(path), r"(?<=[^/])\.[^./]+$", "")


def with_suffix(path: Column | str, suffix: str) -> Column:
    """The path with another extension for its own, if it has one."""
    return F.concat(without_extension(path), F.lit(suffix))


def thousands(n: Column | str) -> Column:
    """A whole number with commas between groups of three digits."""
    return F.format_number(column(n), 0)


def percent(part: Column, whole: Column) -> Column:
    """A share in whole per cent, a half rounded to the even neighbour; null of nothing."""
    return F.when(whole != 0, F.concat(F.bround(part * 100.0 / whole, 0).cast("long").cast("string"), F.lit("%")))


def normalised_id(text: Column | str, collapse: bool = False) -> Column:
    """Lower case, every character beyond ASCII letters and digits an underscore (or every run of them, with collapse)."""
    return F.lower(F.regexp_replace(column(text), "[^A-Za-z0-9]+" if collapse else "[^A-Za-z0-9]", "_"))


def last_segment(identifier: Column | str, separator: str = "_") -> Column:
    return F.substring_index(column(identifier), separator, -1)
