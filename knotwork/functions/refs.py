"""References between sources: extraction and normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import column

HREF = r'href="([^"]*)"'
INCLUDE = r'(?md)^\s*#\s*include\s*([<"])([^>"]+)[>"]'
SYSTEM, SAME_DIRECTORY, UNKNOWN_ROOT = "(system, no subdir)", "(same-directory relative)", "?"


def hrefs(html: Column | str) -> Column:
    return F.regexp_extract_all(column(html), F.lit(HREF), F.lit(1))


def includes(text: Column | str) -> Column:
    """Include directives that start a line: an array of (opening delimiter, path)."""
    found = [F.regexp_extract_all(F.replace(column(text), F.lit("\r\n"), F.lit("\n")), F.lit(INCLUDE), F.lit(i)) for i in (1, 2)]
    return F.transform(F.arrays_zip(found[0].alias("opening"), found[1].alias("path")), lambda x: F.struct(x["opening"].alias("opening"), x["path"].alias("path")))


def normalised(ref: Column | str, collapse_slashes: bool = False) -> Column:
    """Backslashes become slashes; leading dots and slashes, in any mixture, go."""
    out = F.regexp_replace(F.replace(column(ref), F.lit("\\"), F.lit("/")), "^[./]+", "")
    return F.regexp_replace(out, "/+", "/") if collapse_slashes else out


def unmatched_bucket(ref: Column | str, angled: Column) -> Column:
    """The first segment with a slash; of a reference with one segment, whether it was in angle brackets."""
    ref = column(ref)
    return F.when(F.instr(ref, "/") > 0, F.concat(F.substring_index(ref, "/", 1), F.lit("/"))).when(angled, F.lit(SYSTEM)).otherwise(F.lit(SAME_DIRECTORY))


def rooted(ref: Column | str, roots: list[tuple[str, str]]) -> Column:
    """root || rest for the first (prefix, root) that the reference starts with, else null. A literal CASE, so no join."""
    ref, out = column(ref), F.lit(None).cast("string")
    for prefix, root in reversed(roots):
        out = F.when(F.startswith(ref, F.lit(prefix)), F.concat(F.lit(root), F.substr(ref, F.lit(len(prefix) + 1)))).otherwise(out)
    return out


def blamed(ref: Column | str, roots: list[str]) -> Column:
    """The longest root that the reference starts with, else '?'."""
    ref, out = column(ref), F.lit(UNKNOWN_ROOT)
    for root in sorted(roots, key=lambda r: (len(r), r)):
        out = F.when(F.startswith(ref, F.lit(root)), F.lit(root)).otherwise(out)
    return out
