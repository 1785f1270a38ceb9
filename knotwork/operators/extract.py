"""A small extractor: files, types, functions and inheritance, by regular expressions of built-in functions.

It replaces a full parser where an extraction of a code corpus is wanted: a node per file and per definition, with edges for
definition, inheritance, imports and calls. It shuffles only names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, normalised_id, without_extension
from .corpus import SOURCE_EXTENSIONS

#: kind, extensions, pattern (name in group 1, a base in group 2 where there is one).
PATTERNS = [
    ("class", SOURCE_EXTENSIONS, r"(?m)^\s*(?:class|struct)\s+([A-Za-z_]\w*)\s*(?:final\s*)?(?::\s*(?:public|protected|private)?\s*([A-Za-z_][\w:]*))?[^;{]*\{"),
    ("class", [".py"], r"(?m)^class\s+([A-Za-z_]\w*)\s*(?:\(\s*([A-Za-z_][\w.]*))?"),
    ("function", [".py"], r"(?m)^\s*def\s+([A-Za-z_]\w*)\s*\("),
]


def family(path: str) -> Column:
    """One name for the extensions of a language."""
    ext = extension(path)
    return F.when(ext.isin(SOURCE_EXTENSIONS), "c").otherwise(ext)


def _found(pattern: str, groups: int) -> Column:
    names = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
    bases = F.regexp_extract_all("text", F.lit(pattern), F.lit(2)) if groups > 1 else F.transform(names, lambda n: F.lit(""))
    return F.transform(F.arrays_zip(names.alias("name"), bases.alias("base")), lambda x: F.struct(x["name"].alias("name"), F.coalesce(x["base"], F.lit("")).alias("base")))


def definitions(texts: DataFrame) -> DataFrame:
    """path, kind, name, base: a row per definition."""
    out = None
    for kind, extensions, pattern in PATTERNS:
        rows = texts.where(extension("path").isin(extensions)).select("path", F.lit(kind).alias("kind"), F.explode(_found(pattern, 1 if kind == "function" else 2)).alias("d")).select("path", "kind", "d.*")
        out = rows if out is None else out.union(rows)
    return out.distinct()


def imports(texts: DataFrame) -> DataFrame:
    """path, target: the path without extension, below the checkout, that a Python file imports. Includes are the linker's."""
    found = F.concat(F.regexp_extract_all("text", F.lit(r"(?m)^\s*import\s+([A-Za-z_][\w.]*)"), F.lit(1)), F.regexp_extract_all("text", F.lit(r"(?m)^\s*from\s+([A-Za-z_][\w.]*)\s+import"), F.lit(1)))
    return texts.where(extension("path") == ".py").select("path", F.explode(F.array_distinct(found)).alias("m")).select("path", F.replace("m", F.lit("."), F.lit("/")).alias("target"))


def called(texts: DataFrame) -> DataFrame:
    """path, name (of a function), callee: names that a function's lines call, up to the next definition at the file's margin."""
    blocks = texts.where(extension("path") == ".py").select("path", F.explode(F.split("text", r"(?m)^(?=def\s|class\s|@)")).alias("block"))
    names = F.array_distinct(F.regexp_extract_all("body", F.lit(r"\b([A-Za-z_]\w*)\s*\("), F.lit(1)))
    rows = blocks.select("path", F.regexp_extract("block", r"^def\s+([A-Za-z_]\w*)", 1).alias("name"), F.regexp_replace("block", r"^def\s+[A-Za-z_]\w*\s*\(", "").alias("body")).where("name <> ''")
    return rows.select("path", "name", F.explode(names).alias("callee"))


def extract(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of texts (path, text): files, definitions, and contains, inherits, imports and calls between them.

    Bases and called names are matched to definitions of the same language anywhere in the texts, the first by id; unknown ones make
    no edge. What is inherited or imported is stated (EXTRACTED), what is called is found by name (INFERRED).
    """
    file_id = normalised_id(without_extension("path"))
    found = definitions(texts).select("path", "kind", "name", "base", F.concat(file_id, F.lit("_"), normalised_id("name")).alias("id"), file_id.alias("file"), family("path").alias("family"))
    files = texts.select(file_id.alias("id"), F.element_at(F.split("path", "/"), -1).alias("label"), F.lit("code").alias("file_type"), F.col("path").alias("source_file"))
    nodes = files.union(found.select("id", F.col("name").alias("label"), F.lit("code"), "path")).groupBy("id").agg(F.min(F.struct("source_file", "label", "file_type")).alias("x")).select("id", "x.label", "x.file_type", "x.source_file")
    classes = found.where("kind = 'class'").groupBy(F.col("name").alias("base_name")).agg(F.min("id").alias("base_id"))
    known = found.groupBy(F.col("name").alias("callee"), "family").agg(F.min("id").alias("callee_id"))
    inherits = found.where("base <> ''").withColumn("base_name", F.element_at(F.split("base", "::|\\."), -1)).join(classes, "base_name").where("id <> base_id")
    modules = texts.where(extension("path") == ".py").select(without_extension("path").alias("target"), file_id.alias("target_id")).distinct()
    imported = imports(texts).join(modules, "target").select(file_id.alias("source"), F.col("target_id").alias("target")).where("source <> target")
    calls = called(texts).withColumn("family", family("path")).join(known, ["callee", "family"]).select(F.concat(file_id, F.lit("_"), normalised_id("name")).alias("source"), F.col("callee_id").alias("target")).where("source <> target")
    edges = found.select(F.col("file").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("relation"), F.lit("EXTRACTED").alias("confidence"), F.lit(1.0).alias("confidence_score"))
    edges = edges.union(inherits.select("id", "base_id", F.lit("inherits"), F.lit("EXTRACTED"), F.lit(1.0)))
    edges = edges.union(imported.select("source", "target", F.lit("imports"), F.lit("EXTRACTED"), F.lit(1.0)))
    edges = edges.union(calls.select("source", "target", F.lit("calls"), F.lit("INFERRED"), F.lit(0.85))).distinct()
    return nodes, edges.withColumn("weight", F.lit(1.0))
