"""Files of a checkout as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import includes, normalised, rooted, unmatched_bucket
from ..functions.text import extension
from ..operators.corpus import SOURCE_EXTENSIONS, glob_pattern


def decoded(content: Column) -> Column:
    """UTF-8 text: bytes that aren't valid go, Windows line ends become line feeds."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit("")), "\r\n?", "\n")


def relative(path: Column, root: str) -> Column:
    """The path below root; Spark gives paths as URIs."""
    prefix = root.rstrip("/") + "/"
    plain = F.url_decode(F.replace(F.regexp_replace(path, "^[a-z]+:/*(?=/)", ""), F.lit("+"), F.lit("%2B")))
    bare = prefix if prefix.startswith("/") else "/" + prefix.split(":", 1)[-1].lstrip("/")
    return F.when(F.startswith(plain, F.lit(bare)), F.substr(plain, F.lit(len(bare) + 1)))


def _read(spark: SparkSession, root: str) -> DataFrame:
    """All files below root; those that vanish or can't be read are left out."""
    return spark.read.format("binaryFile").options(recursiveFileLookup=True, ignoreMissingFiles=True, ignoreCorruptFiles=True).load(root)


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length of all files below root. Contents aren't read."""
    files = _read(spark, root)
    return files.select(relative(F.col("path"), root).alias("path"), "length")


def scan_texts(spark: SparkSession, root: str, extensions: list[str] | None = None) -> DataFrame:
    """path, text of the files with the given extensions (any case), by default of program sources."""
    wanted = SOURCE_EXTENSIONS if extensions is None else extensions
    files = _read(spark, root)
    rows = files.select(relative(F.col("path"), root).alias("path"), "content").where(extension("path").isin(wanted))
    return rows.select("path", decoded(F.col("content")).alias("text"))


def resolve_targets(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """name, path: the files of each chunk. A target is '.', a pattern (with * ? [) or a file or folder below the chunk's root.

    The chunk map is a fixed, small table, so its targets become one condition a chunk.
    """
    out = None
    for row in chunks.select("name", "root", "targets").collect():
        condition = F.lit(False)
        for target in row["targets"]:
            base = row["root"].strip("/")
            full = base if target == "." else f"{base}/{target}".strip("/")
            if any(c in target for c in "*?["):
                condition |= F.col("path").rlike(glob_pattern(full))
            elif full in ("", "."):
                condition = F.lit(True)
            else:
                condition |= (F.col("path") == full) | F.startswith("path", F.lit(full + "/"))
        one = files.where(condition).select(F.lit(row["name"]).alias("name"), "path")
        out = one if out is None else out.union(one)
    return out.distinct()


def scan_includes(texts: DataFrame, roots: list[tuple[str, str]], collapse_slashes: bool = False) -> DataFrame:
    """src, ref (the included path below the checkout, or null), bucket (of one without a root): a row per directive."""
    rows = texts.select(F.col("path").alias("src"), F.explode(includes("text")).alias("x"))
    rows = rows.select("src", F.col("x.opening").alias("opening"), normalised("x.path", collapse_slashes).alias("name"))
    ref = rooted("name", roots)
    return rows.select("src", ref.alias("ref"), F.when(ref.isNull(), unmatched_bucket("name", F.col("opening") == "<")).alias("bucket"))


def repo_paths(nodes: DataFrame, root: str, engine: str) -> DataFrame:
    """Adds repo_path (source_file below the checkout, normalised) and outcome: stamped, outside or missing."""
    full = F.when(F.startswith("source_file", F.lit("/")), F.col("source_file")).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), "source_file"))
    parts = F.filter(F.split(full, "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(parts, F.expr("cast(array() AS array<string>)"), lambda s, p: F.when(p == "..", F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0)))).otherwise(F.concat(s, F.array(p))))
    path, base = F.concat(F.lit("/"), F.array_join(walked, "/")), engine.rstrip("/") + "/"
    missing = F.coalesce(F.col("source_file"), F.lit("")) == ""
    inside = F.startswith(path, F.lit(base))
    return nodes.withColumn("repo_path", F.when(~missing & inside, F.substr(path, F.lit(len(base) + 1)))).withColumn("outcome", F.when(missing, "missing").when(inside, "stamped").otherwise("outside"))
