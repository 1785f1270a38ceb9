"""Files of a corpus: coverage, collection, semantic preparation and validation, fragments, detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import extension, word_count
from .select import first_reason, first_wins, packed

#: Fixed values.
CODE_EXTENSIONS = [".hpp", ".h", ".hxx", ".hh", ".inl", ".ipp", ".cpp", ".cc", ".cxx", ".c", ".py", ".ipynb", ".i", ".java"]
BUILD_EXTENSIONS = [*CODE_EXTENSIONS, ".cs", ".ts", ".js"]
DATA_EXTENSIONS = [".xml", ".csv", ".xsd", ".tex", ".md", ".json", ".txt"]
SOURCE_EXTENSIONS = [".hpp", ".h", ".hxx", ".hh", ".inl", ".ipp", ".cpp", ".cc", ".cxx", ".c"]
IGNORED_FOLDERS = [".git", ".vs", "build", "node_modules", "__pycache__", ".github", "ThirdPartyLibs", "cmake", "Docker", ".ci"]
IGNORED_NAMES = ["cmakelists.txt", "cmakepresets.json", "license.txt", "license", "licenseheader.txt", "changelog.txt", "news.txt", "news.md", "readme.md", "contributing.md", "contributors.txt", ".mcp.json", "version_number.txt", ".lsan.txt", "doxy-coverage.py"]
SKIPPED_PARTS = ["ExpectedOutput", "Output", "expected_output", "__pycache__"]
MAX_BYTES, GROUP_SIZE = 400_000, 20


def coverage(files: DataFrame, claimed: DataFrame, excluded: list[tuple[str, str]]) -> DataFrame:
    """path, status (ignored, claimed, excluded, code, data, other), reason, top: the first rule that fits, in the order of the names.

    Ignored folders come before claims, ignored names after them. files: path. claimed: path.
    """
    parts = F.split("path", "/")
    name = F.lower(F.element_at(parts, -1))
    ext, reason = extension("path"), first_reason("path", excluded)
    marked = files.join(claimed.select("path").distinct().withColumn("claim", F.lit(True)), "path", "left")
    status = (
        F.when(F.arrays_overlap(parts, F.array(*[F.lit(x) for x in IGNORED_FOLDERS])), "ignored")
        .when(F.col("claim").isNotNull(), "claimed")
        .when(name.isin(IGNORED_NAMES), "ignored")
        .when(reason.isNotNull(), "excluded")
        .when(ext.isin(CODE_EXTENSIONS), "code")
        .when(ext.isin(DATA_EXTENSIONS), "data")
        .otherwise("other")
    )
    return marked.select("path", status.alias("status"), F.when(status == "excluded", reason).alias("reason"), parts[0].alias("top"))


def unclaimed_by_top(covered: DataFrame, status: str = "code") -> DataFrame:
    """top, n: unclaimed files (of code, or of data) by their path's first part, which is the name of a file at the root."""
    return covered.where(F.col("status") == status).groupBy("top").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "top")


def excluded_by_reason(covered: DataFrame) -> DataFrame:
    return covered.where("status = 'excluded'").groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def glob_pattern(target: str) -> str:
    """A regular expression for a path pattern: * and ? stay within a part, ** spans parts."""
    out, i = "^", 0
    special = set(".^$+(){}|\\")
    while i < len(target):
        if target.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif target.startswith("**", i):
            out, i = out + ".*", i + 2
        elif target[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif target[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + ("\\" if target[i] in special else "") + target[i], i + 1
    return out + "$"


def collect(files: DataFrame, root: str, patterns: list[str]) -> DataFrame:
    """Files for semantic extraction, in order: below root, of one of the patterns there, no skipped part there, at most MAX_BYTES.

    files: path, length.
    """
    base = root.strip("/")
    base = "" if base in ("", ".") else base + "/"
    rest = F.substr(F.col("path"), F.lit(len(base) + 1))
    fits = F.lit(False)
    for p in patterns:
        fits |= rest.rlike(glob_pattern(p))
    skip = F.arrays_overlap(F.split(rest, "/"), F.array(*[F.lit(x) for x in SKIPPED_PARTS]))
    return files.where(F.startswith("path", F.lit(base)) & fits & ~skip & (F.col("length") <= MAX_BYTES)).orderBy("path")


def manifest(files: DataFrame, size: int = GROUP_SIZE) -> DataFrame:
    """chunk, total, output, files: groups of ``size`` in (folder, file) order; a group may span folders."""
    folder = F.when(F.instr("path", "/") > 0, F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.lit("."))
    groups = packed(files.select("path", folder.alias("folder")), "folder", "path", size)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("folder", "path"))), lambda x: x["path"])
    out = groups.groupBy("chunk").agg(listed.alias("files"))
    total = out.agg(F.count("*").alias("total"))
    return out.join(F.broadcast(total), F.lit(True)).select("chunk", "total", F.format_string("chunk_%02d.json", "chunk").alias("output"), "files")


def validate(manifested: DataFrame, outputs: DataFrame) -> DataFrame:
    """chunk, status (ok, missing, invalid), nodes, edges. outputs: output, content (JSON text)."""
    doc = F.try_parse_json("content")
    nodes, edges = (F.try_variant_get(doc, f"$.{x}", "array<variant>") for x in ("nodes", "edges"))
    joined = manifested.select("chunk", "output").join(outputs, "output", "left")
    rows = joined.select("chunk", F.col("content").isNull().alias("absent"), F.size(nodes).alias("n"), F.size(edges).alias("e"), nodes.isNotNull().alias("has_n"), edges.isNotNull().alias("has_e"))
    good = F.col("has_n") & F.col("has_e")
    status = F.when(F.col("absent"), "missing").when(good, "ok").otherwise("invalid")
    return rows.select("chunk", status.alias("status"), F.when(good, F.col("n")).otherwise(0).cast("long").alias("nodes"), F.when(good, F.col("e")).otherwise(0).cast("long").alias("edges"))


def merge_fragments(fragments: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hyperedges) of fragments (file, nodes, edges, hyperedges): the first of an id wins, edges all stay."""
    def rows(column: str) -> DataFrame:
        return fragments.select("file", F.posexplode(column).alias("pos", "x")).select("file", "pos", "x.*")

    return first_wins(rows("nodes"), ["id"], ["file", "pos"]), rows("edges"), first_wins(rows("hyperedges"), ["id"], ["file", "pos"])


def detect(files: DataFrame) -> DataFrame:
    """path, kind, words: what each file is. files: path, text."""
    kind = F.when(extension("path").isin(BUILD_EXTENSIONS), "code").when(extension("path").isin(DATA_EXTENSIONS), "data").otherwise("other")
    return files.select("path", kind.alias("kind"), word_count("text").alias("words"))


def merge_detections(found: DataFrame) -> DataFrame:
    """kind, n_files, words of the union of detections (path, kind, words). The files of a kind are the rows of that kind."""
    return found.groupBy("kind").agg(F.count("*").alias("n_files"), F.sum("words").alias("words"))


def changed(current: DataFrame, snapshot: DataFrame, key: str, text: str) -> DataFrame:
    """key, fingerprint of the rows that the snapshot (key, fingerprint) lacks or has otherwise."""
    now = current.select(key, F.coalesce(F.md5(text), F.lit("null")).alias("fingerprint"))
    return now.join(snapshot, [key, "fingerprint"], "left_anti")
