"""References across chunks: resolution, classification, tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.refs import blamed


def path_index(nodes: DataFrame, path: str, identifier: str) -> DataFrame:
    """path, id: of the nodes on a path the one with the shortest identifier, then the first in the alphabet."""
    best = nodes.where(F.col(path).isNotNull()).groupBy(path).agg(F.min(F.struct(F.length(identifier).alias("size"), F.col(identifier).alias("id"))).alias("b"))
    return best.select(path, F.col("b.id").alias("id"))


def resolve(refs: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """refs (src, ref, ...) whose src is indexed, with source (its node) and target (the ref's node, or null).

    sources: src, source. targets: ref, target.
    """
    return refs.join(sources, "src").join(targets, "ref", "left")


def unresolved_by_root(resolved: DataFrame, roots: list[str]) -> DataFrame:
    """root, n: distinct unresolved (src, ref) by the longest root that the reference starts with, else '?'."""
    missed = resolved.where("target IS NULL").select("src", "ref").distinct()
    return missed.groupBy(blamed("ref", roots).alias("root")).agg(F.count("*").alias("n"))


def tally(refs: DataFrame, top: int = 10) -> DataFrame:
    """metric, key, n: all references, those under a root (matched), and the most frequent buckets of the others."""
    overall = refs.agg(F.count("*").alias("total"), F.count_if("matched").alias("matched"))
    counts = overall.select(F.explode(F.array(F.struct(F.lit("total").alias("metric"), F.lit("").alias("key"), F.col("total").alias("n")), F.struct(F.lit("matched").alias("metric"), F.lit("").alias("key"), F.col("matched").alias("n")))).alias("x")).select("x.*")
    buckets = refs.where("NOT matched").groupBy(F.col("bucket").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(top)
    return counts.unionByName(buckets.select(F.lit("bucket").alias("metric"), "key", "n"))


def cross_edges(edges: DataFrame) -> DataFrame:
    """Distinct directed pairs whose ends are in different repos."""
    return edges.where("source_repo <> target_repo").select("source_repo", "source", "target_repo", "target").distinct()


def index_path(root, repo_path="repo_path", source_file="source_file") -> Column:
    """The path below the checkout that a node is indexed by: its own, else its chunk's root and source file; null if that goes upwards."""
    file = F.replace(F.col(source_file), F.lit("\\"), F.lit("/"))
    usable = F.coalesce(file != "", F.lit(False)) & ~F.contains(file, F.lit(".."))
    base = F.rtrim(F.coalesce(root, F.lit("")), F.lit("/"))
    below = F.when(base.isin("", "."), file).otherwise(F.concat(base, F.lit("/"), file))
    return F.coalesce(F.nullif(F.col(repo_path), F.lit("")), F.when(usable, below))


#: Fixed values of an edge that the linker adds.
LINKED = {"relation": "includes", "context": "cross_module_include", "confidence": "EXTRACTED", "confidence_score": 1.0, "weight": 1.0, "origin": "cross_link"}


def link(includes: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cross edges, one row of counts) of include references.

    includes: src (a path), ref (a path, or null where no root matched), a row per directive. index: repo, path, id. Sources that
    aren't indexed are skipped, targets that aren't are counted as unresolved; pairs within a repo are counted as intra. Edges are
    distinct pairs keyed on (repo, id), with the first path of the source: the owner of an end is the indexed node itself, so equal
    ids in two repos stay apart.
    """
    owner = index.groupBy("path").agg(F.min(F.struct(F.length("id").alias("size"), "id", "repo")).alias("o")).select("path", F.col("o.id").alias("id"), F.col("o.repo").alias("repo"))
    pairs = includes.where("ref IS NOT NULL").select("src", "ref").distinct()
    found = pairs.join(owner.select(F.col("path").alias("src"), F.col("id").alias("source"), F.col("repo").alias("source_repo")), "src")
    found = found.join(owner.select(F.col("path").alias("ref"), F.col("id").alias("target"), F.col("repo").alias("target_repo")), "ref", "left")
    resolved = found.where("target IS NOT NULL")
    crossing = resolved.where("source_repo <> target_repo").groupBy("source_repo", "source", "target_repo", "target").agg(F.min("src").alias("source_file"))
    edges = crossing.withColumns({k: F.lit(v) for k, v in LINKED.items()})
    counts = includes.agg(F.count("*").alias("total_includes"), F.count("ref").alias("matched"), F.countDistinct("src").alias("files_scanned"))
    pair_counts = found.agg(F.count_if(F.col("target").isNull()).alias("unresolved_includes"), F.count_if(F.col("source_repo") == F.col("target_repo")).alias("intra_module_includes_skipped"))
    exact = includes.where("ref IS NOT NULL").join(owner.select(F.col("path").alias("src")), "src", "left_semi").join(owner.select(F.col("path").alias("ref")), "ref", "left_semi").agg(F.count("*").alias("resolved_directives"))
    stats = counts.join(F.broadcast(pair_counts), F.lit(True)).join(F.broadcast(exact), F.lit(True)).join(F.broadcast(edges.agg(F.count("*").alias("cross_module_edges"))), F.lit(True)).join(F.broadcast(owner.agg(F.count("*").alias("indexed_files"))), F.lit(True))
    # the usual figure subtracts distinct pairs from directives; resolved_directives counts directives alone
    return edges, stats.withColumn("resolved_includes", F.col("matched") - F.col("unresolved_includes")).withColumn("ignored", F.col("total_includes") - F.col("matched")).drop("matched")


def missed(includes: DataFrame, index: DataFrame, roots: list[str]) -> DataFrame:
    """kind, key, n of references that made no edge: ``unresolved`` by the root of the target's path, ``ignored`` by their first segment.

    roots: target roots, in the order in which they are tried. Of the ignored the ten most frequent are kept.
    """
    known = index.select("path").distinct()
    pairs = includes.where("ref IS NOT NULL").select("src", "ref").distinct()
    lost = pairs.join(known.select(F.col("path").alias("src")), "src", "left_semi").join(known.select(F.col("path").alias("ref")), "ref", "left_anti")
    root = F.lit("?")
    for r in reversed(roots):
        root = F.when(F.startswith("ref", F.lit(r + "/")), F.lit(r)).otherwise(root)
    unresolved = lost.groupBy(root.alias("key")).agg(F.count("*").alias("n")).select(F.lit("unresolved").alias("kind"), "key", "n")
    ignored = includes.where("ref IS NULL").groupBy(F.col("bucket").alias("key")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "key").limit(10)
    return unresolved.union(ignored.select(F.lit("ignored").alias("kind"), "key", "n"))
