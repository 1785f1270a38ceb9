"""Merging chunk graphs into one namespaced graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .refs import link

COMMUNITY_STRIDE = 1_000_000
ENDS = ("source_repo", "source", "target_repo", "target")


def union_all(tables: list[DataFrame]) -> DataFrame:
    if not tables:
        raise ValueError("no chunk graph was built")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def qualified(repo, local):
    return F.concat_ws("::", repo, local)


def merged_nodes(nodes: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Adds id, local_id, offset community, community_key and community_name (curated, or made from the number).

    nodes: repo, ord (the chunk's position), local_id, community, ... A chunk's offset is its position among the chunks that have
    nodes. names: repo, community, name. A null community has neither key nor name.
    """
    chunks = nodes.groupBy("repo").agg(F.min("ord").alias("o"))
    chunks = chunks.select("repo", (F.dense_rank().over(Window.orderBy("o", "repo")) - 1).cast("long").alias("chunk_index"))
    out = nodes.join(chunks, "repo")
    if names is not None:
        out = out.join(names.select("repo", "community", F.col("name").alias("curated")), ["repo", "community"], "left")
    else:
        out = out.withColumn("curated", F.lit(None).cast("string"))
    has = F.col("community").isNotNull()
    default = F.concat(F.col("repo"), F.lit(" / Community "), F.col("community").cast("string"))
    return (
        out.withColumn("id", qualified("repo", "local_id"))
        .withColumn("community_key", F.when(has, F.concat_ws(":", "repo", F.col("community").cast("string"))))
        .withColumn("community_name", F.when(has, F.coalesce("curated", default)))
        .withColumn("community", F.col("chunk_index") * COMMUNITY_STRIDE + F.col("community"))
        .drop("curated", "chunk_index")
    )


def merged_edges(edges: DataFrame) -> DataFrame:
    """Qualifies both ends. An edge carries its ends' repos, so equal local ids in two chunks can't be confused."""
    return edges.withColumn("source", qualified("source_repo", "source")).withColumn("target", qualified("target_repo", "target"))


def merged_hyperedges(hyperedges: DataFrame) -> DataFrame:
    nodes = F.transform("nodes", lambda n: F.concat(F.col("repo"), F.lit("::"), n))
    return hyperedges.withColumn("id", qualified("repo", "id")).withColumn("nodes", nodes)


def incidence(hyperedges: DataFrame) -> DataFrame:
    return hyperedges.select("id", F.explode("nodes").alias("node"))


def merge_graph(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame | None, names: DataFrame | None, includes: DataFrame | None = None, index: DataFrame | None = None) -> dict[str, DataFrame]:
    """The merged graph: nodes, edges (with the linker's across chunks), hyperedges, and stats, the linker's row of counts.

    Order of work: names attach, all is qualified and united, then crossing references are added. includes, index: as for
    ``refs.link``; without them there are no crossing references and no stats.
    """
    out = {"nodes": merged_nodes(nodes, names)}
    if includes is not None and index is not None:
        crossing, out["stats"] = link(includes, index)
        edges = union_all([edges, crossing.select("source_repo", "source", "target_repo", "target", *[c for c in crossing.columns if c in edges.columns and c not in ENDS])])
    out["edges"] = merged_edges(edges)
    if hyperedges is not None:
        out["hyperedges"] = merged_hyperedges(hyperedges)
    return out


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, edges, communities, repos."""
    left = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("repo", "community").alias("communities"), F.countDistinct("repo").alias("repos"))
    return left.join(F.broadcast(edges.agg(F.count("*").alias("edges"))), F.lit(True))
