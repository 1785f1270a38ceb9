"""Repair of identifiers that carry an absolute path, by column expressions and joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import extension, normalised_id, without_extension
from ..scratch import Scratch

#: Extensions of headers and of implementations.
HEADERS = [".h", ".hpp", ".hxx", ".hh", ".inl", ".ipp"]
IMPLEMENTATIONS = [".cpp", ".cc", ".cxx", ".c", ".mm", ".m"]


def leaked_prefix(nodes: DataFrame) -> str | None:
    """What stands before a file's own identifier in the identifier of one of its nodes: the absolute path that leaked, or None."""
    with_ext = normalised_id("source_file")
    hit = nodes.where(F.coalesce(F.col("source_file"), F.lit("")) != "").where(F.endswith("id", F.concat(F.lit("_"), with_ext)))
    found = hit.select(F.expr("left(id, length(id) - length(source_file) - 1)").alias("p"), "source_file").orderBy("source_file", "p").first()
    return found["p"] if found else None


def remap(nodes: DataFrame, prefix: str) -> DataFrame:
    """id, new_id, kept_apart, generic of the nodes whose identifier carries the prefix.

    A file's own node and its symbols lose prefix and extension. Where that would join nodes, it does so only for exactly one header
    with implementations; other files keep their extension in a bare file identifier. Whatever else carries the prefix loses it.
    """
    short, long_ = normalised_id(without_extension("source_file")), normalised_id("source_file")
    old_symbol, old_file = F.concat(F.lit(prefix + "_"), short), F.concat(F.lit(prefix + "_"), long_)
    rest = F.expr("substr(id, length(old_symbol) + 1)")
    rows = nodes.where(F.coalesce(F.col("source_file"), F.lit("")) != "").select("id", "source_file", short.alias("short"), long_.alias("long"), old_symbol.alias("old_symbol"), old_file.alias("old_file"))
    tentative = F.when((F.col("id") == F.col("old_file")) | (F.col("id") == F.col("old_symbol")), F.col("short")).when(F.startswith("id", F.concat("old_symbol", F.lit("_"))), F.concat("short", rest))
    rows = rows.withColumn("t", tentative).where("t IS NOT NULL").withColumn("ext", extension("source_file"))
    groups = rows.groupBy("t").agg(
        F.countDistinct("id").alias("ids"),
        F.countDistinct("source_file").alias("files"),
        F.countDistinct(F.when(F.col("ext").isin(HEADERS), F.col("source_file"))).alias("headers"),
        F.countDistinct(F.when(F.col("ext").isin(IMPLEMENTATIONS), F.col("source_file"))).alias("impls"),
    )
    clean = (F.col("ids") == 1) | ((F.col("headers") == 1) & (F.col("headers") + F.col("impls") == F.col("files")))
    mapped = rows.join(groups, "t").select("id", F.when(clean, F.col("t")).otherwise(F.col("long")).alias("new_id"), (~clean).alias("kept_apart")).groupBy("id").agg(F.min("new_id").alias("new_id"), F.max("kept_apart").alias("kept_apart"))
    mapped = mapped.withColumn("generic", F.lit(False))
    others = nodes.select("id").distinct().where(F.startswith("id", F.lit(prefix + "_"))).join(mapped.select("id"), "id", "left_anti")
    return mapped.unionByName(others.select("id", F.expr(f"substr(id, {len(prefix) + 2})").alias("new_id"), F.lit(False).alias("kept_apart"), F.lit(True).alias("generic")))


def repair(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, dict]:
    """(nodes, edges, stats) with repaired identifiers; unchanged, with {"skipped": ...}, if none leaks. Running it twice changes nothing.

    Of nodes that become one, the header's attributes stay, then an implementation's, then the first by position. Edges that become
    self-loops go; those that were before stay. nodes: id, source_file, pos, ...; edges: source, target, ...
    """
    prefix = leaked_prefix(nodes)
    if prefix is None:
        return nodes, edges, {"skipped": "no identifier carries a path"}
    scratch = Scratch(nodes.sparkSession, "repair")
    new = scratch.save(remap(nodes, prefix))
    ext = extension(F.coalesce("source_file", F.lit("")))
    rank = F.when(ext.isin(HEADERS), 0).when(ext.isin(IMPLEMENTATIONS), 1).otherwise(2)
    moved = nodes.join(new.select("id", "new_id"), "id", "left").withColumn("id", F.coalesce("new_id", "id")).drop("new_id").withColumn("__rank", rank)
    order = Window.partitionBy("id").orderBy("__rank", "pos")
    kept = moved.withColumn("__k", F.row_number().over(order)).where("__k = 1").drop("__k", "__rank")
    ended = edges
    for end in ("source", "target"):
        ended = ended.join(new.select(F.col("id").alias(end), F.col("new_id").alias(f"__{end}")), end, "left")
    was_loop = F.col("source") == F.col("target")
    ends = {e: F.coalesce(f"__{e}", e) for e in ("source", "target")}
    redirected = ended.withColumn("__was", was_loop).withColumns(ends).where((F.col("source") != F.col("target")) | F.col("__was")).drop("__source", "__target", "__was")
    kept, redirected = scratch.save(kept), scratch.save(redirected)
    merged = new.groupBy("new_id").agg(F.count("*").alias("n"), F.max("generic").alias("generic"))
    counts = merged.agg(F.count_if((F.col("n") > 1) & ~F.col("generic")).alias("merges")).first()
    kinds = new.agg(F.count_if("generic").alias("generic"), F.count_if("kept_apart").alias("apart")).first()
    before, after = nodes.count(), kept.count()
    links, links_after = edges.count(), redirected.count()
    stats = {
        "prefix": prefix,
        "nodes_before": before,
        "nodes_after": after,
        "links_before": links,
        "links_after": links_after,
        "unmapped": nodes.where(F.coalesce(F.col("source_file"), F.lit("")) != "").join(new.where("NOT generic").select("id"), "id", "left_anti").count(),
        "generic_fixed": kinds["generic"],
        "collision_merges": counts["merges"],
        "files_kept_distinct": kinds["apart"],
        "selfloops_dropped": links - links_after,
        "still_absolute_after_fix": kept.where(F.startswith("id", F.lit(prefix + "_"))).count(),
    }
    return kept, redirected, stats
