"""Curated names: anchors, attachment to clusters, preservation, synchronisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import NAME_SEPARATOR, is_curated, names_of

ANCHOR_COUNT, MAX_NAMES, LEAST_HITS = 15, 2, 4
#: Least recall, as a fraction of whole numbers: 2/5.
RECALL = (2, 5)


def node_degree(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, degree: both ends of every edge count, so a self-loop counts twice and repeated edges each count."""
    return edges.select(F.explode(F.array(source, target)).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))


def top_anchors(members: DataFrame, degrees: DataFrame, count: int = ANCHOR_COUNT) -> DataFrame:
    """community, rank, node: each community's nodes of highest degree, ties by node. members: community, node."""
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    ranked = members.where("community IS NOT NULL").join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("community", "rank", "node")


def claims(anchors: DataFrame, members: DataFrame) -> DataFrame:
    """entry, label, n, community, hit, placed: each anchored entry's best community.

    anchors: entry (position), label, node. The most anchors win, ties by community; placed if at least two fifths of the anchors and
    at least four of them (or all, if fewer) are there. Entries without anchors don't appear; entries that hit nothing have no community.
    """
    sizes = anchors.groupBy("entry", "label").agg(F.count("*").alias("n"))
    hits = anchors.join(members.where("community IS NOT NULL"), "node").groupBy("entry", "community").agg(F.count("*").alias("hit"))
    # argmax as an aggregation: an entry's communities are reduced before the shuffle
    best = hits.groupBy("entry").agg(F.min(F.struct((-F.col("hit")).alias("less"), "community")).alias("b"))
    out = sizes.join(best.select("entry", F.col("b.community").alias("community"), (-F.col("b.less")).alias("hit")), "entry", "left")
    enough = (RECALL[1] * F.col("hit") >= RECALL[0] * F.col("n")) & (F.col("hit") >= F.least(F.lit(LEAST_HITS), F.col("n")))
    return out.withColumn("placed", F.coalesce(enough, F.lit(False)))


def attach(claimed: DataFrame) -> DataFrame:
    """community, name: its two best claims by recall, then by position, joined."""
    order = Window.partitionBy("community").orderBy(F.desc(F.col("hit") / F.col("n")), "entry")
    top = claimed.where("placed").withColumn("k", F.row_number().over(order)).where(F.col("k") <= MAX_NAMES)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "label"))), lambda x: x["label"]), NAME_SEPARATOR)
    return top.groupBy("community").agg(joined.alias("name"))


def attach_stats(claimed: DataFrame, entries: DataFrame) -> DataFrame:
    """One row: mode, threshold, matched communities, placed and dropped labels, communities with several claims, labels available.

    entries: the rows of the anchor table, of which those without anchors count as available too.
    """
    per = claimed.where("placed").groupBy("community").agg(F.count("*").alias("claims"))
    merged = per.agg(F.count("*").alias("matched"), F.count_if(F.col("claims") > 1).alias("merged_communities"))
    counts = claimed.agg(F.count_if("placed").alias("labels_placed"), F.count_if(~F.col("placed")).alias("labels_dropped"))
    all_ = entries.agg(F.count("*").alias("available"))
    return counts.join(F.broadcast(merged), F.lit(True)).join(F.broadcast(all_), F.lit(True)).withColumns({"mode": F.lit("anchor"), "threshold": F.lit(RECALL[0] / RECALL[1])})


def attach_by_id(members: DataFrame, labels: DataFrame) -> DataFrame:
    """The fallback without anchors: names by (repo, community) of the communities that exist."""
    return members.select("repo", "community").distinct().join(labels, ["repo", "community"])


def preserve(old: DataFrame, mapping: DataFrame, top: DataFrame) -> DataFrame:
    """label, kind, anchors: old entries whose label isn't among the new names, then one entry per name of each community with members.

    old: label, anchors (joined). mapping: community, name (perhaps "A / B"). top: community, rank, node.
    """
    new = mapping.withColumn("label", F.explode(names_of("name")))
    kept = old.join(new.select("label").distinct(), "label", "left_anti").select("label", F.lit("kept").alias("kind"), "anchors")
    listed = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("anchors"))
    return kept.unionByName(new.join(listed, "community").select("label", F.lit("new").alias("kind"), "anchors"))


def sync(nodes: DataFrame, requested: DataFrame) -> DataFrame:
    """repo, community, name: each requested repo's curated names, from its nodes; a repo without any has one row of nulls.

    nodes: repo, community, community_name, position; the last node of a community decides its name.
    """
    named = nodes.where(F.col("community").isNotNull() & is_curated("community_name"))
    last = named.groupBy("repo", "community").agg(F.max_by("community_name", "position").alias("name"))
    return requested.join(last, "repo", "left")


def missing_names(wanted: DataFrame, attached: DataFrame, built: DataFrame) -> DataFrame:
    """repo, name: wanted names that no community of a built repo carries; both sides may hold joined names."""
    split = [t.select("repo", F.explode(names_of("name")).alias("name")).distinct() for t in (wanted, attached)]
    return split[0].join(built.select("repo").distinct(), "repo", "left_semi").join(split[1], ["repo", "name"], "left_anti")


def retention(nodes: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row: distinct curated names in the graph (attached), labels ever anchored, and whether the first is at least half.

    Labels are distinct in their own anchor file, that is, by repo; the files' counts are summed. anchors: repo, label.
    """
    curated = F.coalesce(is_curated("community_name"), F.lit(False))
    have = nodes.agg(F.countDistinct(F.when(curated, F.col("community_name"))).alias("attached"))
    want = anchors.select("repo", "label").distinct().agg(F.count("*").alias("anchored"))
    return have.join(F.broadcast(want), F.lit(True)).withColumn("ok", 2 * F.col("attached") >= F.col("anchored"))


def anchor_entries(preserved: DataFrame) -> DataFrame:
    """entry, label, anchors (array): the anchor table in the order to write: kept entries as they were, then new ones by community.

    preserved: label, kind, anchors (joined), and entry (of kept ones) or community (of new ones).
    """
    order = Window.orderBy(F.col("kind") != "kept", F.coalesce("entry", "community"), "label")
    rows = preserved.withColumn("entry", (F.row_number().over(order) - 1).cast("int"))
    return rows.select("entry", "label", F.filter(F.split("anchors", ","), lambda x: x != "").alias("anchors"))
