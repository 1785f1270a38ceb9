"""Proposing, auditing and digesting names: token bags, TF-IDF, vocabulary checks, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import first_filled, last_segment, name_tokens

STALE = (1, 4)
ABSENT = "no such community"


def token_bags(docs: DataFrame, group: str, text: str) -> DataFrame:
    """group, token, tf."""
    return docs.select(group, F.explode(name_tokens(text)).alias("token")).groupBy(group, "token").agg(F.count("*").alias("tf"))


def doc_freq(bags: DataFrame) -> DataFrame:
    """token, df: the groups that hold each token (bags have a row per group and token)."""
    return bags.groupBy("token").agg(F.count("*").alias("df"))


def propose(names: DataFrame, bags: DataFrame, group: str) -> DataFrame:
    """Each name's best group by the sum of tf/total x ln(N/(1+df)) over its tokens, repeats counting; null unless the sum is above 0.

    names: id, name, original. Returns id, proposed, score (in billionths), changed, ambiguous (no group, or one that several names
    want). Terms are summed as decimals: the order of addition doesn't show.
    """
    totals = bags.groupBy(group).agg(F.sum("tf").alias("total"))
    n = totals.agg(F.count("*").alias("groups"))
    asked = names.select("id", F.explode(name_tokens("name")).alias("token")).groupBy("id", "token").agg(F.count("*").alias("times"))
    wanted = bags.join(asked.select("token").distinct(), "token", "left_semi")
    weighted = wanted.join(doc_freq(wanted), "token").join(totals, group).join(F.broadcast(n), F.lit(True))
    term = F.col("tf") / F.col("total") * F.log(F.col("groups") / (1 + F.col("df")))
    scores = asked.join(weighted.select("token", group, term.alias("term")), "token")
    scores = scores.groupBy("id", group).agg(F.sum((F.col("times") * F.col("term")).cast("decimal(28,12)")).alias("score")).where("score > 0")
    best = scores.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("less"), F.col(group).alias("proposed"))).alias("b"))
    out = names.join(best, "id", "left").select("id", "original", F.col("b.proposed").alias("proposed"), F.floor(-F.col("b.less") * 1_000_000_000).cast("long").alias("score"))
    rivals = out.groupBy("proposed").agg(F.count("*").alias("rivals"))
    joined = out.join(rivals, "proposed", "left")
    return joined.select("id", "proposed", "score", (~F.col("proposed").eqNullSafe(F.col("original"))).alias("changed"), (F.col("proposed").isNull() | (F.coalesce("rivals", F.lit(0)) > 1)).alias("ambiguous"))


def audit(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """community, name, size, matched_tokens, matched, note, stale: whether a name shares a token with its community's paths and labels.

    A token matches even inside a word. matched_tokens keeps the name's order. A community that doesn't exist is a mismatch, with a
    note; more than a quarter of mismatches means that the numbers are stale, not the names. The tokens of each name are matched
    against each distinct text of its community, so no community's text is gathered in one place. Names and communities may repeat.
    """
    asked = labels.select("community", "name", F.posexplode_outer(name_tokens("name")).alias("at", "token"))
    text = F.lower(F.concat_ws(" ", first_filled("repo_path", "source_file"), F.coalesce("label", F.lit(""))))
    members = nodes.where("community IS NOT NULL")
    seen = members.join(labels.select("community").distinct(), "community", "left_semi").select("community", text.alias("text")).distinct()
    # a pair of community and token is looked for once, however many names have it
    pairs = asked.where("token IS NOT NULL").select("community", "token").distinct()
    hits = pairs.join(seen, "community").where(F.contains("text", F.col("token"))).select("community", "token").distinct().withColumn("hit", F.lit(True))
    sizes = members.groupBy("community").agg(F.count("*").alias("size"))
    found = asked.join(hits, ["community", "token"], "left").groupBy("community", "name").agg(F.array_sort(F.collect_list(F.when(F.col("hit"), F.struct("at", "token")))).alias("m"))
    out = found.join(sizes, "community", "left").select(
        "community",
        "name",
        F.coalesce("size", F.lit(0)).cast("long").alias("size"),
        F.array_join(F.array_distinct(F.transform("m", lambda x: x["token"])), " ").alias("matched_tokens"),
        (F.size("m") > 0).alias("matched"),
        F.when(F.col("size").isNull(), F.lit(ABSENT)).alias("note"),
    )
    totals = out.agg(F.coalesce(STALE[1] * F.count_if(~F.col("matched")) > STALE[0] * F.count("*"), F.lit(False)).alias("stale"))
    return out.join(F.broadcast(totals), F.lit(True))


def samples(nodes: DataFrame, proposed: DataFrame, count: int = 5) -> DataFrame:
    """proposed, members: the last parts of the first members of each proposed community. nodes: community, node, position."""
    order = Window.partitionBy("community").orderBy("position", "node")
    wanted = proposed.where("proposed IS NOT NULL").select(F.col("proposed").alias("community")).distinct()
    top = nodes.join(wanted, "community", "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") <= count)
    listed = F.array_sort(F.collect_list(F.struct("k", last_segment("node").alias("part"))))
    return top.groupBy(F.col("community").alias("proposed")).agg(F.array_join(F.transform(listed, lambda x: x["part"]), ",").alias("members"))


def first_files(nodes: DataFrame, count: int = 4) -> DataFrame:
    """community, files: its first files by name, joined. Ranked after reduction to distinct files."""
    files = nodes.where("community IS NOT NULL").select("community", first_filled("repo_path", "source_file").alias("file")).where("file <> ''").distinct()
    order = Window.partitionBy("community").orderBy("file")
    top = files.withColumn("k", F.row_number().over(order)).where(F.col("k") <= count)
    return top.groupBy("community").agg(F.array_join(F.array_sort(F.collect_list("file")), ",").alias("files"))


def top_communities(members: DataFrame, count: int = 40) -> DataFrame:
    """repo, community, size: the largest, ties by repo and community."""
    sizes = members.where("community IS NOT NULL").groupBy("repo", "community").agg(F.count("*").alias("size"))
    return sizes.orderBy(F.desc("size"), "repo", "community").limit(count)


def top_symbols(nodes: DataFrame, degrees: DataFrame, count: int = 12) -> DataFrame:
    """community, rank, node, label: by degree, ties by node. Blank labels go after the cut, as they took a place."""
    order = Window.partitionBy("community").orderBy(F.desc("degree"), "node")
    ranked = nodes.where("community IS NOT NULL").join(degrees, "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("rank", F.row_number().over(order))
    return ranked.where((F.col("rank") <= count) & (F.trim(F.coalesce("label", F.lit(""))) != "")).select("community", "rank", "node", "label")


def top_files(nodes: DataFrame, count: int = 10) -> DataFrame:
    """community, rank, file, n: its most common files, ties by name."""
    counts = nodes.where("community IS NOT NULL").groupBy("community", F.col("source_file").alias("file")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("community").orderBy(F.desc("n"), "file")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count).select("community", "rank", "file", "n")
