"""Graph analytics: undirected view, components, label propagation, cohesion, hubs, surprising links.

Iterative operators are driver loops with one job a round; every round's table is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import FILE_ROWS, Scratch, tasks

#: Confidence, best first.
CONFIDENCES = ["EXTRACTED", "INFERRED", "AMBIGUOUS"]
SALTS = 16
#: Rows beyond which a table is never broadcast.
MANY = 50_000


def undirected(edges: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """a, b, relation, confidence: one row per unordered pair, of the best confidence, then the first relation. Ends must be in ids."""
    rank = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(c) for c in CONFIDENCES]), F.col("confidence")), F.lit(0)), F.lit(9))
    rows = edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), F.struct(rank.alias("rank"), "relation", "confidence").alias("x"))
    pairs = rows.groupBy("a", "b").agg(F.min("x").alias("x")).select("a", "b", "x.relation", "x.confidence")
    if ids is not None:  # the ends that aren't there are few, so the pairs aren't shuffled for them
        ends = rows.select(F.explode(F.array("a", "b")).alias("id")).distinct()
        lost = Scratch(edges.sparkSession, "lost").save(ends.join(ids, "id", "left_anti").select("id"), rows=FILE_ROWS)
        for end in ("a", "b"):
            pairs = pairs.join(lost, F.col(end).eqNullSafe(F.col("id")), "left_anti")
    return pairs


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """node, component (the smallest node of its component), for every node of the links (a, b).

    Links are contracted: every node is taken to its smallest neighbour's, that one's, and so on, links are put between the nodes where
    these ways end, and so on until none are left. This is done for one smaller and one larger neighbour of each node first, which are
    fewer than the links and mostly give what all of them do; then for the links that have an end outside the largest component. A null
    end is no node.
    """
    saved = scratch.save(edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo IS NOT NULL"), rows=FILE_ROWS)
    links = saved.where("lo < hi")
    low = _ends_of(links, scratch)
    high = links.groupBy("lo").agg(F.max("hi").alias("hi"))
    found = _joined([low, *_contracted(_between(high, low, scratch), scratch)], scratch)
    rest = _outside(links, found, scratch)
    if rest is not None:
        found = _joined([found, *_contracted(_between(rest, found, scratch), scratch)], scratch)
    named = found.select("node", F.col("up").alias("component")).union(found.select("up").distinct().select("up", "up"))
    alone = saved.where("lo = hi").select(F.col("lo").alias("node")).distinct().join(named, "node", "left_anti")
    return scratch.save(named.union(alone.select("node", F.col("node").alias("component"))), rows=FILE_ROWS)


def _contracted(links: DataFrame, scratch: Scratch) -> list[DataFrame]:
    """Where the nodes of these links (lo, hi) go, a table (node, up) a round: what one leaves is a node of the next, or stays."""
    out = []
    while not links.isEmpty():
        out.append(_ends_of(links, scratch))
        links = _between(links, out[-1], scratch)
    return out


def _ends_of(links: DataFrame, scratch: Scratch) -> DataFrame:
    """node, up: for each node with a smaller neighbour, the end of the way over smallest neighbours. The ways are halved each round."""
    moving = scratch.save(links.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("up")), rows=FILE_ROWS)
    settled: list[DataFrame] = []
    while True:
        known = moving
        for s in settled:
            known = known.union(s)
        jumps = _jumps(moving, known, scratch)
        if jumps.isEmpty():
            return known
        moved = scratch.save(_jumped(moving, jumps), rows=FILE_ROWS)
        settled.append(moved.where("NOT moved").select("node", "up"))
        moving = moved.where("moved").select("node", "up")


def _jumps(rows: DataFrame, known: DataFrame, scratch: Scratch) -> DataFrame:
    """up, jump: of the rows' ends those that go on, and where to. An end is looked up once, however many rows have it."""
    return scratch.save(rows.select("up").distinct().join(known.select(F.col("node").alias("up"), F.col("up").alias("jump")), "up"), rows=FILE_ROWS)


def _jumped(rows: DataFrame, jumps: DataFrame) -> DataFrame:
    """node, up, moved after the jumps.

    Many jumps stand SALTS times each, so the rows of a large component are dealt to as many tasks; they aren't broadcast then, though
    their file may be small. Few are left to Catalyst as they are.
    """
    many = jumps.count() > MANY
    own, salts = (F.pmod(F.xxhash64("node"), F.lit(SALTS)), F.sequence(F.lit(0), F.lit(SALTS - 1))) if many else (F.lit(0), F.array(F.lit(0)))
    target = jumps.select(F.col("up").alias("at"), "jump", F.explode(salts).alias("s"))
    out = rows.join(target.hint("merge") if many else target, (F.col("up") == F.col("at")) & (own == F.col("s")), "left")
    return out.select("node", F.coalesce("jump", "up").alias("up"), F.col("jump").isNotNull().alias("moved"))


def _between(links: DataFrame, ends: DataFrame, scratch: Scratch) -> DataFrame:
    """lo, hi: the links between where their nodes go."""
    for x in ("hi", "lo"):
        links = links.join(ends.select(F.col("node").alias(x), F.col("up").alias(f"to_{x}")), x, "left")
    a, b = F.coalesce("to_lo", "lo"), F.coalesce("to_hi", "hi")
    return scratch.save(links.select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi")).where("lo < hi").distinct(), rows=FILE_ROWS)


def _joined(tables: list[DataFrame], scratch: Scratch) -> DataFrame:
    """node, up of tables that follow each other, as one."""
    out = tables[-1]
    for t in reversed(tables[:-1]):
        out = scratch.save(_jumped(t, _jumps(t, out, scratch)).select("node", "up").union(out), rows=FILE_ROWS)
    return out


def _outside(links: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame | None:
    """The links with an end outside the largest component; all of them, if that has less than nine tenths of the nodes; none, if all."""
    sizes = found.groupBy("up").agg(F.count("*").alias("n"))
    top = sizes.agg(F.sum("n").alias("all"), F.max(F.struct("n", "up")).alias("most")).first()
    if not top["all"]:
        return None
    if top["most"]["n"] < 0.9 * top["all"]:
        return links
    other = found.where(F.col("up") != F.lit(top["most"]["up"]))
    nodes = scratch.save(other.select("node").union(other.select("up").distinct()), rows=FILE_ROWS)
    if nodes.isEmpty():
        return None
    hi, lo = (nodes.select(F.col("node").alias(x)) for x in ("hi", "lo"))
    return links.join(hi, "hi", "left_semi").union(links.join(lo, "lo", "left_semi"))


def label_propagation(edges: DataFrame, rounds: int, scratch: Scratch) -> DataFrame:
    """node, label after so many synchronous rounds from the nodes themselves: the heaviest neighbouring label, ties to the smallest."""
    both = scratch.save(edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "w").union(edges.select("b", "a", "w")), rows=FILE_ROWS)
    parts = tasks(both.count())
    labels = both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        # few votes of a task are for the same label, so they are dealt before they are summed, to as many tasks as they need
        sent = both.join(labels, F.col("v") == F.col("node")).select("u", "label", "w").repartition(parts, "u", "label")
        votes = sent.groupBy("u", "label").agg(F.sum("w").alias("score"))
        best = votes.groupBy(F.col("u").alias("node")).agg(F.min(F.struct((-F.col("score")).alias("less"), "label")).alias("b"))
        labels = scratch.save(best.select("node", F.col("b.label").alias("label")), rows=FILE_ROWS)
    return labels


def cohesion(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """community, intra, possible: links inside it and pairs of its nodes (1 of 1 for a single node). pairs: a, b, distinct."""
    ends = [members.where("community IS NOT NULL").select(F.col("node").alias(e), F.col("community").alias(f"c_{e}")) for e in ("a", "b")]
    inside = pairs.join(ends[0], "a").join(ends[1], "b").where("c_a = c_b").groupBy(F.col("c_a").alias("community")).agg(F.count("*").alias("links"))
    sizes = members.where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("n"))
    single = F.col("n") == 1
    return sizes.join(inside, "community", "left").select("community", F.when(single, 1).otherwise(F.coalesce("links", F.lit(0))).cast("long").alias("intra"), F.when(single, 1).otherwise(F.expr("n * (n - 1) div 2")).cast("long").alias("possible"))


def confident(edges: DataFrame, least: str = "INFERRED") -> DataFrame:
    """The edges of at least this confidence: EXTRACTED is the best, then INFERRED, then AMBIGUOUS."""
    return edges.where(F.col("confidence").isin(CONFIDENCES[: CONFIDENCES.index(least) + 1]))


def god_nodes(degrees: DataFrame, count: int = 10) -> DataFrame:
    return degrees.orderBy(F.desc("degree"), "node").limit(count)


def surprising(members: DataFrame, pairs: DataFrame, degrees: DataFrame, count: int = 20) -> DataFrame:
    """a, b, links, degrees: links between communities, those of the rarest pair of communities first, then of the highest degrees."""
    ends = [members.where("community IS NOT NULL").select(F.col("node").alias(e), F.col("community").alias(f"c_{e}")) for e in ("a", "b")]
    crossing = pairs.join(ends[0], "a").join(ends[1], "b").where("c_a <> c_b").select("a", "b", F.least("c_a", "c_b").alias("c"), F.greatest("c_a", "c_b").alias("d"))
    rarity = crossing.groupBy("c", "d").agg(F.count("*").alias("links"))
    of = [degrees.select(F.col("node").alias(e), F.col("degree").alias(f"d_{e}")) for e in ("a", "b")]
    return crossing.join(rarity, ["c", "d"]).join(of[0], "a").join(of[1], "b").select("a", "b", "links", (F.col("d_a") + F.col("d_b")).alias("degrees")).orderBy("links", F.desc("degrees"), "a", "b").limit(count)


def questions(hubs: DataFrame, links: DataFrame) -> DataFrame:
    """Suggested questions, from hubs (node) and surprising links (a, b)."""
    return hubs.select(F.format_string("What depends on %s?", F.col("node").cast("string")).alias("question")).union(links.select(F.format_string("Why is %s linked to %s?", F.col("a").cast("string"), F.col("b").cast("string"))))
