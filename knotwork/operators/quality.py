"""Checks of a merged graph: each is a DataFrame, ``verify`` unions them into (check, ok, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import extension, is_curated, name_signature, percent, thousands
from ..scratch import FILE_ROWS, Scratch, tasks
from . import labels
from .corpus import SOURCE_EXTENSIONS

ENDS = (("source_repo", "source"), ("target_repo", "target"))
#: Fixed values of the extraction rules.
FILE_TYPES = ["code", "document", "paper", "image", "rationale", "concept"]
INFERRED_SCORES = [0.95, 0.85, 0.75, 0.65, 0.55]


def lost_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """repo, local_id: the distinct ends of edges that are no nodes, written. Most graphs have few, so what follows is a small join.

    Ends are reduced before they are shuffled, and the edges aren't shuffled at all, unless there are many lost ends.
    """
    both = F.array(*[F.struct(F.col(r).alias("repo"), F.col(i).alias("local_id")) for r, i in ENDS])
    found = edges.select(F.explode(both).alias("x")).select("x.*").distinct()
    return Scratch(edges.sparkSession, "lost").save(found.join(nodes.select("repo", "local_id"), ["repo", "local_id"], "left_anti"), rows=FILE_ROWS)


def with_lost(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with s_lost and t_lost: whether that end is no node. An end that is null or has no repo is none."""
    lost = lost_ends(edges, nodes)
    for side, (repo, local) in zip("st", ENDS, strict=True):
        one = lost.select(F.col("repo").alias("lost_repo"), F.col("local_id").alias("lost_id"), F.lit(True).alias(f"{side}_lost"))
        edges = edges.join(one, F.col(repo).eqNullSafe(F.col("lost_repo")) & F.col(local).eqNullSafe(F.col("lost_id")), "left").drop("lost_repo", "lost_id")
    return edges.withColumns({f"{s}_lost": F.coalesce(f"{s}_lost", F.lit(False)) for s in "st"})


def crossing() -> Column:
    """Whether the ends' nodes are in different repos; an end without a node is in none."""
    return F.when(F.col("s_lost") | F.col("t_lost"), F.col("s_lost") != F.col("t_lost")).otherwise(F.col("source_repo") != F.col("target_repo"))


def dangling_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges of which an end is no node."""
    return with_lost(edges, nodes).where("s_lost OR t_lost").select("source_repo", "source", "target_repo", "target").distinct()


def cross_recount(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, and those whose ends' nodes are in different repos; an end without a node is in none, so differs from any."""
    return with_lost(edges, nodes).agg(F.count("*").alias("n_edges"), F.count_if(crossing()).alias("n_cross"))


def community_spans(nodes: DataFrame) -> DataFrame:
    """Communities with nodes in more than one repo."""
    return nodes.where("community IS NOT NULL").groupBy("community").agg(F.countDistinct("repo").alias("n_repos")).where("n_repos > 1")


def named_coverage(nodes: DataFrame) -> DataFrame:
    """One row: nodes with a curated name, and the distinct names."""
    curated = F.coalesce(is_curated("community_name"), F.lit(False))
    return nodes.agg(F.count_if(curated).alias("named_nodes"), F.countDistinct(F.when(curated, F.col("community_name"))).alias("distinct_names"))


def graph_health(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, edges with a null end, dangling edges, self-loops, repeated directed and undirected pairs."""
    rows = edges.select("source_repo", "source", "target_repo", "target")
    empty = F.col("source").isNull() | F.col("target").isNull()
    lost = with_lost(rows, nodes).agg(F.count_if((F.col("s_lost") | F.col("t_lost")) & ~empty).alias("dangling"))
    x = {c: F.struct(F.col(r).alias("repo"), F.col(i).alias("id")) for c, (r, i) in zip("st", ENDS, strict=True)}
    rows = rows.select(F.least(x["s"], x["t"]).alias("p"), F.greatest(x["s"], x["t"]).alias("q"), (x["s"] <= x["t"]).alias("forward"), empty.alias("empty"))
    # dealt once, by the pair: a pair's two directions are counted where it is
    dealt = rows.repartition(tasks(edges.count()), "p", "q")
    pairs = dealt.groupBy("p", "q").agg(F.count("*").alias("n"), F.count_if("forward").alias("forward"), F.count_if("empty").alias("empty"))
    directed = (F.col("forward") > 0).cast("long") + (F.col("forward") < F.col("n")).cast("long")
    loops = F.when(F.col("p") == F.col("q"), F.col("n")).otherwise(0)
    counts = pairs.agg(F.sum("n").alias("edges"), F.sum("empty").alias("missing_endpoint"), F.sum(loops).alias("self_loops"), F.sum(F.col("n") - directed).alias("directed_duplicates"), F.sum(F.col("n") - 1).alias("undirected_duplicates"))
    return counts.join(F.broadcast(lost), F.lit(True)).select("edges", "missing_endpoint", "dangling", "self_loops", "directed_duplicates", "undirected_duplicates")


def near_duplicate_names(names: DataFrame, column: str) -> DataFrame:
    """signature, n: distinct names that have the same words of four letters or more."""
    return names.select(column).where(F.col(column).isNotNull()).distinct().groupBy(name_signature(column).alias("signature")).agg(F.count("*").alias("n")).where("n > 1")


def additive_only(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entries of the old anchor table (entry, label, anchors) that the new one lacks or has changed or moved."""
    columns = ["entry", "label", "anchors"]
    return old.select(columns).exceptAll(new.select(columns))


def repeatable(one: DataFrame, two: DataFrame) -> DataFrame:
    """Rows that only one of two builds has; none if they are equal."""
    return one.exceptAll(two).withColumn("only_in", F.lit("first")).union(two.exceptAll(one).withColumn("only_in", F.lit("second")))


def spec_rules(nodes: DataFrame, edges: DataFrame, hyperedges: DataFrame) -> DataFrame:
    """rule, broken: how many rows break each rule of extraction.

    A call stays inside one language: its ends' files have extensions of one family. nodes: id, file_type, source_file.
    """
    score, kind = F.col("confidence_score"), F.col("confidence")
    ext = extension("source_file")
    family = F.when(ext.isin(SOURCE_EXTENSIONS), "c").when(ext != "", ext)
    calls = edges.where("relation = 'calls'")
    for side, end in (("s", "source"), ("t", "target")):
        calls = calls.join(nodes.select(F.col("id").alias(end), family.alias(f"{side}_family")), end)
    counts = [
        nodes.agg(F.count_if(~F.col("file_type").isin(FILE_TYPES)).alias("file_type"), F.count_if(~F.col("id").rlike("^[a-z0-9_]+$")).alias("id_characters")),
        edges.agg(
            F.count_if((kind == "EXTRACTED") & (score != 1.0)).alias("extracted_score"),
            F.count_if((kind == "INFERRED") & ~score.isin(INFERRED_SCORES)).alias("inferred_score"),
            F.count_if((kind == "AMBIGUOUS") & ~score.between(0.1, 0.3)).alias("ambiguous_score"),
        ),
        calls.agg(F.count_if(F.col("s_family") != F.col("t_family")).alias("call_across_languages")),
        hyperedges.agg(F.count_if(F.size("nodes") < 3).alias("hyperedge_arity")),
        hyperedges.groupBy("chunk").agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 3).alias("hyperedges_a_chunk")),
    ]
    out = None
    for c in counts:
        rows = c.select(F.explode(F.array(*[F.struct(F.lit(x).alias("rule"), F.col(x).alias("broken")) for x in c.columns])).alias("r")).select("r.*")
        out = rows if out is None else out.union(rows)
    return out


def ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: edges, those of which an end is no node (dangling), and those whose ends' nodes are in different repos (crossing).

    One pass, after the lost ends are found.
    """
    rows = with_lost(edges, nodes)
    return rows.agg(F.count("*").alias("edges"), F.count_if(F.col("s_lost") | F.col("t_lost")).alias("dangling"), F.count_if(crossing()).alias("crossing"))


def verify(nodes: DataFrame, edges: DataFrame, anchors: DataFrame | None = None, wanted: DataFrame | None = None, stats: DataFrame | None = None, required: dict[str, str] | None = None) -> DataFrame:
    """check, ok, severity, detail: the invariants of a merged graph.

    nodes: repo, local_id, community, community_key, community_name. anchors: repo, label of every name ever anchored. wanted: repo,
    name of the label files. stats: the linker's row of counts. required: repos that must be there, by the name of their check.
    """

    def empty(columns: str) -> DataFrame:
        return nodes.sparkSession.range(0).selectExpr(*[f"cast(null as {t}) AS {c}" for c, t in (x.split() for x in columns.split(", "))])

    def one(rows: DataFrame, name: str, ok, detail, severity: str = "error") -> DataFrame:
        return rows.select(F.lit(name).alias("check"), ok.alias("ok"), F.lit(severity).alias("severity"), detail.alias("detail"))

    anchors = empty("repo string, label string") if anchors is None else anchors
    wanted = empty("repo string, name string") if wanted is None else wanted
    curated = nodes.where(is_curated("community_name")).select("repo", F.col("community_name").alias("name"))
    ended = ends(edges, nodes)
    # one row a community, of which few span repos, and one a repo: the chunk map is small
    spans = nodes.where("community IS NOT NULL").groupBy("community").agg(F.min("community_key").alias("key"), F.min("repo").alias("low"), F.max("repo").alias("high")).where("low < high")
    five = spans.orderBy("community").limit(5).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("community", "key"))), lambda x: x["key"]), ", ").alias("five"))
    spans = spans.agg(F.count("*").alias("n")).join(F.broadcast(five), F.lit(True))
    per_repo = nodes.groupBy("repo").agg(F.count("*").alias("n"), F.count_if(F.coalesce(is_curated("community_name"), F.lit(False))).alias("named"))
    repos = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "repo")))
    listed = F.array_join(F.transform(repos, lambda x: F.concat(x["repo"], F.lit("="), thousands(-x["less"]))), ", ")
    kept = labels.retention(nodes, anchors)
    gap = labels.missing_names(wanted, curated.distinct(), nodes)
    gaps = gap.groupBy("repo").agg(F.array_join(F.array_sort(F.collect_list("name")), ", ").alias("names"), F.count("*").alias("n"))
    gaps = gaps.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("repo", "names"))), lambda x: F.concat(x["repo"], F.lit(": "), x["names"])), "; ").alias("names"))
    named = per_repo.agg(F.sum("named").alias("covering"), listed.alias("repos")).join(F.broadcast(kept), F.lit(True))
    recall = (nodes.sparkSession.range(1).selectExpr("0L AS total_includes", "0L AS resolved_includes", "0L AS unresolved_includes", "0L AS ignored")) if stats is None else stats
    some = F.col("total_includes") > 0
    n, names = F.col("n"), F.col("attached")
    checks = [
        one(ended, "no dangling edges", F.col("dangling") == 0, F.concat(thousands("dangling"), F.lit(" dangling"))),
        one(ended, "cross-module edges present", F.col("crossing") > 0, F.concat(thousands("crossing"), F.lit(" cross-module edges"))),
        one(spans, "communities do not span chunks", n == 0, F.concat(n.cast("string"), F.lit(" in several chunks"), F.when(n > 0, F.concat(F.lit(": "), "five")).otherwise(""))),
        one(named, "curated labels attached", names > 0, F.concat(names.cast("string"), F.lit(" names on "), thousands(F.coalesce("covering", F.lit(0))), F.lit(" nodes"))),
        one(kept, "curated-name retention rate", F.col("ok"), F.concat(names.cast("string"), F.lit(" of "), F.col("anchored").cast("string"), F.lit(" anchored names"))),
        one(gaps, "all curated names attached", n == 0, F.when(n == 0, "none is missing").otherwise(F.concat(n.cast("string"), F.lit(" missing: "), "names")), "warn"),
        one(named, "all built chunks merged", F.col("repos") != "", F.col("repos")),
        one(recall, "include recall computed", some, F.when(some, F.concat(thousands("resolved_includes"), F.lit(" of "), thousands("total_includes"), F.lit(" references resolved ("), percent(F.col("resolved_includes"), F.col("total_includes")), F.lit(")"))).otherwise("no references were scanned")),
    ]
    for name, repo in (required or {}).items():
        checks.append(one(per_repo.agg(F.coalesce(F.sum(F.when(F.col("repo") == repo, n)), F.lit(0)).alias("n")), name, n > 0, F.concat(n.cast("string"), F.lit(" nodes"))))
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is something at a path, in any store; ``verify`` has nothing to say where there isn't."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(found)


def exit_code(checks: DataFrame) -> int:
    """1 if any check that isn't a warning failed."""
    return int(not checks.where("NOT ok AND severity <> 'warn'").isEmpty())
