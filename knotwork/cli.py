"""Command line: info, coverage, build, merge, verify, semantic, relabel, bench, query, path, neighbors.

A chunk map is a JSON file of rows {name, root, targets, kind, note}. It and the suite of questions are fixed, small inputs, so loops
over them are plain Python; everything about files, nodes and edges is a plan.
"""

from __future__ import annotations

import argparse
import json
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sinks
from .functions.text import names_of, token_estimate
from .operators import analytics, assemble, corpus, extract, labels, quality, refs, relabel, savings, select, traversal
from .schema import CHUNKS
from .scratch import Scratch
from .sources import config, documents, files

ROUNDS = 8


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")


def _maybe(spark: SparkSession, folder: str, name: str) -> DataFrame | None:
    return spark.read.parquet(f"{folder}/{name}") if quality.exists(spark, f"{folder}/{name}") else None


def chunk_map(spark: SparkSession, path: str, only: list[str] | None = None, skip_added: bool = False) -> DataFrame:
    rows = spark.read.schema(CHUNKS).option("multiLine", True).json(path)
    return select.select_chunks(rows.withColumn("labelled", F.coalesce("labelled", F.lit(False))), only, skip_added)


def clustered(nodes: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """nodes with community: the largest is 0, ties by its label. Nodes without links are communities of their own."""
    pairs = analytics.undirected(edges, nodes.select("id")).where("a <> b").select("a", "b", F.lit(2).alias("w"))
    # a node also votes for itself, as much as one neighbour, so that two don't swap their labels for ever
    own = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(1).alias("w"))
    found = analytics.label_propagation(pairs.union(own), ROUNDS, scratch)
    own = nodes.join(found.select(F.col("node").alias("id"), F.col("label").alias("cluster")), "id")
    sizes = scratch.save(own.groupBy("cluster").agg((-F.count("*")).alias("less")))
    numbers = select.packed(sizes, "less", "cluster", size=1).select("cluster", (F.col("chunk") - 1).alias("community"))
    return own.join(numbers, "cluster").drop("cluster")


def build(spark: SparkSession, engine: str, chunks: DataFrame, out: Path) -> dict[str, int]:
    """A graph document for each chunk of code that has files; returns the number of nodes by chunk."""
    claims = files.resolve_targets(files.scan_files(spark, engine), chunks.where("kind = 'code'"))
    texts = files.scan_texts(spark, engine, corpus.BUILD_EXTENSIONS)
    built = {}
    for row in chunks.where("kind = 'code'").select("name", "root").collect():
        scratch = Scratch(spark, f"build-{row['name']}")
        root = row["root"].strip("/")
        below = F.col("path") if root in ("", ".") else F.regexp_replace("path", f"^\\Q{root}\\E/", "")
        own = scratch.save(texts.join(claims.where(F.col("name") == row["name"]).select("path"), "path", "left_semi").select(below.alias("path"), "text"))
        if own.isEmpty():
            continue
        nodes, edges = (scratch.save(x) for x in extract.extract(own))
        nodes = files.repo_paths(clustered(nodes, edges, scratch), f"{engine.rstrip('/')}/{root}", engine).drop("outcome")
        (out / row["name"]).mkdir(parents=True, exist_ok=True)
        built[row["name"]] = sinks.write_graph_document(out / row["name"] / "graph.json", scratch.save(nodes.orderBy("id")), scratch.save(edges.orderBy("source", "target", "relation")))
    return built


def attached(nodes: DataFrame, label_folder: str) -> DataFrame:
    """repo, community, name: by anchors where a chunk has them, else by number."""
    spark = nodes.sparkSession
    members = nodes.select("repo", "community", F.concat_ws("::", "repo", "local_id").alias("node")).where("community IS NOT NULL")
    anchors = documents.load_anchors(spark, label_folder)
    anchored = anchors.select(F.concat_ws("::", "repo", F.format_string("%06d", "entry")).alias("entry"), "label", F.explode("anchors").alias("n"), "repo").select("entry", "label", F.concat_ws("::", "repo", "n").alias("node"))
    keyed = members.select("node", F.struct("repo", "community").alias("community"))
    by_anchor = labels.attach(labels.claims(anchored, keyed)).select("community.repo", "community.community", "name")
    plain = documents.load_labels(spark, label_folder).join(anchors.select("repo").distinct(), "repo", "left_anti")
    return by_anchor.unionByName(labels.attach_by_id(members, plain).select("repo", "community", "name"))


def include_roots(chunks: DataFrame) -> list[tuple[str, str]]:
    """What an include of a chunk's files starts with, the last part of its root, and the root; longer ones first."""
    found = {r["root"].strip("/") for r in chunks.select("root").collect()} - {"", "."}
    return sorted(((root.rsplit("/", 1)[-1] + "/", root + "/") for root in found), key=lambda x: (-len(x[0]), x))


def merge(spark: SparkSession, graphs: dict[str, str], label_folder: str | None, out: str, engine: str | None = None, chunks: DataFrame | None = None, document: Path | None = None) -> None:
    """Names attach, nodes and edges are qualified and united, includes across chunks are linked, and all is written with its stats."""
    nodes, edges, hyperedges = documents.load_graphs(spark, graphs)
    names = attached(nodes, label_folder) if label_folder else None
    includes = index = None
    if engine and chunks is not None:
        roots = spark.createDataFrame([(r["name"], r["root"]) for r in chunks.select("name", "root").collect()], "repo string, root string")
        index = nodes.join(roots, "repo", "left").select("repo", refs.index_path(F.col("root")).alias("path"), F.col("local_id").alias("id")).where("path IS NOT NULL")
        includes = files.scan_includes(files.scan_texts(spark, engine), include_roots(chunks))
    g = assemble.merge_graph(nodes, edges, hyperedges, names, includes, index)
    sinks.write_tables(g["nodes"], g["edges"], out)
    for name in ("hyperedges", "stats"):
        if name in g:
            g[name].write.mode("overwrite").parquet(f"{out}/{name}")
    meta = {"chunks": sorted(graphs), "built_at": datetime.now(timezone.utc).isoformat(), **(config.provenance(Path(engine)) if engine else {})}
    stats = _maybe(spark, out, "stats")
    if stats is not None:
        meta["link_stats"] = stats.first().asDict()
        for r in refs.missed(includes, index, [r.rstrip("/") for _, r in include_roots(chunks)]).collect():  # a row a root, and ten at most
            meta["link_stats"].setdefault(f"{r['kind']}_by_root" if r["kind"] == "unresolved" else "ignored_by_prefix", {})[r["key"]] = r["n"]
        meta["cross_module_edges"] = meta["link_stats"]["cross_module_edges"]
    spark.createDataFrame([(json.dumps(meta),)], "meta string").write.mode("overwrite").text(f"{out}/meta")
    if document:
        document.parent.mkdir(parents=True, exist_ok=True)
        written = _tables(spark, out)
        sinks.write_graph_document(document, written[0], written[1], _maybe(spark, out, "hyperedges"), meta)


def verify(spark: SparkSession, folder: str, label_folder: str | None, required: dict[str, str] | None = None) -> DataFrame:
    """The checks of a merged graph; the one check that it exists, where it doesn't."""
    if not quality.exists(spark, f"{folder}/nodes"):
        return spark.range(1).select(F.lit("merged graph exists").alias("check"), F.lit(False).alias("ok"), F.lit("error").alias("severity"), F.lit(f"{folder} not found - run `merge`").alias("detail"))
    nodes, edges = _tables(spark, folder)
    qualified = nodes.select("repo", F.col("id").alias("local_id"), "community", "community_key", "community_name")
    anchors = documents.load_anchors(spark, label_folder).select("repo", "label") if label_folder else None
    wanted = documents.load_labels(spark, label_folder).select("repo", "name") if label_folder else None
    there = spark.range(1).select(F.lit("merged graph exists").alias("check"), F.lit(True).alias("ok"), F.lit("error").alias("severity"), F.lit(folder).alias("detail"))
    return there.unionByName(quality.verify(qualified, edges, anchors, wanted, _maybe(spark, folder, "stats"), required))


def bench(spark: SparkSession, folder: str, engine: str, chunks: DataFrame, suite: str) -> tuple[DataFrame, DataFrame, str]:
    """(ratios, totals, digest of the suite): what each question's answer costs in tokens, and the files that it draws from."""
    scratch = Scratch(spark, "bench")
    nodes, edges = _tables(spark, folder)
    pairs = scratch.save(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct())
    degrees = scratch.save(labels.node_degree(edges))
    keyed = nodes.select(F.col("id").alias("node"), "label", "source_file")
    asked = documents.load_questions(spark, suite).collect()
    answers = []
    for q in asked:
        found = traversal.query_graph(keyed, pairs, degrees, q["question"], scratch, q["depth"], q["token_budget"]).orderBy("position").select("line").collect()  # as many lines as the budget allows
        answers.append((q["qid"], "\n".join(r["line"] for r in found)))
    answered = spark.createDataFrame(answers, "qid string, answer string")
    roots = spark.createDataFrame([(r["name"], r["root"]) for r in chunks.select("name", "root").collect()], "repo string, root string")
    base = F.rtrim("root", F.lit("/"))
    place = F.when(base.isin("", "."), F.col("source_file")).otherwise(F.concat(base, F.lit("/"), "source_file"))
    cited = nodes.where("source_file <> ''").join(roots, "repo").select("source_file", place.alias("path")).distinct()
    texts = files.scan_texts(spark, engine, corpus.BUILD_EXTENSIONS + corpus.DATA_EXTENSIONS).select("path", token_estimate("text").alias("tokens"))
    ratios = scratch.save(savings.token_ratio(answered, cited.join(texts, "path", "left").select(F.col("source_file").alias("source"), "tokens")))
    return ratios, savings.totals(ratios), asked[0]["suite"] if asked else ""


def relabel_chunk(spark: SparkSession, folder: str, repo: str, label_folder: Path, action: str, top: int = 40) -> str:
    """One chunk's names: propose, audit, digest, sync or write-anchors. Returns the report."""
    nodes, edges = (t.where(F.col(c) == repo) for t, c in zip(_tables(spark, folder), ("repo", "source_repo"), strict=True))
    local = nodes.select(F.col("id").alias("node"), "local_id", F.element_at(F.split("community_key", ":"), -1).cast("long").alias("community"), "label", "repo_path", "source_file", "community_name", F.col("pos").alias("position"), "repo")
    degrees = labels.node_degree(edges)
    names = documents.load_labels(spark, str(label_folder)).where(F.col("repo") == repo)
    if action == "digest":
        largest = relabel.top_communities(local, top).select("community")
        return sinks.report(relabel.top_symbols(local.join(largest, "community", "left_semi").select("node", "community", "label"), degrees).orderBy("community", "rank"), "Symbols by community")
    if action == "audit":
        return sinks.audit_report(relabel.audit(local, names.select("community", "name")), repo)
    if action == "sync":
        rows = labels.sync(local, spark.range(1).select(F.lit(repo).alias("repo")))
        sinks.write_labels(rows, label_folder)
        return sinks.report(rows.orderBy("community"), "Names")
    if action == "propose":
        text = local.select("community", F.concat_ws(" ", F.coalesce("repo_path", "source_file"), "label").alias("text")).where("community IS NOT NULL")
        bags = Scratch(spark, "bags").save(relabel.token_bags(text, "community", "text"))
        asked = names.select(F.concat_ws(":", F.col("community").cast("string"), "name").alias("id"), "name", F.col("community").alias("original"))
        proposed = relabel.propose(asked, bags, "community")
        shown = proposed.join(relabel.samples(local.select("community", F.col("local_id").alias("node"), "position"), proposed), "proposed", "left")
        return sinks.report(shown.select("id", "proposed", "score", "changed", "ambiguous", "members").orderBy("id"), "Proposals")
    # write-anchors: what was there stays unless its name is written anew
    old = documents.load_anchors(spark, str(label_folder)).where(F.col("repo") == repo).select("label", F.array_join("anchors", ",").alias("anchors"), "entry", "size")
    members = local.select(F.col("local_id").alias("node"), "community")
    ranked = labels.top_anchors(members, degrees.select(F.regexp_replace("node", f"^\\Q{repo}::\\E", "").alias("node"), "degree"))
    numbered = names.select("community", "name")
    kept = labels.preserve(old.select("label", "anchors"), numbered, ranked)
    numbers = numbered.select(F.explode(names_of("name")).alias("label"), "community").groupBy("label").agg(F.min("community").alias("community"))
    rows = kept.join(old.select("label", "entry"), "label", "left").join(numbers, "label", "left")
    sizes = members.where("community IS NOT NULL").groupBy("community").agg(F.count("*").alias("n"))
    known = old.select("label", F.col("size").alias("old_size")).unionByName(numbers.join(sizes, "community").select("label", F.col("n").alias("old_size")).join(old.select("label"), "label", "left_anti")).groupBy("label").agg(F.first("old_size").alias("size"))
    entries = labels.anchor_entries(rows).join(known, "label", "left")
    target = label_folder / f"{repo}.anchors.json"
    n = sinks.write_anchors(Scratch(spark, "anchors").save(entries), target, labels.ANCHOR_COUNT)
    return f"{target}: {n} names\n"


def semantic(spark: SparkSession, engine: str, root: str, patterns: list[str], out: Path, check: bool) -> str:
    """Writes the manifest of a corpus's chunks, or says which of them have come back."""
    if check:
        plan = spark.createDataFrame([(r["chunk"], Path(r["output"]).name) for r in json.loads((out / "_manifest.json").read_text(encoding="utf-8"))], "chunk int, output string")
        found = spark.read.option("pathGlobFilter", "chunk_*.json").text(str(out), wholetext=True).select(F.element_at(F.split("_metadata.file_path", "/"), -1).alias("output"), F.col("value").alias("content"))
        return sinks.chunks_report(corpus.validate(plan, found))
    found = corpus.collect(files.scan_files(spark, engine), root, patterns)
    return f"{out / '_manifest.json'}: {sinks.write_manifest(corpus.manifest(found), out)} chunks\n"


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="knotwork")
    p.add_argument("--engine", help="the checkout")
    p.add_argument("--out", help="folder of the chunks' graphs")
    p.add_argument("--chunks", help="the chunk map")
    p.add_argument("--labels", help="folder of label and anchor files")
    p.add_argument("--graph", default="knotwork-out/merged", help="folder of the merged tables")
    commands = p.add_subparsers(dest="command", required=True)
    commands.add_parser("info", help="chunks, and which are built and named")
    c = commands.add_parser("coverage", help="files that no chunk claims")
    c.add_argument("--exclude", nargs="*", default=[], metavar="PREFIX=REASON")
    b = commands.add_parser("build", help="extract and cluster the chunks, then merge")
    b.add_argument("--only", nargs="+")
    b.add_argument("--skip-added", action="store_true")
    b.add_argument("--no-merge", action="store_true")
    m = commands.add_parser("merge", help="merge graph documents: name=path ..., by default all that are built")
    m.add_argument("graphs", nargs="*")
    m.add_argument("--document", type=Path, help="also write one JSON document")
    v = commands.add_parser("verify")
    v.add_argument("--docs")
    v.add_argument("--xsd")
    s = commands.add_parser("semantic", help="prepare or validate a semantic extraction")
    s.add_argument("--root", default=".")
    s.add_argument("--patterns", nargs="+", default=["**/*.xml", "**/*.csv"])
    s.add_argument("--folder", type=Path, default=Path("semantic"))
    s.add_argument("--validate", action="store_true")
    r = commands.add_parser("relabel")
    r.add_argument("chunk")
    r.add_argument("--action", choices=["propose", "audit", "digest", "sync", "write-anchors"], default="propose")
    r.add_argument("--top", type=int, default=40)
    e = commands.add_parser("bench", help="tokens of answers and of their sources")
    e.add_argument("questions")
    q = commands.add_parser("query", help="context for a question")
    q.add_argument("question")
    q.add_argument("--depth", type=int, default=3)
    q.add_argument("--budget", type=int, default=2000)
    t = commands.add_parser("path", help="a shortest path between two nodes, with the relation and direction of each step")
    t.add_argument("start")
    t.add_argument("end")
    n = commands.add_parser("neighbors")
    n.add_argument("node")
    return p


def main(arguments: list[str] | None = None) -> int:
    a = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("knotwork").getOrCreate()
    text, code = run(spark, a)
    print(text)
    return code


def run(spark: SparkSession, a: argparse.Namespace) -> tuple[str, int]:
    out = Path(a.out or "knotwork-out")
    chunks = chunk_map(spark, a.chunks, getattr(a, "only", None), getattr(a, "skip_added", False)) if a.chunks else None
    if a.command in ("info", "coverage", "build", "bench") and chunks is None or a.command in ("coverage", "build", "bench", "semantic") and not a.engine:
        raise config.ConfigError(f"{a.command} needs a chunk map and a checkout")
    if a.command == "info":
        built = spark.createDataFrame([(p.parent.name,) for p in sorted(out.glob("*/graph.json"))], "name string").withColumn("built", F.lit(True))
        rows = chunks.select("name", "root", "kind", "labelled").join(built, "name", "left").withColumn("built", F.coalesce("built", F.lit(False)))
        return sinks.report(rows.orderBy("name"), "Chunks"), 0
    if a.command == "coverage":
        listed = files.scan_files(spark, a.engine)
        excluded = [tuple(x.split("=", 1)) for x in a.exclude]
        return sinks.coverage_report(Scratch(spark, "coverage").save(corpus.coverage(listed, files.resolve_targets(listed, chunks), excluded))), 0
    if a.command == "build":
        built = build(spark, a.engine, chunks, out)
        if not a.no_merge:
            merge(spark, {n: str(out / n / "graph.json") for n in built}, a.labels, a.graph, a.engine, chunks)
        return "\n".join(f"{k}: {v:,} nodes" for k, v in built.items()) + "\n", 0
    if a.command == "merge":
        graphs = dict(g.split("=", 1) for g in a.graphs) or {p.parent.name: str(p) for p in sorted(out.glob("*/graph.json")) if p.parent.name != "merged"}
        merge(spark, graphs, a.labels, a.graph, a.engine, chunks, a.document)
        return sinks.report(assemble.graph_summary(*_tables(spark, a.graph)), "Merged"), 0
    if a.command == "semantic":
        return semantic(spark, a.engine, a.root, a.patterns, a.folder, a.validate), 0
    if a.command == "verify":
        required = {k: v for k, v in (("docs present", a.docs), ("xsd present", a.xsd)) if v}
        checks = Scratch(spark, "verify").save(verify(spark, a.graph, a.labels, required))
        return sinks.checks_report(checks), quality.exit_code(checks)
    if a.command == "relabel":
        return relabel_chunk(spark, a.graph, a.chunk, Path(a.labels), a.action, a.top), 0
    if a.command == "bench":
        return sinks.bench_report(*bench(spark, a.graph, a.engine, chunks, a.questions)), 0
    nodes, edges = _tables(spark, a.graph)
    if a.command == "neighbors":
        return sinks.report(traversal.get_neighbors(traversal.adjacency(edges), a.node), a.node), 0
    scratch = Scratch(spark, a.command)
    pairs = scratch.save(edges.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b")).where("a <> b").distinct())
    if a.command == "path":
        path = scratch.save(traversal.shortest_path(pairs, a.start, a.end, scratch))
        return sinks.report(traversal.path_hops(path, edges).orderBy("hop"), "Path"), 0
    keyed = nodes.select(F.col("id").alias("node"), "label", F.coalesce("repo_path", "source_file").alias("source_file"))
    return sinks.report(traversal.query_graph(keyed, pairs, labels.node_degree(edges), a.question, scratch, a.depth, a.budget).select("line").orderBy("position"), a.question), 0


if __name__ == "__main__":
    raise SystemExit(main())
