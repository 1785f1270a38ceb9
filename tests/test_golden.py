"""Hand-worked cases for operators that the driver tables don't reach."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from knotwork.functions import refs as R
from knotwork.functions import text as X
from knotwork.operators import corpus, extract, identity, labels, quality, refs, relabel, savings, select, traversal
from knotwork.scratch import Scratch
from knotwork.sources import config, documents, files


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_label_attachment(spark):
    members = spark.createDataFrame([(n, c) for c, ns in ((0, "abcd"), (1, "efgh")) for n in ns], "node string, community long")
    entries = ["abc", "abefgh", "abcduvwxyz", "dq", "", "ea"]
    anchors = spark.createDataFrame([(i, f"L{i + 1}", n) for i, ns in enumerate(entries) for n in ns], "entry int, label string, node string")
    claimed = labels.claims(anchors, members)
    assert rows(claimed, "label", "placed") == [("L1", True), ("L2", True), ("L3", True), ("L4", False), ("L6", False)]
    assert rows(labels.attach(claimed), "community", "name") == [(0, "L1 / L3"), (1, "L2")]
    stats = labels.attach_stats(claimed, spark.createDataFrame([(i,) for i in range(6)], "entry int")).first().asDict()
    assert stats == {"matched": 2, "labels_placed": 3, "labels_dropped": 2, "merged_communities": 1, "available": 6, "mode": "anchor", "threshold": 0.4}


def test_preserve(spark):
    old = spark.createDataFrame([("X", "1"), ("Y", "2")], "label string, anchors string")
    mapping = spark.createDataFrame([(5, "Y / Z"), (6, "W")], "community long, name string")
    top = spark.createDataFrame([(5, 1, "n1"), (5, 2, "n2")], "community long, rank int, node string")
    assert rows(labels.preserve(old, mapping, top), "label", "kind", "anchors") == [("X", "kept", "1"), ("Y", "new", "n1,n2"), ("Z", "new", "n1,n2")]


def test_include_scan(spark):
    lines = ["#include <ab/a.hpp>", '  #  include "abc/b.hpp"', '#include "../ab/c.hpp"', "#include <ab//d.hpp>", "#include <vector>", '#include "util.hpp"', "#include <far/x.hpp>", "// #include <ab/e.hpp>"]
    texts = spark.createDataFrame([("Q/ab/m.cpp", "\r\n".join(lines))], "path string, text string")
    found = files.scan_includes(texts, [("ab/", "Q/ab/"), ("abc/", "X/abc/")])
    assert [r["ref"] for r in found.collect()] == ["Q/ab/a.hpp", "X/abc/b.hpp", "Q/ab/c.hpp", "Q/ab//d.hpp", None, None, None]
    assert [r["bucket"] for r in found.collect()][4:] == [R.SYSTEM, R.SAME_DIRECTORY, "far/"]
    index = spark.createDataFrame([("A", "Q/ab/m.cpp", "m"), ("A", "Q/ab/a.hpp", "a"), ("B", "X/abc/b.hpp", "b_long"), ("B", "X/abc/b.hpp", "b")], "repo string, path string, id string")
    edges, stats = refs.link(found, index)
    assert rows(edges, "source_repo", "source", "target_repo", "target", "context", "origin", "source_file") == [("A", "m", "B", "b", "cross_module_include", "cross_link", "Q/ab/m.cpp")]
    assert rows(refs.missed(found, index, ["Q/ab", "X/abc"]), "kind", "key", "n") == [("ignored", R.SAME_DIRECTORY, 1), ("ignored", R.SYSTEM, 1), ("ignored", "far/", 1), ("unresolved", "Q/ab", 2)]
    got = stats.first().asDict()
    assert (got["total_includes"], got["ignored"], got["unresolved_includes"], got["resolved_includes"], got["resolved_directives"]) == (7, 3, 2, 2, 2)


def test_path_index(spark):
    nodes = spark.createDataFrame([("p", "foo_bar"), ("p", "foo"), ("p", "fop")], "path string, id string")
    assert refs.path_index(nodes, "path", "id").first()["id"] == "foo"


def test_id_repair(spark):
    nodes = spark.createDataFrame(
        [("abs_src_a_hpp", "src/a.hpp", 0), ("abs_src_a_cpp", "src/a.cpp", 1), ("abs_src_a_f", "src/a.cpp", 2), ("abs_src_d_txt", "src/d.txt", 3), ("abs_src_d_md", "src/d.md", 4), ("abs_other", "", 5), ("free", "", 6)],
        "id string, source_file string, pos int",
    )
    edges = spark.createDataFrame([("abs_src_a_hpp", "abs_src_a_cpp"), ("free", "free"), ("abs_src_a_f", "abs_other")], "source string, target string")
    kept, moved, stats = identity.repair(nodes, edges)
    assert stats == {"prefix": "abs", "nodes_before": 7, "nodes_after": 6, "links_before": 3, "links_after": 2, "unmapped": 0, "generic_fixed": 1, "collision_merges": 1, "files_kept_distinct": 2, "selfloops_dropped": 1, "still_absolute_after_fix": 0}
    assert rows(kept, "id", "source_file") == [("free", ""), ("other", ""), ("src_a", "src/a.hpp"), ("src_a_f", "src/a.cpp"), ("src_d_md", "src/d.md"), ("src_d_txt", "src/d.txt")]
    assert rows(moved, "source", "target") == [("free", "free"), ("src_a_f", "other")]
    assert identity.repair(kept, moved)[2] == {"skipped": "no identifier carries a path"}


def test_audit(spark):
    nodes = spark.createDataFrame([(1, None, "x/shipment.hpp", "")], "community long, repo_path string, source_file string, label string")
    names = spark.createDataFrame([(1, "Ship routing"), (2, "Gone"), (1, "shipment"), (1, "hpp file")], "community long, name string")
    got = relabel.audit(nodes, names)
    assert rows(got, "name", "matched", "stale") == [("Gone", False, False), ("Ship routing", True, False), ("hpp file", True, False), ("shipment", True, False)]
    assert rows(got, "name", "size", "matched_tokens", "note") == [("Gone", 0, "", relabel.ABSENT), ("Ship routing", 1, "ship", None), ("hpp file", 1, "hpp", None), ("shipment", 1, "shipment", None)]
    assert relabel.audit(nodes, names.where("name = 'Gone'")).first()["stale"]


def test_packing_spans_folders(spark):
    paths = spark.createDataFrame([(f"A/{i:02}.xml", 1) for i in range(15)] + [(f"B/{i:02}.xml", 1) for i in range(10)], "path string, length int")
    got = [(r["chunk"], r["total"], r["output"], len(r["files"])) for r in corpus.manifest(paths).orderBy("chunk").collect()]
    assert got == [(1, 2, "chunk_01.json", 20), (2, 2, "chunk_02.json", 5)]


def test_coverage_precedence(spark):
    paths = ["build/x.cpp", "README.md", "sub/README.md", "guides/x.md", "guides_index.md", "guides_index.mdx", "src/a.CPP", "src/a.xml"]
    claimed = spark.createDataFrame([("README.md",), ("build/x.cpp",)], "path string")
    got = corpus.coverage(spark.createDataFrame([(p,) for p in paths], "path string"), claimed, [("guides", "docs"), ("guides_index.md", "index")])
    want = {"build/x.cpp": "ignored", "README.md": "claimed", "sub/README.md": "ignored", "guides/x.md": "excluded", "guides_index.md": "excluded", "guides_index.mdx": "other", "src/a.CPP": "code", "src/a.xml": "data"}
    assert {r["path"]: r["status"] for r in got.collect()} == want
    assert rows(corpus.unclaimed_by_top(got), "top", "n") == [("src", 1)]
    assert rows(corpus.unclaimed_by_top(got, "data"), "top", "n") == [("src", 1)]
    root = corpus.coverage(spark.createDataFrame([("setup.py",), (".mcp.json",)], "path string"), claimed, [])
    assert rows(root, "path", "status", "top") == [(".mcp.json", "ignored", ".mcp.json"), ("setup.py", "code", "setup.py")]


def test_tokens(spark):
    df = spark.createDataFrame([("a_b c-d!",), ("für",), (None,)], "t string")
    assert [r[0] for r in df.select(X.token_estimate("t")).collect()] == [5, 1, 0]
    assert df.sparkSession.range(1).select(X.name_tokens(F.lit("The Tide-Mark of an ab core x1y"))).first()[0] == ["tide", "mark", "x1y"]


def test_first_wins(spark):
    df = spark.createDataFrame([("chunk_02", 0, "i", "late"), ("chunk_01", 3, "i", "early"), ("chunk_01", 0, "j", "x")], "file string, pos int, id string, label string")
    assert rows(select.first_wins(df, ["id"], ["file", "pos"]), "id", "label") == [("i", "early"), ("j", "x")]


def test_fragments_and_validation(spark, tmp_path):
    node = {"id": "a", "label": "A", "file_type": "concept"}
    (tmp_path / "chunk_01.json").write_text(json.dumps({"nodes": [node], "edges": [{"source": "a", "target": "b", "confidence": "EXTRACTED", "confidence_score": 1.0}], "hyperedges": []}))
    (tmp_path / "chunk_02.json").write_text(json.dumps({"nodes": [node | {"label": "B"}, {"id": "b", "label": "b"}], "edges": [{"source": "a", "target": "b"}], "hyperedges": []}))
    nodes, edges, hyper = corpus.merge_fragments(documents.load_fragments(spark, str(tmp_path)))
    assert rows(nodes, "id", "label") == [("a", "A"), ("b", "b")]
    assert edges.count() == 2 and hyper.count() == 0
    plan = spark.createDataFrame([(1, "chunk_01.json"), (2, "chunk_02.json"), (3, "chunk_03.json"), (4, "x")], "chunk int, output string")
    outputs = spark.createDataFrame([("chunk_01.json", (tmp_path / "chunk_01.json").read_text()), ("chunk_02.json", '{"nodes": [], "edges": 3}'), ("x", "{")], "output string, content string")
    assert rows(corpus.validate(plan, outputs), "chunk", "status", "nodes", "edges") == [(1, "ok", 1, 1), (2, "invalid", 0, 0), (3, "missing", 0, 0), (4, "invalid", 0, 0)]
    with pytest.raises(FileNotFoundError):
        (tmp_path / "empty").mkdir()
        documents.load_fragments(spark, str(tmp_path / "empty"))


def test_files_and_labels(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.HPP").write_bytes(b"x\r\n\xff#include <v>\r\n")
    (tmp_path / "src" / "n.txt").write_text("no")
    assert rows(files.scan_files(spark, str(tmp_path)), "path") == [("src/a.HPP",), ("src/n.txt",)]
    assert rows(files.scan_texts(spark, str(tmp_path)), "path", "text") == [("src/a.HPP", "x\n#include <v>\n")]
    chunks = spark.createDataFrame([("one", "src", ["*.HPP"]), ("two", ".", ["src"])], "name string, root string, targets array<string>")
    assert rows(files.resolve_targets(files.scan_files(spark, str(tmp_path)), chunks.withColumn("root", F.regexp_replace("root", r"^\.$", ""))), "name", "path") == [("one", "src/a.HPP"), ("two", "src/a.HPP"), ("two", "src/n.txt")]
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "A.json").write_text('{"0": "Zero", "12": "X / Y"}')
    (folder / "A.anchors.json").write_text('{"anchor_count": 2, "communities": [{"label": "L", "size": 3, "anchors": ["p", "q"]}]}')
    assert rows(documents.load_labels(spark, str(folder)), "repo", "community", "name") == [("A", 0, "Zero"), ("A", 12, "X / Y")]
    assert rows(documents.load_anchors(spark, str(folder)), "repo", "entry", "label") == [("A", 0, "L")]


def test_repo_paths(spark):
    df = spark.createDataFrame([("a/../b.h",), ("/eng/x/c.h",), ("/else/d.h",), ("",)], "source_file string")
    got = files.repo_paths(df, "/eng/src", "/eng")
    assert [(r["repo_path"], r["outcome"]) for r in got.collect()] == [("src/b.h", "stamped"), ("x/c.h", "stamped"), (None, "outside"), (None, "missing")]


def test_sync_and_sink(spark, tmp_path):
    from knotwork import sinks

    nodes = spark.createDataFrame([("A", 10, "Ten", 0), ("A", 10, "Ten again", 1), ("A", 9, "Nine", 2), ("B", 1, "B / Community 1", 3)], "repo string, community long, community_name string, position long")
    got = labels.sync(nodes, spark.createDataFrame([("A",), ("B",)], "repo string"))
    assert rows(got, "repo", "community", "name") == [("A", 10, "Ten again"), ("A", 9, "Nine"), ("B", None, None)]
    assert sinks.write_labels(got, tmp_path) == {"A": 2}
    assert list(json.loads((tmp_path / "A.json").read_text())) == ["9", "10"]
    assert "| A | 10 | Ten again |" in sinks.report(got, "Names")


def test_traversal(spark):
    pairs = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (5, 6)], "a long, b long")
    scratch = Scratch(spark, "test")
    assert rows(traversal.shortest_path(pairs, 1, 3, scratch), "hop", "node") == [(0, 1), (1, 2), (2, 3)]
    assert traversal.shortest_path(pairs, 1, 6, scratch).count() == 0
    assert traversal.preorder(pairs, 1, 3, scratch) == [1, 2, 3, 4]
    chain = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    assert rows(traversal.shortest_path(chain, 0, 12, scratch).orderBy("hop"), "node") == sorted([(i,) for i in range(13)], key=str)
    assert traversal.shortest_path(chain, 0, 12, scratch, depth=11).count() == 0 and traversal.shortest_path(chain, 5, 5, scratch).count() == 1
    rows_ = spark.createDataFrame([("a", "b", "uses"), ("a", "b", "uses"), ("b", "b", "is")], "source string, target string, relation string")
    assert rows(traversal.get_neighbors(traversal.adjacency(rows_), "b"), "node", "relation", "direction") == [("a", "uses", "in"), ("b", "is", "in"), ("b", "is", "out")]


def test_path_hops(spark):
    path = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "hop int, node string")
    edges = spark.createDataFrame([("a", "b", "uses"), ("a", "b", "calls"), ("c", "b", "includes")], "source string, target string, relation string")
    assert rows(traversal.path_hops(path, edges), "hop", "source", "target", "relation", "direction") == [(1, "a", "b", "calls", "out"), (2, "b", "c", "includes", "in")]


def test_extract(spark):
    texts = spark.createDataFrame([("x/a.hpp", "class Base {\n};\nclass Later;\n  struct Child : public ns::Base {\n"), ("x/m.py", "class P(Base):\n  def run(self):\n    pass\n")], "path string, text string")
    nodes, edges = extract.extract(texts)
    assert {r["id"] for r in nodes.collect()} == {"x_a", "x_m", "x_a_base", "x_a_child", "x_m_p", "x_m_run"}
    assert rows(edges.where("relation = 'inherits'"), "source", "target") == [("x_a_child", "x_a_base"), ("x_m_p", "x_a_base")]
    more = spark.createDataFrame([("x/m.py", "import x.n\nfrom x.gone import y\n\ndef go(a):\n    help(a)\n    go(a)\n"), ("x/n.py", "def help(a):\n    return a\n")], "path string, text string")
    found = extract.extract(more)[1]
    assert rows(found.where("relation <> 'contains'"), "relation", "source", "target", "confidence") == [("calls", "x_m_go", "x_n_help", "INFERRED"), ("imports", "x_m", "x_n", "EXTRACTED")]


def test_owner_of_equal_ids(spark):
    """Two repos share a local id: a link to it stays between the repos that own its ends."""
    index = spark.createDataFrame([("A", "A/m.cpp", "m"), ("B", "B/u.hpp", "util"), ("A", "A/u.hpp", "util")], "repo string, path string, id string")
    found = spark.createDataFrame([("A/m.cpp", "B/u.hpp", None), ("A/m.cpp", "A/u.hpp", None)], "src string, ref string, bucket string")
    edges, stats = refs.link(found, index)
    assert rows(edges, "source_repo", "source", "target_repo", "target") == [("A", "m", "B", "util")]
    assert stats.first()["intra_module_includes_skipped"] == 1


def test_graph_documents_and_merge(spark, tmp_path):
    from knotwork import cli

    def graph(name, nodes, links):
        (tmp_path / f"{name}.json").write_text(json.dumps({"directed": False, "graph": {}, "nodes": nodes, "links": links}))
        return f"{tmp_path}/{name}.json"

    a = graph("a", [{"id": "x", "label": "X", "community": 0}, {"id": "y", "label": "Y", "community": 0}], [{"source": "x", "target": "y", "relation": "calls", "confidence": "EXTRACTED"}])
    b = graph("b", [{"id": "x", "label": "X2", "community": 7}], [])
    folder = tmp_path / "labels"
    folder.mkdir()
    (folder / "A.anchors.json").write_text(json.dumps({"anchor_count": 15, "communities": [{"label": "Pair", "size": 2, "anchors": ["x", "y"]}]}))
    (folder / "B.json").write_text(json.dumps({"7": "Lone"}))
    cli.merge(spark, {"A": a, "B": b}, str(folder), str(tmp_path / "out"))
    nodes, edges = cli._tables(spark, str(tmp_path / "out"))
    assert rows(nodes, "id", "community", "community_key", "community_name") == [("A::x", 0, "A:0", "Pair"), ("A::y", 0, "A:0", "Pair"), ("B::x", 1000007, "B:7", "Lone")]
    assert rows(edges, "source", "target", "relation") == [("A::x", "A::y", "calls")]


def test_rubric_and_spec_rules(spark):
    contexts = spark.createDataFrame([("t", "Builds a TideTable")], "task string, context string")
    rubric = spark.createDataFrame([("t", "i1", ["tidetable", "zzz"]), ("t", "i2", ["missing"])], "task string, item string, any array<string>")
    assert rows(savings.rubric_coverage(contexts, rubric), "task", "covered", "items") == [("t", 1, 2)]
    nodes = spark.createDataFrame([("a_1", "concept", "x.py"), ("Bad", "odd", "y.hpp")], "id string, file_type string, source_file string")
    edges = spark.createDataFrame([("EXTRACTED", 0.9, "a_1", "Bad", "calls"), ("INFERRED", 0.85, "a_1", "a_1", "calls"), ("AMBIGUOUS", 0.5, "a_1", "Bad", "uses")], "confidence string, confidence_score double, source string, target string, relation string")
    hyper = spark.createDataFrame([("c", ["a", "b"])], "chunk string, nodes array<string>")
    assert dict(rows(quality.spec_rules(nodes, edges, hyper), "rule", "broken")) == {"file_type": 1, "id_characters": 1, "extracted_score": 1, "inferred_score": 0, "ambiguous_score": 1, "call_across_languages": 1, "hyperedge_arity": 1, "hyperedges_a_chunk": 0}
    assert quality.repeatable(nodes, nodes).count() == 0


def test_config(tmp_path, monkeypatch):
    monkeypatch.delenv("KNOTWORK_ENGINE", raising=False)
    with pytest.raises(config.ConfigError):
        config.load(tmp_path)
    (tmp_path / "eng").mkdir()
    (tmp_path / "knotwork.toml").write_text(f'engine = "{tmp_path}/eng"\n')
    assert config.load(tmp_path).engine == (tmp_path / "eng").resolve()
    with pytest.raises(config.ConfigError):
        config.load(tmp_path, markers=("absent",))
    engine = tmp_path / "eng"
    assert config.provenance(engine) == {"commit": None, "describe": None, "release": None, "version": None}
    (engine / "News.txt").write_text("Release 7:\n\nmore\n")
    (engine / "v.hpp").write_text('  #define VERSION "1.2"\n')
    (engine / ".git").mkdir()
    (engine / ".git" / "HEAD").write_text("ref: refs/heads/main\n")
    (engine / ".git" / "packed-refs").write_text("# pack\n" + "a" * 40 + " refs/heads/main\n")
    assert config.provenance(engine, version_file="v.hpp", define="VERSION") == {"commit": "a" * 40, "describe": None, "release": "Release 7", "version": "1.2"}


def test_stream_ingest(spark, tmp_path):
    from knotwork.streaming.ingest import ingest

    seen: list[list[int]] = []

    def run():
        ingest(spark, str(tmp_path / "in"), "id long, text string", "id", "text", str(tmp_path / "snap"), str(tmp_path / "check"), lambda df: seen.append(sorted(r["id"] for r in df.collect())))

    spark.createDataFrame([(1, "a"), (2, "b")], "id long, text string").write.parquet(str(tmp_path / "in"))
    run()
    spark.createDataFrame([(1, "a"), (2, "c"), (3, "d")], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert seen == [[1, 2], [2, 3]]


def test_ingest_takes_null_texts_once(spark, tmp_path):
    from knotwork.streaming.ingest import ingest

    seen: list[list] = []

    def run():
        ingest(spark, str(tmp_path / "in"), "id long, text string", "id", "text", str(tmp_path / "snap"), str(tmp_path / "check"), lambda df: seen.append(sorted((r["id"] for r in df.collect()), key=str)))

    for _ in range(2):
        spark.createDataFrame([(1, None), (None, "b")], "id long, text string").write.mode("append").parquet(str(tmp_path / "in"))
        run()
    assert seen == [[1, None], []]


def test_scratch_needs_a_shared_folder(spark, monkeypatch):
    from knotwork import scratch

    root = scratch.shared_root(spark)
    assert root and scratch.Scratch(spark, "x").write_text("a/b.txt", "hé").startswith(root)


def test_collect_and_manifest_files(spark, tmp_path):
    from knotwork import sinks

    listed = spark.createDataFrame([("Examples/b/x.xml", 5), ("Examples/a/y.csv", 5), ("Examples/Output/z.xml", 5), ("Examples/big.xml", 400_001), ("Other/x.xml", 1), ("Examples/n.txt", 1)], "path string, length long")
    found = corpus.collect(listed, "Examples", ["**/*.xml", "**/*.csv"])
    assert [r["path"] for r in found.collect()] == ["Examples/a/y.csv", "Examples/b/x.xml"]
    assert sinks.write_manifest(corpus.manifest(found, 1), tmp_path / "m") == 2
    written = json.loads((tmp_path / "m" / "_manifest.json").read_text())
    assert [(w["chunk"], w["total"], w["files"]) for w in written] == [(1, 2, ["Examples/a/y.csv"]), (2, 2, ["Examples/b/x.xml"])]
    detected = corpus.detect(spark.createDataFrame([("a.py", "x y"), ("b.md", "z")], "path string, text string"))
    assert rows(corpus.merge_detections(detected.union(detected)), "kind", "n_files", "words") == [("code", 2, 4), ("data", 2, 2)]


def test_commands_from_checkout_to_checked_graph(spark, tmp_path, monkeypatch):
    """Build, merge with links across chunks, relabel, verify, bench and the lookups, as a user runs them."""
    from knotwork import cli

    monkeypatch.setattr(cli, "ROUNDS", 2)
    engine = tmp_path / "engine"
    for path, text in {
        "core/a.hpp": "#include <util/u.hpp>\n#include <vector>\nclass Alpha : public Base {\n};\n",
        "core/b.py": "import core.c\n\ndef run():\n    helper()\n",
        "core/c.py": "def helper():\n    pass\n",
        "util/u.hpp": "class Base {\n};\n",
        "loose.cpp": "struct L {\n};\n",
    }.items():
        (engine / path).parent.mkdir(parents=True, exist_ok=True)
        (engine / path).write_text(text)
    chunks = tmp_path / "chunks.json"
    chunks.write_text(json.dumps([{"name": "Core", "root": "core", "targets": ["."], "kind": "code", "labelled": True}, {"name": "Util", "root": "util", "targets": ["."], "kind": "code"}]))
    label_folder = tmp_path / "labels"
    label_folder.mkdir()
    base = ["--engine", str(engine), "--out", str(tmp_path / "out"), "--chunks", str(chunks), "--labels", str(label_folder), "--graph", str(tmp_path / "merged")]

    def run(*arguments):
        return cli.run(spark, cli.parser().parse_args([*base, *arguments]))

    assert run("verify")[1] == 1 and "not found" in run("verify")[0]
    assert "Unclaimed code files: 1" in run("coverage")[0] and "loose.cpp" in run("coverage")[0]
    (label_folder / "Core.json").write_text(json.dumps({"0": "Helpers and run"}))
    (label_folder / "Util.anchors.json").write_text(json.dumps({"anchor_count": 15, "communities": [{"label": "Bases", "size": 2, "anchors": ["u", "u_base"]}]}))
    assert "Core: " in run("build")[0]
    nodes, edges = cli._tables(spark, str(tmp_path / "merged"))
    assert rows(edges.where("origin = 'cross_link'"), "source", "target", "context", "source_file") == [("Core::a", "Util::u", "cross_module_include", "core/a.hpp")]
    assert {r["community_name"] for r in nodes.where("repo = 'Util'").collect()} == {"Bases"}
    meta = json.loads(spark.read.text(str(tmp_path / "merged" / "meta")).first()[0])
    assert meta["chunks"] == ["Core", "Util"] and meta["cross_module_edges"] == 1 and meta["link_stats"]["ignored_by_prefix"] == {R.SYSTEM: 1}
    text, code = run("verify")
    assert code == 0 and "- passed: include recall computed (1 of 2 references resolved (50%))" in text, text
    assert run("verify", "--docs", "Docs")[1] == 1
    assert "| Core |" in run("info")[0]
    assert "| x |" not in run("relabel", "Core")[0] and "Helpers" in run("relabel", "Core", "--action", "propose")[0]
    assert "Core: " in run("relabel", "Core", "--action", "audit")[0]
    run("relabel", "Core", "--action", "write-anchors")
    written = json.loads((label_folder / "Core.anchors.json").read_text())
    assert [c["label"] for c in written["communities"]] == ["Helpers and run"] and written["communities"][0]["anchors"]
    run("relabel", "Core", "--action", "write-anchors")
    assert json.loads((label_folder / "Core.anchors.json").read_text()) == written
    assert "Bases" in run("relabel", "Util", "--action", "sync")[0] and json.loads((label_folder / "Util.json").read_text())
    assert "Alpha" in run("relabel", "Core", "--action", "digest")[0]
    document = tmp_path / "graph.json"
    run("merge", "--document", str(document))
    whole = json.loads(document.read_text())
    assert len(whole["nodes"]) == cli._tables(spark, str(tmp_path / "merged"))[0].count() and whole["graph"]["link_stats"]["total_includes"] == 2
    suite = tmp_path / "questions.json"
    suite.write_text(json.dumps({"questions": [{"id": "q1", "question": "helper run"}]}))
    assert "| q1 |" in run("bench", str(suite))[0]
    assert "includes | out" in run("path", "Core::a", "Util::u")[0]
    assert "Util::u" in run("neighbors", "Core::a")[0] and "NODE" in run("query", "alpha helper")[0]
    assert "chunks" in run("semantic", "--root", ".", "--patterns", "**/*.py", "--folder", str(tmp_path / "sem"))[0]
    assert "Chunks: 0 of 1" in run("semantic", "--validate", "--folder", str(tmp_path / "sem"))[0]
    (tmp_path / "sem" / "chunk_01.json").write_text('{"nodes": [{"id": "a"}], "edges": []}')
    assert run("semantic", "--validate", "--folder", str(tmp_path / "sem"))[0] == "Chunks: 1 of 1, 1 nodes, 0 edges\n"
