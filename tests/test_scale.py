"""What a query shuffles and how many rows its tasks get, at sizes that are small but show the growth."""

from __future__ import annotations

import random

import pytest

from pyspark.sql import functions as F

from knotwork import scratch as S
from knotwork.operators import analytics, quality, traversal
from knotwork.plans import views
from knotwork.scratch import Scratch


def new_stages(spark, work) -> list:
    """What Spark knows of the stages of ``work``."""
    context = spark.sparkContext
    store, bus = context._jsc.sc().statusStore(), context._jsc.sc().listenerBus()

    def stages() -> dict:
        bus.waitUntilEmpty(30_000)
        none = context._gateway.new_array(context._jvm.double, 0)
        found = store.stageList(context._jvm.java.util.ArrayList(), False, False, none, context._jvm.java.util.ArrayList())
        return {found.apply(i).stageId(): found.apply(i) for i in range(found.size())}

    before = stages()
    work()
    return [x for i, x in stages().items() if i not in before]


def shuffled(spark, work) -> int:
    """Rows that the stages of ``work`` write to shuffles."""
    return sum(x.shuffleWriteRecords() for x in new_stages(spark, work))


def test_components_shuffle_few_rows_a_link(spark):
    draw = random.Random(1)
    links = [(f"x{draw.randrange(500)}", f"y{draw.randrange(2000)}") for _ in range(40_000)]
    edges = Scratch(spark, "links").save(spark.createDataFrame(links, "a string, b string"))
    found = []
    assert shuffled(spark, lambda: found.extend(analytics.components(edges, Scratch(spark, "few")).collect())) < 2 * len(links)
    assert {r["component"] for r in found} == {min(n for n, _ in links)} and len(found) == len({n for link in links for n in link})


@pytest.mark.parametrize(
    "links, expected",
    [
        ([(None, 3), (3, 4), (None, None)], {3: 3, 4: 3}),
        ([(i, i + 1) for i in range(40)] + [(7, 7), (99, 99)], {**dict.fromkeys(range(41), 0), 99: 99}),
        # beside a large component a small one, which one smaller and one larger neighbour a node leave in two parts
        ([(i, i + 1) for i in range(300)] + [(1000 + a, 1000 + b) for a, b in [(0, 8), (0, 9), (1, 8), (1, 6), (2, 5), (2, 9), (1, 7), (3, 7), (0, 7)]], {**dict.fromkeys(range(301), 0), **{1000 + i: 1000 for i in (0, 1, 2, 3, 5, 6, 7, 8, 9)}}),
    ],
)
def test_components_of_odd_links(spark, links, expected):
    got = analytics.components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "odd")).collect()
    assert {r["node"]: r["component"] for r in got} == expected and len(got) == len(expected)


def in_order(pairs, start, depth) -> list:
    """Depth-first by a plain walk in Python."""
    near: dict = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen: dict = {}

    def visit(node, level):
        seen[node] = True
        for n in sorted(near.get(node, ())) if level < depth else ():
            if n not in seen:
                visit(n, level + 1)

    visit(start, 0)
    return list(seen)


@pytest.mark.parametrize("extra", [[], [("n0", "n3"), ("s11", "s700"), ("s5", "s5")]])
def test_depth_first_of_many(spark, extra):
    """More than ten thousand nodes, as a tree and with cycles."""
    links = [("r", f"n{i}") for i in range(5)] + [(f"n{i % 5}", f"s{i}") for i in range(10_500)] + extra
    pairs = spark.createDataFrame(links, "a string, b string")
    got = traversal.depth_first(pairs, "r", 2, Scratch(spark, "order")).orderBy("position").collect()
    expected = in_order(links, "r", 2)  # with cycles, a nation that is met as a supplier's depth isn't gone on from
    assert [r["position"] for r in got] == list(range(len(expected)))
    assert [r["node"] for r in got] == expected and len(got) == (8_406 if extra else 10_506)


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_depth_first_of_odd_links(spark, depth):
    draw = random.Random(depth)
    links = [(draw.randrange(30), draw.randrange(30)) for _ in range(50)] + [(0, 7)]
    pairs = spark.createDataFrame(links, "a long, b long")
    assert traversal.preorder(pairs, 0, depth, Scratch(spark, "odd")) == in_order(links, 0, depth)
    assert traversal.preorder(pairs, 77, depth, Scratch(spark, "none")) == [77]


@pytest.fixture
def lines(spark, tmp_path):
    """A folder with 200,000 lines of 50,000 orders."""
    n = F.col("id")
    rows = spark.range(200_000).select(F.floor(n / 4).alias("l_orderkey"), (F.xxhash64("id") % 5_000 + 5_000).alias("l_partkey"), (n % 100).alias("l_suppkey"))
    rows.write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_common_orders_are_dealt_by_their_number(spark, lines, monkeypatch):
    monkeypatch.setattr(S, "TASK_ROWS", 20_000, raising=False)
    stages = new_stages(spark, lambda: views._co_edges(spark, lines).write.format("noop").mode("overwrite").save())
    tasks = [x.shuffleReadRecords() / x.numTasks() for x in stages if x.shuffleReadRecords() > 10_000]
    assert tasks and max(tasks) <= 2 * 20_000  # both sides of the join


def test_stored_tables_have_small_files(spark, lines):
    table = views.stored(spark, lines, "co_edges", lambda: views._co_edges(spark, lines))
    assert table.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 100_000


def graph(spark):
    """edges among 2,000 nodes, of which one is not in nodes, and the nodes."""
    n, repo = F.col("id"), F.lit("r")
    rows = spark.range(60_000).select(repo.alias("source_repo"), F.concat(F.lit("n"), n % 1_999).alias("source"), repo.alias("target_repo"), F.concat(F.lit("n"), F.floor(n / 31)).alias("target"), F.lit("uses").alias("relation"), F.lit("INFERRED").alias("confidence"))
    scratch = Scratch(spark, "graph")
    nodes = spark.range(1_999).where("id <> 5").select(repo.alias("repo"), F.concat(F.lit("n"), "id").alias("local_id"))
    return scratch.save(rows), scratch.save(nodes)


@pytest.fixture
def few_bytes(spark):
    """Tables of some thousand rows are too large for a broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "3000")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("name, times", [("graph_health", 2), ("dangling_edges", 1), ("cross_recount", 1), ("ends", 1)])
def test_edges_are_hardly_shuffled(spark, few_bytes, name, times):
    edges, nodes = graph(spark)
    found = []
    assert shuffled(spark, lambda: found.extend(getattr(quality, name)(edges, nodes).collect())) < times * 60_000
    lost = edges.where("source = 'n5' OR target = 'n5'")
    assert {"graph_health": lambda: found[0]["dangling"] == lost.count(), "dangling_edges": lambda: len(found) == lost.distinct().count(), "cross_recount": lambda: found[0]["n_cross"] == lost.where("source <> target").count(), "ends": lambda: found[0]["dangling"] == lost.count()}[name]()


def test_pairs_are_shuffled_once(spark, few_bytes):
    edges, nodes = graph(spark)
    ids, found = nodes.select(F.col("local_id").alias("id")), []
    assert shuffled(spark, lambda: found.extend(analytics.undirected(edges, ids).collect())) < 2 * 60_000
    pairs = edges.where("source <> 'n5' AND target <> 'n5'").select(F.least("source", "target"), F.greatest("source", "target")).distinct()
    assert len(found) == pairs.count()


def test_adjacency_is_shuffled_once(spark):
    edges, _ = graph(spark)
    assert shuffled(spark, lambda: traversal.adjacency(edges).write.format("noop").mode("overwrite").save()) <= 2.1 * 60_000
