"""The driver tables as a graph: each view is a plan over the parquet files, and ``PREFIX`` is the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.refs import hrefs, normalised
from ..operators import traversal
from ..scratch import FILE_ROWS, Scratch, tasks

#: Fixed rows that the quality queries add to the edges: a dangling edge, a self-loop twice, a reversed pair.
ODD_EDGES = [("orders", "o-1", "customer", "c-1"), ("part", "p0", "part", "p0"), ("part", "p0", "part", "p0"), ("region", "r0", "nation", "n0"), ("nation", "n0", "region", "r0")]
LANGUAGES = ["de", "en", "es", "fr"]
PAGE_RULES = [("fr/1", "French, first"), ("de", "German"), ("es/9", "Spanish, ninth"), ("es", "Spanish"), ("en/999", "English, last")]
QUESTIONS = [(1, "which small red widget"), (2, "blue bolt or hot gear"), (3, "tiny gizmo and ring")]


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def fixed(spark: SparkSession, rows: list[tuple], columns: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(cells))


NODE = "repo, ord, local_id, label, source_file, community"


def nodes(spark: SparkSession, d: str) -> DataFrame:
    def of(table: str, repo: str, ord: int, key: str, letter: str, label: str, file: str = "cast(null as string)", community: str = "cast(null as bigint)") -> DataFrame:
        return read(spark, d, table).selectExpr(f"'{repo}' AS repo", f"{ord} AS ord", f"concat('{letter}', {key}) AS local_id", f"{label} AS label", f"{file} AS source_file", f"cast({community} as bigint) AS community")

    return (
        of("region", "region", 0, "r_regionkey", "r", "r_name")
        .union(of("nation", "nation", 1, "n_nationkey", "n", "n_name", community="n_regionkey"))
        .union(of("customer", "customer", 2, "c_custkey", "c", "c_name", "concat('segment/', c_mktsegment)", "c_nationkey"))
        .union(of("supplier", "supplier", 3, "s_suppkey", "s", "s_name", community="s_nationkey"))
        .union(of("part", "part", 4, "p_partkey", "p", "p_name", "concat('type/', p_type, '/', p_brand)", "cast(substr(p_brand, 7) as int)"))
        .union(of("orders", "orders", 5, "o_orderkey", "o", "o_orderpriority", community="month(o_orderdate)"))
    )


_stored: dict[tuple[str, str, str], DataFrame] = {}


def stored(spark: SparkSession, d: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table of the graph, written on first use and read from then on: a session's tables of a folder don't change."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _stored:
        _stored[key] = Scratch(spark, f"stored-{name}").save(build(), rows=FILE_ROWS)
    return _stored[key]


def store(spark: SparkSession, d: str) -> DataFrame:
    """Writes the graph: table, rows."""
    out = None
    for name, table in (("edges", edges), ("co_edges", co_edges), ("adjacency", adjacency)):
        one = table(spark, d).agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


def edges(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "edges", lambda: _edges(spark, d))


def adjacency(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "adjacency", lambda: traversal.adjacency(edges(spark, d)))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    def of(rows: DataFrame, a: str, a_key: str, b: str, b_key: str, relation: str, confidence: str) -> DataFrame:
        return rows.selectExpr(f"'{a}' AS source_repo", f"concat('{a[0]}', {a_key}) AS source", f"'{b}' AS target_repo", f"concat('{b[0]}', {b_key}) AS target", f"'{relation}' AS relation", f"'{confidence}' AS confidence")

    line = read(spark, d, "lineitem")
    parts = tasks(line.count())  # read from the files' footers
    # by ranges of parts, then of the other end: a part's edges lie together, and a part with very many goes to several tasks
    in_orders = line.select("l_orderkey", "l_partkey").repartitionByRange(parts, "l_partkey", "l_orderkey").distinct()
    supplied = line.select("l_partkey", "l_suppkey").repartitionByRange(parts, "l_partkey", "l_suppkey").distinct()
    return (
        of(read(spark, d, "customer"), "customer", "c_custkey", "nation", "c_nationkey", "in_nation", "EXTRACTED")
        .union(of(read(spark, d, "supplier"), "supplier", "s_suppkey", "nation", "s_nationkey", "in_nation", "EXTRACTED"))
        .union(of(read(spark, d, "nation"), "nation", "n_nationkey", "region", "n_regionkey", "in_region", "EXTRACTED"))
        .union(of(read(spark, d, "orders"), "orders", "o_orderkey", "customer", "o_custkey", "placed_by", "EXTRACTED"))
        .union(of(in_orders, "orders", "l_orderkey", "part", "l_partkey", "contains", "INFERRED"))
        .union(of(supplied, "part", "l_partkey", "supplier", "l_suppkey", "supplied_by", "AMBIGUOUS"))
    )


def co_edges(spark: SparkSession, d: str) -> DataFrame:
    return stored(spark, d, "co_edges", lambda: _co_edges(spark, d))


def _co_edges(spark: SparkSession, d: str) -> DataFrame:
    """a, b, w: parts that share orders, and how many. An order has a handful of lines, so the join by order stays linear.

    The lines are dealt by order once, TASK_ROWS a task; distinct and both sides of the join use that. Few pairs come twice from a task,
    so they are dealt before they are counted, to tasks of about as many.
    """
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    parts = tasks(line.count())  # read from the files' footers
    line = line.repartition(parts, "l_orderkey").distinct()
    other = line.select("l_orderkey", F.col("l_partkey").alias("b"))
    pairs = line.join(other.hint("merge"), "l_orderkey").where("l_partkey < b").select(F.col("l_partkey").alias("a"), "b")
    return pairs.repartition(2 * parts, "a", "b").groupBy("a", "b").agg(F.count("*").alias("w"))


def odd_edges(spark: SparkSession, d: str) -> DataFrame:
    return edges(spark, d).select("source_repo", "source", "target_repo", "target").union(fixed(spark, ODD_EDGES, ["source_repo", "source", "target_repo", "target"]))


def parts(spark: SparkSession, d: str) -> DataFrame:
    """node, community (brand), label, source_file, and the communities of three other clusterings."""
    brand = F.expr("cast(substr(p_brand, 7) as bigint)")
    return read(spark, d, "part").select(
        F.col("p_partkey").alias("node"),
        brand.alias("community"),
        F.col("p_name").alias("label"),
        F.expr("concat('type/', p_type, '/', p_brand)").alias("source_file"),
        F.when(F.col("p_partkey") % 4 == 0, (brand + 1) % 25).otherwise(brand).alias("reclustered"),
        F.expr("cast(cast(substr(p_brand, 7) as int) div 3 as bigint)").alias("merged"),
    )


def named(spark: SparkSession, d: str) -> DataFrame:
    """repo, community, name of the parts' brands and the customers' nations."""
    brands = parts(spark, d).select("community").distinct().select(F.lit("part").alias("repo"), "community", F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("name"))
    nations = read(spark, d, "nation").select(F.lit("customer").alias("repo"), F.col("n_nationkey").cast("long").alias("community"), F.col("n_name").alias("name"))
    return brands.union(nations)


def refs(spark: SparkSession, d: str) -> DataFrame:
    """page_id, pos, src (the page's language), href, ref (normalised)."""
    pages = read(spark, d, "pages").select("page_id", F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("src"), F.posexplode(hrefs("html")).alias("pos", "href"))
    return pages.withColumn("ref", normalised("href"))


#: Documents as source files of seven chunks: what includes are written as, and the paths that they stand for. One chunk has no root.
INCLUDE_ROOTS = [(f"lib{k}/", f"m{k}/") for k in range(6)]
SOURCE_FILES = "concat('m', doc_id % 7, '/f', doc_id % 3, '/d', doc_id, '.hpp')"


def _target(number: str, name: str = "lib") -> str:
    return f"concat('{name}', ({number}) % 7, '/f', ({number}) % 3, '/d', {number}, '.hpp')"


#: The lines of a file: one to the next file, one within the chunk, one to twice the number, which half of them lack, and odd ones.
INCLUDE_TEXT = "concat_ws(chr(10), concat('#include <', " + _target("doc_id + 1") + ", '>'), concat('  #  include \"../', " + _target("doc_id + 7") + ", '\"'), concat('#include <', " + _target("doc_id * 2") + ", '>'), '// #include <lib0/x.hpp>', '#include <vector>', '#include \"util.hpp\"', concat('#include <far', doc_id % 13, '/x.hpp>'))"
FILE = f"doc_id, concat('m', doc_id % 7) AS repo, 10 + doc_id % 7 AS ord, concat('d', doc_id) AS local_id, {SOURCE_FILES} AS path, {INCLUDE_TEXT} AS text, n_chars"


def source_files(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, repo, ord, local_id, path, text, n_chars of documents as source files, with include lines for a text."""
    return read(spark, d, "documents").selectExpr(*FILE_COLUMNS)


FILE_COLUMNS = [
    "doc_id",
    "concat('m', cast(doc_id % 7 as string)) AS repo",
    "cast(10 + doc_id % 7 as int) AS ord",
    "concat('d', cast(doc_id as string)) AS local_id",
    f"{SOURCE_FILES} AS path",
    INCLUDE_TEXT + " AS text",
    "n_chars",
]
FILES = f"g_files AS (SELECT {FILE} FROM documents)"
#: All include directives: src, opening, name, then ref (null without a root) and bucket.
INCLUDES = FILES + r""", g_lines AS (SELECT path AS src, unnest(regexp_extract_all(text, '(?m)^\s*#\s*include\s*([<"])([^>"]+)[>"]', 1)) AS opening, unnest(regexp_extract_all(text, '(?m)^\s*#\s*include\s*([<"])([^>"]+)[>"]', 2)) AS raw FROM g_files),
g_names AS (SELECT src, opening, regexp_replace(replace(raw, '', '/'), '^[./]+', '') AS name FROM g_lines),
g_inc AS (SELECT src, ref, CASE WHEN ref IS NULL THEN CASE WHEN strpos(name, '/') > 0 THEN split_part(name, '/', 1) || '/' WHEN opening = '<' THEN '(system, no subdir)' ELSE '(same-directory relative)' END END AS bucket
  FROM (SELECT *, CASE """ + " ".join(f"WHEN starts_with(name, '{p}') THEN '{r}' || substr(name, {len(p) + 1})" for p, r in INCLUDE_ROOTS) + """ END AS ref FROM g_names)),
g_pairs AS (SELECT DISTINCT src, ref FROM g_inc WHERE ref IS NOT NULL),
g_found AS (SELECT p.src, p.ref, s.repo AS source_repo, s.local_id AS source, t.repo AS target_repo, t.local_id AS target FROM g_pairs p JOIN g_files s ON s.path = p.src LEFT JOIN g_files t ON t.path = p.ref)"""

PREFIX = f"""
WITH RECURSIVE g_nodes AS (
  SELECT 'region' AS repo, 0 AS ord, 'r' || r_regionkey AS local_id, r_name AS label, CAST(NULL AS VARCHAR) AS source_file, CAST(NULL AS BIGINT) AS community FROM region
  UNION ALL SELECT 'nation', 1, 'n' || n_nationkey, n_name, NULL, n_regionkey FROM nation
  UNION ALL SELECT 'customer', 2, 'c' || c_custkey, c_name, 'segment/' || c_mktsegment, c_nationkey FROM customer
  UNION ALL SELECT 'supplier', 3, 's' || s_suppkey, s_name, NULL, s_nationkey FROM supplier
  UNION ALL SELECT 'part', 4, 'p' || p_partkey, p_name, 'type/' || p_type || '/' || p_brand, CAST(substr(p_brand, 7) AS BIGINT) FROM part
  UNION ALL SELECT 'orders', 5, 'o' || o_orderkey, o_orderpriority, NULL, month(o_orderdate) FROM orders),
g_edges AS (
  SELECT 'customer' AS source_repo, 'c' || c_custkey AS source, 'nation' AS target_repo, 'n' || c_nationkey AS target, 'in_nation' AS relation, 'EXTRACTED' AS confidence FROM customer
  UNION ALL SELECT 'supplier', 's' || s_suppkey, 'nation', 'n' || s_nationkey, 'in_nation', 'EXTRACTED' FROM supplier
  UNION ALL SELECT 'nation', 'n' || n_nationkey, 'region', 'r' || n_regionkey, 'in_region', 'EXTRACTED' FROM nation
  UNION ALL SELECT 'orders', 'o' || o_orderkey, 'customer', 'c' || o_custkey, 'placed_by', 'EXTRACTED' FROM orders
  UNION ALL SELECT DISTINCT 'orders', 'o' || l_orderkey, 'part', 'p' || l_partkey, 'contains', 'INFERRED' FROM lineitem
  UNION ALL SELECT DISTINCT 'part', 'p' || l_partkey, 'supplier', 's' || l_suppkey, 'supplied_by', 'AMBIGUOUS' FROM lineitem),
g_line AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem),
g_co AS (SELECT x.l_partkey AS a, y.l_partkey AS b, count(*) AS w FROM g_line x JOIN g_line y ON x.l_orderkey = y.l_orderkey AND x.l_partkey < y.l_partkey GROUP BY 1, 2),
g_both AS (SELECT a AS u, b AS v, w FROM g_co UNION ALL SELECT b, a, w FROM g_co),
g_odd AS (SELECT source_repo, source, target_repo, target FROM g_edges UNION ALL (VALUES {", ".join(str(r) for r in ODD_EDGES)})),
g_parts AS (SELECT p_partkey AS node, CAST(substr(p_brand, 7) AS BIGINT) AS community, p_name AS label, 'type/' || p_type || '/' || p_brand AS source_file,
  CASE WHEN p_partkey % 4 = 0 THEN (CAST(substr(p_brand, 7) AS BIGINT) + 1) % 25 ELSE CAST(substr(p_brand, 7) AS BIGINT) END AS reclustered,
  CAST(substr(p_brand, 7) AS BIGINT) // 3 AS merged FROM part),
g_degree AS (SELECT node, count(*) AS degree FROM (SELECT a AS node FROM g_co UNION ALL SELECT b FROM g_co) GROUP BY node),
g_top AS (SELECT community, rank, node FROM (SELECT community, node, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, node) AS rank
  FROM g_parts LEFT JOIN g_degree USING (node)) WHERE rank <= 15),
g_named AS (SELECT DISTINCT 'part' AS repo, community, 'Brand family ' || community AS name FROM g_parts UNION ALL SELECT 'customer', n_nationkey, n_name FROM nation),
g_refs AS (SELECT page_id, src, i - 1 AS pos, list[i] AS href, regexp_replace(replace(list[i], '\\', '/'), '^[./]+', '') AS ref
  FROM (SELECT page_id, regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS src, regexp_extract_all(html, 'href="([^"]*)"', 1) AS list, unnest(range(1, len(regexp_extract_all(html, 'href="([^"]*)"', 1)) + 1)) AS i FROM pages))
"""
