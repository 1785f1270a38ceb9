"""One query per operator over the driver tables, each with its SQL counterpart for DuckDB."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import sinks
from ..functions import refs as R
from ..functions import text as X
from ..operators import analytics, assemble, corpus, extract, identity, labels, quality, refs, relabel, savings, select, traversal
from ..scratch import Scratch
from ..sources import documents, files
from ..streaming.ingest import ingest
from . import views as V

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, prefix: bool = True) -> Callable[[Query], Query]:
    """Registers a query under its name. Whole numbers are returned as long."""
    def register(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            df = f(spark, d)
            return df.select([F.col(c.name).cast("long").alias(c.name) if isinstance(c.dataType, T.IntegerType) else F.col(c.name) for c in df.schema])

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE_SQL[f.__name__] = (V.PREFIX if prefix else "") + sql
        return run

    return register


STOPS = ", ".join(f"'{w}'" for w in X.STOP_WORDS)


def tokens_sql(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda t: length(t) >= 3 AND t NOT IN ({STOPS}))"


def estimate_sql(text: str) -> str:
    return rf"CAST(len(regexp_extract_all({text}, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS BIGINT)"


@query("SELECT 'edges' AS name, count(*) AS n FROM g_edges UNION ALL SELECT 'co_edges', count(*) FROM g_co UNION ALL SELECT 'adjacency', count(*) FROM (SELECT DISTINCT source, target, relation, 'out' FROM g_edges UNION SELECT DISTINCT target, source, relation, 'in' FROM g_edges)")
def graph_store(s, d):
    """What lookups read: the edges, the parts' common orders, and the edges by either end, written once a session."""
    return V.store(s, d)


# ---- scans and projections ------------------------------------------------------------------------------------------------------


@query("SELECT repo AS name, ord, count(community) > 0 AS labelled, CASE WHEN repo = 'region' THEN 'semantic' ELSE 'code' END AS kind FROM g_nodes GROUP BY 1, 2 HAVING count(community) > 0 OR repo = 'region'")
def chunk_select(s, d):
    chunks = V.nodes(s, d).groupBy(F.col("repo").alias("name"), "ord").agg((F.count("community") > 0).alias("labelled")).withColumn("kind", F.when(F.col("name") == "region", "semantic").otherwise("code"))
    return select.select_chunks(chunks, skip_added=True)


@query("SELECT repo, local_id, coalesce(nullif(CASE WHEN community % 2 = 0 THEN label ELSE '' END, ''), nullif(source_file, ''), '') AS path FROM g_nodes")
def coalesce_path(s, d):
    path = F.when(F.col("community") % 2 == 0, F.col("label")).otherwise("")
    return V.nodes(s, d).select("repo", "local_id", X.first_filled(path, "source_file").alias("path"))


@query("SELECT DISTINCT repo, community, name FROM (SELECT repo, community, CASE WHEN community % 3 = 0 THEN repo || ' / Community ' || community ELSE name END AS name FROM g_named) WHERE name <> '' AND NOT contains(name, 'Community ')")
def curated_filter(s, d):
    name = F.when(F.col("community") % 3 == 0, F.concat(F.col("repo"), F.lit(" / Community "), F.col("community").cast("string"))).otherwise(F.col("name"))
    return V.named(s, d).select("repo", "community", name.alias("name")).where(X.is_curated("name")).distinct()


@query(r"""SELECT page_id, lower(regexp_replace(path, '[^A-Za-z0-9]', '_', 'g')) AS with_ext, lower(regexp_replace(regexp_replace(path, '([^/])\.[^./]+$', '\1'), '[^A-Za-z0-9]', '_', 'g')) AS without_ext,
lower(regexp_extract(path, '[^/]+(\.[^./]+)$', 1)) AS ext FROM (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path FROM pages)""", prefix=False)
def normalize_id(s, d):
    path = V.read(s, d, "pages").select("page_id", F.regexp_extract("url", "://([^?#]*)", 1).alias("path"))
    return path.select("page_id", X.normalised_id("path").alias("with_ext"), X.normalised_id(X.without_extension("path")).alias("without_ext"), X.extension("path").alias("ext"))


@query("SELECT repo, community, i AS position, parts[i] AS name FROM (SELECT repo, community, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT DISTINCT split_part(k, ':', 1) AS repo, split_part(k, ':', 2) AS community, string_split(n, ' / ') AS parts FROM (SELECT p_brand || ':' || p_size AS k, p_brand || ' / ' || p_type AS n FROM part)))", prefix=False)
def split_names(s, d):
    key = F.split("k", ":", 2)
    rows = V.read(s, d, "part").select(F.expr("concat(p_brand, ':', p_size)").alias("k"), F.expr("concat(p_brand, ' / ', p_type)").alias("n")).distinct()
    return rows.select(key[0].alias("repo"), key[1].alias("community"), F.posexplode(X.names_of("n")).alias("p", "name")).select("repo", "community", (F.col("p") + 1).cast("long").alias("position"), "name")


@query("SELECT doc_id, lang, source, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS k FROM documents) WHERE k = 1", prefix=False)
def first_wins_dedup(s, d):
    return select.first_wins(V.read(s, d, "documents").select("doc_id", "text", "lang", "source"), ["text"], ["doc_id"])


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", prefix=False)
def unclaimed_files(s, d):
    return select.unclaimed(V.read(s, d, "documents").select("doc_id", "source"), V.read(s, d, "labels"), "doc_id")


PAGE_PATH = "regexp_extract(url, '://[^/]*/([^?#]*)', 1)"
REASONS = "CASE " + " ".join(f"WHEN path = '{p}' OR starts_with(path, '{p}/') THEN '{r}'" for p, r in V.PAGE_RULES) + " END"


@query(f"SELECT reason, count(*) AS n FROM (SELECT {REASONS} AS reason FROM (SELECT {PAGE_PATH} AS path FROM pages)) GROUP BY reason", prefix=False)
def prefix_reason(s, d):
    path = V.read(s, d, "pages").select(F.regexp_extract("url", "://[^/]*/([^?#]*)", 1).alias("path"))
    return path.groupBy(select.first_reason("path", V.PAGE_RULES).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT page_id, pos, href, CASE " + " ".join(f"WHEN starts_with(ref, '{p}') THEN 'root-{p}' || substr(ref, 3)" for p in V.LANGUAGES) + " END AS target FROM g_refs")
def prefix_join(s, d):
    return V.refs(s, d).select("page_id", F.col("pos").cast("long").alias("pos"), "href", R.rooted("ref", [(p, f"root-{p}") for p in V.LANGUAGES]).alias("target"))


@query("SELECT doc_id, source, (row_number() OVER (ORDER BY source, doc_id) - 1) // 20 + 1 AS chunk FROM documents", prefix=False)
def pack_chunks(s, d):
    return select.packed(V.read(s, d, "documents").select("doc_id", "source"), "source", "doc_id")


# ---- text -----------------------------------------------------------------------------------------------------------------------


@query(f"SELECT doc_id, {estimate_sql('text')} AS tokens FROM documents", prefix=False)
def token_estimate(s, d):
    return V.read(s, d, "documents").select("doc_id", X.token_estimate("text").alias("tokens"))


@query(r"SELECT doc_id, CAST(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM documents", prefix=False)
def word_count(s, d):
    return V.read(s, d, "documents").select("doc_id", X.word_count("text").alias("words"))


@query(f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS tokens FROM documents", prefix=False)
def name_tokens(s, d):
    return V.read(s, d, "documents").select("doc_id", F.array_join(X.name_tokens("text"), " ").alias("tokens"))


BAGS = f"bags AS (SELECT source, token, count(*) AS tf FROM (SELECT source, unnest({tokens_sql('text')}) AS token FROM documents) GROUP BY 1, 2)"


def bags_of(s, d):
    return relabel.token_bags(V.read(s, d, "documents"), "source", "text")


@query(f"WITH {BAGS} SELECT * FROM bags", prefix=False)
def token_bags(s, d):
    return bags_of(s, d)


@query(f"WITH {BAGS} SELECT token, count(*) AS df FROM bags GROUP BY token", prefix=False)
def doc_freq(s, d):
    return relabel.doc_freq(bags_of(s, d))


@query(f"""WITH {BAGS}, totals AS (SELECT source, sum(tf) AS total FROM bags GROUP BY source), df AS (SELECT token, count(*) AS df FROM bags GROUP BY token),
asked AS (SELECT id, token, count(*) AS times FROM (SELECT item_id AS id, unnest({tokens_sql('text')}) AS token FROM benchmark) GROUP BY 1, 2),
scores AS (SELECT id, source, sum(CAST(times * (CAST(tf AS DOUBLE) / CAST(total AS DOUBLE) * ln(CAST((SELECT count(*) FROM totals) AS DOUBLE) / (1 + df))) AS DECIMAL(28,12))) AS score
  FROM asked JOIN bags USING (token) JOIN df USING (token) JOIN totals USING (source) GROUP BY 1, 2),
best AS (SELECT id, source AS proposed, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, source) AS k FROM scores WHERE score > 0) WHERE k = 1),
out AS (SELECT item_id AS id, 'src' || item_id % 20 AS original, proposed, score FROM benchmark LEFT JOIN best ON id = item_id)
SELECT id, proposed, CAST(floor(score * 1000000000) AS BIGINT) AS score, proposed IS DISTINCT FROM original AS changed,
  proposed IS NULL OR count(*) OVER (PARTITION BY proposed) > 1 AS ambiguous FROM out""", prefix=False)
def tfidf_propose(s, d):
    names = V.read(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("name"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("original"))
    return relabel.propose(names, Scratch(s, "bags").save(bags_of(s, d)), "source")


@query("SELECT signature, count(*) AS n FROM (SELECT DISTINCT p_name, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(p_name), '[a-z]{4,}'))), ' ') AS signature FROM part) GROUP BY 1 HAVING count(*) > 1", prefix=False)
def near_duplicate_names(s, d):
    return quality.near_duplicate_names(V.read(s, d, "part"), "p_name")


AUDITED = "audited AS (SELECT item_id % 30 AS community, CASE WHEN item_id % 3 = 0 THEN text ELSE (SELECT min(label) FROM g_parts WHERE g_parts.community = (item_id * 7) % 25 + 1) END AS name FROM benchmark)"


def audited_names(s, d):
    """A name for every benchmark item: its whole text, or a part's name of another community."""
    first = V.parts(s, d).groupBy("community").agg(F.min("label").alias("label"))
    items = V.read(s, d, "benchmark").withColumn("other", (F.col("item_id") * 7) % 25 + 1)
    name = F.when(F.col("item_id") % 3 == 0, F.col("text")).otherwise(F.col("label"))
    return items.join(first, F.col("other") == F.col("community"), "left").select((F.col("item_id") % 30).alias("community"), name.alias("name"))


@query(f""", {AUDITED}, blobs AS (SELECT community, lower(string_agg(source_file || ' ' || label, ' ')) AS blob, count(*) AS size FROM g_parts GROUP BY 1),
hits AS (SELECT DISTINCT a.community, name, coalesce(size, 0) AS size, CASE WHEN size IS NULL THEN '{relabel.ABSENT}' END AS note,
  list_filter({tokens_sql("coalesce(name, '')")}, lambda t: contains(coalesce(blob, ''), t)) AS found FROM audited a LEFT JOIN blobs USING (community)),
firsts AS (SELECT *, list_filter(found, lambda t, i: list_position(found, t) = i) AS distinct_found FROM hits)
SELECT community, name, size, array_to_string(distinct_found, ' ') AS matched_tokens, len(found) > 0 AS matched, note, (SELECT 4 * count(*) FILTER (WHERE len(found) = 0) > count(*) FROM hits) AS stale FROM firsts""")
def label_audit(s, d):
    return relabel.audit(V.parts(s, d).withColumn("repo_path", F.lit(None).cast("string")), audited_names(s, d))


@query(f""", {AUDITED}, p AS (SELECT DISTINCT community AS proposed FROM audited WHERE community % 2 = 0)
SELECT proposed, string_agg(part, ',' ORDER BY k) AS members FROM (SELECT community AS proposed, split_part('part_p' || node, '_', 2) AS part, row_number() OVER (PARTITION BY community ORDER BY node) AS k FROM g_parts JOIN p ON community = proposed) WHERE k <= 5 GROUP BY 1""")
def proposal_samples(s, d):
    wanted = audited_names(s, d).where("community % 2 = 0").select(F.col("community").alias("proposed"))
    members = V.parts(s, d).select("community", F.concat(F.lit("part_p"), F.col("node").cast("string")).alias("node"), F.col("node").alias("position"))
    return relabel.samples(members, wanted)


@query("SELECT community, array_to_string(list_sort(list(DISTINCT source_file))[1:4], ',') AS files FROM g_parts GROUP BY community")
def audit_files(s, d):
    return relabel.first_files(V.parts(s, d).withColumn("repo_path", F.lit(None).cast("string")))


# ---- references -----------------------------------------------------------------------------------------------------------------


@query("SELECT page_id, pos, href, ref FROM g_refs")
def ref_normalise(s, d):
    return V.refs(s, d).select("page_id", "pos", "href", "ref")


def resolved_refs(s, d):
    hubs = V.read(s, d, "pages").select(F.regexp_extract("url", "://[^/]*/([^/?#]*)", 1).alias("ref")).distinct()
    return refs.resolve(V.refs(s, d), hubs.select(F.col("ref").alias("src"), F.concat(F.lit("hub_"), "ref").alias("source")), hubs.select("ref", F.concat(F.lit("hub_"), "ref").alias("target")))


RESOLVED = "hubs AS (SELECT DISTINCT regexp_extract(url, '://[^/]*/([^/?#]*)', 1) AS hub FROM pages), resolved AS (SELECT page_id, pos, src, ref, 'hub_' || s.hub AS source, 'hub_' || t.hub AS target FROM g_refs JOIN hubs s ON s.hub = src LEFT JOIN hubs t ON t.hub = ref)"


@query(f", {RESOLVED} SELECT page_id, pos, ref, source, target FROM resolved")
def ref_resolution(s, d):
    return resolved_refs(s, d).select("page_id", "pos", "ref", "source", "target")


ROOTS = ["a", "an", "d", "de", "e", "en", "er"]
BLAMED = "CASE " + " ".join(f"WHEN starts_with(ref, '{r}') THEN '{r}'" for r in sorted(ROOTS, key=len, reverse=True)) + " ELSE '?' END"


@query(f", {RESOLVED} SELECT root, count(*) AS n FROM (SELECT DISTINCT src, ref, {BLAMED} AS root FROM resolved WHERE target IS NULL) GROUP BY root")
def ref_unresolved_by_root(s, d):
    return refs.unresolved_by_root(resolved_refs(s, d), ROOTS)


MATCHED = "ref IN (" + ", ".join(f"'{p}'" for p in V.LANGUAGES) + ")"


@query(f""", t AS (SELECT ref, {MATCHED} AS matched, CASE WHEN strpos(ref, '/') > 0 THEN split_part(ref, '/', 1) || '/' WHEN starts_with(href, '/') THEN '{R.SYSTEM}' ELSE '{R.SAME_DIRECTORY}' END AS bucket FROM g_refs)
SELECT 'total' AS metric, '' AS key, count(*) AS n FROM t UNION ALL SELECT 'matched', '', count(*) FILTER (WHERE matched) FROM t
UNION ALL (SELECT 'bucket', bucket, count(*) AS n FROM t WHERE NOT matched GROUP BY bucket ORDER BY n DESC, bucket LIMIT 10)""")
def ref_tally(s, d):
    rows = V.refs(s, d).withColumn("matched", F.col("ref").isin(V.LANGUAGES)).withColumn("bucket", R.unmatched_bucket("ref", F.startswith("href", F.lit("/"))))
    return refs.tally(rows)


@query("SELECT source_file AS path, arg_min(local_id, length(local_id) * 1000000000000 + CAST(substr(local_id, 2) AS BIGINT)) AS id FROM g_nodes WHERE source_file IS NOT NULL GROUP BY 1")
def path_index(s, d):
    return refs.path_index(V.nodes(s, d).withColumnRenamed("source_file", "path"), "path", "local_id")


@query("SELECT DISTINCT source_repo, source, target_repo, target FROM g_edges WHERE source_repo <> target_repo")
def cross_edges(s, d):
    parts = V.co_edges(s, d).select(F.lit("part").alias("source_repo"), F.concat(F.lit("p"), "a").alias("source"), F.lit("part").alias("target_repo"), F.concat(F.lit("p"), "b").alias("target"))
    return refs.cross_edges(V.edges(s, d).select("source_repo", "source", "target_repo", "target").union(parts))


OWNED = "owned AS (SELECT e.*, s.repo AS so, t.repo AS t_o FROM g_odd e LEFT JOIN g_nodes s ON s.repo = source_repo AND s.local_id = source LEFT JOIN g_nodes t ON t.repo = target_repo AND t.local_id = target)"


@query(f", {OWNED} SELECT count(*) AS n_edges, count(*) FILTER (WHERE so IS DISTINCT FROM t_o OR so IS NULL AND t_o IS NOT NULL) AS n_cross FROM owned")
def cross_recount(s, d):
    return quality.cross_recount(V.odd_edges(s, d), V.nodes(s, d))


# ---- assembly -------------------------------------------------------------------------------------------------------------------


MERGED = """merged AS (SELECT repo, repo || '::' || local_id AS id, local_id, ord * 1000000 + community AS community, repo || ':' || community AS community_key,
  CASE WHEN community IS NOT NULL THEN coalesce(name, repo || ' / Community ' || community) END AS community_name FROM g_nodes LEFT JOIN g_named USING (repo, community))"""


def merged(s, d):
    return assemble.merged_nodes(V.nodes(s, d), V.named(s, d))


@query(f", {MERGED} SELECT repo, id, local_id, community, community_key, community_name FROM merged")
def merged_nodes(s, d):
    return merged(s, d).select("repo", "id", "local_id", "community", "community_key", "community_name")


@query("SELECT source_repo || '::' || source AS source, target_repo || '::' || target AS target, relation, confidence FROM g_edges UNION ALL SELECT 'part::p' || a, 'part::p' || b, 'ordered_with', 'INFERRED' FROM g_co")
def merged_edges(s, d):
    parts = V.co_edges(s, d).select(F.lit("part").alias("source_repo"), F.concat(F.lit("p"), "a").alias("source"), F.lit("part").alias("target_repo"), F.concat(F.lit("p"), "b").alias("target"), F.lit("ordered_with").alias("relation"), F.lit("INFERRED").alias("confidence"))
    return assemble.merged_edges(assemble.union_all([V.edges(s, d), parts])).select("source", "target", "relation", "confidence")


def hyperedges(s, d):
    rows = V.read(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    grouped = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("p"), "l_partkey"))).alias("nodes")).where("size(nodes) >= 3")
    return assemble.merged_hyperedges(grouped.select(F.lit("orders").alias("repo"), F.concat(F.lit("h"), "l_orderkey").alias("id"), "nodes"))


@query("SELECT 'orders::h' || l_orderkey AS id, string_agg('part::p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS nodes FROM g_line GROUP BY l_orderkey HAVING count(*) >= 3")
def hyperedge_namespacing(s, d):
    return hyperedges(s, d).select("id", F.array_join(F.transform("nodes", lambda n: F.regexp_replace(n, "^orders::", "part::")), ",").alias("nodes"))


@query("SELECT 'orders::h' || l_orderkey AS id, 'orders::p' || l_partkey AS node FROM g_line WHERE l_orderkey IN (SELECT l_orderkey FROM g_line GROUP BY 1 HAVING count(*) >= 3)")
def hyperedge_incidence(s, d):
    return assemble.incidence(hyperedges(s, d))


@query("SELECT repo, community, count(*) AS n FROM g_nodes WHERE community IS NOT NULL GROUP BY 1, 2")
def community_sizes(s, d):
    return V.nodes(s, d).where("community IS NOT NULL").groupBy("repo", "community").agg(F.count("*").alias("n"))


@query("SELECT repo, count(*) AS n FROM g_nodes GROUP BY 1")
def nodes_per_repo(s, d):
    return V.nodes(s, d).groupBy("repo").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "repo")


@query("SELECT count(*) AS nodes, count(DISTINCT repo || ':' || community) AS communities, count(DISTINCT repo) AS repos, (SELECT count(*) FROM g_edges) AS edges FROM g_nodes")
def graph_summary(s, d):
    return assemble.graph_summary(V.nodes(s, d), V.edges(s, d))


# ---- names ----------------------------------------------------------------------------------------------------------------------


def degrees(s, d):
    return labels.node_degree(V.co_edges(s, d), "a", "b")


@query("SELECT node, degree FROM g_degree")
def node_degree(s, d):
    return degrees(s, d)


@query("SELECT community, rank, node FROM g_top")
def top_anchors(s, d):
    return labels.top_anchors(V.parts(s, d), degrees(s, d))


def anchored(s, d):
    """entry, label, node: the top anchors of each brand, named after it."""
    top = labels.top_anchors(V.parts(s, d), degrees(s, d))
    return top.select(F.col("community").alias("entry"), F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("label"), "node")


def claimed(s, d, clustering="reclustered"):
    return labels.claims(anchored(s, d), V.parts(s, d).select("node", F.col(clustering).alias("community")))


def claims_sql(clustering: str) -> str:
    return f"""sizes AS (SELECT community AS entry, count(*) AS n FROM g_top GROUP BY 1),
hits AS (SELECT t.community AS entry, p.{clustering} AS community, count(*) AS hit FROM g_top t JOIN g_parts p USING (node) GROUP BY 1, 2),
best AS (SELECT entry, community, hit FROM (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY hit DESC, community) AS k FROM hits) WHERE k = 1),
claims AS (SELECT entry, 'Brand family ' || entry AS label, n, community, hit, 5 * hit >= 2 * n AND hit >= least(4, n) AS placed FROM sizes JOIN best USING (entry)),
attached AS (SELECT community, string_agg(label, ' / ' ORDER BY k) AS name FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY CAST(hit AS DOUBLE) / n DESC, entry) AS k FROM claims WHERE placed) WHERE k <= 2 GROUP BY community)"""


@query(f", {claims_sql('reclustered')} SELECT community, name FROM attached")
def anchor_attach(s, d):
    return labels.attach(claimed(s, d))


@query(f", {claims_sql('merged')} SELECT community, name FROM attached")
def anchor_attach_merged(s, d):
    return labels.attach(claimed(s, d, "merged"))


@query(f""", {claims_sql('reclustered')} SELECT 'anchor' AS mode, CAST(0.4 AS DOUBLE) AS threshold, count(*) FILTER (WHERE placed) AS labels_placed, count(*) FILTER (WHERE NOT placed) AS labels_dropped, count(*) + 2 AS available,
(SELECT count(DISTINCT community) FROM claims WHERE placed) AS matched, (SELECT count(*) FROM (SELECT community FROM claims WHERE placed GROUP BY 1 HAVING count(*) > 1)) AS merged_communities FROM claims""")
def attach_stats(s, d):
    entries = anchored(s, d).select("entry").distinct().union(s.range(2).select(F.col("id") + 1000))  # two entries without anchors
    return labels.attach_stats(claimed(s, d), entries)


@query("SELECT DISTINCT repo, community, name FROM g_nodes JOIN g_named USING (repo, community)")
def label_by_id(s, d):
    return labels.attach_by_id(V.nodes(s, d), V.named(s, d))


def preserved(s, d):
    old = labels.top_anchors(V.parts(s, d), degrees(s, d)).groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("anchors"))
    old = old.select(F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("label"), "anchors")
    members = V.parts(s, d).select("node", F.col("reclustered").alias("community"))
    return labels.preserve(old, labels.attach(claimed(s, d)), labels.top_anchors(members, degrees(s, d)))


@query(f""", {claims_sql('reclustered')}, new AS (SELECT community, unnest(string_split(name, ' / ')) AS label FROM attached),
old AS (SELECT 'Brand family ' || community AS label, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS anchors FROM g_top GROUP BY community),
retop AS (SELECT community, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS anchors FROM (SELECT reclustered AS community, node, row_number() OVER (PARTITION BY reclustered ORDER BY coalesce(degree, 0) DESC, node) AS rank FROM g_parts LEFT JOIN g_degree USING (node)) WHERE rank <= 15 GROUP BY community)
SELECT label, 'kept' AS kind, anchors FROM old WHERE label NOT IN (SELECT label FROM new) UNION ALL SELECT label, 'new', anchors FROM new JOIN retop USING (community)""")
def anchor_preserve(s, d):
    return preserved(s, d)


@query(f""", {MERGED}, last AS (SELECT repo, community, community_name AS name FROM (SELECT m.*, row_number() OVER (PARTITION BY repo, community ORDER BY CAST(substr(local_id, 2) AS BIGINT) DESC) AS k FROM merged m
  WHERE community IS NOT NULL AND community_name <> '' AND NOT contains(community_name, 'Community ')) WHERE k = 1)
SELECT r.repo, community, name FROM (SELECT DISTINCT repo FROM g_nodes) r LEFT JOIN last USING (repo)""")
def label_sync(s, d):
    rows = merged(s, d).withColumn("position", F.expr("cast(substr(local_id, 2) as bigint)"))
    return labels.sync(rows, V.nodes(s, d).select("repo").distinct())


@query(f""", {claims_sql('reclustered')} SELECT 'part' AS repo, label AS name FROM (SELECT DISTINCT 'Brand family ' || community AS label FROM g_parts WHERE community % 4 > 0 UNION SELECT 'Brand family ' || (community + 20) FROM g_parts) WHERE label NOT IN (SELECT unnest(string_split(name, ' / ')) FROM attached)""")
def missing_names(s, d):
    brand = V.parts(s, d).select("community").distinct()
    wanted = brand.where("community % 4 > 0").union(brand.select(F.col("community") + 20)).select(F.lit("part").alias("repo"), F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("name"))
    attached = labels.attach(claimed(s, d)).select(F.lit("part").alias("repo"), "name")
    return labels.missing_names(wanted, attached, V.nodes(s, d))


ANCHORED = "anchored AS (SELECT 'part' AS repo, 'Brand family ' || community AS label FROM g_top UNION ALL SELECT 'customer', 'Brand family ' || community FROM g_top WHERE community % 2 = 0)"


def anchor_rows(s, d):
    """repo, label of two anchor files, which share some labels."""
    top = labels.top_anchors(V.parts(s, d), degrees(s, d)).select("community", F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("label"))
    return top.select(F.lit("part").alias("repo"), "label").union(top.where("community % 2 = 0").select(F.lit("customer"), "label"))


RETAINED = "retained AS (SELECT (SELECT count(DISTINCT community_name) FROM merged WHERE community_name <> '' AND NOT contains(community_name, 'Community ')) AS attached, (SELECT count(*) FROM (SELECT DISTINCT repo, label FROM anchored)) AS anchored)"


@query(f", {MERGED}, {ANCHORED}, {RETAINED} SELECT attached, anchored, 2 * attached >= anchored AS ok FROM retained")
def label_retention(s, d):
    return labels.retention(merged(s, d), anchor_rows(s, d))


@query(f", {MERGED} SELECT count(*) FILTER (WHERE c) AS named_nodes, count(DISTINCT CASE WHEN c THEN community_name END) AS distinct_names FROM (SELECT community_name, coalesce(community_name <> '' AND NOT contains(community_name, 'Community '), false) AS c FROM merged)")
def named_coverage(s, d):
    return quality.named_coverage(merged(s, d))


# ---- digests --------------------------------------------------------------------------------------------------------------------


@query("SELECT repo, community, count(*) AS size FROM g_nodes WHERE community IS NOT NULL GROUP BY 1, 2 ORDER BY size DESC, repo, community LIMIT 40")
def digest_top_communities(s, d):
    return relabel.top_communities(V.nodes(s, d))


@query("SELECT community, rank, node, label FROM (SELECT community, node, label, row_number() OVER (PARTITION BY community ORDER BY coalesce(degree, 0) DESC, node) AS rank FROM g_parts LEFT JOIN g_degree USING (node)) WHERE rank <= 12 AND trim(label) <> ''")
def digest_symbols(s, d):
    return relabel.top_symbols(V.parts(s, d).select("community", "node", "label"), degrees(s, d))


@query("SELECT community, rank, file, n FROM (SELECT community, source_file AS file, count(*) AS n, row_number() OVER (PARTITION BY community ORDER BY count(*) DESC, source_file) AS rank FROM g_parts GROUP BY 1, 2) WHERE rank <= 10")
def digest_files(s, d):
    return relabel.top_files(V.parts(s, d))


# ---- quality --------------------------------------------------------------------------------------------------------------------


@query(f", {OWNED} SELECT DISTINCT source_repo, source, target_repo, target FROM owned WHERE so IS NULL OR t_o IS NULL")
def dangling_edges(s, d):
    return quality.dangling_edges(V.odd_edges(s, d), V.nodes(s, d))


@query("SELECT community, count(DISTINCT repo) AS n_repos FROM g_nodes WHERE community IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo) > 1")
def community_spans(s, d):
    return quality.community_spans(V.nodes(s, d))


@query(f""", {OWNED}, k AS (SELECT *, source_repo || ':' || source AS s, target_repo || ':' || target AS t FROM owned)
SELECT count(*) AS edges, count(*) FILTER (WHERE source IS NULL OR target IS NULL) AS missing_endpoint, count(*) FILTER (WHERE so IS NULL OR t_o IS NULL) AS dangling, count(*) FILTER (WHERE s = t) AS self_loops,
count(*) - count(DISTINCT s || '>' || t) AS directed_duplicates, count(*) - count(DISTINCT least(s, t) || '>' || greatest(s, t)) AS undirected_duplicates FROM k""")
def graph_health(s, d):
    return quality.graph_health(V.odd_edges(s, d), V.nodes(s, d))


INCLUDE_STATS = """i_stats AS (SELECT (SELECT count(*) FROM g_inc) AS total_includes, (SELECT count(ref) FROM g_inc) - (SELECT count(*) FROM g_found WHERE target IS NULL) AS resolved_includes,
  (SELECT count(*) FROM g_found WHERE target IS NULL) AS unresolved_includes, (SELECT count(*) FROM g_inc WHERE ref IS NULL) AS ignored, (SELECT count(DISTINCT src) FROM g_inc) AS files_scanned,
  (SELECT count(*) FROM (SELECT DISTINCT source_repo, source, target_repo, target FROM g_found WHERE source_repo <> target_repo)) AS cross_module_edges,
  (SELECT count(*) FROM g_found WHERE source_repo = target_repo) AS intra_module_includes_skipped, (SELECT count(*) FROM g_files) AS indexed_files,
  (SELECT count(*) FROM g_inc JOIN g_files s ON s.path = src JOIN g_files t ON t.path = ref) AS resolved_directives)"""


def include_rows(s, d):
    return files.scan_includes(V.source_files(s, d), V.INCLUDE_ROOTS)


def include_index(s, d):
    return V.source_files(s, d).select("repo", "path", F.col("local_id").alias("id"))


@query(f"WITH {V.INCLUDES} SELECT src, ref, bucket FROM g_inc", prefix=False)
def include_scan(s, d):
    return include_rows(s, d)


@query(f"WITH {V.INCLUDES} SELECT source_repo, source, target_repo, target, min(src) AS source_file, 'includes' AS relation, 'cross_module_include' AS context, 'EXTRACTED' AS confidence, 1.0::DOUBLE AS confidence_score, 1.0::DOUBLE AS weight, 'cross_link' AS origin FROM g_found WHERE source_repo <> target_repo GROUP BY ALL", prefix=False)
def link(s, d):
    return refs.link(include_rows(s, d), include_index(s, d))[0]


@query(f"WITH {V.INCLUDES}, {INCLUDE_STATS} SELECT * FROM i_stats", prefix=False)
def link_stats(s, d):
    return refs.link(include_rows(s, d), include_index(s, d))[1]


@query(f"""WITH {V.INCLUDES} SELECT 'unresolved' AS kind, split_part(ref, '/', 1) AS key, count(*) AS n FROM g_found WHERE target IS NULL GROUP BY ALL
UNION ALL (SELECT 'ignored', bucket, count(*) FROM g_inc WHERE ref IS NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)""", prefix=False)
def link_missed(s, d):
    return refs.missed(include_rows(s, d), include_index(s, d), [r.rstrip("/") for _, r in V.INCLUDE_ROOTS])


@query(f"WITH {V.FILES} SELECT path, repo AS owner, local_id AS id FROM g_files WHERE doc_id % 5 > 0 OR n_chars > 1000", prefix=False)
def index_fallback(s, d):
    """The paths that nodes are indexed by: their own, or that of their chunk's root and file; upward ones have none."""
    rows = V.source_files(s, d).withColumn("own", F.col("doc_id") % 2 == 0)
    rows = rows.withColumn("repo_path", F.when(F.col("own"), F.col("path"))).withColumn("source_file", F.when((F.col("doc_id") % 5 == 0) & (F.col("n_chars") <= 1000), "../x.hpp").otherwise(F.regexp_replace("path", "^[^/]*/", "")))
    rows = rows.withColumn("repo_path", F.when((F.col("doc_id") % 5 > 0) | (F.col("n_chars") > 1000), F.col("repo_path")))
    return rows.select(refs.index_path(F.concat("repo", F.lit("/"))).alias("path"), F.col("repo").alias("owner"), F.col("local_id").alias("id")).where("path IS NOT NULL")


VERIFIED_NAMES = "SELECT 'part' AS repo, 'Brand family ' || community AS name FROM g_parts UNION SELECT 'part', 'Brand family ' || (community + 20) FROM g_parts"


@query(f""", {OWNED}, {MERGED}, {ANCHORED}, {RETAINED}, {V.INCLUDES}, {INCLUDE_STATS},
per AS (SELECT repo, count(*) AS n, count(*) FILTER (WHERE community_name <> '' AND NOT contains(community_name, 'Community ')) AS named FROM merged GROUP BY 1),
spans AS (SELECT community, min(community_key) AS key FROM merged WHERE community IS NOT NULL GROUP BY 1 HAVING count(DISTINCT repo) > 1),
gap AS (SELECT DISTINCT repo, name FROM ({VERIFIED_NAMES}) w WHERE NOT EXISTS (SELECT 1 FROM (SELECT repo AS r, unnest(string_split(community_name, ' / ')) AS part FROM (SELECT DISTINCT repo, community_name FROM merged WHERE community_name <> '' AND NOT contains(community_name, 'Community '))) h WHERE h.r = w.repo AND h.part = w.name)),
e AS (SELECT count(*) FILTER (WHERE so IS NULL OR t_o IS NULL) AS dangling, count(*) FILTER (WHERE so IS DISTINCT FROM t_o) AS crossing FROM owned),
c AS (SELECT 'no dangling edges' AS "check", dangling = 0 AS ok, 'error' AS severity, format('{{:,}} dangling', dangling) AS detail FROM e
UNION ALL SELECT 'cross-module edges present', crossing > 0, 'error', format('{{:,}} cross-module edges', crossing) FROM e
UNION ALL SELECT 'communities do not span chunks', count(*) = 0, 'error', count(*) || ' in several chunks' || CASE WHEN count(*) > 0 THEN ': ' || (SELECT string_agg(key, ', ' ORDER BY community) FROM (SELECT * FROM spans ORDER BY community LIMIT 5)) ELSE '' END FROM spans
UNION ALL SELECT 'curated labels attached', attached > 0, 'error', attached || ' names on ' || format('{{:,}}', (SELECT CAST(sum(named) AS BIGINT) FROM per)) || ' nodes' FROM retained
UNION ALL SELECT 'curated-name retention rate', 2 * attached >= anchored, 'error', attached || ' of ' || anchored || ' anchored names' FROM retained
UNION ALL SELECT 'all curated names attached', count(*) = 0, 'warn', CASE WHEN count(*) = 0 THEN 'none is missing' ELSE count(*) || ' missing: ' || 'part: ' || string_agg(name, ', ' ORDER BY name) END FROM gap
UNION ALL SELECT 'all built chunks merged', count(*) > 0, 'error', string_agg(repo || '=' || format('{{:,}}', n), ', ' ORDER BY n DESC, repo) FROM per
UNION ALL SELECT 'include recall computed', total_includes > 0, 'error', format('{{:,}} of {{:,}} references resolved (', resolved_includes, total_includes) || CAST(round_even(100.0::DOUBLE * resolved_includes / total_includes, 0) AS BIGINT) || '%)' FROM i_stats
UNION ALL SELECT 'docs present', sum(CASE WHEN repo = 'region' THEN n ELSE 0 END) > 0, 'error', CAST(sum(CASE WHEN repo = 'region' THEN n ELSE 0 END) AS BIGINT) || ' nodes' FROM per
UNION ALL SELECT 'xsd present', sum(CASE WHEN repo = 'xsd' THEN n ELSE 0 END) > 0, 'error', CAST(sum(CASE WHEN repo = 'xsd' THEN n ELSE 0 END) AS BIGINT) || ' nodes' FROM per)
SELECT "check", ok, severity, detail FROM c""")
def verify_summary(s, d):
    brand = V.parts(s, d).select("community").distinct()
    names = F.concat(F.lit("Brand family "), F.col("community").cast("string"))
    wanted = brand.union(brand.select(F.col("community") + 20)).select(F.lit("part").alias("repo"), names.alias("name"))
    stats = refs.link(include_rows(s, d), include_index(s, d))[1]
    return quality.verify(merged(s, d), V.odd_edges(s, d), anchor_rows(s, d), wanted, stats, {"docs present": "region", "xsd present": "xsd"})


@query(f""", {V.INCLUDES}, every AS (SELECT repo, ord, local_id, label, community FROM g_nodes UNION ALL SELECT repo, ord, local_id, path, NULL FROM g_files),
chunks AS (SELECT repo, row_number() OVER (ORDER BY min(ord), repo) - 1 AS k FROM every GROUP BY repo),
n AS (SELECT repo || '::' || local_id AS a, CASE WHEN community IS NULL THEN '' ELSE repo || ':' || community || ' ' || (k * 1000000 + community) END AS b, CASE WHEN community IS NULL THEN '' ELSE coalesce(name, repo || ' / Community ' || community) END AS c FROM every JOIN chunks USING (repo) LEFT JOIN g_named USING (repo, community)),
h AS (SELECT 'part::h' || l_orderkey AS id, string_agg('part::p' || l_partkey, ',' ORDER BY 'p' || l_partkey) AS nodes FROM g_line GROUP BY l_orderkey HAVING count(*) >= 3)
SELECT 'node' AS kind, a, b, c FROM n UNION ALL SELECT 'edge', source_repo || '::' || source, target_repo || '::' || target, relation || ' ' || confidence FROM g_edges
UNION ALL SELECT 'edge', source_repo || '::' || source, target_repo || '::' || target, 'includes EXTRACTED' FROM (SELECT DISTINCT source_repo, source, target_repo, target FROM g_found WHERE source_repo <> target_repo)
UNION ALL SELECT 'hyperedge', id, nodes, '' FROM h UNION ALL SELECT 'stats', 'cross_module_edges', (SELECT count(*) FROM (SELECT DISTINCT source_repo, source, target_repo, target FROM g_found WHERE source_repo <> target_repo)) || '', ''
UNION ALL SELECT 'chunks', (SELECT string_agg(repo, ',' ORDER BY repo) FROM chunks), '', ''""")
def merged_graph(s, d):
    """The whole merge: names, namespaces, hyperedges, links across chunks, stats and the chunk list, as rows."""
    files_ = V.source_files(s, d).select("repo", "ord", "local_id", F.col("path").alias("label"), F.col("path").alias("source_file"), F.lit(None).cast("long").alias("community"))
    rows = V.read(s, d, "lineitem").select("l_orderkey", "l_partkey").distinct()
    hyper = rows.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.concat(F.lit("p"), "l_partkey"))).alias("nodes")).where("size(nodes) >= 3")
    hyper = hyper.select(F.lit("part").alias("repo"), F.concat(F.lit("h"), "l_orderkey").alias("id"), "nodes")
    g = assemble.merge_graph(V.nodes(s, d).unionByName(files_), V.edges(s, d), hyper, V.named(s, d), include_rows(s, d), include_index(s, d))
    blank = F.lit("")
    community = F.coalesce(F.concat_ws(" ", F.col("community_key"), F.col("community").cast("string")), blank)
    return (
        g["nodes"].select(F.lit("node").alias("kind"), F.col("id").alias("a"), community.alias("b"), F.coalesce("community_name", blank).alias("c"))
        .union(g["edges"].select(F.lit("edge"), "source", "target", F.concat_ws(" ", "relation", "confidence")))
        .union(g["hyperedges"].select(F.lit("hyperedge"), "id", F.array_join("nodes", ","), blank))
        .union(g["stats"].select(F.lit("stats"), F.lit("cross_module_edges"), F.col("cross_module_edges").cast("string"), blank))
        .union(g["nodes"].select("repo").distinct().agg(F.array_join(F.array_sort(F.collect_list("repo")), ",")).select(F.lit("chunks"), "*", blank, blank))
    )


@query("SELECT local_id, min(repo) AS owner FROM (SELECT *, row_number() OVER (PARTITION BY local_id ORDER BY ord) AS k FROM (SELECT repo, ord, local_id FROM g_nodes UNION ALL SELECT 'again', 9, local_id FROM g_nodes WHERE repo = 'part')) WHERE k = 1 GROUP BY 1")
def id_owner(s, d):
    """The first chunk of each local id."""
    nodes = V.nodes(s, d).select("repo", "ord", "local_id")
    again = nodes.where("repo = 'part'").select(F.lit("again"), F.lit(9), "local_id")
    return select.first_wins(nodes.union(again), ["local_id"], ["ord", "repo"]).select("local_id", F.col("repo").alias("owner"))


# ---- graph ----------------------------------------------------------------------------------------------------------------------


@query("""SELECT a, b, relation, confidence FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY CASE confidence WHEN 'EXTRACTED' THEN 1 WHEN 'INFERRED' THEN 2 ELSE 3 END, relation) AS k FROM
(SELECT least(s, t) AS a, greatest(s, t) AS b, relation, confidence FROM (SELECT source_repo || '::' || source AS s, target_repo || '::' || target AS t, relation, confidence FROM g_edges UNION ALL
 SELECT target_repo || '::' || target, source_repo || '::' || source, 'zz_' || relation, 'AMBIGUOUS' FROM g_edges))) WHERE k = 1""")
def undirected_edges(s, d):
    rows = assemble.merged_edges(V.edges(s, d)).select("source", "target", "relation", "confidence")
    turned = F.struct(F.col("target").alias("source"), F.col("source").alias("target"), F.concat(F.lit("zz_"), "relation").alias("relation"), F.lit("AMBIGUOUS").alias("confidence"))
    # each edge beside its turned one, so a task that has one has both
    both = rows.select(F.explode(F.array(F.struct(*rows.columns), turned)).alias("x")).select("x.*")
    ids = V.nodes(s, d).select(assemble.qualified("repo", "local_id").alias("id"))
    return analytics.undirected(both, ids)


def _spread(i: int) -> str:
    return f"c{i} AS MATERIALIZED (SELECT v AS node, min(label) AS label FROM ce JOIN c{i - 1} ON u = node GROUP BY v)"


#: The graph's links lead from parts over orders, customers and nations to regions, so fewer steps than these reach everything.
COMPONENT_STEPS = 14


@query(f""", pairs AS (SELECT source_repo || '::' || source AS a, target_repo || '::' || target AS b FROM g_edges UNION ALL SELECT repo || '::' || local_id, repo || '::' || local_id FROM g_nodes WHERE repo IN ('customer', 'orders')),
ce AS MATERIALIZED (SELECT DISTINCT a AS u, b AS v FROM pairs UNION SELECT b, a FROM pairs UNION SELECT a, a FROM pairs UNION SELECT b, b FROM pairs),
c0 AS MATERIALIZED (SELECT DISTINCT u AS node, u AS label FROM ce), {', '.join(_spread(i) for i in range(1, COMPONENT_STEPS + 1))} SELECT node, label AS component FROM c{COMPONENT_STEPS}""")
def connected_components(s, d):
    rows = assemble.merged_edges(V.edges(s, d)).select(F.col("source").alias("a"), F.col("target").alias("b"))
    own = assemble.qualified("repo", "local_id")  # nodes without links are components of their own
    alone = V.nodes(s, d).where("repo IN ('customer', 'orders')").select(own.alias("a"), own.alias("b"))
    return analytics.components(rows.union(alone), Scratch(s, "components"))


def _round(i: int) -> str:
    return f"l{i} AS (SELECT u AS node, label FROM (SELECT u, label, row_number() OVER (PARTITION BY u ORDER BY sum(w) DESC, label) AS k FROM g_both JOIN l{i - 1} ON v = node GROUP BY u, label) WHERE k = 1)"


@query(f", l0 AS (SELECT DISTINCT u AS node, u AS label FROM g_both), {', '.join(_round(i) for i in (1, 2, 3))} SELECT node, label FROM l3")
def label_propagation(s, d):
    return analytics.label_propagation(V.co_edges(s, d), 3, Scratch(s, "propagation"))


@query("""SELECT community, CASE WHEN n = 1 THEN 1 ELSE coalesce(links, 0) END AS intra, CASE WHEN n = 1 THEN 1 ELSE n * (n - 1) // 2 END AS possible FROM (SELECT community, count(*) AS n FROM g_parts GROUP BY 1)
LEFT JOIN (SELECT x.community, count(*) AS links FROM g_co JOIN g_parts x ON x.node = a JOIN g_parts y ON y.node = b WHERE x.community = y.community GROUP BY 1) USING (community)""")
def cohesion(s, d):
    return analytics.cohesion(V.parts(s, d).select("node", "community"), V.co_edges(s, d))


@query("SELECT node, degree FROM g_degree ORDER BY degree DESC, node LIMIT 10")
def god_nodes(s, d):
    return god_nodes_of(s, d)


def god_nodes_of(s, d):
    return analytics.god_nodes(degrees(s, d))


@query(""", x AS (SELECT a, b, least(p.community, q.community) AS c, greatest(p.community, q.community) AS d FROM g_co JOIN g_parts p ON p.node = a JOIN g_parts q ON q.node = b WHERE p.community <> q.community)
SELECT a, b, links, e.degree + f.degree AS degrees FROM x JOIN (SELECT c, d, count(*) AS links FROM x GROUP BY 1, 2) USING (c, d) JOIN g_degree e ON e.node = a JOIN g_degree f ON f.node = b ORDER BY links, degrees DESC, a, b LIMIT 20""")
def surprising_connections(s, d):
    return analytics.surprising(V.parts(s, d).select("node", "community"), V.co_edges(s, d), degrees(s, d))


@query("SELECT source, target, relation FROM g_edges WHERE confidence IN ('EXTRACTED', 'INFERRED')")
def confidence_filter(s, d):
    return analytics.confident(V.edges(s, d)).select("source", "target", "relation")


@query(""", x AS (SELECT a, b, least(p.community, q.community) AS c, greatest(p.community, q.community) AS d FROM g_co JOIN g_parts p ON p.node = a JOIN g_parts q ON q.node = b WHERE p.community <> q.community),
hubs AS (SELECT node FROM g_degree ORDER BY degree DESC, node LIMIT 10),
odd AS (SELECT a, b FROM x JOIN (SELECT c, d, count(*) AS links FROM x GROUP BY 1, 2) USING (c, d) JOIN g_degree e ON e.node = a JOIN g_degree f ON f.node = b ORDER BY links, e.degree + f.degree DESC, a, b LIMIT 20)
SELECT 'What depends on ' || node || '?' AS question FROM hubs UNION ALL SELECT 'Why is ' || a || ' linked to ' || b || '?' FROM odd""")
def suggested_questions(s, d):
    return analytics.questions(god_nodes_of(s, d), analytics.surprising(V.parts(s, d).select("node", "community"), V.co_edges(s, d), degrees(s, d)))


ASKED = ["Small Ring", "red wid", "gizmo", "type/ECONOMY", "blue"]


@query(", asked AS (SELECT unnest([" + ", ".join(f"'{a}'" for a in ASKED) + """]) AS asked)
SELECT asked, kind, node, label FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY kind, length(label), node) AS k FROM (SELECT asked, node, label, CAST(CASE WHEN lower(label) = lower(asked) THEN 0 WHEN starts_with(lower(label), lower(asked)) THEN 1 WHEN contains(lower(label), lower(asked)) THEN 2 END AS BIGINT) AS kind FROM g_parts, asked) WHERE kind IS NOT NULL) WHERE k = 1""")
def get_node(s, d):
    return traversal.get_node(V.parts(s, d).select("node", "label"), ASKED)


@query("SELECT DISTINCT target AS node, relation, 'out' AS direction FROM g_edges WHERE source = 'n3' UNION SELECT source, relation, 'in' FROM g_edges WHERE target = 'n3'")
def get_neighbors(s, d):
    return traversal.get_neighbors(V.adjacency(s, d), "n3")


@query("SELECT node, label, source_file FROM g_parts WHERE community = 5")
def get_community(s, d):
    return V.parts(s, d).where("community = 5").select("node", "label", "source_file")


BFS = "walk(v, h) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT g_both.v, h + 1 FROM walk JOIN g_both ON u = walk.v WHERE h < 6), dist AS (SELECT v AS node, CAST(min(h) AS BIGINT) AS hop FROM walk GROUP BY 1)"


def from_zero(s, d, scratch):
    start = s.range(1).select(F.lit(0).cast("long").alias("node"))
    return traversal.bfs(scratch.save(V.co_edges(s, d)), start, 6, scratch)


@query(f", {BFS} SELECT node, hop FROM dist")
def graph_query_bfs(s, d):
    return from_zero(s, d, Scratch(s, "bfs"))


@query(f""", {BFS}, last AS (SELECT max(p_partkey) AS node FROM part), far AS (SELECT hop FROM dist JOIN last USING (node)) SELECT CAST(unnest(range(0, hop + 1)) AS BIGINT) AS hop, true AS linked FROM far""")
def shortest_path(s, d):
    """The hops from the first part to the last, each checked to be a link; of several paths any is right."""
    scratch = Scratch(s, "path")
    pairs = V.co_edges(s, d)
    goal = V.parts(s, d).agg(F.max("node")).first()[0]
    path = scratch.save(traversal.shortest_path(pairs, 0, goal, scratch))
    steps = path.select("hop", F.col("node").alias("v")).join(path.select((F.col("hop") + 1).alias("hop"), F.col("node").alias("u")), "hop", "left")
    links = traversal.both_ways(pairs).select(F.col("u").alias("x"), F.col("v").alias("y"))
    joined = steps.join(links, (F.col("u") == F.col("x")) & (F.col("v") == F.col("y")), "left")
    return joined.select("hop", (F.col("x").isNotNull() | (F.col("hop") == 0)).alias("linked"))


@query("""SELECT CAST(hop AS BIGINT) AS hop, relation, direction FROM (VALUES (1, 'in_region', 'in'), (2, 'in_nation', 'in'), (3, 'supplied_by', 'in')) v(hop, relation, direction)
WHERE EXISTS (SELECT 1 FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0))""", prefix=False)
def path_relations(s, d):
    """What the steps from a region to a part that one of its suppliers has are called, and which way they go."""
    scratch = Scratch(s, "relations")
    nation = V.read(s, d, "nation").where("n_regionkey = 0").select(F.col("n_nationkey").alias("s_nationkey"))
    suppliers = V.read(s, d, "supplier").join(nation, "s_nationkey").select(F.col("s_suppkey").alias("l_suppkey"))
    goal = V.read(s, d, "lineitem").join(suppliers, "l_suppkey").agg(F.min("l_partkey")).first()[0]
    edges = V.edges(s, d).select("source", "target", "relation")
    pairs = edges.select(F.col("source").alias("a"), F.col("target").alias("b"))
    path = scratch.save(traversal.shortest_path(pairs, "r0", f"p{goal}", scratch))
    return traversal.path_hops(path, edges).select("hop", "relation", "direction")


@query(""", tree AS (SELECT 'n' || n_nationkey AS node, CAST(NULL AS VARCHAR) AS up FROM nation WHERE n_regionkey = 0 UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 0),
walk AS (SELECT 'r0' AS node, '' AS place UNION ALL SELECT node, coalesce(up || '/', '') || node || '/' FROM tree)
SELECT CAST(row_number() OVER (ORDER BY place) - 1 AS BIGINT) AS position, node FROM walk""")
def depth_first(s, d):
    """Depth-first order of a region's nations and their suppliers, the smallest name first."""
    keep = V.edges(s, d).where("source_repo IN ('nation', 'supplier')").select(F.col("source").alias("a"), F.col("target").alias("b"))
    return traversal.depth_first(keep, "r0", 2, Scratch(s, "preorder"))


REACH = ["region", "nation", "customer", "supplier", "part", "orders", "documents"]


@query("SELECT a.r AS source_repo, b.r AS target_repo, a.r <> 'documents' AND b.r <> 'documents' AS reachable FROM (SELECT unnest([" + ", ".join(f"'{r}'" for r in REACH) + "]) AS r) a, (SELECT unnest([" + ", ".join(f"'{r}'" for r in REACH) + "]) AS r) b WHERE a.r <> b.r")
def repo_reachability(s, d):
    repos = V.nodes(s, d).select("repo").distinct().union(s.range(1).select(F.lit("documents")))
    return traversal.repo_reachability(repos, V.edges(s, d), Scratch(s, "reach"))


ASKS = "asks(qid, question) AS (VALUES " + ", ".join(str(q) for q in V.QUESTIONS) + ")"


@query(f""", {ASKS}, qt AS (SELECT DISTINCT qid, unnest({tokens_sql('question')}) AS token FROM asks), nt AS (SELECT DISTINCT node, length(label) AS size, unnest({tokens_sql('label')}) AS token FROM g_parts)
SELECT qid, rank, node FROM (SELECT qid, node, row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, size, node) AS rank FROM qt JOIN nt USING (token) GROUP BY qid, node, size) WHERE rank <= 5""")
def graph_query_seeds(s, d):
    asks = V.fixed(s, V.QUESTIONS, ["qid", "question"])
    return traversal.seeds(V.parts(s, d).select("node", "label"), asks)


@query(f""", {BFS}, lines AS (SELECT node, hop, coalesce(degree, 0) AS degree, 'NODE ' || label || ' [src=' || source_file || ']' AS line FROM dist LEFT JOIN g_degree USING (node) JOIN g_parts USING (node)),
run AS (SELECT row_number() OVER w AS position, node, line, {estimate_sql('line')} AS tokens, CAST(sum({estimate_sql('line')}) OVER w AS BIGINT) AS total FROM lines WINDOW w AS (ORDER BY hop, degree DESC, node))
SELECT * FROM run WHERE total <= 500""")
def graph_query_budget(s, d):
    return traversal.budgeted(from_zero(s, d, Scratch(s, "bfs")), degrees(s, d), V.parts(s, d), 500)


# ---- savings --------------------------------------------------------------------------------------------------------------------


ANSWERS = f"""it AS (SELECT DISTINCT item_id, unnest({tokens_sql('text')}) AS token FROM benchmark), dt AS (SELECT DISTINCT doc_id, source, unnest({tokens_sql('text')}) AS token FROM documents),
df AS (SELECT token, count(*) AS df FROM dt GROUP BY 1),
rare AS (SELECT item_id, token FROM (SELECT item_id, token, row_number() OVER (PARTITION BY item_id ORDER BY df, token) AS k FROM it JOIN df USING (token)) WHERE k = 1),
top AS (SELECT token, doc_id, source, k FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id) AS k FROM dt) WHERE k <= 5),
hit AS (SELECT item_id, doc_id, source, k FROM rare JOIN top USING (token)),
answers AS (SELECT item_id AS qid, string_agg('NODE ' || doc_id || ' [src=' || source || ']', chr(10) ORDER BY k) AS answer FROM hit GROUP BY 1),
named AS (SELECT DISTINCT item_id AS qid, source FROM hit),
per AS (SELECT source, sum({estimate_sql('text')}) FILTER (WHERE doc_id % 11 > 0) AS tokens, count(*) FILTER (WHERE doc_id % 11 > 0) AS present, count(*) FILTER (WHERE doc_id % 11 = 0) AS absent FROM documents GROUP BY 1),
ratios AS (SELECT qid, graph_tokens, CAST(source_tokens AS BIGINT) AS source_tokens, CAST(source_files AS BIGINT) AS source_files, CAST(unresolved_files AS BIGINT) AS unresolved_files, round(CAST(source_tokens AS DOUBLE) / graph_tokens, 1) AS ratio FROM (SELECT qid, {estimate_sql('answer')} AS graph_tokens FROM answers)
  JOIN (SELECT qid, coalesce(sum(tokens), 0) AS source_tokens, sum(present) AS source_files, sum(absent) AS unresolved_files FROM named JOIN per USING (source) GROUP BY 1) USING (qid))"""


def answers(s, d):
    """qid, answer: for each benchmark item the first five documents that have its rarest token.

    The rarest token decides before documents are joined, so common words bring no pairs; each token's documents are ranked once.
    """
    items = V.read(s, d, "benchmark").select("item_id", F.explode(F.array_distinct(X.name_tokens("text"))).alias("token"))
    docs = V.read(s, d, "documents").select("doc_id", "source", F.explode(F.array_distinct(X.name_tokens("text"))).alias("token"))
    asked = items.select("token").distinct()
    docs = Scratch(s, "answers").save(docs.join(asked, "token", "left_semi"))
    df = docs.groupBy("token").agg(F.count("*").alias("df"))
    rare = items.join(df, "token").groupBy("item_id").agg(F.min(F.struct("df", "token")).alias("r")).select("item_id", F.col("r.token").alias("token"))
    order = Window.partitionBy("token").orderBy("doc_id")
    top = docs.join(rare.select("token").distinct(), "token", "left_semi").withColumn("k", F.row_number().over(order)).where("k <= 5")
    line = F.concat(F.lit("NODE "), F.col("doc_id").cast("string"), F.lit(" [src="), F.col("source"), F.lit("]"))
    listed = top.groupBy("token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
    return rare.join(listed, "token").select(F.col("item_id").alias("qid"), "answer")


def ratios(s, d):
    read = V.read(s, d, "documents")  # every eleventh file can't be read
    per_file = read.select("source", F.when(F.col("doc_id") % 11 > 0, X.token_estimate("text")).alias("tokens"))
    return savings.token_ratio(Scratch(s, "ratios").save(answers(s, d)), per_file)


@query(f"WITH {ANSWERS} SELECT qid, source FROM named", prefix=False)
def answer_sources(s, d):
    return savings.answer_sources(answers(s, d))


@query(f"WITH {ANSWERS} SELECT * FROM ratios", prefix=False)
def token_ratio(s, d):
    return ratios(s, d)


@query(f"WITH {ANSWERS} SELECT count(*) AS questions, CAST(sum(graph_tokens) AS BIGINT) AS graph_tokens, CAST(sum(source_tokens) AS BIGINT) AS source_tokens, round(median(ratio), 1) AS median_ratio, round(CAST(sum(source_tokens) AS DOUBLE) / sum(graph_tokens), 1) AS ratio FROM ratios", prefix=False)
def token_ratio_totals(s, d):
    return savings.totals(ratios(s, d))


# ---- incremental ----------------------------------------------------------------------------------------------------------------


@query("SELECT doc_id, md5(text) AS fingerprint FROM documents WHERE doc_id % 2 = 1", prefix=False)
def incremental_changed(s, d):
    docs = V.read(s, d, "documents")
    snapshot = docs.where("doc_id % 2 = 0").select("doc_id", F.md5("text").alias("fingerprint"))
    return corpus.changed(docs, snapshot, "doc_id", "text")


# ---- corpus files ---------------------------------------------------------------------------------------------------------------


#: Documents as files of a checkout: folders, names and extensions of all the kinds that the rules tell apart.
EXTENSIONS = [".hpp", ".CPP", ".py", ".xml", ".md", ".bin", ""]
FOLDERS = ["src", "build", "data/Output", "guides", "data"]
FILE_NAMES = rf"""names AS (SELECT doc_id, n_chars, text, CASE WHEN doc_id % 37 = 0 THEN 'README.md' ELSE 'd' || doc_id || {"".join(f"CASE WHEN doc_id % 7 = {i} THEN '{e}' ELSE '' END || " for i, e in enumerate(EXTENSIONS))}'' END AS name, CASE doc_id % 6 {" ".join(f"WHEN {i} THEN '{f}/'" for i, f in enumerate(FOLDERS))} ELSE '' END AS folder FROM documents),
files AS (SELECT doc_id, n_chars, text, folder || CASE WHEN folder = 'src/' THEN 's' || doc_id % 4 || '/' ELSE '' END || name AS path FROM names),
parts AS (SELECT *, split_part(path, '/', 1) AS top, lower(regexp_extract(path, '[^/]+(\.[^./]+)$', 1)) AS ext, lower(regexp_extract(path, '[^/]*$')) AS base FROM files)"""
EXCLUDED = [("guides", "guides are no code"), ("d5.bin", "one file")]


def checkout(s, d):
    """doc_id, n_chars, text, path."""
    n = F.col("doc_id")
    number = n.cast("string")
    ext = F.element_at(F.array(*[F.lit(e) for e in EXTENSIONS]), (n % 7 + 1).cast("int"))
    name = F.when(n % 37 == 0, "README.md").otherwise(F.concat(F.lit("d"), number, ext))
    folder = F.element_at(F.array(*[F.lit(f + "/") for f in FOLDERS], F.lit("")), (n % 6 + 1).cast("int"))
    inner = F.when(folder == "src/", F.concat(F.lit("s"), (n % 4).cast("string"), F.lit("/"))).otherwise("")
    return V.read(s, d, "documents").select("doc_id", "n_chars", "text", F.concat(folder, inner, name).alias("path"))


def covered(s, d):
    rows = checkout(s, d)
    return corpus.coverage(rows.select("path").distinct(), rows.where("doc_id % 4 = 1").select("path"), EXCLUDED)


COVERED = f"""claims AS (SELECT DISTINCT path FROM files WHERE doc_id % 4 = 1),
covered AS (SELECT path, top, CASE WHEN len(list_intersect(string_split(path, '/'), [{', '.join(f"'{x}'" for x in corpus.IGNORED_FOLDERS)}])) > 0 THEN 'ignored' WHEN path IN (SELECT path FROM claims) THEN 'claimed'
  WHEN base IN ({', '.join(f"'{x}'" for x in corpus.IGNORED_NAMES)}) THEN 'ignored' WHEN path = 'guides' OR starts_with(path, 'guides/') THEN 'excluded' WHEN path = 'd5.bin' OR starts_with(path, 'd5.bin/') THEN 'excluded'
  WHEN ext IN ({', '.join(f"'{x}'" for x in corpus.CODE_EXTENSIONS)}) THEN 'code' WHEN ext IN ({', '.join(f"'{x}'" for x in corpus.DATA_EXTENSIONS)}) THEN 'data' ELSE 'other' END AS status FROM (SELECT DISTINCT path, top, ext, base FROM parts)),
reasons AS (SELECT *, CASE WHEN status = 'excluded' THEN CASE WHEN starts_with(path, 'guides') THEN 'guides are no code' ELSE 'one file' END END AS reason FROM covered)"""


@query(f"WITH {FILE_NAMES}, {COVERED} SELECT path, status, reason, top FROM reasons", prefix=False)
def coverage(s, d):
    return covered(s, d)


@query(f"WITH {FILE_NAMES}, {COVERED} SELECT status, top, count(*) AS n FROM covered WHERE status IN ('code', 'data') GROUP BY ALL", prefix=False)
def unclaimed_by_top(s, d):
    rows = covered(s, d)
    return corpus.unclaimed_by_top(rows).withColumn("status", F.lit("code")).unionByName(corpus.unclaimed_by_top(rows, "data").withColumn("status", F.lit("data")))


@query(f"WITH {FILE_NAMES}, {COVERED} SELECT reason, count(*) AS n FROM reasons WHERE status = 'excluded' GROUP BY 1", prefix=False)
def excluded_by_reason(s, d):
    return corpus.excluded_by_reason(covered(s, d))


COLLECTED = "collected AS (SELECT DISTINCT path, n_chars * 100 AS length FROM files WHERE starts_with(path, 'data/') AND ext IN ('.xml', '.md') AND NOT starts_with(path, 'data/Output/') AND n_chars * 100 <= 400000)"


@query(f"WITH {FILE_NAMES}, {COLLECTED.replace('FROM files', 'FROM parts')} SELECT path, length FROM collected", prefix=False)
def corpus_collect(s, d):
    rows = checkout(s, d).select("path", (F.col("n_chars") * 100).alias("length")).distinct()
    return corpus.collect(rows, "data", ["**/*.xml", "*.md"])


@query(f"""WITH {FILE_NAMES}, dirs AS (SELECT DISTINCT path, CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '.' END AS dir FROM files), ranked AS (SELECT *, (row_number() OVER (ORDER BY dir, path) - 1) // 20 + 1 AS chunk FROM dirs)
SELECT chunk, (SELECT max(chunk) FROM ranked) AS total, 'chunk_' || lpad(CAST(chunk AS VARCHAR), CAST(greatest(2, length(CAST(chunk AS VARCHAR))) AS INTEGER), '0') || '.json' AS output, string_agg(path, ',' ORDER BY dir, path) AS files FROM ranked GROUP BY chunk""", prefix=False)
def manifest(s, d):
    return corpus.manifest(checkout(s, d).select("path").distinct()).withColumn("files", F.array_join("files", ","))


@query(rf"""WITH {FILE_NAMES}, kinds AS (SELECT CASE WHEN ext IN ({', '.join(f"'{x}'" for x in corpus.BUILD_EXTENSIONS)}) THEN 'code' WHEN ext IN ({', '.join(f"'{x}'" for x in corpus.DATA_EXTENSIONS)}) THEN 'data' ELSE 'other' END AS kind, CAST(len(list_filter(regexp_split_to_array(trim(text), '\s+'), lambda w: w <> '')) AS BIGINT) AS words FROM parts)
SELECT kind, count(*) AS n_files, CAST(sum(words) AS BIGINT) AS words FROM kinds GROUP BY 1""", prefix=False)
def detections(s, d):
    rows = checkout(s, d)
    return corpus.merge_detections(corpus.detect(rows.where("doc_id % 2 = 0")).union(corpus.detect(rows.where("doc_id % 2 = 1"))))


@query(f"WITH {FILE_NAMES} SELECT path, ext, CASE WHEN ext <> '' THEN left(path, length(path) - length(ext)) ELSE path END || '.txt' AS renamed, md5(path) AS digest, sha256(coalesce(text, '')) AS sha256, format('{{:,}}', n_chars * 1000) AS thousands, CAST(round_even(100.0::DOUBLE * (doc_id % 31) / 31, 0) AS BIGINT) || '%' AS share FROM parts", prefix=False)
def path_and_number_formats(s, d):
    n = F.col("doc_id")
    return checkout(s, d).select("path", X.extension("path").alias("ext"), X.with_suffix("path", ".txt").alias("renamed"), F.md5("path").alias("digest"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha256"), X.thousands(F.col("n_chars") * 1000).alias("thousands"), X.percent(n % 31, F.lit(31)).alias("share"))


@query(f"""WITH {FILE_NAMES}, o AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN '{{"nodes": [1, 2], "edges": [3]}}' WHEN 2 THEN '{{"nodes": [], "edges": 3}}' WHEN 3 THEN '{{"nodes": [' ELSE '{{"nodes": [' || doc_id || '], "edges": []}}' END AS content FROM documents)
SELECT doc_id AS chunk, CASE doc_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'ok' WHEN 4 THEN 'ok' ELSE 'invalid' END AS status, CAST(CASE doc_id % 5 WHEN 1 THEN 2 WHEN 4 THEN 1 ELSE 0 END AS BIGINT) AS nodes, CAST(CASE doc_id % 5 WHEN 1 THEN 1 ELSE 0 END AS BIGINT) AS edges FROM o""", prefix=False)
def fragment_validation(s, d):
    docs = V.read(s, d, "documents").select(F.col("doc_id").alias("chunk"), F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("output"))
    kind = F.col("chunk") % 5
    content = F.when(kind == 1, '{"nodes": [1, 2], "edges": [3]}').when(kind == 2, '{"nodes": [], "edges": 3}').when(kind == 3, '{"nodes": [').otherwise(F.concat(F.lit('{"nodes": ['), F.col("chunk").cast("string"), F.lit('], "edges": []}')))
    return corpus.validate(docs, docs.where(kind != 0).select("output", content.alias("content")))


@query("""WITH f AS (SELECT 'chunk_' || lpad(CAST(doc_id % 50 AS VARCHAR), 2, '0') AS file, doc_id // 50 AS pos, 'n' || doc_id % 70 AS id, CAST(doc_id AS VARCHAR) AS label FROM documents)
SELECT 'node' AS kind, id, label FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY file, pos) AS k FROM f) WHERE k = 1 UNION ALL SELECT 'edge', id, 'n0' FROM f
UNION ALL SELECT 'hyperedge', id, label FROM (SELECT 'h' || substr(id, 2) AS id, label, row_number() OVER (PARTITION BY id ORDER BY file, pos) AS k FROM f) WHERE k = 1""", prefix=False)
def fragment_merge(s, d):
    n = F.col("doc_id")
    node = F.concat(F.lit("n"), (n % 70).cast("string"))
    rows = V.read(s, d, "documents").select(F.concat(F.lit("chunk_"), F.lpad((n % 50).cast("string"), 2, "0")).alias("file"), n, node.alias("id"), n.cast("string").alias("label"))

    def listed(*columns):
        return F.transform(F.array_sort(F.collect_list(F.struct("doc_id", "id", "label"))), lambda x: F.struct(*[c(x) for c in columns]))

    fragments = rows.groupBy("file").agg(
        listed(lambda x: x["id"].alias("id"), lambda x: x["label"].alias("label")).alias("nodes"),
        listed(lambda x: x["id"].alias("source"), lambda x: F.lit("n0").alias("target")).alias("edges"),
        listed(lambda x: F.concat(F.lit("h"), F.substr(x["id"], F.lit(2))).alias("id"), lambda x: x["label"].alias("label")).alias("hyperedges"),
    )
    nodes, edges, hyper = corpus.merge_fragments(fragments)
    return nodes.select(F.lit("node").alias("kind"), "id", "label").union(edges.select(F.lit("edge"), "source", "target")).union(hyper.select(F.lit("hyperedge"), "id", "label"))


@query("""WITH t AS (SELECT CAST(doc_id % 40 AS VARCHAR) AS task, lower(string_agg(text, ' ')) AS text FROM documents GROUP BY 1),
r AS (SELECT CAST(item_id % 40 AS VARCHAR) AS task, item_id AS item, list_distinct(string_split(text, ' '))[1:3] AS terms FROM (SELECT item_id, text FROM benchmark))
SELECT task, count(*) FILTER (WHERE hit) AS covered, count(*) AS items FROM (SELECT r.task, item, EXISTS (SELECT 1 FROM documents d WHERE CAST(doc_id % 40 AS VARCHAR) = r.task AND (contains(lower(d.text), lower(string_split(b.text, ' ')[1])) OR contains(lower(d.text), lower(string_split(b.text, ' ')[2])))) AS hit FROM r JOIN benchmark b ON b.item_id = item) r GROUP BY 1""", prefix=False)
def rubric_coverage(s, d):
    contexts = V.read(s, d, "documents").where("text IS NOT NULL").select((F.col("doc_id") % 40).cast("string").alias("task"), F.col("text").alias("context"))
    words = F.split("text", " ")
    rubric = V.read(s, d, "benchmark").select((F.col("item_id") % 40).cast("string").alias("task"), F.col("item_id").alias("item"), F.filter(F.slice(words, 1, 2), lambda w: w.isNotNull()).alias("any"))
    return savings.rubric_coverage(contexts, rubric)


# ---- rules of extraction, repair, repeatability ---------------------------------------------------------------------------------


@query("""WITH n AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'D-' ELSE 'd_' END || doc_id AS id, CASE WHEN doc_id % 7 = 0 THEN 'odd' ELSE 'code' END AS file_type, CASE WHEN doc_id % 3 = 0 THEN 'a.py' ELSE 'a.cpp' END AS source_file, doc_id FROM documents),
e AS (SELECT *, CASE doc_id % 3 WHEN 0 THEN 'EXTRACTED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS confidence, (doc_id % 21) / 20.0::DOUBLE AS score FROM n)
SELECT 'file_type' AS rule, count(*) FILTER (WHERE file_type = 'odd') AS broken FROM n UNION ALL SELECT 'id_characters', count(*) FILTER (WHERE id LIKE 'D%') FROM n
UNION ALL SELECT 'extracted_score', count(*) FILTER (WHERE confidence = 'EXTRACTED' AND score <> 1) FROM e UNION ALL SELECT 'inferred_score', count(*) FILTER (WHERE confidence = 'INFERRED' AND score NOT IN (0.95::DOUBLE, 0.85::DOUBLE, 0.75::DOUBLE, 0.65::DOUBLE, 0.55::DOUBLE)) FROM e
UNION ALL SELECT 'ambiguous_score', count(*) FILTER (WHERE confidence = 'AMBIGUOUS' AND NOT (score BETWEEN 0.1 AND 0.3)) FROM e
UNION ALL SELECT 'call_across_languages', count(*) FILTER (WHERE a.source_file <> b.source_file) FROM n a JOIN n b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 2 = 0
UNION ALL SELECT 'hyperedge_arity', count(*) FILTER (WHERE doc_id % 4 < 3) FROM n UNION ALL SELECT 'hyperedges_a_chunk', count(*) FROM (SELECT doc_id // 10 FROM n GROUP BY 1 HAVING count(*) > 3)""", prefix=False)
def extraction_rules(s, d):
    n = F.col("doc_id")
    own = F.concat(F.when(n % 10 == 0, "D-").otherwise("d_"), n.cast("string"))
    docs = V.read(s, d, "documents").select("doc_id", own.alias("id"), F.when(n % 7 == 0, "odd").otherwise("code").alias("file_type"), F.when(n % 3 == 0, "a.py").otherwise("a.cpp").alias("source_file"))
    following = docs.select((n - 1).alias("doc_id"), F.col("id").alias("target"))
    kind = F.element_at(F.array(*[F.lit(c) for c in analytics.CONFIDENCES]), (n % 3 + 1).cast("int"))
    edges = docs.join(following, "doc_id", "left").select(F.col("id").alias("source"), "target", F.when(n % 2 == 0, "calls").otherwise("uses").alias("relation"), kind.alias("confidence"), ((n % 21) / 20.0).alias("confidence_score"))
    hyper = docs.select(F.floor(n / 10).cast("string").alias("chunk"), F.transform(F.sequence(F.lit(0), n % 4), lambda i: i.cast("string")).alias("nodes"))
    hyper = hyper.withColumn("nodes", F.slice("nodes", 1, F.size("nodes") - 1))
    return quality.spec_rules(docs, edges, hyper)


@query(", r AS (SELECT community AS entry, 'L' || community AS label, string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) AS anchors FROM g_top GROUP BY 1) SELECT entry, label, anchors FROM r WHERE entry % 5 = 0 OR entry % 7 = 0")
def additive_only(s, d):
    top = labels.top_anchors(V.parts(s, d), degrees(s, d))
    old = top.groupBy(F.col("community").alias("entry")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("anchors")).withColumn("label", F.concat(F.lit("L"), F.col("entry").cast("string")))
    new = old.where("entry % 5 <> 0").withColumn("label", F.when(F.col("entry") % 7 == 0, "changed").otherwise(F.col("label")))
    return quality.additive_only(old, new).select("entry", "label", "anchors")


@query(f", {MERGED} SELECT id, 'second' AS only_in FROM merged WHERE repo = 'nation'")
def repeatable_builds(s, d):
    one = merged(s, d).select("id", "community_key")
    return quality.repeatable(one.where("id NOT LIKE 'nation::%'"), one).select("id", "only_in")


@query("""WITH n AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '../up/d' || doc_id || '.h' WHEN 1 THEN '/eng/x/./d' || doc_id || '.h' WHEN 2 THEN '/else/d' || doc_id ELSE '' END AS source_file FROM documents)
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'up/d' || doc_id || '.h' WHEN 1 THEN 'x/d' || doc_id || '.h' END AS repo_path, CASE doc_id % 4 WHEN 0 THEN 'stamped' WHEN 1 THEN 'stamped' WHEN 2 THEN 'outside' ELSE 'missing' END AS outcome FROM n""", prefix=False)
def repo_paths(s, d):
    n = F.col("doc_id")
    number = n.cast("string")
    file = F.when(n % 4 == 0, F.concat(F.lit("../up/d"), number, F.lit(".h"))).when(n % 4 == 1, F.concat(F.lit("/eng/x/./d"), number, F.lit(".h"))).when(n % 4 == 2, F.concat(F.lit("/else/d"), number)).otherwise("")
    return files.repo_paths(V.read(s, d, "documents").select("doc_id", file.alias("source_file")), "/eng/src", "/eng").select("doc_id", "repo_path", "outcome")


#: Nodes with a leaked path: of every five documents a header, its implementation, a symbol of that, a text and a page of one name.
LEAKED = """n AS (SELECT doc_id, doc_id // 5 AS g, CASE doc_id % 5 WHEN 0 THEN '.hpp' WHEN 1 THEN '.cpp' WHEN 2 THEN '.cpp' WHEN 3 THEN '.txt' ELSE '.md' END AS ext FROM documents WHERE text IS NOT NULL),
g_have AS (SELECT g, bool_or(ext = '.txt') AND bool_or(ext = '.md') AS both_texts FROM n GROUP BY 1),
kept AS (SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN 's_a' || g WHEN doc_id % 5 = 2 THEN 's_a' || g || '_f' WHEN both_texts THEN 's_t' || g || replace(ext, '.', '_') ELSE 's_t' || g END AS id FROM n JOIN g_have USING (g))"""


@query(f"WITH {LEAKED} SELECT id, min(doc_id) AS doc_id FROM kept GROUP BY 1", prefix=False)
def id_repair(s, d):
    return repaired(s, d)[0].select("id", "doc_id")


@query(f"WITH {LEAKED} SELECT a.id AS source, b.id AS target FROM kept a JOIN kept b ON b.doc_id = a.doc_id + 1 WHERE a.id <> b.id", prefix=False)
def id_repair_edges(s, d):
    return repaired(s, d)[1].select("source", "target")


def repaired(s, d):
    n = F.col("doc_id")
    group = F.floor(n / 5).cast("string")
    kind = n % 5
    file = F.when(kind == 0, F.concat(F.lit("s/a"), group, F.lit(".hpp"))).when(kind < 3, F.concat(F.lit("s/a"), group, F.lit(".cpp"))).when(kind == 3, F.concat(F.lit("s/t"), group, F.lit(".txt"))).otherwise(F.concat(F.lit("s/t"), group, F.lit(".md")))
    own = F.when(kind == 2, F.concat(F.lit("abs_root_s_a"), group, F.lit("_f"))).otherwise(F.concat(F.lit("abs_root_"), X.normalised_id(file)))
    docs = V.read(s, d, "documents").where("text IS NOT NULL").select("doc_id", own.alias("id"), file.alias("source_file"), n.alias("pos"))
    edges = docs.select(F.col("id").alias("source"), (n + 1).alias("doc_id")).join(docs.select("doc_id", F.col("id").alias("target")), "doc_id").select("source", "target")
    return identity.repair(docs, edges)


# ---- documents, labels and suites as files --------------------------------------------------------------------------------------


@query("SELECT 'node' AS kind, repo, local_id AS a, label AS b FROM g_nodes WHERE repo IN ('region', 'nation') UNION ALL SELECT 'edge', source_repo, source, target FROM g_edges WHERE source_repo = 'nation' UNION ALL SELECT 'hyperedge', 'region', 'all', string_agg(local_id, ',' ORDER BY local_id) FROM g_nodes WHERE repo = 'region'")
def graph_documents(s, d):
    """Chunk graphs written as documents, one a chunk, and read back. Regions and nations are tables of fixed size."""
    folder = Path(tempfile.mkdtemp())
    nodes, edges = V.nodes(s, d), V.edges(s, d).where("source_repo = 'nation'")
    for repo in ("region", "nation"):
        own = nodes.where(F.col("repo") == repo).select(F.col("local_id").alias("id"), "label", "community").orderBy("id")
        links = edges.where(F.col("source_repo") == repo).select("source", "target", "relation", "confidence")
        hyper = own.agg(F.array_sort(F.collect_list("id")).alias("nodes")).select(F.lit("all").alias("id"), "nodes") if repo == "region" else None
        sinks.write_graph_document(folder / f"{repo}.json", own, links, hyper, {"chunks": [repo]})
    scratch = Scratch(s, "documents")
    paths = {f.stem: scratch.write_text(f.name, f.read_text(encoding="utf-8")) for f in sorted(folder.iterdir())}
    read_nodes, read_edges, read_hyper = documents.load_graphs(s, paths)
    return (
        read_nodes.select(F.lit("node").alias("kind"), "repo", F.col("local_id").alias("a"), F.col("label").alias("b"))
        .union(read_edges.select(F.lit("edge"), "source_repo", "source", "target"))
        .union(read_hyper.select(F.lit("hyperedge"), "repo", "id", F.array_join("nodes", ",")))
    )


@query("SELECT 'name' AS kind, repo, community, name FROM g_named WHERE community % 4 > 0 UNION ALL SELECT 'anchor', 'part', row_number() OVER (ORDER BY community) - 1, 'Brand family ' || community || ':' || string_agg(CAST(node AS VARCHAR), ',' ORDER BY rank) FROM g_top GROUP BY community")
def label_files(s, d):
    """Label and anchor files written and read back: a name a community, so their size is that of the naming, not of the graph."""
    folder = Path(tempfile.mkdtemp())
    sinks.write_labels(V.named(s, d).where("community % 4 > 0"), folder)
    top = labels.top_anchors(V.parts(s, d), degrees(s, d))
    listed = top.groupBy("community").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda x: x["node"].cast("string")), ",").alias("anchors"))
    fresh = listed.select(F.concat(F.lit("Brand family "), F.col("community").cast("string")).alias("label"), F.lit("new").alias("kind"), "anchors", F.lit(None).cast("int").alias("entry"), "community")
    sinks.write_anchors(labels.anchor_entries(fresh), folder / "part.anchors.json", labels.ANCHOR_COUNT)
    scratch = Scratch(s, "labels")
    for f in sorted(folder.iterdir()):
        scratch.write_text(f.name, f.read_text(encoding="utf-8"))
    names, anchors = documents.load_labels(s, scratch.base), documents.load_anchors(s, scratch.base)
    read_anchors = anchors.select(F.lit("anchor"), "repo", F.col("entry").cast("long"), F.concat("label", F.lit(":"), F.array_join("anchors", ",")))
    return names.select(F.lit("name").alias("kind"), "repo", "community", "name").union(read_anchors)


SUITE = '{"meta": {"description": "three questions", "version": 1}, "questions": [' + ", ".join(f'{{"id": "q{q}", "question": "{t}", "depth": {q}}}' for q, t in V.QUESTIONS) + "]}\n"


@query(f", {ASKS} SELECT 'q' || qid AS qid, question, 'bfs' AS mode, CAST(qid AS BIGINT) AS depth, CAST(2000 AS BIGINT) AS token_budget, sha256('{SUITE}') AS suite FROM asks")
def question_suite(s, d):
    return documents.load_questions(s, Scratch(s, "suite").write_text("suite.json", SUITE))


@query("SELECT 'src/' || n_nationkey || '/' || n_name || CASE n_nationkey % 3 WHEN 0 THEN '.HPP' WHEN 1 THEN '.cpp' ELSE '.md' END AS path, CASE WHEN n_nationkey % 3 < 2 THEN n_name || chr(10) || 'x' END AS text, CASE WHEN n_nationkey % 3 = 0 THEN 'headers' END AS chunk FROM nation", prefix=False)
def checkout_scan(s, d):
    """Files written to the shared folder, listed, read as texts and claimed by a chunk's pattern."""
    scratch = Scratch(s, "checkout")
    for r in V.read(s, d, "nation").collect():  # a table of 25 rows
        key, name = r["n_nationkey"], r["n_name"]
        scratch.write_text(f"src/{key}/{name}{('.HPP', '.cpp', '.md')[key % 3]}", f"{name}\r\nx")
    listed = files.scan_files(s, scratch.base)
    texts = files.scan_texts(s, scratch.base)
    chunks = s.sql("SELECT 'headers' AS name, 'src' AS root, array('**/*.HPP') AS targets")
    claimed_ = files.resolve_targets(listed, chunks).select("path", F.col("name").alias("chunk"))
    return listed.select("path").join(texts, "path", "left").join(claimed_, "path", "left").select("path", "text", "chunk")


@query("SELECT doc_id, CAST(CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS BIGINT) AS times FROM documents", prefix=False)
def stream_ingest(s, d):
    """How often each document was handed on: all at first, then those whose text has changed, and none that hasn't."""
    scratch = Scratch(s, "stream")
    taken = []

    def apply(rows):
        taken.append(scratch.save(rows.select("doc_id")))

    docs = V.read(s, d, "documents").select("doc_id", "text")
    later = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("!"))).otherwise(F.col("text")))
    for rows in (docs, later):
        rows.write.mode("append").parquet(f"{scratch.base}/in")
        ingest(s, f"{scratch.base}/in", "doc_id long, text string", "doc_id", "text", f"{scratch.base}/snapshot", f"{scratch.base}/progress", apply)
    out = taken[0]
    for t in taken[1:]:
        out = out.union(t)
    return out.groupBy("doc_id").agg(F.count("*").alias("times"))


@query("""WITH f AS (SELECT doc_id, 'p/f' || doc_id || '.py' AS path FROM documents),
n AS (SELECT 'p_f' || doc_id AS id FROM f UNION ALL SELECT 'p_f' || doc_id || '_k' || doc_id FROM f UNION ALL SELECT 'p_f' || doc_id || '_run' FROM f)
SELECT 'node' AS kind, id AS a, '' AS b FROM n UNION ALL SELECT 'contains', 'p_f' || doc_id, 'p_f' || doc_id || '_k' || doc_id FROM f UNION ALL SELECT 'contains', 'p_f' || doc_id, 'p_f' || doc_id || '_run' FROM f
UNION ALL SELECT 'inherits', 'p_f' || a.doc_id || '_k' || a.doc_id, 'p_f' || b.doc_id || '_k' || b.doc_id FROM f a JOIN f b ON b.doc_id = a.doc_id + 1
UNION ALL SELECT 'imports', 'p_f' || a.doc_id, 'p_f' || b.doc_id FROM f a JOIN f b ON b.doc_id = a.doc_id + 2
UNION ALL SELECT 'calls', 'p_f' || a.doc_id || '_run', 'p_f' || b.doc_id || '_k' || b.doc_id FROM f a JOIN f b ON b.doc_id = a.doc_id + 1""", prefix=False)
def extraction(s, d):
    """A small program a document: a class that inherits the next one's, a function that calls it, an import of the one after."""
    n = F.col("doc_id")

    def number(k):
        return (n + k).cast("string")

    text = F.concat(F.lit("import p.f"), number(2), F.lit("\n\nclass K"), number(0), F.lit("(K"), number(1), F.lit("):\n    pass\n\ndef run():\n    return K"), number(1), F.lit("()\n"))
    texts = V.read(s, d, "documents").select(F.concat(F.lit("p/f"), number(0), F.lit(".py")).alias("path"), text.alias("text"))
    nodes, edges = extract.extract(texts)
    return nodes.select(F.lit("node").alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).union(edges.select("relation", "source", "target"))
