"""Graph documents, fragments, labels, anchors and question suites from JSON files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import ANCHORS, FRAGMENT, GRAPH, QUESTIONS, TASKS


def _file_name() -> F.Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def load_graphs(spark: SparkSession, paths: dict[str, str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, hyperedges) of graph documents by chunk name, in the order given (ord). Edges may be under links or edges."""
    out: list[DataFrame | None] = [None, None, None]
    for ord, (repo, path) in enumerate(paths.items()):
        doc = spark.read.schema(GRAPH).option("multiLine", True).json(path)
        links = F.coalesce("links", "edges", F.expr("array()"))
        tables = [
            doc.select(F.posexplode("nodes").alias("pos", "x")).select("pos", "x.*").drop("repo", "local_id").withColumn("local_id", F.col("id")),
            doc.select(F.posexplode(links).alias("pos", "x")).select("pos", "x.*").withColumnRenamed("_origin", "origin").withColumn("source_repo", F.lit(repo)).withColumn("target_repo", F.lit(repo)),
            doc.select(F.posexplode("graph.hyperedges").alias("pos", "x")).select("pos", "x.*"),
        ]
        for i, t in enumerate(tables):
            t = t.withColumn("repo", F.lit(repo)).withColumn("ord", F.lit(ord))
            out[i] = t if out[i] is None else out[i].unionByName(t)
    if out[0] is None:
        raise ValueError("no chunk graph was built")
    return tuple(out)


def load_fragments(spark: SparkSession, folder: str) -> DataFrame:
    """file, nodes, edges, hyperedges of all chunk_*.json of a folder; a folder without any is an error."""
    out = spark.read.schema(FRAGMENT).option("multiLine", True).option("pathGlobFilter", "chunk_*.json").json(folder).withColumn("file", _file_name())
    if out.isEmpty():
        raise FileNotFoundError(f"no chunk_*.json in {folder}")
    return out


def load_labels(spark: SparkSession, folder: str) -> DataFrame:
    """repo, community, name of all label files (a JSON object of names by number); anchor files are left out."""
    text = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True).withColumn("file", _file_name())
    rows = text.where(~F.endswith("file", F.lit(".anchors.json"))).select(F.regexp_replace("file", r"\.json$", "").alias("repo"), F.explode(F.from_json("value", "MAP<STRING, STRING>")).alias("k", "name"))
    return rows.select("repo", F.expr("try_cast(k as bigint)").alias("community"), "name")


def load_anchors(spark: SparkSession, folder: str) -> DataFrame:
    """repo, entry (position), label, size, anchors of all anchor files."""
    docs = spark.read.schema(ANCHORS).option("multiLine", True).option("pathGlobFilter", "*.anchors.json").json(folder).withColumn("file", _file_name())
    return docs.select(F.regexp_replace("file", r"\.anchors\.json$", "").alias("repo"), F.posexplode("communities").alias("entry", "x")).select("repo", "entry", "x.*")


def load_questions(spark: SparkSession, path: str) -> DataFrame:
    """qid, question, mode, depth, token_budget, suite (the digest of the file)."""
    raw = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("suite"), F.from_json(F.col("content").cast("string"), QUESTIONS).alias("x"))
    return raw.select("suite", F.explode("x.questions").alias("q")).select(F.col("q.id").alias("qid"), "q.question", F.coalesce("q.mode", F.lit("bfs")).alias("mode"), F.coalesce("q.depth", F.lit(3)).alias("depth"), F.coalesce("q.token_budget", F.lit(2000)).alias("token_budget"), "suite")


def load_rubric(spark: SparkSession, path: str) -> DataFrame:
    """task, item, any."""
    tasks = spark.read.schema(TASKS).option("multiLine", True).json(path).select(F.explode("tasks").alias("t"))
    return tasks.select(F.col("t.id").alias("task"), F.explode("t.rubric").alias("r")).select("task", F.col("r.id").alias("item"), F.col("r.any").alias("any"))
