"""What an answer from the graph costs in tokens, against reading its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate

SOURCE = r"src=(\S+)"


def answer_sources(answers: DataFrame) -> DataFrame:
    """qid, source: the distinct sources that an answer's text names. A source name ends at white space."""
    found = F.regexp_extract_all("answer", F.lit(SOURCE), F.lit(1))
    return answers.select("qid", F.explode(F.array_distinct(F.transform(found, lambda s: F.regexp_replace(s, r"\]$", "")))).alias("source"))


def token_ratio(answers: DataFrame, files: DataFrame) -> DataFrame:
    """qid, graph_tokens, source_tokens, source_files, unresolved_files, ratio (one decimal; null without graph tokens).

    files: source, tokens, one row a file; tokens are null for a file that can't be read, which is then unresolved.
    """
    per_source = files.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("tokens").alias("present"), F.count_if(F.col("tokens").isNull()).alias("absent"))
    read = answer_sources(answers).join(per_source, "source").groupBy("qid").agg(F.sum("tokens").alias("source_tokens"), F.sum("present").alias("source_files"), F.sum("absent").alias("unresolved_files"))
    cost = answers.select("qid", token_estimate("answer").alias("graph_tokens"))
    out = cost.join(read, "qid", "left").fillna(0, ["source_tokens", "source_files", "unresolved_files"])
    return out.withColumn("ratio", F.when(F.col("graph_tokens") > 0, F.round(F.col("source_tokens") / F.col("graph_tokens"), 1)))


def totals(ratios: DataFrame) -> DataFrame:
    """One row: questions, sums, overall ratio, median of the ratios, both to one decimal."""
    sums = ratios.agg(F.count("*").alias("questions"), F.sum("graph_tokens").alias("graph_tokens"), F.sum("source_tokens").alias("source_tokens"), F.round(F.expr("percentile(ratio, 0.5)"), 1).alias("median_ratio"))
    return sums.withColumn("ratio", F.when(F.col("graph_tokens") > 0, F.round(F.col("source_tokens") / F.col("graph_tokens"), 1)))


def rubric_coverage(contexts: DataFrame, rubric: DataFrame) -> DataFrame:
    """task, covered, items: rubric items of which any term stands in the task's context, case apart. rubric: task, item, any (array)."""
    text = contexts.select("task", F.lower("context").alias("text"))
    found = rubric.join(text, "task").where(F.exists("any", lambda t: F.contains(F.col("text"), F.lower(t)))).select("task", "item").distinct()
    return rubric.select("task", "item").distinct().join(found.withColumn("hit", F.lit(1)), ["task", "item"], "left").groupBy("task").agg(F.count("hit").alias("covered"), F.count("*").alias("items"))
