"""Selections, first matches, first-wins dedup and packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import Scratch


def select_chunks(chunks: DataFrame, only: list[str] | None = None, skip_added: bool = False) -> DataFrame:
    """The named chunks, or all; skip_added keeps labelled and semantic ones. Unknown names are an error."""
    if only:
        known = {r["name"] for r in chunks.select("name").distinct().collect()}  # the chunk map is a fixed, small table
        if missing := sorted(set(only) - known):
            raise ValueError(f"unknown chunks: {', '.join(missing)}")
        chunks = chunks.where(F.col("name").isin(only))
    return chunks.where("labelled OR kind = 'semantic'") if skip_added else chunks


def first_reason(path, rules: list[tuple[str, str]]):
    """The reason of the first rule whose prefix is the path itself or a parent folder of it, else null."""
    path = F.col(path) if isinstance(path, str) else path
    out = F.lit(None).cast("string")
    for prefix, reason in reversed(rules):
        out = F.when((path == prefix) | F.startswith(path, F.lit(prefix + "/")), F.lit(reason)).otherwise(out)
    return out


def first_wins(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first in the given total order. A hot key's rows are reduced before they are shuffled."""
    rest = [c for c in rows.columns if c not in key and c not in order]
    best = rows.groupBy(*key).agg(F.min(F.struct(*order, *rest)).alias("first"))
    return best.select(*key, *[F.col("first")[c].alias(c) for c in [*order, *rest]])


def unclaimed(files: DataFrame, claimed: DataFrame, key: str) -> DataFrame:
    return files.join(claimed.select(key).distinct(), key, "left_anti")


def packed(files: DataFrame, folder: str, name: str, size: int = 20) -> DataFrame:
    """Adds ``chunk``, from 1: groups of ``size`` in (folder, name) order; a group may span folders.

    Rows are dealt into ranges of that order and written, so a row's place in its range is fixed; where a range starts is a running
    sum over the ranges' counts, one row a partition.
    """
    scratch = Scratch(files.sparkSession, "packed")
    dealt = files.repartitionByRange(folder, name).withColumn("__part", F.spark_partition_id())
    inside = Window.partitionBy("__part").orderBy(folder, name)
    ranked = scratch.save(dealt.withColumn("__at", F.row_number().over(inside)))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ranked.groupBy("__part").agg(F.count("*").alias("n")).select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at") - 1
    return ranked.join(F.broadcast(starts), "__part").withColumn("chunk", (F.floor(place / size) + 1).cast("long")).drop("__part", "__start", "__at")
