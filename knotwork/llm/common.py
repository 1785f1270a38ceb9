"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, shared_root
from ..shipping import ship

__all__ = ["Scratch", "hash_unit", "literal_rows", "shared_root", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A DataFrame of a few fixed rows, planned as a literal (no RDD)."""
    fields = [part.strip().split(" ") for part in schema.split(",")]
    if not rows:
        return spark.sql("SELECT " + ", ".join(f"CAST(NULL AS {t}) AS {n}" for n, t in fields) + " WHERE false")
    cells = F.array(*[F.struct(*[F.lit(v).cast(t).alias(n) for v, (n, t) in zip(row, fields, strict=True)]) for row in rows])
    return spark.range(1).select(F.inline(cells))


def hash_unit(*parts) -> F.Column:
    """A uniform number in (0, 1) from 52 bits of the md5 of the parts, joined by colons."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))
