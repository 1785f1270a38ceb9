"""Incremental ingestion of changed texts: a file stream, fingerprints, and a batch for what is new."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.quality import exists


def ingest(spark: SparkSession, folder: str, schema: str, key: str, text: str, snapshot: str, checkpoint: str, apply: Callable[[DataFrame], None]) -> None:
    """Takes all Parquet files of a folder that earlier runs haven't seen and hands ``apply`` the rows whose text is new or changed.

    The stream stops when it has taken what is there. Fingerprints are written by batch, so a batch that is repeated after a failure
    overwrites its own and changes nothing else.
    """
    def batch(rows: DataFrame, number: int) -> None:
        # a null text has a fingerprint of its own, so it doesn't count as changed for ever
        now = rows.withColumn("fingerprint", F.coalesce(F.md5(text), F.lit("null")))
        if exists(spark, snapshot):
            seen = spark.read.parquet(snapshot).where(F.col("batch") != number).groupBy(F.col(key).alias("__key")).agg(F.max_by("fingerprint", "batch").alias("__seen"))
            now = now.join(seen, F.col(key).eqNullSafe(F.col("__key")) & (F.col("fingerprint") == F.col("__seen")), "left_anti")
        now = now.select(*rows.columns, "fingerprint").persist()
        apply(now.drop("fingerprint"))
        now.select(key, "fingerprint").write.mode("overwrite").parquet(f"{snapshot}/batch={number}")
        now.unpersist()

    stream = spark.readStream.schema(schema).parquet(folder)
    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
