"""The pipeline's stages against what they must keep and drop."""

from __future__ import annotations

import duckdb
import pytest

from knotwork.llm import decontamination, language_id, near_dedup

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_pipeline(spark, small, tmp_path):
    docs = before = spark.read.parquet(f"{small}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, small)
        if name != "token_binary":
            assert out.columns == before.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = [r["doc_id"] for r in docs.select("doc_id").collect()]
    everything = [r["doc_id"] for r in before.select("doc_id").collect()]
    assert len(kept["language_id"]) >= 0.99 * len(everything)
    classes = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(spark.read.parquet(str(tmp_path / "language_id"))).collect()}
    assert sorted(kept["near_dedup"]) == sorted(set(classes.values()))
    leaks = {r["doc_id"] for r in decontamination.leaks(before, spark.read.parquet(f"{small}/benchmark.parquet")).collect()}
    assert set(kept["decontamination"]) == set(kept["near_dedup"]) - leaks
    assert set(kept["mixing"]) <= set(kept["decontamination"])
    assert sorted(kept["token_binary"]) == sorted(kept["mixing"])
    items = [t for (t,) in duckdb.connect().execute(f"SELECT text FROM '{small}/benchmark.parquet'").fetchall()]
    left = [r["text"] for r in spark.read.parquet(str(tmp_path / "decontamination")).collect()]
    assert not any(i in t for i in items for t in left)


def test_run_equals_stages(spark, small):
    rows = corpus_pipeline.run(spark, small)
    assert rows.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and rows.count() > 0
    assert language_id is not None
