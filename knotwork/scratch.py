"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .shipping import ship

CHECKPOINT_KEY = "spark.checkpoint.dir"
#: Most rows of a file of a table of the graph. Rows of ids take a few bytes there, so Spark, which counts 4 MB for opening a file and
#: fills a task with 128 MB, would else read tens of millions of them in one task. So it reads 32 files of them at most.
FILE_ROWS = 100_000
#: Rows that a task gets of what is dealt out.
TASK_ROWS = 500_000
_own_root: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set, a temporary one in local mode, and an error on a cluster."""
    root = spark.sparkContext.getConf().get(CHECKPOINT_KEY) or spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"set {CHECKPOINT_KEY} to a folder that driver and executors share")
    if not _own_root:
        _own_root.append("file://" + tempfile.mkdtemp(prefix="knotwork-"))
    return _own_root[0]


def tasks(rows: int) -> int:
    """How many tasks so many rows are dealt to."""
    return max(1, -(-rows // TASK_ROWS))


class Scratch:
    """Written tables cut lineage: a lost executor costs a reread, not a rerun, and an iteration's plan stays short."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.base = f"{shared_root(spark)}/knotwork/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def save(self, df: DataFrame, compression: str = "zstd", rows: int = 0) -> DataFrame:
        """Writes a table and reads it. rows: the most that a file has, if given."""
        self.count += 1
        path = f"{self.base}/{self.count}"
        df.write.option("compression", compression).option("maxRecordsPerFile", rows).parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def _path(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def write_text(self, name: str, text: str) -> str:
        """Writes one small file below the scratch folder, whatever store that is in, and returns its path."""
        full = f"{self.base}/{name}"
        path, store = self._path(full)
        out = store.create(path, True)
        try:
            out.write(bytearray(text.encode("utf-8")))
        finally:
            out.close()
        return full

    def drop(self, saved: DataFrame) -> None:
        """Deletes a saved table that no later plan reads."""
        path, store = self._path(saved._scratch_path)
        store.delete(path, True)

    def keep_only(self, *saved: DataFrame) -> None:
        """Deletes all other tables saved so far."""
        kept = {s._scratch_path for s in saved}
        for name in [p for p in self.paths if p not in kept]:
            path, store = self._path(name)
            store.delete(path, True)
        self.paths = [p for p in self.paths if p in kept]
