"""Makes this package importable in the Python workers of a session's executors."""

from __future__ import annotations

import hashlib
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Hands the package to Spark as a zip file, once per application; Spark itself takes it to the executors."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    if not root.is_dir():  # already running from a zip file
        return
    files = sorted(p for p in root.rglob("*.py"))
    digest = hashlib.sha256(b"".join(p.read_bytes() for p in files)).hexdigest()[:16]
    target = os.path.join(tempfile.mkdtemp(prefix="knotwork-"), f"knotwork-{digest}.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for p in files:
            archive.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped[context.applicationId] = target
