"""Session helpers: the shared working folder, lineage cuts and shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where a session names no spark.checkpoint.dir, as in local tests.
FALLBACK_DIR = "file:///tmp/checkpoints/quire"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_shipped: dict[str, str] = {}


def local_session(name: str = "quire", cores: int | str = "*", **conf) -> SparkSession:
    """A local session for tests and benchmarks."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    settings = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    for k, v in {**settings, **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, set here only where it is unset and all is one process."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None:
        if not base and context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(base or FALLBACK_DIR)
    return base or context.getCheckpointDir()


def work_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/quire/{name}-{uuid.uuid4().hex[:12]}"


@contextmanager
def passing_shuffles(spark: SparkSession) -> Iterator[None]:
    """Frames made and writes begun inside lose their shuffle files when an action on them ends, not when the driver collects its garbage.

    Another action on such a frame makes the files again.
    """
    was = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if was is None else spark.conf.set(_CLEANUP, was)


@contextmanager
def small_batches(spark: SparkSession, most: int = 4 << 20) -> Iterator[None]:
    """Actions inside send Python workers Arrow batches of about `most` bytes, or of one longer row, not 10,000 rows of any length."""
    was = spark.conf.get(_BATCH_BYTES, None)
    spark.conf.set(_BATCH_BYTES, str(most))
    try:
        yield
    finally:
        spark.conf.unset(_BATCH_BYTES) if was is None else spark.conf.set(_BATCH_BYTES, was)


def cut(df: DataFrame) -> DataFrame:
    """Compute df once and cut its lineage by a reliable checkpoint in the shared folder; its shuffle files go."""
    shared_dir(df.sparkSession)
    with passing_shuffles(df.sparkSession):
        own = df.select("*")
    return own.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each Spark application."""
    context = spark.sparkContext
    key = context.applicationId
    if key in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="quire-"), "quire.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(target)
    _shipped[key] = target
