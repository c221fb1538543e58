"""Session plumbing shared by the operators: work folder, worker path, sizes."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
#: What a plan's statistics say when Spark knows nothing about the input.
_UNKNOWN_BYTES = 1 << 60


def prepare(spark: SparkSession) -> None:
    """Let Python workers import this package."""
    sc = spark.sparkContext
    known = sc.environment.get("PYTHONPATH", "")
    if _ROOT not in known.split(":"):
        sc.environment["PYTHONPATH"] = f"{_ROOT}:{known}" if known else _ROOT


def work_folder(spark: SparkSession) -> str:
    """The shared folder for checkpoints and files.

    ``spark.checkpoint.dir`` of the session, or the folder that the context was given; only where both are unset, in local
    mode (tests), a temporary folder is taken, and removed at exit. With ``spark.cleaner.referenceTracking.cleanCheckpoints`` Spark removes old checkpoints itself.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="eventide-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        folder = "file://" + path
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, keep it in the shared checkpoint folder and cut its lineage."""
    prepare(df.sparkSession)
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def plan_bytes(df: DataFrame) -> int | None:
    """Size of the input as the optimizer estimates it, or None where it has no estimate."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return None if size >= _UNKNOWN_BYTES else size


def sample_fraction(df: DataFrame, rows: int, row_bytes: int) -> float:
    """Fraction that gives about ``rows`` rows of ``df``; only for choosing boundaries."""
    size = plan_bytes(df)
    if size is None:
        return min(1.0, rows / max(1, df.count()))
    return min(1.0, rows * row_bytes / max(1, size))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
