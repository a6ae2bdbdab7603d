"""Cutting lineage after costly steps, on the shared folder the cluster names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a scratch folder only in local mode with none set.

    Checkpoints that are no longer used go with ``spark.cleaner.referenceTracking.cleanCheckpoints``; tables written
    to fresh folders stay until whoever runs the session removes the folder.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    if current:
        return current
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if context.master != "local" and not context.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="tertulia-checkpoint-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder that does not exist yet, on the storage that checkpoints use."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Compute once and keep on reliable storage, so that retries do not repeat the work before."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
