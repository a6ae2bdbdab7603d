"""Answers of a reviewer or summariser that outlive the job that asked for them."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = "prompt_key string, answer string, error string"
#: Files of finished tasks stay when the job ends before its last task.
TASK_COMMIT = {"mapreduce.fileoutputcommitter.algorithm.version": "2"}


class AnswerStore:
    """A folder of Parquet files, one subfolder per run, keyed by a digest of the prompt.

    A task's answers are there as soon as the task has ended, whatever becomes of the job, unless the storage has a
    committer of its own that publishes whole jobs. An answer that came is final, a null one too; one with an error is
    asked again by the next run. Take one folder per model and settings: the key knows the prompt alone. Runs may overlap;
    then a prompt may be asked by both, and the earlier run's answer counts.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def attempts(self) -> DataFrame:
        """``prompt_key, answer, error, run``: every answer and failure. Runs a job where the store is new."""
        empty = self.spark.createDataFrame([], SCHEMA)
        empty.write.mode("ignore").parquet(f"{self.path}/run=0")
        return self.spark.read.schema(f"{SCHEMA}, run long").parquet(self.path)

    def unanswered(self, prompts: DataFrame) -> DataFrame:
        """The prompts that have no answer yet. Only keys of the store are moved."""
        done = self.attempts().where("error is null").select("prompt_key").distinct()
        return prompts.join(done, "prompt_key", "left_anti")

    def add(self, answers: DataFrame) -> None:
        """Write ``prompt_key, answer, error`` as a new run, task by task."""
        target = f"{self.path}/run={time.time_ns()}"
        answers.select("prompt_key", "answer", "error").write.options(**TASK_COMMIT).parquet(target)

    def answers_to(self, keys: DataFrame) -> DataFrame:
        """``prompt_key, answer, error, run`` of the asked keys: the first answer, else the last error.

        A key has as many rows as it had attempts, so no key is large.
        """
        known = self.attempts().join(keys.select("prompt_key").distinct(), "prompt_key", "left_semi")
        failed = F.col("error").isNotNull()
        place = [failed, F.when(failed, -F.col("run")).otherwise(F.col("run")), F.col("answer"), F.col("error")]
        ranked = known.withColumn("_rank", F.row_number().over(Window.partitionBy("prompt_key").orderBy(*place)))
        return ranked.where("_rank = 1").drop("_rank")
