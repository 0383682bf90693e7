"""A log of batches with commits: repeated appends add nothing, readers see whole batches only.

A batch goes to a folder of its own, and a commit names it once all its rows are there. A job that
dies before the commit leaves rows that no reader sees and that its repetition overwrites; a batch
that is committed is not written again. Batches are told apart by the caller's id, such as the id
of a streaming batch, so one id must always stand for the same rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

_COMMIT = "batch_id long"
#: The folder column; an own column of this name cannot be logged.
BATCH = "log_batch"


@dataclass(frozen=True)
class BatchLog:
    """The log under ``path``; ``rows`` holds the batches, ``commits`` one file for each whole one."""

    spark: SparkSession
    path: str

    def committed(self) -> DataFrame:
        """The ids of whole batches, empty for a new log."""
        try:
            return self.spark.read.schema(_COMMIT).json(f"{self.path}/commits/*")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _COMMIT)

    def write(self, rows: DataFrame, batch_id: int) -> None:
        """Rows of a batch that is not committed yet; overwrites what a dead job left."""
        if BATCH in rows.columns:
            raise ValueError(f"{BATCH} is the name of the batch folders")
        rows.write.mode("overwrite").parquet(f"{self.path}/rows/{BATCH}={batch_id}")

    def append(self, rows: DataFrame, batch_id: int) -> bool:
        """Write and commit a batch; False, and nothing written, if it is committed already."""
        if not self.committed().where(F.col("batch_id") == batch_id).isEmpty():
            return False
        self.write(rows, batch_id)
        self.spark.createDataFrame([(batch_id,)], _COMMIT).coalesce(1).write.mode("overwrite").json(
            f"{self.path}/commits/{BATCH}={batch_id}")
        return True

    def read(self, schema, before: int | None = None) -> DataFrame:
        """Rows of whole batches, of those with a smaller id when ``before`` is given.

        ``schema`` is that of the appended rows. Batches are pruned by their folder.
        """
        chosen = self.committed() if before is None else self.committed().where(F.col("batch_id") < before)
        try:
            logged = self.spark.read.schema(schema).parquet(f"{self.path}/rows")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)
        if BATCH not in logged.columns:
            return self.spark.createDataFrame([], schema)
        return logged.join(chosen, F.col(BATCH) == F.col("batch_id"), "left_semi").drop(BATCH)
