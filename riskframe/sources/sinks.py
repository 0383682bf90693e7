"""Table sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, functions as F

METRIC_COLUMNS = ("model", "accuracy", "precision", "recall", "f1_score", "roc_auc")


def write_processed(df: DataFrame, path: str) -> None:
    """Prepared rows, one folder per fold, so a reader of one fold skips the other."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


write_splits = write_processed


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The comparison table: one row per model, hence one file."""
    metrics.select(*METRIC_COLUMNS).coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_scored(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.format(fmt).save(path)


def append_scored(df: DataFrame, path: str) -> None:
    """Append scored records under the columns the log already has, matched by name.

    Other names or types raise, as a later read of the log could not tell them apart.
    """
    try:
        log = df.sparkSession.read.parquet(path).dtypes
    except AnalysisException as exc:
        if exc.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        log = df.dtypes
    if dict(log) != dict(df.dtypes):
        raise ValueError(f"the log has {log}, not {df.dtypes}")
    df.select(*[F.col(f"`{c}`") for c, _ in log]).write.mode("append").parquet(path)
