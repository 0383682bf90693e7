"""Run log: append, latest run, best metric per model, configuration drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.ordering import previous_value
from riskframe.spec import RUN_SCHEMA


def run_record(spark: SparkSession, **values) -> DataFrame:
    """One run as a typed row with its nested object."""
    row = tuple(values.get(f.name) for f in RUN_SCHEMA)
    return spark.createDataFrame([row], RUN_SCHEMA)


def append_run(run: DataFrame, path: str) -> None:
    run.write.mode("append").json(path)


def latest_run(runs: DataFrame, ts: str, run_id: str) -> DataFrame:
    """The newest run as one row: a max of structs, no sort."""
    rest = [c for c in runs.columns if c not in (ts, run_id)]
    return runs.agg(F.max(F.struct(ts, run_id, *rest)).alias("r")).select("r.*").select(*runs.columns)


def best_per_model(runs: DataFrame, model: str, metric: str, ts: str, run_id: str) -> DataFrame:
    """Best run of each model: metric, then recency, then id. Combines before the shuffle."""
    return runs.groupBy(model).agg(
        F.max(F.struct(metric, ts, run_id)).alias("r")
    ).select(model, f"r.{metric}", f"r.{ts}", f"r.{run_id}")


def config_drift(
    runs: DataFrame, by: Sequence[str], ts: str, run_id: str, config: str,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Digest of each run's configuration and whether it differs from the run before."""
    hashed = runs.select(
        *by, ts, run_id, F.sha2(F.col(config), 256).alias("config_sha"),
        F.struct(ts, run_id).alias("_at"),
    )
    prev = previous_value(hashed, by, "_at", "config_sha", "previous_sha", rows_per_range)
    changed = F.col("previous_sha").isNotNull() & (F.col("previous_sha") != F.col("config_sha"))
    return prev.select(*by, ts, run_id, "config_sha", changed.cast("int").alias("changed"))
