"""Training job: raw table in; models, metrics and a run record out."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, functions as F

from riskframe.config import RunConfig
from riskframe.functions.concurrently import run_together
from riskframe.functions.staging import stage
from riskframe.operators import evaluate, kernel, learn
from riskframe.operators.clean import clean, rejected
from riskframe.operators.prepare import PrepModel, fit_prep
from riskframe.operators.runs import append_run, run_record
from riskframe.operators.split import apply_split, fit_split
from riskframe.plans.registry import ModelStore
from riskframe.sources.sinks import write_metrics, write_processed, write_scored
from riskframe.spec import FeatureSpec


@dataclass(frozen=True)
class TrainResult:
    metrics: DataFrame
    best: str
    models: Mapping
    prep: PrepModel
    scored: DataFrame
    rejected: DataFrame                 # rows with a missing or unknown label, as a written table


def prepare_folds(raw: DataFrame, spec: FeatureSpec, config: RunConfig) -> tuple[DataFrame, PrepModel]:
    """Clean, split and prepare: a staged table with ``split`` and all model columns.

    The cleaned table is staged because the split and the fits scan it several times.
    """
    table = stage(clean(raw, spec, config.clean), "cleaned")
    label = spec.target if config.split.stratify else None
    cuts = fit_split(table, spec.id, label, config.split.test_size, config.split.seed)
    table = apply_split(table, cuts)
    prep = fit_prep(table.where(F.col("split") == "train"), spec)
    prepared = prep.transform(table).select(spec.id, spec.target, "split", *[F.col(f"`{c}`") for c in prep.order])
    return stage(prepared, "prepared"), prep


def fit_all(train: DataFrame, spec: FeatureSpec, columns: list[str], config: RunConfig) -> dict:
    """The four classifiers on one frame; each fit is distributed and fits may overlap."""
    frame = learn.training_frame(train, spec.target, [spec.id, *columns])
    fits = (
        lambda: learn.fit_logistic(frame, spec.target, columns, config.logistic),
        lambda: learn.fit_tree(frame, spec.target, columns, config.tree),
        lambda: learn.fit_forest(frame, spec.target, columns, config.forest, spec.id),
        lambda: kernel.fit_calibrated_svm(frame, spec.id, spec.target, columns, config.kernel),
    )
    return {m.name: m for m in run_together(train.sparkSession, fits, config.parallelism)}


def score_all(models: Mapping, prepared: DataFrame, spec: FeatureSpec, *keep: str) -> DataFrame:
    """One stacked frame (model, id, y, p, yhat), staged so metrics do not predict again."""
    stacked = None
    for name, m in models.items():
        part = m.predict(prepared).select(
            F.lit(name).alias("model"), spec.id, *keep, F.col(spec.target).alias("y"), "p", "yhat")
        stacked = part if stacked is None else stacked.unionByName(part)
    return stage(stacked, "scored")


def train(
    raw: DataFrame, spec: FeatureSpec, config: RunConfig = RunConfig(), out_dir: str | None = None
) -> TrainResult:
    if config.target_column:
        spec = replace(spec, target=config.target_column)
    spark = raw.sparkSession
    # Rows with an unknown label are kept apart, not lost.
    unknown = stage(rejected(raw, spec), "rejected")
    prepared, prep = prepare_folds(raw, spec, config)
    models = fit_all(prepared.where(F.col("split") == "train"), spec, prep.order, config)
    scored = score_all(models, prepared.where(F.col("split") == "test"), spec)
    metrics = stage(evaluate.comparison(scored), "metrics")
    best = evaluate.best_model(metrics).first()["model"]
    if out_dir:
        write_processed(prepared, f"{out_dir}/processed")
        write_metrics(metrics, f"{out_dir}/model_comparison")
        version = ModelStore(spark, f"{out_dir}/store", spec).save(models, prep, best, config.clean)
        now = datetime.now(UTC)
        snapshot = f"{out_dir}/config_snapshot"
        spark.createDataFrame([(config.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(snapshot)
        write_scored(unknown, f"{out_dir}/rejected")
        append_run(run_record(
            spark, run_id=now.strftime("%Y%m%dT%H%M%SZ"), timestamp_utc=now, best_model_name=best,
            best_model_file=f"versions/{version}/models/{best}", model_dir=f"{out_dir}/store", reports_dir=out_dir,
            config_snapshot_path=snapshot, metrics_path=f"{out_dir}/model_comparison",
        ), f"{out_dir}/runs")
    return TrainResult(metrics, best, models, prep, scored, unknown)
