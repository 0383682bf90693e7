"""Training on tables whose categorical columns grow with the data."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from riskframe.config import RunConfig
from riskframe.functions.staging import stage
from riskframe.operators import evaluate
from riskframe.operators.clean import clean
from riskframe.operators.split import apply_split, fit_split
from riskframe.operators.wide import WideLogistic, fit_wide, fit_wide_logistic
from riskframe.spec import FeatureSpec


@dataclass(frozen=True)
class WideResult:
    model: WideLogistic
    train: DataFrame                    # assembled training rows, written
    scored: DataFrame                   # (model, id, y, p, yhat) of the test rows, written
    metrics: DataFrame


def train_wide(raw: DataFrame, spec: FeatureSpec, config: RunConfig = RunConfig(), out_dir: str | None = None) -> WideResult:
    """Clean, split, prepare and fit the logistic model; the model goes to ``out_dir`` if given.

    Trees and the kernel classifier read one column for each category and stay with ``train``.
    """
    table = stage(clean(raw, spec, config.clean), "cleaned")
    label = spec.target if config.split.stratify else None
    table = apply_split(table, fit_split(table, spec.id, label, config.split.test_size, config.split.seed))
    rows, held = (table.where(F.col("split") == part) for part in ("train", "test"))
    prep = fit_wide(rows, spec)
    assembled = prep.assemble(rows)
    model = fit_wide_logistic(assembled, spec.target, prep, config.logistic)
    scored = stage(model.predict(prep.transform(held)).select(
        F.lit(model.name).alias("model"), spec.id, F.col(spec.target).alias("y"), "p", "yhat"), "scored")
    if out_dir:
        model.save(out_dir)
    return WideResult(model, assembled, scored, evaluate.comparison(scored))
