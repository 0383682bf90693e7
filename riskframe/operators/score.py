"""Scoring: the same clean and prepare plan as training, then a model, in one narrow stage."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import columns as C
from riskframe.operators.clean import clean_features, record_from_json
from riskframe.operators.prepare import PrepModel
from riskframe.spec import FeatureSpec


@dataclass(frozen=True)
class LinearScore:
    """A logistic model with known coefficients, as a plain expression."""

    intercept: float
    coef: Mapping[str, float]

    def margin(self) -> Column:
        out = F.lit(self.intercept)
        for c, w in self.coef.items():
            out = out + F.lit(w) * F.col(f"`{c}`")
        return out

    def predict(self, prepared: DataFrame) -> DataFrame:
        p = 1.0 / (1.0 + F.exp(-self.margin()))
        scored = prepared.withColumn("p", p)
        return scored.withColumn("yhat", F.when(F.col("p") > 0.5, 1).otherwise(0))


def score(
    raw: DataFrame,
    spec: FeatureSpec,
    prep: PrepModel,
    predict: Callable[[DataFrame], DataFrame],
    flag_mode: str = "lenient",
) -> DataFrame:
    """Append ``predicted_label`` and ``predicted_probability`` to the original columns.

    ``predict`` maps prepared rows to rows with ``yhat`` and ``p``. The input rides
    along as a struct, so its names and values come back untouched.
    """
    packed = F.struct(*[F.col(f"`{c}`") for c in raw.columns]).alias("_input")
    names = [C.normalise_name(c) for c in raw.columns]
    if len(set(names)) != len(names):
        raise ValueError("headers collide after normalising")
    used = [
        F.col(f"`{c}`").alias(n) for c, n in zip(raw.columns, names, strict=True) if n in spec.features
    ]
    features = clean_features(raw.select(packed, *used).withColumnRenamed("_input", "input"),
                              spec, flag_mode)
    scored = predict(prep.transform(features))
    return scored.select(
        "input.*",
        C.decode_label(F.col("yhat"), spec.labels).alias("predicted_label"),
        F.round("p", 4).alias("predicted_probability"),
    )


def score_records(
    df: DataFrame,
    column: str,
    spec: FeatureSpec,
    prep: PrepModel,
    predict: Callable[[DataFrame], DataFrame],
    model_name: str,
    flag_mode: str = "lenient",
) -> DataFrame:
    """Score partial JSON records; absent fields take the training defaults."""
    typed = record_from_json(df, column, spec, flag_mode)
    return predict(prep.transform(typed)).select(
        *df.columns,
        F.col("yhat").alias("prediction"),
        C.decode_label(F.col("yhat"), spec.labels).alias("label"),
        F.col("p").alias("probability"),
        F.lit(model_name).alias("model_used"),
    )


def input_report(raw: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Features a batch lacks; nothing to report for a single record."""
    present = {C.normalise_name(c) for c in raw.columns}
    absent = [c for c in spec.features if c not in present]
    if len(raw.limit(2).take(2)) < 2:
        absent = []
    return raw.sparkSession.createDataFrame(
        [(c, "filled with training default") for c in absent], "column string, action string"
    )


def apply_threshold(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    return scored.withColumn("yhat", C.decide(F.col("p"), threshold))
