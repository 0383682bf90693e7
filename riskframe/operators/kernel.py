"""Kernel SVM by random Fourier features, with calibrated probabilities.

An exact RBF solver is quadratic in rows. Random features (Rahimi & Recht, 2007)
turn the kernel into a dot product of ``components`` cosines, so a linear SVM on
them is linear in rows. Scores become probabilities by Platt's method (1999),
fitted on out-of-fold scores. All folds and the fit on all rows go through the same staged rows
(``margins``), which hold the inputs; a step computes the cosines of a block of rows at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskframe.config import KernelConfig
from riskframe.functions.staging import stage
from riskframe.operators import margins
from riskframe.operators.learn import SVM, WEIGHT, assembler
from riskframe.operators.split import apply_folds, fit_folds
from riskframe.sources.readers import read_json

_PARAMS = (
    "columns array<string>, gamma double, components int, seed bigint, coefficients array<double>, "
    "slope double, offset double"
)


def kernel_gamma(train: DataFrame, columns: Sequence[str]) -> float:
    """1 / (width * variance of all matrix entries)."""
    cells = [F.col(f"`{c}`") for c in columns]
    total, squares, n = train.agg(
        F.sum(sum(cells[1:], cells[0])),
        F.sum(sum((c * c for c in cells[1:]), cells[0] * cells[0])),
        F.count("*"),
    ).first()
    size = n * len(columns)
    return 1.0 / (len(columns) * (squares / size - (total / size) ** 2))


def fourier_map(width: int, gamma: float, components: int, seed: int) -> Callable[[np.ndarray], np.ndarray]:
    """x -> sqrt(2/D) cos(Wx + b) for a matrix of rows."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0.0, np.sqrt(2.0 * gamma), (width, components))
    b = rng.uniform(0.0, 2.0 * np.pi, components)
    scale = np.sqrt(2.0 / components)
    return lambda x: scale * np.cos(x @ w + b)


def _inputs(columns: Sequence[str]) -> Column:
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def fit_sigmoid(scores: DataFrame, score: str, target: str) -> tuple[float, float]:
    """Slope and offset of p = 1 / (1 + exp(-(slope * score + offset))).

    Platt's smoothed targets are expressed as two weighted rows per example.
    """
    pos, neg = scores.agg(F.sum(F.col(target)), F.sum(1 - F.col(target))).first()
    hi, lo = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
    t = F.when(F.col(target) == 1, hi).otherwise(lo)
    pairs = scores.select(F.col(score).alias("_s"), F.inline(F.array(
        F.struct(F.lit(1).alias("_label"), t.alias("_w")),
        F.struct(F.lit(0).alias("_label"), (1 - t).alias("_w")),
    )))
    vec = assembler(["_s"])
    fit = LogisticRegression(labelCol="_label", weightCol="_w", regParam=0.0, maxIter=100).fit(
        vec.transform(pairs))
    return float(fit.coefficients[0]), float(fit.intercept)


def apply_sigmoid(score: Column, slope: float, offset: float) -> Column:
    return 1.0 / (1.0 + F.exp(-(F.lit(slope) * score + F.lit(offset))))


@dataclass(frozen=True)
class KernelSvm:
    """Fitted kernel classifier with the same interface as ``Classifier``."""

    name: str
    columns: tuple[str, ...]
    gamma: float
    config: KernelConfig
    #: One for each component, the intercept last.
    coefficients: tuple[float, ...]
    slope: float
    offset: float

    def decision(self, prepared: DataFrame) -> DataFrame:
        """``prepared`` with ``score``; one matrix product per Arrow batch, no vector column."""
        width, beta = len(self.columns), np.array(self.coefficients)
        features = fourier_map(width, self.gamma, self.config.components, self.config.seed)

        @F.arrow_udf(T.DoubleType())
        def score(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), width)
            return pa.array(features(flat) @ beta[:-1] + beta[-1])

        return prepared.withColumn("score", score(_inputs(self.columns)))

    def predict(self, prepared: DataFrame) -> DataFrame:
        p = apply_sigmoid(F.col("score"), self.slope, self.offset)
        return self.decision(prepared).withColumn("p", p).drop("score").withColumn(
            "yhat", F.when(F.col("p") > 0.5, 1).otherwise(0))

    def save(self, path: str) -> None:
        row = (list(self.columns), self.gamma, self.config.components, self.config.seed, list(self.coefficients),
               self.slope, self.offset)
        SparkSession.active().createDataFrame([row], _PARAMS).coalesce(1).write.mode("overwrite").json(f"{path}/params")


def load_kernel(spark: SparkSession, path: str) -> KernelSvm:
    r = read_json(spark, f"{path}/params", T.StructType.fromDDL(_PARAMS)).first()
    config = KernelConfig(components=r["components"], seed=r["seed"])
    return KernelSvm(SVM, tuple(r["columns"]), r["gamma"], config, tuple(r["coefficients"]), r["slope"], r["offset"])


def _staged(rows: DataFrame, target: str, columns: Sequence[str], fold: str | None) -> DataFrame:
    """The inputs as narrow rows; their cosines, many times as wide, are not kept."""
    return stage(margins.pack(rows.withColumn("_x", _inputs(columns)), "_x", target, WEIGHT, fold), "kernel_rows")


def _fit(rows: DataFrame, left_out: Sequence[int], config: KernelConfig, features: Callable) -> list[np.ndarray]:
    return margins.fit_margins(rows, left_out, config.components, config.c, config.max_iter, config.tol, features)


def fit_kernel_svm(
    train: DataFrame, target: str, columns: Sequence[str], config: KernelConfig = KernelConfig()
) -> KernelSvm:
    """Uncalibrated fit on all rows (slope 1, offset 0)."""
    gamma = kernel_gamma(train, columns)
    features = fourier_map(len(columns), gamma, config.components, config.seed)
    (beta,) = _fit(_staged(train, target, columns, None), [margins.ALL], config, features)
    return KernelSvm(SVM, tuple(columns), gamma, config, tuple(beta.tolist()), 1.0, 0.0)


def fit_calibrated_svm(
    train: DataFrame, id_col: str, target: str, columns: Sequence[str], config: KernelConfig = KernelConfig()
) -> KernelSvm:
    """Out-of-fold scores from ``folds`` fits, one sigmoid on them, and a fit on all rows.

    Fold membership is a comparison of the id's hash with fitted cuts. All fits go through the
    same staged rows, those of the folds with one scan per step for all of them.
    """
    gamma = kernel_gamma(train, columns)
    features = fourier_map(len(columns), gamma, config.components, config.seed)
    folded = apply_folds(train, fit_folds(train, id_col, target, config.folds, config.seed))
    rows = _staged(folded, target, columns, "fold")
    folds = list(range(config.folds))
    *parts, whole = _fit(rows, [*folds, margins.ALL], config, features)
    scores = stage(margins.held_out_scores(rows, folds, parts, features), "held_out_scores")
    slope, offset = fit_sigmoid(scores, "score", "label")
    return KernelSvm(SVM, tuple(columns), gamma, config, tuple(whole.tolist()), slope, offset)
