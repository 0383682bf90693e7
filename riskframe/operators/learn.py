"""Fits of the logistic model, the tree and the forest on one prepared frame."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
import math

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.config import ForestConfig, LogisticConfig, TreeConfig
from riskframe.operators.explain import ranked_importance
from riskframe.operators.prepare import class_weights, weight_expression
from riskframe.operators.trees import DeepForest, TreeModel, grow, grow_deep

WEIGHT = "_weight"
# Gradient fits run one short job per step, so a small table is better in few tasks.
ROWS_PER_TASK = 100_000
LOGISTIC, TREE, FOREST, SVM = "logistic_regression", "decision_tree", "random_forest", "svm"


def assembler(columns: Sequence[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=list(columns), outputCol="features", handleInvalid="error")


@dataclass(frozen=True)
class Classifier:
    """A fitted classifier: prepared columns in, ``p`` and ``yhat`` out."""

    name: str
    model: Transformer

    def predict(self, prepared: DataFrame) -> DataFrame:
        out = self.model.transform(prepared)
        return out.withColumns({
            "p": vector_to_array("probability")[1],
            "yhat": F.col("prediction").cast("int"),
        }).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)


def training_frame(prepared: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    """Feature columns, target and balanced weight.

    A table that arrives in fewer partitions than its size warrants is spread out;
    one that has enough is left where it lies.
    """
    df = prepared.select(target, *[F.col(f"`{c}`") for c in columns])
    weights = class_weights(df, target).collect()
    df = df.withColumn(WEIGHT, weight_expression(target, weights))
    cores = df.sparkSession.sparkContext.defaultParallelism
    parts = min(cores, max(4, sum(r["n"] for r in weights) // ROWS_PER_TASK))
    return df.repartition(parts) if df.rdd.getNumPartitions() < parts else df


def logistic(target: str, total: float, config: LogisticConfig = LogisticConfig()) -> LogisticRegression:
    """The L2-penalised estimator; balanced weights sum to the row count, which sets the scale of C."""
    return LogisticRegression(
        labelCol=target, weightCol=WEIGHT, maxIter=config.max_iter, elasticNetParam=0.0,
        standardization=False, regParam=1.0 / (config.c * total), tol=config.tol,
    )


def fit_logistic(
    train: DataFrame, target: str, columns: Sequence[str], config: LogisticConfig = LogisticConfig()
) -> Classifier:
    vec = assembler(columns)
    total = train.agg(F.sum(WEIGHT)).first()[0]
    fit = logistic(target, total, config).fit(vec.transform(train))
    return Classifier(LOGISTIC, PipelineModel([vec, fit]))


def _both_weights(train: DataFrame, target: str) -> tuple[float, float]:
    """Balanced weights of class 0 and 1; a class without rows weighs 1."""
    found = {r[target]: r["weight"] for r in class_weights(train, target).collect()}
    return float(found.get(0, 1.0)), float(found.get(1, 1.0))


def fit_tree(
    train: DataFrame, target: str, columns: Sequence[str], config: TreeConfig = TreeConfig()
) -> TreeModel:
    """One tree over all thresholds (``max_bins`` None) or a bounded number for each column."""
    weights = _both_weights(train, target)
    nodes = grow(train, target, columns, weights, config.max_depth, config.min_leaf, max_bins=config.max_bins, seed=config.seed)
    return TreeModel(TREE, tuple(columns), nodes, weights)


def fit_forest(
    train: DataFrame, target: str, columns: Sequence[str], config: ForestConfig = ForestConfig(), id_col: str | None = None
) -> TreeModel | DeepForest:
    """Trees on draws of the rows by the hash of ``id_col``, a square root of the columns tried at each node."""
    weights, few = _both_weights(train, target), math.ceil(math.sqrt(len(columns)))
    if config.max_depth is None and config.max_bins:
        return grow_deep(
            FOREST, train, target, columns, weights, config.min_leaf, config.trees, few, config.max_bins, id_col, config.seed)
    nodes = grow(
        train, target, columns, weights, config.max_depth, config.min_leaf, config.trees, few, config.max_bins, id_col, config.seed)
    return TreeModel(FOREST, tuple(columns), nodes, weights)


def importance_table(spark: SparkSession, model: TreeModel | DeepForest, columns: Sequence[str]) -> DataFrame:
    """Impurity importances of a fitted tree or forest, ranked."""
    return ranked_importance(spark, columns, model.importances())
