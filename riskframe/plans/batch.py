"""Batch scoring jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskframe.operators.score import input_report, score, score_records
from riskframe.plans.registry import ModelStore
from riskframe.sources.readers import read_csv_checked
from riskframe.sources.sinks import write_scored
from riskframe.spec import FeatureSpec


def score_table(raw: DataFrame, spec: FeatureSpec, store: ModelStore, name: str | None = None) -> DataFrame:
    """Original columns plus label and probability; one narrow stage, no shuffle.

    Model, preparation and flag mode are of one saved version, whatever is saved meanwhile.
    """
    store = store.pinned()
    return score(raw, spec, store.prep(), store.model(name).predict, store.flag_mode())


def score_csv(
    spark: SparkSession, source: str, target: str, spec: FeatureSpec, store: ModelStore, name: str | None = None
) -> DataFrame:
    """Write the scored file; returns the features that the batch lacks and how they were filled.

    Records with more or fewer fields than the header are not scored but written as they stand to
    ``<target>_rejects``.
    """
    raw, rejects = read_csv_checked(spark, source)
    rejects.write.mode("overwrite").text(f"{target.rstrip('/')}_rejects")
    write_scored(score_table(raw, spec, store, name), target, "csv")
    return input_report(raw, spec)


def score_json_records(
    df: DataFrame, column: str, spec: FeatureSpec, store: ModelStore, name: str | None = None
) -> DataFrame:
    store = store.pinned()
    model = store.model(name)
    return score_records(df, column, spec, store.prep(), model.predict, model.name, store.flag_mode())
