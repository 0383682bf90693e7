"""Joins that assemble the flat patient table and attach predictions or labels.

Join strategies are left to Catalyst: statistics decide on a broadcast, and
adaptive execution splits skewed partitions of the sort-merge form.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def assemble(patients: DataFrame, records: DataFrame, symptoms: DataFrame,
             patient_key: str, record_key: str) -> DataFrame:
    """patient 1-N record 1-1 symptoms."""
    return patients.join(records, patient_key).join(symptoms, record_key)


def attach_predictions(records: DataFrame, predictions: DataFrame, key: str) -> DataFrame:
    """Every record with its prediction, or nulls."""
    return records.join(predictions, key, "left")


def without_match(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Records that have no partner: unscored records, unlabelled documents."""
    return left.join(right.select(key), key, "left_anti")


def attach_labels(docs: DataFrame, labels: DataFrame, key: str) -> DataFrame:
    return docs.join(labels, key)
