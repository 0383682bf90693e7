"""Input frames shared by the catalogue queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.config import CleanConfig
from riskframe.functions.staging import stage
from riskframe.operators.clean import clean
from riskframe.operators.prepare import PrepModel, fit_prep
from riskframe.operators.split import apply_split, fit_split
from riskframe.sources.cohort import clinical_cohort, labelled_documents
from riskframe.spec import CLINICAL

cohort = clinical_cohort
documents = labelled_documents


def typed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned records, copies kept."""
    return clean(cohort(spark, sf_dir), CLINICAL, CleanConfig(remove_duplicates=False))


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned distinct records, staged because every fit below reads them several times."""
    return stage(clean(cohort(spark, sf_dir), CLINICAL), "cleaned")


def split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = cleaned(spark, sf_dir)
    return apply_split(df, fit_split(df, CLINICAL.id, CLINICAL.target))


def train(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(spark, sf_dir).where(F.col("split") == "train")


def fitted(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, PrepModel]:
    df = split(spark, sf_dir)
    return df, fit_prep(df.where(F.col("split") == "train"), CLINICAL)


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fixed scores per record, with ties, as long rows."""
    k, y, j = F.col(CLINICAL.id), F.col(CLINICAL.target), F.col("j")
    p = F.pmod(31 * k + 7 * j * F.pmod(k, F.lit(1009)) + 20 * j * y, F.lit(101)) / F.lit(100.0)
    return (
        typed(spark, sf_dir)
        .select("*", F.explode(F.sequence(F.lit(1), F.lit(4))).alias("j"))
        .withColumn("p", p)
        .select(
            F.concat(F.lit("model_"), j.cast("string")).alias("model"), k, "residence",
            y.alias("y"), "p", F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("yhat"),
        )
    )
