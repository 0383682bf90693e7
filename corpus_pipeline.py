"""Corpus pipeline: rules, ranking, near-duplicates, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs. All but the last keep the columns of documents.
Columns beyond those of documents pass through unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.catalog.registry import query
from riskframe.functions.staging import stage
from riskframe.llm import decontam, lattice, linerules, ranking, resemblance
from riskframe.llm.queries import rank_labels, table
from riskframe.llm.text import session


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the line rules keep, without their failing lines; n_chars follows the text.

    Null, empty and short texts are rejected. Repeated rows are judged alike.
    """
    session(spark)
    return linerules.clean_documents(docs)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking model accepts.

    The model learns from the labelled rows of the documents table, as those that the rules
    rejected are examples of low quality too. Null texts are scored as empty ones.
    """
    model = ranking.fit(table(session(spark), sf_dir, "documents"), rank_labels(spark, sf_dir))
    return docs.where(ranking.score(F.col("text"), model) >= ranking.CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest doc_id.

    Groups are those of the wide SimHash search: five words, similarity 0.8 or more. Null and
    blank texts have an empty fingerprint and count as copies of each other.
    """
    session(spark)
    return resemblance.keep_first(docs, scanned=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; null texts hold none and stay."""
    return decontam.drop_leaks(docs, table(spark, sf_dir, "benchmark"), scanned=True)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the piece ids of the best segmentation, its N best scores and the round-trip check."""
    session(spark)
    encoded = lattice.encode(docs)
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_pieces"), "ids", "scores", "round_trip")


STAGES = [
    ("quality rules", quality_rules),
    ("quality classifier", quality_classifier),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("SentencePiece encoding and decoding", encoding),
]

#: The ranking fit, the fingerprints and the lattice search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "_"))
    return STAGES[-1][1](spark, docs, sf_dir)


def register() -> None:
    query("pipeline", ORACLE_SQL)(run)
