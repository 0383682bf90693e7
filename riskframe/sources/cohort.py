"""Test cohorts derived from the star-schema tables.

Integer arithmetic only, so every engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.sources.readers import read_table


def _chance(hash_of: str, base: int, lift: int) -> str:
    """True for about base% of negatives and (base + lift)% of positives."""
    return f"pmod({hash_of}, 100) < {base} + {lift} * pos"


def clinical_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One messy patient record per order, plus exact copies under new ids."""
    orders = read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS k", "o_custkey AS c", "month(o_orderdate) AS m")
    customer = read_table(spark, sf_dir, "customer").selectExpr("c_custkey AS c", "c_mktsegment AS segment")
    base = orders.join(customer, "c").selectExpr(
        "*",
        "CASE WHEN pmod(7 * k + 3 * c, 100) < 45 THEN 1 ELSE 0 END AS pos",
        "explode(CASE WHEN k % 250 = 0 THEN array(0, 1000000000) ELSE array(0) END) AS shift",
    )
    return base.selectExpr(
        "k + shift AS patient_id",
        "CASE WHEN k % 97 != 0 THEN pmod(13 * c + k, 800) / 10D END AS age_years",
        "CASE WHEN k % 10 = 3 THEN NULL WHEN k % 211 = 0 THEN 'n/a' "
        "ELSE string((80 + pmod(31 * k + c, 70) - 15 * pos) / 10D) END AS hemoglobin_g_dl",
        "int(pmod(c + k, 3) + pos * pmod(11 * k, 9)) AS fever_days",
        "CASE WHEN pmod(3 * k + c, 5) < 3 THEN 1 ELSE 0 END AS uses_mosquito_net",
        f"CASE WHEN {_chance('17 * k', 30, 60)} THEN 'True' ELSE 'False' END AS has_fever",
        f"CASE WHEN {_chance('19 * k + c', 25, 55)} THEN 'true' ELSE 'false' END AS has_chills",
        f"{_chance('23 * k + c', 40, 35)} AS has_headache",
        f"{_chance('29 * k + c', 15, 30)} AS has_vomiting",
        f"{_chance('37 * k + c', 20, 15)} AS has_diarrhea",
        f"CASE WHEN k % 89 != 0 THEN {_chance('41 * k + c', 35, 45)} END AS has_weakness",
        "CASE WHEN c % 101 = 0 THEN NULL WHEN c % 2 = 0 THEN 'Female' ELSE 'Male' END AS sex",
        "CASE WHEN k % 1999 = 0 THEN 'PeriUrban' WHEN segment IN ('BUILDING', 'HOUSEHOLD') THEN 'Urban' "
        "ELSE 'Rural' END AS residence",
        "CASE WHEN m BETWEEN 4 AND 10 THEN 'Rainy' ELSE 'Dry' END AS season",
        "CASE WHEN pos = 1 THEN element_at(array('Positive', 'positive', ' POSITIVE '), int(k % 3) + 1) "
        "WHEN k % 2 = 0 THEN 'Negative' ELSE '0' END AS case_status",
        "pos * pmod(43 * k, 50000) AS parasitemia_count",
    )


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a quality label and three shape features over the whole text."""
    docs = read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels")
    digits = F.length(F.regexp_replace("text", "[^0-9]", ""))
    features = docs.select(
        "doc_id",
        F.col("n_chars").cast("double").alias("n_chars"),
        (F.length("text") - F.length(F.replace("text", F.lit(" "), F.lit(""))) + 1)
        .cast("double").alias("n_words"),
        F.try_divide(digits.cast("double"), F.length("text").cast("double")).alias("digit_share"),
        "lang",
        "source",
    )
    return features.join(labels.select("doc_id", "quality"), "doc_id")


def order_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One labelled row per order with two wide text columns, the customer and the day."""
    return read_table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey AS order_id",
        "CASE WHEN o_orderkey % 89 != 0 THEN o_totalprice END AS total",
        "CASE WHEN o_orderkey % 97 != 0 THEN concat('customer ', o_custkey) END AS customer",
        "date_format(o_orderdate, 'yyyy-MM-dd') AS day",
        "CASE WHEN pmod(11 * o_orderkey, 10) < 8 THEN pmod(o_custkey, 2) ELSE pmod(o_orderkey, 2) END AS returned",
    )
