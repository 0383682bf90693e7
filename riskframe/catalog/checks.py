"""Data-quality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.cleaning import SEGMENTS
from riskframe.catalog.oracle import CLEAN, SPLIT, TYPED
from riskframe.catalog.registry import query, r6
from riskframe.operators import clean as clean_ops, quality
from riskframe.sources import readers
from riskframe.spec import CLINICAL

_COLS = (*CLINICAL.features, CLINICAL.target)


def _per_column(template: str, columns=_COLS) -> str:
    return " UNION ALL ".join(template.format(c=c) for c in columns)


@query("c1_nulls", f"WITH {TYPED} " + _per_column(
    "SELECT '{c}' AS \"column\", count(*) - count({c}) AS n_null, count(*) AS n_rows FROM typed"))
def c1(spark, sf):
    return quality.null_counts(inputs.typed(spark, sf), _COLS)


@query("c2_null_share", f"WITH {TYPED} " + _per_column(
    "SELECT '{c}' AS \"column\", round((count(*) - count({c})) / count(*), 6) AS null_share, "
    "CAST((count(*) - count({c})) / count(*) > 0.05 AS INTEGER) AS over_limit FROM typed"))
def c2(spark, sf):
    return quality.null_shares(inputs.typed(spark, sf), _COLS, limit=0.05).withColumn(
        "null_share", r6("null_share"))


@query("c3_duplicates", f"""WITH {TYPED}
SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_distinct, CAST(sum(n - 1) AS BIGINT) AS n_duplicates
FROM (SELECT count(*) AS n FROM typed GROUP BY {", ".join(_COLS)})""")
def c3(spark, sf):
    return quality.duplicate_count(inputs.typed(spark, sf), _COLS)


@query("c4_class_distribution", f"""WITH {CLEAN}
SELECT case_status, count(*) AS n, (SELECT count(*) FROM clean) AS total,
  round(100.0 * count(*) / (SELECT count(*) FROM clean), 6) AS percent FROM clean GROUP BY 1""")
def c4(spark, sf):
    df = clean_ops.clean(inputs.cohort(spark, sf), CLINICAL)
    return quality.class_distribution(df, CLINICAL.target).withColumn("percent", r6("percent"))


@query("c5_imbalance", """SELECT CAST(sum(quality) AS BIGINT) AS n_pos, CAST(sum(1 - quality) AS BIGINT) AS n_neg,
  round(sum(quality) / nullif(sum(1 - quality), 0), 6) AS ratio FROM labels""")
def c5(spark, sf):
    return quality.imbalance_ratio(readers.read_table(spark, sf, "labels"), "quality").withColumn(
        "ratio", r6("ratio"))


_BOUNDS = {"age_years": (0.5, 79.0), "hemoglobin_g_dl": (7.0, 14.0), "fever_days": (0.0, 9.0)}


@query("c6_ranges", f"WITH {TYPED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {lo}::DOUBLE AS low, {hi}::DOUBLE AS high, count({c}) AS n_values, "
    f"count(*) FILTER (WHERE {c} < {lo}) AS n_below, count(*) FILTER (WHERE {c} > {hi}) AS n_above FROM typed"
    for c, (lo, hi) in _BOUNDS.items()))
def c6(spark, sf):
    return quality.range_check(inputs.typed(spark, sf), _BOUNDS)


@query("c6_range_rejects", f"""WITH {TYPED}
SELECT patient_id, concat_ws(',', CASE WHEN age_years < 0.5 OR age_years > 79 THEN 'age_years' END,
  CASE WHEN hemoglobin_g_dl < 7 OR hemoglobin_g_dl > 14 THEN 'hemoglobin_g_dl' END,
  CASE WHEN fever_days < 0 OR fever_days > 9 THEN 'fever_days' END) AS broken FROM typed
WHERE age_years NOT BETWEEN 0.5 AND 79 OR hemoglobin_g_dl NOT BETWEEN 7 AND 14 OR fever_days NOT BETWEEN 0 AND 9""")
def c6_rejects(spark, sf):
    return quality.range_rejects(inputs.typed(spark, sf), _BOUNDS).select(
        "patient_id", F.concat_ws(",", "out_of_range").alias("broken"))


@query("c7_allowed_values", f"""WITH {TYPED}
SELECT 'residence' AS "column", residence AS value, count(*) AS n FROM typed
WHERE residence NOT IN ('Rural', 'Urban') GROUP BY residence
UNION ALL SELECT 'sex', sex, count(*) FROM typed WHERE sex NOT IN ('Male', 'Female') GROUP BY sex
UNION ALL SELECT 'season', season, count(*) FROM typed WHERE season NOT IN ('Rainy', 'Dry') GROUP BY season""")
def c7(spark, sf):
    return quality.allowed_values(inputs.typed(spark, sf), CLINICAL.allowed)


@query("c8_missing_columns", """SELECT unnest(['sex', 'residence', 'season', 'age_years', 'hemoglobin_g_dl',
  'fever_days', 'uses_mosquito_net', 'has_fever', 'has_chills', 'has_headache', 'has_vomiting', 'has_diarrhea',
  'has_weakness']) AS "column", 'filled with training default' AS action, count(*) AS n_rows FROM customer""")
def c8(spark, sf):
    customer = readers.read_table(spark, sf, "customer")
    return clean_ops.missing_columns(customer, CLINICAL.features).withColumn(
        "n_rows", customer.agg(F.count("*")).scalar())


@query("c9_bad_labels", """SELECT lower(trim(o_orderpriority)) AS label, count(*) AS n FROM orders
WHERE lower(trim(o_orderpriority)) NOT IN ('1-urgent', '2-high') GROUP BY 1""")
def c9(spark, sf):
    return quality.unknown_labels(
        readers.read_table(spark, sf, "orders"), "o_orderpriority", {"1-urgent": 1, "2-high": 1})


@query("c10_separation", f"""WITH {TYPED},
o AS (SELECT covar_pop(fever_days, case_status) / nullif(stddev_pop(fever_days) * stddev_pop(case_status), 0) AS r,
  CAST(max(fever_days) FILTER (WHERE case_status = 0) = 0 AS INTEGER) AS flat FROM typed)
SELECT case_status, min(fever_days) AS min_value, max(fever_days) AS max_value,
  round(avg(fever_days), 6) AS mean_value, round(any_value(r), 6) AS r, any_value(flat) AS negative_constant_zero
FROM typed, o GROUP BY case_status""")
def c10(spark, sf):
    return quality.separation(inputs.typed(spark, sf), "fever_days", CLINICAL.target).withColumns(
        {"mean_value": r6("mean_value"), "r": r6("r")})


@query("c11_recode_audit", """SELECT 'before' AS phase, c_mktsegment AS value, count(*) AS n FROM customer GROUP BY 2
UNION ALL SELECT 'after', replace(replace(replace(c_mktsegment, 'BUILDING', 'Construction'), 'HOUSEHOLD', 'Home'),
  'MACHINERY', 'Industry'), count(*) FROM customer GROUP BY 2""")
def c11(spark, sf):
    return quality.recode_audit(readers.read_table(spark, sf, "customer"), "c_mktsegment", SEGMENTS)


@query("c12_column_types", """SELECT * FROM (VALUES (0, 'c_custkey', 'bigint', 5), (1, 'c_name', 'string', 5),
  (2, 'c_nationkey', 'int', 5), (3, 'c_acctbal', 'double', 5), (4, 'c_mktsegment', 'string', 5))
  AS t(position, "column", type, n_columns), (SELECT count(*) AS n_rows FROM customer)""")
def c12(spark, sf):
    customer = readers.read_table(spark, sf, "customer")
    return clean_ops.column_types(customer).withColumn("n_rows", customer.agg(F.count("*")).scalar())


@query("c13_split_overlap", f"""WITH {SPLIT},
v AS (SELECT count(*) FILTER (WHERE split = 'train') AS a, count(*) FILTER (WHERE split = 'test') AS b FROM split
  GROUP BY {", ".join(CLINICAL.features)})
SELECT (SELECT count(*) FROM v WHERE a > 0 AND b > 0) AS n_shared,
  count(*) FILTER (WHERE split = 'train') AS n_train, count(*) FILTER (WHERE split = 'test') AS n_test,
  round(avg(case_status) FILTER (WHERE split = 'train'), 6) AS share_train,
  round(avg(case_status) FILTER (WHERE split = 'test'), 6) AS share_test FROM split""")
def c13(spark, sf):
    return quality.split_overlap(inputs.split(spark, sf), CLINICAL).withColumns(
        {"share_train": r6("share_train"), "share_test": r6("share_test")})
