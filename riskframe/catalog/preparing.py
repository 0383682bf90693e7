"""Split, preparation and derived-field queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.oracle import CATEGORICAL, CLEAN, FILLED, NUMERIC, SCALED, SPLIT, STATS, TYPED
from riskframe.catalog.registry import query, r6
from riskframe.functions import columns as C
from riskframe.operators import balance, prepare, split as split_ops
from riskframe.sources import readers
from riskframe.operators.clean import clean
from riskframe.spec import CLINICAL


@query("e1_stratified_split", f"WITH {SPLIT} SELECT patient_id, case_status, split FROM split")
def e1(spark, sf):
    return inputs.split(spark, sf).select("patient_id", "case_status", "split")


@query("e2_hash_split", f"""WITH {CLEAN} SELECT patient_id,
  CASE WHEN CAST('0x' || substr(md5(concat(patient_id, ':', 42)), 1, 8) AS BIGINT) < 0.2 * 4294967296
    THEN 'test' ELSE 'train' END AS split FROM clean""")
def e2(spark, sf):
    return split_ops.hash_split(clean(inputs.cohort(spark, sf), CLINICAL), "patient_id").select("patient_id", "split")


@query("e3_plain_split", f"""WITH {CLEAN} SELECT patient_id,
  CASE WHEN row_number() OVER (ORDER BY md5(concat(patient_id, ':', 42))) <= (count(*) OVER () + 4) // 5
    THEN 'test' ELSE 'train' END AS split FROM clean""")
def e3(spark, sf):
    df = inputs.cleaned(spark, sf)
    return split_ops.apply_split(df, split_ops.fit_split(df, "patient_id", None)).select("patient_id", "split")


@query("e4_medians", f"WITH {SPLIT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, CAST(quantile_cont({c}, 0.5) AS DOUBLE) AS median FROM split WHERE split = 'train'"
    for c in NUMERIC))
def e4(spark, sf):
    return prepare.medians(inputs.train(spark, sf), CLINICAL.numeric)


@query("e5_modes", f"WITH {SPLIT} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, (SELECT {c} FROM split WHERE split = 'train' AND {c} IS NOT NULL GROUP BY {c} "
    f"ORDER BY count(*) DESC, {c} LIMIT 1) AS mode" for c in CATEGORICAL))
def e5(spark, sf):
    return prepare.modes(inputs.train(spark, sf), CLINICAL.categorical)


@query("e6_imputed", f"""WITH {FILLED}
SELECT patient_id, age_years, hemoglobin_g_dl, has_weakness, sex, residence, split FROM filled""")
def e6(spark, sf):
    df, prep = inputs.fitted(spark, sf)
    return prep.impute(df).select(
        "patient_id", "age_years", "hemoglobin_g_dl", "has_weakness", "sex", "residence", "split")


@query("e7_scaler", f"WITH {STATS} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(m_{c}, 6) AS mean, round(s_{c}, 6) AS std FROM stats" for c in NUMERIC))
def e7(spark, sf):
    df, prep = inputs.fitted(spark, sf)
    train = prep.impute(df.where("split = 'train'"))
    return prepare.scaler_stats(train, CLINICAL.numeric).select("feature", r6("mean"), r6("std"))


@query("e8_scaled", f"WITH {SCALED} SELECT patient_id, split, " + ", ".join(
    f"round({c}, 6) AS {c}" for c in NUMERIC) + " FROM scaled")
def e8(spark, sf):
    df, prep = inputs.fitted(spark, sf)
    return prep.scale(prep.impute(df)).select("patient_id", "split", *[r6(c) for c in CLINICAL.numeric])


@query("e9_categories", f"WITH {FILLED} " + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, string_agg(DISTINCT {c}, ',' ORDER BY {c}) AS categories "
    f"FROM filled WHERE split = 'train'" for c in CATEGORICAL))
def e9(spark, sf):
    df, prep = inputs.fitted(spark, sf)
    train = prep.impute(df.where("split = 'train'"))
    return prepare.categories(train, CLINICAL.categorical).select(
        "feature", F.concat_ws(",", "categories").alias("categories"))


@query("e10_onehot", f"WITH {FILLED} " + " UNION ALL ".join(
    f"SELECT patient_id, '{c}_' || v AS feature, CAST({c} = v AS DOUBLE) AS value "
    f"FROM filled, (SELECT DISTINCT {c} AS v FROM filled WHERE split = 'train')" for c in CATEGORICAL))
def e10(spark, sf):
    """Every one-hot cell, as rows: which columns there are depends on the training fold."""
    df, prep = inputs.fitted(spark, sf)
    cells = [F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("value")) for c in prep.onehot_names]
    return prep.onehot(prep.impute(df)).select("patient_id", F.inline(F.array(*cells)))


@query("e10_onehot_long", """SELECT doc_id, code FROM documents JOIN (SELECT source,
  row_number() OVER (ORDER BY source) - 1 AS code FROM (SELECT DISTINCT source FROM documents)) USING (source)""")
def e10_long(spark, sf):
    return prepare.onehot_long(readers.read_table(spark, sf, "documents"), "doc_id", "source")


@query("e11_assembled", f"WITH {SCALED} SELECT patient_id, round(" + " + ".join(
    f"{c} * {c}" for c in NUMERIC) + " + 3, 6) AS sq_norm FROM scaled")
def e11(spark, sf):
    """Squared norm of the assembled vector: the scaled block plus one hot value per categorical."""
    from pyspark.ml.functions import vector_to_array

    df, prep = inputs.fitted(spark, sf)
    vectors = prep.vector().transform(prep.transform(df))
    norm = F.aggregate(vector_to_array("features"), F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("patient_id", r6(norm, "sq_norm"))


@query("e12_label_encode", f"""WITH {TYPED},
codes AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS sex_code
  FROM (SELECT DISTINCT coalesce(sex, 'nan') AS v FROM typed))
SELECT patient_id, sex_code FROM typed JOIN codes ON v = coalesce(sex, 'nan')""")
def e12(spark, sf):
    return prepare.label_encode(
        inputs.typed(spark, sf).select("patient_id", "sex"), "sex", "sex_code").select("patient_id", "sex_code")


@query("e12_label_codes", """SELECT c_name AS value, row_number() OVER (ORDER BY c_name) - 1 AS code
FROM (SELECT DISTINCT c_name FROM customer)""")
def e12_codes(spark, sf):
    return prepare.label_codes(readers.read_table(spark, sf, "customer"), "c_name")


@query("e13_class_weights", """SELECT quality, count(*) AS n,
  round((SELECT count(*) FROM labels) / ((SELECT count(DISTINCT quality) FROM labels) * count(*)), 6) AS weight
FROM labels GROUP BY quality""")
def e13(spark, sf):
    return prepare.class_weights(readers.read_table(spark, sf, "labels"), "quality").withColumn(
        "weight", r6("weight"))


@query("e14_age_bins", f"""WITH {TYPED} SELECT patient_id,
  CASE WHEN age_years <= 0 OR age_years > 100 THEN NULL WHEN age_years <= 5 THEN '0-5' WHEN age_years <= 15 THEN '6-15'
    WHEN age_years <= 50 THEN '16-50' WHEN age_years <= 100 THEN '50+' END AS age_group,
  CASE WHEN age_years <= 0 OR age_years > 100 THEN NULL WHEN age_years <= 5 THEN 0 WHEN age_years <= 15 THEN 1
    WHEN age_years <= 50 THEN 2 WHEN age_years <= 100 THEN 3 END AS age_group_order FROM typed""")
def e14(spark, sf):
    age = F.col("age_years")
    return inputs.typed(spark, sf).select(
        "patient_id", C.age_group(age).alias("age_group"), C.age_group_order(age).alias("age_group_order"))


@query("e15_derived", f"""WITH {TYPED} SELECT patient_id, CAST(trunc(age_years * 12) AS INTEGER) AS age_months,
  CASE WHEN hemoglobin_g_dl IS NULL OR hemoglobin_g_dl >= 11 THEN 'No' ELSE 'Yes' END AS anemia_status FROM typed""")
def e15(spark, sf):
    return inputs.typed(spark, sf).select(
        "patient_id", C.age_months(F.col("age_years")).alias("age_months"),
        C.anemia_status(F.col("hemoglobin_g_dl")).alias("anemia_status"))


@query("e16_index", """SELECT p_partkey, round(p_retailprice * p_size / 100, 6) AS heat_humidity_index FROM part""")
def e16(spark, sf):
    return readers.read_table(spark, sf, "part").select(
        "p_partkey",
        r6(C.heat_humidity_index(F.col("p_retailprice"), F.col("p_size")), "heat_humidity_index"))


@query("e17_bins", """SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN NULL WHEN o_totalprice <= 50 THEN 0
  WHEN o_totalprice / 1000 <= 50 THEN 0 WHEN o_totalprice / 1000 <= 150 THEN 1 WHEN o_totalprice / 1000 <= 300 THEN 2
  ELSE 3 END AS rain_class FROM orders""")
def e17(spark, sf):
    return readers.read_table(spark, sf, "orders").select(
        "o_orderkey", C.rain_class(F.col("o_totalprice") / 1000).alias("rain_class"))


@query("e18_rate", """SELECT l_returnflag, l_linestatus, round(1000.0 * count(*) FILTER (WHERE l_quantity > 40)
  / nullif(count(*), 0), 6) AS case_rate_per_1000 FROM lineitem GROUP BY 1, 2""")
def e18(spark, sf):
    counts = readers.read_table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count_if(F.col("l_quantity") > 40).alias("cases"), F.count("*").alias("population"))
    rate = C.rate_per_thousand(F.col("cases").cast("double"), F.col("population"))
    return counts.select("l_returnflag", "l_linestatus", r6(rate, "case_rate_per_1000"))


@query("e19_stay", """SELECT o_orderkey, l_linenumber, l_partkey,
  CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS stay,
  date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 1 AND 10 AS in_range
FROM orders JOIN lineitem ON o_orderkey = l_orderkey""")
def e19(spark, sf):
    orders = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    items = readers.read_table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(
        "o_orderkey", "l_linenumber", "l_partkey",
        C.stay_days(F.col("o_orderdate"), F.col("l_shipdate")).alias("stay"),
    ).withColumn("in_range", F.col("stay").between(1, 10))


@query("e20_oversample", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY quality
    ORDER BY md5(concat(doc_id, ':', 42))) AS rk, count(*) OVER (PARTITION BY quality) AS n FROM labels),
m AS (SELECT max(n) AS big, min(n) AS small FROM r)
SELECT doc_id, quality, CAST(unnest(range(1, 1 + CASE WHEN n = small
  THEN big // small + CASE WHEN rk <= big % small THEN 1 ELSE 0 END ELSE 1 END)) AS INTEGER) AS copy FROM r, m""")
def e20(spark, sf):
    labels = readers.read_table(spark, sf, "labels")
    return balance.oversample(labels, "doc_id", "quality").select("doc_id", "quality", "copy")


@query("f6_folds", f"""WITH {CLEAN} SELECT patient_id, case_status,
  CAST(ntile(5) OVER (PARTITION BY case_status ORDER BY md5(concat(patient_id, ':', 42))) - 1 AS INTEGER) AS fold
FROM clean""")
def f6(spark, sf):
    df = inputs.cleaned(spark, sf)
    folds = split_ops.fit_folds(df, CLINICAL.id, CLINICAL.target, 5)
    return split_ops.apply_folds(df, folds).select("patient_id", "case_status", "fold")
