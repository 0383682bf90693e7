"""Sources, sinks and cleaning queries."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from riskframe.catalog import inputs
from riskframe.catalog.oracle import CLEAN, COHORT, SPLIT, TYPED
from riskframe.catalog.registry import query
from riskframe.functions import columns as C
from riskframe.functions.staging import new_path
from riskframe.operators import clean as ops
from riskframe.sources import readers, sinks
from riskframe.sources.commits import BatchLog
from riskframe.spec import CLINICAL, FeatureSpec

EVENT_RECORD = FeatureSpec(id="event_id", target="event_type", continuous=("k", "score"), categorical=("note",))
SEGMENTS = {"BUILDING": "Construction", "HOUSEHOLD": "Home", "MACHINERY": "Industry"}


@query("a1_csv_scan", "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer")
def a1(spark, sf):
    path = new_path(spark, "customer_csv")
    table = readers.read_table(spark, sf, "customer")
    table.toDF("C CustKey", " C-Name", "C NationKey", "C_AcctBal ", "C MktSegment").write.option(
        "header", True).csv(path)
    text = ops.normalise_headers(readers.read_csv(spark, path))
    return text.select(
        F.col("c_custkey").cast("bigint").alias("c_custkey"), "c_name",
        C.to_number(F.col("c_acctbal")).alias("c_acctbal"), "c_mktsegment",
    )


@query("a1_csv_rejects", """SELECT kind, count(*) AS n, CAST(sum(hash_key) AS BIGINT) AS keys, max(record) AS last FROM (
  SELECT CASE WHEN o_orderkey % 7 IN (0, 3) THEN 'rejected' ELSE 'kept' END AS kind, o_orderkey AS hash_key,
    CASE o_orderkey % 7 WHEN 0 THEN concat_ws(',', o_orderkey, o_custkey)
      WHEN 3 THEN concat_ws(',', o_orderkey, o_custkey, o_orderstatus, 'surplus') END AS record FROM orders) GROUP BY kind""")
def a1_rejects(spark, sf):
    """Orders as text records, some with a field too few or too many, read back and told apart."""
    k = F.col("o_orderkey") % 7
    record = F.when(k == 0, F.concat_ws(",", "o_orderkey", "o_custkey")).when(
        k == 3, F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus", F.lit("surplus"))
    ).otherwise(F.concat_ws(",", "o_orderkey", "o_custkey", "o_orderstatus"))
    base = new_path(spark, "csv")
    rows = readers.read_table(spark, sf, "orders").select(record.alias("value"))
    # The writer adds the header to each file; records are written as they stand, as one column without quotes.
    rows.withColumnRenamed("value", "id,customer,status").write.option("header", True).option("quote", "").option(
        "sep", "\x01").csv(base)
    kept, rejects = readers.read_csv_checked(spark, base)
    both = kept.select(F.lit("kept").alias("kind"), F.col("id").cast("bigint").alias("k"), F.lit(None).cast("string").alias("record")).unionByName(
        rejects.select(F.lit("rejected").alias("kind"), F.split("record", ",")[0].cast("bigint").alias("k"), "record"))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("k").alias("keys"), F.max("record").alias("last"))


@query("a2_na_tokens", f"""WITH {COHORT}
SELECT patient_id, CASE WHEN hemoglobin_g_dl IN ('', 'NA', 'N/A', 'n/a', 'nan', 'NaN', 'null', 'NULL', 'None')
  THEN NULL ELSE hemoglobin_g_dl END AS hemoglobin_g_dl, sex FROM cohort""")
def a2(spark, sf):
    return readers.missing_tokens_to_null(inputs.cohort(spark, sf)).select(
        "patient_id", "hemoglobin_g_dl", "sex")


@query("a3_json_scan", """SELECT event_id, event_type,
  CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events""")
def a3(spark, sf):
    """Events as JSON lines with a nested object, read back under a declared schema."""
    path = new_path(spark, "events_json")
    nested = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("event_type", T.StringType()),
        T.StructField("props", T.StructType([T.StructField("k", T.LongType())])),
    ])
    events = readers.read_table(spark, sf, "events")
    events.select("event_id", "event_type", F.from_json("props", "k bigint").alias("props")).write.json(path)
    return readers.read_json(spark, path, nested).select("event_id", "event_type", "props.*")


@query("a4_processed_sink", f"""WITH {SPLIT}
SELECT split, case_status, count(*) AS n FROM split GROUP BY ALL""")
def a4(spark, sf):
    path = new_path(spark, "processed")
    sinks.write_processed(inputs.split(spark, sf), path)
    return readers.read_parquet(spark, path).groupBy("split", "case_status").agg(F.count("*").alias("n"))


@query("a6_scored_sink", """SELECT c_custkey AS "Cust Key", c_mktsegment AS "Segment",
  CASE WHEN c_acctbal > 0 THEN 'Case Positive' ELSE 'Case Negative' END AS predicted_label
FROM customer""")
def a6(spark, sf):
    """Original headers and values survive next to the appended columns."""
    path = new_path(spark, "scored")
    table = readers.read_table(spark, sf, "customer").select(
        F.col("c_custkey").alias("Cust Key"), F.col("c_mktsegment").alias("Segment"), "c_acctbal")
    yhat = C.decide(F.col("c_acctbal"), 1e-9)
    sinks.write_scored(
        table.withColumn("predicted_label", C.decode_label(yhat, CLINICAL.labels)).drop("c_acctbal"), path)
    return readers.read_parquet(spark, path)


@query("a7_append_log", """SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1""")
def a7(spark, sf):
    """Two typed appends to one log equal the whole table."""
    path = new_path(spark, "log")
    orders = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    sinks.append_scored(orders.where(F.col("o_orderstatus") == "F"), path)
    sinks.append_scored(orders.where(F.col("o_orderstatus") != "F"), path)
    return readers.read_parquet(spark, path).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("a7_committed_log", """SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS key_sum
FROM orders GROUP BY 1""")
def a7_commits(spark, sf):
    """A repeated batch and the rows of a job that died before its commit change nothing."""
    log = BatchLog(spark, new_path(spark, "commits"))
    orders = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    finished = F.col("o_orderstatus") == "F"
    log.write(orders.where(finished), 0)
    for batch_id, part in ((0, finished), (1, ~finished), (1, ~finished)):
        log.append(orders.where(part), batch_id)
    log.write(orders, 2)
    return log.read(orders.schema).groupBy("o_orderstatus").agg(
        F.count("*").alias("n"), F.sum("o_orderkey").alias("key_sum"))


@query("a9_write_splits", f"""WITH {SPLIT}
SELECT patient_id, age_years, sex, case_status, split FROM split""")
def a9(spark, sf):
    path = new_path(spark, "splits")
    sinks.write_splits(inputs.split(spark, sf), path)
    return readers.read_parquet(spark, path).select(
        "patient_id", "age_years", "sex", "case_status", "split")


@query("a10_union_splits", f"""WITH {CLEAN}
SELECT patient_id, sex, age_years, case_status FROM clean""")
def a10(spark, sf):
    df = inputs.split(spark, sf).select("patient_id", "sex", "age_years", "case_status", "split")
    return ops.stack_frames(
        df.where("split = 'train'"), df.where("split = 'test'")).drop("split")


@query("b1_normalise_text", r"""SELECT p_partkey,
  trim(regexp_replace(lower(trim(p_type || ' (' || p_brand || ')%')), '[^a-z0-9]+', '_', 'g'), '_') AS type_key,
  trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '_', 'g'), '_') AS name_key FROM part""")
def b1(spark, sf):
    part = readers.read_table(spark, sf, "part")
    label = F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")%"))
    return part.select(
        "p_partkey", C.normalise_text(label).alias("type_key"),
        C.normalise_text(F.col("p_name")).alias("name_key"))


@query("b2_drop_leakage", f"WITH {COHORT} SELECT * EXCLUDE (parasitemia_count) FROM cohort")
def b2(spark, sf):
    return ops.drop_leakage(inputs.cohort(spark, sf), CLINICAL)


def _flags(rule):
    return [rule(F.col(c)).alias(c) for c in CLINICAL.flags]


@query("b3_flag_strict", f"""WITH {COHORT}
SELECT patient_id, 0 AS uses_mosquito_net, CAST(lower(has_fever) = 'true' AS INTEGER) AS has_fever,
  CAST(lower(has_chills) = 'true' AS INTEGER) AS has_chills, CAST(has_headache AS INTEGER) AS has_headache,
  CAST(has_vomiting AS INTEGER) AS has_vomiting, CAST(has_diarrhea AS INTEGER) AS has_diarrhea,
  CASE WHEN has_weakness THEN 1 ELSE 0 END AS has_weakness FROM cohort""")
def b3(spark, sf):
    return inputs.cohort(spark, sf).select("patient_id", *_flags(C.flag_strict))


@query("b4_flag_lenient", f"""WITH {COHORT}
SELECT patient_id, uses_mosquito_net, CAST(lower(has_fever) = 'true' AS INTEGER) AS has_fever,
  CAST(lower(has_chills) = 'true' AS INTEGER) AS has_chills, CAST(has_headache AS INTEGER) AS has_headache,
  CAST(has_vomiting AS INTEGER) AS has_vomiting, CAST(has_diarrhea AS INTEGER) AS has_diarrhea,
  CAST(has_weakness AS INTEGER) AS has_weakness FROM cohort""")
def b4(spark, sf):
    return inputs.cohort(spark, sf).select("patient_id", *_flags(C.flag_lenient))


@query("b5_numeric_coerce", f"""WITH {COHORT}
SELECT patient_id, TRY_CAST(hemoglobin_g_dl AS DOUBLE) AS hemoglobin_g_dl,
  TRY_CAST(season AS DOUBLE) AS season_number FROM cohort""")
def b5(spark, sf):
    return inputs.cohort(spark, sf).select(
        "patient_id", C.to_number(F.col("hemoglobin_g_dl")).alias("hemoglobin_g_dl"),
        C.to_number(F.col("season")).alias("season_number"))


@query("b6_target_encode", f"""WITH {COHORT}
SELECT patient_id, CASE lower(trim(case_status)) WHEN 'positive' THEN 1 WHEN '1' THEN 1
  WHEN 'negative' THEN 0 WHEN '0' THEN 0 END AS case_status FROM cohort""")
def b6(spark, sf):
    return ops.encode_target(inputs.cohort(spark, sf), CLINICAL).select("patient_id", "case_status")


@query("b7_integer_targets", """SELECT count(*) FILTER (WHERE p_size NOT IN (0, 1)) AS n_bad FROM part""")
def b7(spark, sf):
    part = readers.read_table(spark, sf, "part")
    return ops.bad_integer_targets(part, "p_size").agg(F.count("*").alias("n_bad"))


@query("b8_drop_missing_target", f"""WITH {COHORT}
SELECT count(*) AS n_kept, count(*) FILTER (WHERE patient_id % 113 = 0) AS n_multiple FROM cohort
WHERE patient_id % 113 <> 0""")
def b8(spark, sf):
    holed = inputs.cohort(spark, sf).withColumn(
        "case_status", F.when(F.col("patient_id") % 113 != 0, F.col("case_status")))
    return ops.drop_missing_target(holed, CLINICAL).agg(
        F.count("*").alias("n_kept"), F.count_if(F.col("patient_id") % 113 == 0).alias("n_multiple"))


@query("b9_dedup", f"WITH {CLEAN} SELECT * FROM clean")
def b9(spark, sf):
    return ops.deduplicate(inputs.typed(spark, sf), CLINICAL)


@query("b10_select_features", f"""WITH {TYPED}
SELECT patient_id, sex, residence, season, age_years, hemoglobin_g_dl, fever_days, uses_mosquito_net,
  has_fever, has_chills, has_headache, has_vomiting, has_diarrhea, has_weakness FROM typed""")
def b10(spark, sf):
    return ops.select_features(inputs.typed(spark, sf), CLINICAL, "patient_id")


@query("b11_recode", """SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'Construction'
  WHEN 'HOUSEHOLD' THEN 'Home' WHEN 'MACHINERY' THEN 'Industry' ELSE c_mktsegment END AS c_mktsegment
FROM customer""")
def b11(spark, sf):
    customer = readers.read_table(spark, sf, "customer")
    return ops.recode_values(customer, "c_mktsegment", SEGMENTS).select("c_custkey", "c_mktsegment")


@query("b12_decode_label", """SELECT p_partkey, CASE p_size WHEN 0 THEN 'Case Negative'
  WHEN 1 THEN 'Case Positive' ELSE 'Unknown' END AS label FROM part""")
def b12(spark, sf):
    part = readers.read_table(spark, sf, "part")
    return ops.decode_labels(part, "p_size", CLINICAL, "label").select("p_partkey", "label")


@query("b13_filter_class", f"""WITH {TYPED} SELECT patient_id, fever_days FROM typed WHERE case_status = 1""")
def b13(spark, sf):
    return ops.filter_class(inputs.typed(spark, sf), CLINICAL, 1).select("patient_id", "fever_days")


@query("b14_fill_defaults", f"""WITH {TYPED}
SELECT patient_id, coalesce(age_years, 30.0) AS age_years, coalesce(hemoglobin_g_dl, 11.4) AS hemoglobin_g_dl,
  coalesce(sex, 'Male') AS sex, CAST(coalesce(has_weakness, 1) AS DOUBLE) AS has_weakness,
  'Rainy' AS season, 1.0::DOUBLE AS has_fever FROM typed""")
def b14(spark, sf):
    defaults = dict.fromkeys(CLINICAL.flags, 0) | {
        "sex": "Male", "residence": "Rural", "season": "Rainy", "age_years": 30.0,
        "hemoglobin_g_dl": 11.4, "fever_days": 1, "has_fever": 1, "has_weakness": 1,
    }
    partial = inputs.typed(spark, sf).drop("season", "has_fever")
    return ops.fill_defaults(partial, CLINICAL, defaults).select(
        "patient_id", "age_years", "hemoglobin_g_dl", "sex", "has_weakness", "season", "has_fever")


@query("b15_preview", f"""WITH {COHORT}
SELECT patient_id, age_years, sex, case_status FROM cohort ORDER BY patient_id LIMIT 100""")
def b15(spark, sf):
    return ops.preview(inputs.cohort(spark, sf), "patient_id").select(
        "patient_id", "age_years", "sex", "case_status")


@query("b16_record_coerce", """SELECT event_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
  CAST(NULL AS DOUBLE) AS score, CAST(NULL AS VARCHAR) AS note FROM events""")
def b16(spark, sf):
    events = readers.read_table(spark, sf, "events").select("event_id", "props")
    return ops.record_from_json(events, "props", EVENT_RECORD).drop("props")


@query("e23_pseudonymise", f"WITH {COHORT} SELECT sha256(CAST(patient_id AS VARCHAR)) AS patient_id, sex FROM cohort")
def e23(spark, sf):
    return ops.pseudonymise(inputs.cohort(spark, sf), CLINICAL).select("patient_id", "sex")
