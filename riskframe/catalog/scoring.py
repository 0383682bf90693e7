"""Scoring, join and run-log queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.evaluating import _COUNTS, _RATE_SQL, _auc_sql
from riskframe.catalog.oracle import NUMERIC, SCALED
from riskframe.catalog.registry import query, r6
from riskframe.operators import evaluate, explain, records, runs, score
from riskframe.operators.prepare import fit_prep
from riskframe.sources import readers
from riskframe.spec import CLINICAL

# A fixed logistic model on the scaled block and three one-hot columns.
INTERCEPT = -0.4
COEF = {
    "age_years": -0.05, "hemoglobin_g_dl": -1.1, "fever_days": 1.4, "uses_mosquito_net": 0.02,
    "has_fever": 0.7, "has_chills": 0.6, "has_headache": 0.35, "has_vomiting": 0.33, "has_diarrhea": 0.15,
    "has_weakness": 0.5, "sex_Male": 0.01, "residence_Rural": 0.1, "season_Rainy": 0.2,
}
MODEL = score.LinearScore(INTERCEPT, COEF)

_MARGIN = f"{INTERCEPT}::DOUBLE + " + " + ".join(
    f"{w}::DOUBLE * " + (c if c in NUMERIC else "CAST({} = '{}' AS DOUBLE)".format(*c.split("_")))
    for c, w in COEF.items())
_LINEAR = SCALED + f""",
linear AS (SELECT patient_id, residence, case_status AS y, split, 1 / (1 + exp(-({_MARGIN}))) AS p FROM scaled)"""


def _prep_and_cohort(spark, sf):
    df = inputs.split(spark, sf)
    return fit_prep(df.where("split = 'train'"), CLINICAL), inputs.cohort(spark, sf)


@query("i1_batch_score", f"""WITH {SCALED},
allrows AS (SELECT t.patient_id, """ + ", ".join(
    f"(CAST(coalesce(t.{c}, d_{c}) AS DOUBLE) - m_{c}) / s_{c} AS {c}" for c in NUMERIC
) + f""", coalesce(t.sex, d_sex) AS sex, t.residence, t.season FROM typed t, defaults, stats),
s AS (SELECT patient_id, 1 / (1 + exp(-({_MARGIN}))) AS p FROM allrows)
SELECT patient_id AS "Patient ID", CASE WHEN p > 0.5 THEN 'Case Positive' ELSE 'Case Negative' END AS predicted_label,
  round(p, 4) AS predicted_probability FROM s""")
def i1(spark, sf):
    prep, cohort = _prep_and_cohort(spark, sf)
    raw = cohort.withColumnsRenamed({"patient_id": "Patient ID", "age_years": "Age_Years", "sex": " Sex "})
    return score.score(raw, CLINICAL, prep, MODEL.predict).select(
        "Patient ID", "predicted_label", "predicted_probability")


@query("i1_scored_metrics", f"""WITH {_LINEAR},
x AS (SELECT residence, y, p, CAST(p > 0.5 AS INTEGER) AS yhat FROM linear WHERE split = 'test'),
conf AS ({_COUNTS.format(keys='residence', table='x')}), area AS ({_auc_sql('residence', 'x')})
SELECT residence, {_RATE_SQL}, round(roc_auc, 6) AS roc_auc FROM conf JOIN area USING (residence)""")
def i1_metrics(spark, sf):
    """Cohort to metrics in one go: clean, split, fit on train, score the test fold, compare by residence."""
    df, prep = inputs.fitted(spark, sf)
    test = df.where("split = 'test'").withColumn("y", F.col(CLINICAL.target))
    scored = MODEL.predict(prep.transform(test))
    out = evaluate.comparison(scored, ["residence"])
    return out.withColumns({c: r6(c) for c in out.columns if c != "residence"})


@query("i2_partial_records", f"""WITH {SCALED},
rec AS (SELECT patient_id, age_years, has_fever, sex FROM typed),
full_rec AS (SELECT patient_id, """ + ", ".join(
    f"(CAST(coalesce({'rec.' + c if c in ('age_years', 'has_fever') else 'NULL'}, d_{c}) AS DOUBLE) - m_{c}) / s_{c} AS {c}"
    for c in NUMERIC
) + f""", coalesce(rec.sex, d_sex) AS sex, d_residence AS residence, d_season AS season FROM rec, defaults, stats),
s AS (SELECT patient_id, 1 / (1 + exp(-({_MARGIN}))) AS p FROM full_rec)
SELECT patient_id, CAST(p > 0.5 AS INTEGER) AS prediction,
  CASE WHEN p > 0.5 THEN 'Case Positive' ELSE 'Case Negative' END AS label,
  round(p, 6) AS probability, 'fixed_logistic' AS model_used FROM s""")
def i2(spark, sf):
    """Sparse JSON records holding three of the thirteen features."""
    prep, _ = _prep_and_cohort(spark, sf)
    sparse = inputs.typed(spark, sf).select(
        "patient_id", F.to_json(F.struct("age_years", "has_fever", "sex")).alias("record"))
    out = score.score_records(sparse, "record", CLINICAL, prep, MODEL.predict, "fixed_logistic")
    return out.drop("record").withColumn("probability", r6("probability"))


_TERM = {c: c if c in NUMERIC else "CAST({} = '{}' AS DOUBLE)".format(*c.split("_")) for c in COEF}


@query("h4_contributions", f"""WITH {SCALED} """ + " UNION ALL ".join(
    f"SELECT patient_id, '{c}' AS feature, round({COEF[c]}::DOUBLE * {x}, 6) AS contribution FROM scaled WHERE split = 'test'"
    for c, x in _TERM.items()))
def h4(spark, sf):
    """Every term of the margin but the intercept: scaled columns have mean zero in training,
    so coef * value is coef * (x - mean) / std; one-hot columns enter as they are."""
    df, prep = inputs.fitted(spark, sf)
    test = prep.transform(df.where("split = 'test'"))
    return explain.contributions(test, "patient_id", COEF).withColumn("contribution", r6("contribution"))


@query("h4_top_contributions", f"""WITH {SCALED}, c AS ({" UNION ALL ".join(
    f"SELECT patient_id, '{c}' AS feature, {COEF[c]}::DOUBLE * {x} AS v FROM scaled WHERE split = 'test'"
    for c, x in _TERM.items())})
SELECT patient_id, string_agg(feature, ',' ORDER BY rk) AS top FROM (
  SELECT patient_id, feature, row_number() OVER (PARTITION BY patient_id ORDER BY round(abs(v), 9) DESC, feature) AS rk FROM c)
WHERE rk <= 3 GROUP BY patient_id""")
def h4_top(spark, sf):
    df, prep = inputs.fitted(spark, sf)
    test = prep.transform(df.where("split = 'test'"))
    return explain.top_contributions(test, "patient_id", COEF, 3).select(
        "patient_id", F.concat_ws(",", F.col("top.feature")).alias("top"))


@query("k1_assemble", """SELECT c_custkey, c_mktsegment, o_orderkey, o_orderstatus, l_linenumber, l_quantity, l_shipdate
FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey""")
def k1(spark, sf):
    patients = readers.read_table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    visits = readers.read_table(spark, sf, "orders").select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus")
    symptoms = readers.read_table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity", "l_shipdate")
    return records.assemble(patients, visits, symptoms, "c_custkey", "o_orderkey")


@query("k2_predictions", """SELECT o_orderkey, o_orderstatus, n_items FROM orders LEFT JOIN (
  SELECT l_orderkey, count(*) AS n_items FROM lineitem WHERE l_quantity > 45 GROUP BY 1) ON o_orderkey = l_orderkey""")
def k2(spark, sf):
    visits = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    preds = readers.read_table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(
        F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n_items"))
    return records.attach_predictions(visits, preds, "o_orderkey")


@query("k2_unscored", """SELECT o_orderkey, o_orderstatus FROM orders
WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)""")
def k2_unscored(spark, sf):
    visits = readers.read_table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    preds = readers.read_table(spark, sf, "lineitem").where("l_quantity > 45").select(
        F.col("l_orderkey").alias("o_orderkey"))
    return records.without_match(visits, preds, "o_orderkey")


@query("k3_labelled", "SELECT doc_id, lang, source, quality FROM documents JOIN labels USING (doc_id)")
def k3_labelled(spark, sf):
    docs = readers.read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    labels = readers.read_table(spark, sf, "labels").select("doc_id", "quality")
    return records.attach_labels(docs, labels, "doc_id")


@query("k3_unlabelled", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def k3(spark, sf):
    docs = readers.read_table(spark, sf, "documents").select("doc_id", "lang", "source")
    return records.without_match(docs, readers.read_table(spark, sf, "labels"), "doc_id")


def _run_log(spark, sf):
    """Events read as a run log: one run per event, one model per event type."""
    return readers.read_table(spark, sf, "events").select(
        F.col("event_id").alias("run_id"), "ts", F.col("event_type").alias("model"),
        F.col("value").alias("f1_score"), F.col("props").alias("config"))


@query("j2_latest_run", """SELECT event_id AS run_id, ts, event_type AS model, value AS f1_score, props AS config
FROM events ORDER BY ts DESC, event_id DESC LIMIT 1""")
def j2_latest(spark, sf):
    return runs.latest_run(_run_log(spark, sf), "ts", "run_id")


@query("j2_best_run", """SELECT event_type AS model, value AS f1_score, ts, event_id AS run_id FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts DESC, event_id DESC) AS rk FROM events)
WHERE rk = 1""")
def j2(spark, sf):
    return runs.best_per_model(_run_log(spark, sf), "model", "f1_score", "ts", "run_id")


@query("j3_config_drift", """SELECT event_type AS model, ts, event_id AS run_id, sha256(props) AS config_sha,
  CAST(coalesce(lag(props) OVER (PARTITION BY event_type ORDER BY ts, event_id) <> props, false) AS INTEGER) AS changed
FROM events""")
def j3(spark, sf):
    return runs.config_drift(_run_log(spark, sf), ["model"], "ts", "run_id", "config")
