"""Evaluation queries on the fixed-score frame."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.oracle import FIXED, SPLIT, TYPED
from riskframe.catalog.registry import query, r6
from riskframe.functions.columns import decide
from riskframe.functions.staging import new_path
from riskframe.operators import evaluate
from riskframe.sources import readers, sinks
from riskframe.spec import CLINICAL

_RATES = ("accuracy", "precision", "recall", "f1_score")

_COUNTS = """SELECT {keys}, count(*) FILTER (WHERE y = 1 AND yhat = 1) AS tp,
  count(*) FILTER (WHERE y = 0 AND yhat = 1) AS fp, count(*) FILTER (WHERE y = 1 AND yhat = 0) AS fn,
  count(*) FILTER (WHERE y = 0 AND yhat = 0) AS tn FROM {table} GROUP BY {keys}"""
_RATE_SQL = """round(coalesce((tp + tn) / nullif(tp + tn + fp + fn, 0), 0), 6) AS accuracy,
  round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision,
  round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall,
  round(coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1_score"""


def _auc_sql(keys: str, table: str, p: str = "p") -> str:
    """Mean rank form, independent of the pair-count form used in Spark."""
    return f"""SELECT {keys}, coalesce((sum(rk) FILTER (WHERE y = 1) - np * (np + 1) / 2.0) / nullif(np * nn, 0), 0)
    AS roc_auc FROM (SELECT {keys}, y, rank() OVER (PARTITION BY {keys} ORDER BY {p})
      + (count(*) OVER (PARTITION BY {keys}, {p}) - 1) / 2.0 AS rk,
      sum(y) OVER (PARTITION BY {keys}) AS np, sum(1 - y) OVER (PARTITION BY {keys}) AS nn FROM {table})
  GROUP BY {keys}, np, nn"""


_COMPARISON = f"""conf AS ({_COUNTS.format(keys='model', table='scored')}), area AS ({_auc_sql('model', 'scored')}),
comparison AS (SELECT model, {_RATE_SQL}, round(roc_auc, 6) AS roc_auc FROM conf JOIN area USING (model))"""


def _rounded(df, cols=(*_RATES, "roc_auc")):
    return df.withColumns({c: r6(c) for c in cols if c in df.columns})


@query("g1_confusion", f"WITH {FIXED} " + _COUNTS.format(keys="model", table="scored"))
def g1(spark, sf):
    return evaluate.confusion(inputs.scored(spark, sf))


@query("g2_metrics", f"WITH {FIXED}, conf AS ({_COUNTS.format(keys='model', table='scored')}) "
       f"SELECT model, {_RATE_SQL} FROM conf")
def g2(spark, sf):
    return _rounded(evaluate.rates(evaluate.confusion(inputs.scored(spark, sf))))


@query("g3_auc", f"WITH {FIXED}, area AS ({_auc_sql('model', 'scored')}) "
       "SELECT model, round(roc_auc, 6) AS roc_auc FROM area")
def g3(spark, sf):
    return _rounded(evaluate.auc(inputs.scored(spark, sf)))


@query("g3_auc_continuous", "WITH s AS (SELECT l_returnflag AS model, l_extendedprice AS p, "
       "CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END AS y FROM lineitem), "
       f"area AS ({_auc_sql('model', 's')}) SELECT model, round(roc_auc, 6) AS roc_auc FROM area")
def g3_continuous(spark, sf):
    """AUC of a raw price as the score: nearly every row has its own value."""
    scored = readers.read_table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("model"), F.col("l_extendedprice").alias("p"),
        F.when(F.col("l_quantity") > 25, 1).otherwise(0).alias("y"))
    return _rounded(evaluate.auc(scored))


@query("g4_roc", f"""WITH {FIXED},
c AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM scored GROUP BY ALL),
r AS (SELECT *, sum(pos) OVER w AS tps, sum(neg) OVER w AS fps, lead(pos) OVER w AS pos2, lead(neg) OVER w AS neg2,
  sum(pos) OVER (PARTITION BY model) AS np, sum(neg) OVER (PARTITION BY model) AS nn, row_number() OVER w AS i
  FROM c WINDOW w AS (PARTITION BY model ORDER BY p DESC))
SELECT model, round(fps / nn, 6) AS fpr, round(tps / np, 6) AS tpr, p AS threshold FROM r
WHERE i = 1 OR pos2 IS NULL OR pos2 <> pos OR neg2 <> neg
UNION ALL SELECT DISTINCT model, 0.0::DOUBLE, 0.0::DOUBLE, CAST(NULL AS DOUBLE) FROM scored""")
def g4(spark, sf):
    return _rounded(evaluate.roc_points(inputs.scored(spark, sf)), ("fpr", "tpr"))


@query("g5_auc_binned", f"""WITH {FIXED}, b AS (SELECT model, y, least(floor(p * 20), 19) AS bin FROM scored),
area AS ({_auc_sql('model', 'b', 'bin')}) SELECT model, round(roc_auc, 6) AS roc_auc FROM area""")
def g5(spark, sf):
    return _rounded(evaluate.auc_binned(inputs.scored(spark, sf), bins=20))


@query("g6_comparison", f"WITH {FIXED}, {_COMPARISON} SELECT * FROM comparison")
def g6(spark, sf):
    return _rounded(evaluate.comparison(inputs.scored(spark, sf)))


@query("a5_metrics_sink", f"WITH {FIXED}, {_COMPARISON} SELECT * FROM comparison")
def a5(spark, sf):
    path = new_path(spark, "metrics")
    sinks.write_metrics(_rounded(evaluate.comparison(inputs.scored(spark, sf))), path)
    return readers.read_csv(spark, path).select(
        "model", *[F.col(c).cast("double").alias(c) for c in (*_RATES, "roc_auc")])


@query("g7_melt", f"""WITH {FIXED}, {_COMPARISON}
SELECT model, 'Accuracy' AS metric, accuracy AS score FROM comparison
UNION ALL SELECT model, 'Precision', precision FROM comparison
UNION ALL SELECT model, 'Recall', recall FROM comparison
UNION ALL SELECT model, 'F1-Score', f1_score FROM comparison""")
def g7(spark, sf):
    return evaluate.melt_metrics(_rounded(evaluate.comparison(inputs.scored(spark, sf))))


@query("g8_best_model", f"""WITH {FIXED}, {_COMPARISON}
SELECT * FROM comparison ORDER BY f1_score DESC, roc_auc DESC, accuracy DESC, model LIMIT 1""")
def g8(spark, sf):
    return _rounded(evaluate.best_model(evaluate.comparison(inputs.scored(spark, sf))))


@query("g9_threshold", f"""WITH {FIXED} SELECT model, patient_id, CAST(p >= 0.35 AS INTEGER) AS decision FROM scored""")
def g9(spark, sf):
    return inputs.scored(spark, sf).select("model", "patient_id", decide(F.col("p"), 0.35).alias("decision"))


@query("g10_sweep", f"""WITH {FIXED},
d AS (SELECT model, i / 20.0::DOUBLE AS threshold, y, CAST(p >= i / 20.0::DOUBLE AS INTEGER) AS yhat
  FROM scored, (SELECT unnest(range(21)) AS i)),
conf AS ({_COUNTS.format(keys='model, threshold', table='d')}) SELECT model, threshold, {_RATE_SQL} FROM conf""")
def g10(spark, sf):
    return _rounded(evaluate.threshold_sweep(inputs.scored(spark, sf)))


@query("g11_report", f"""WITH {FIXED}, pc AS (
SELECT model, CAST(k AS VARCHAR) AS class,
  coalesce(count(*) FILTER (WHERE y = k AND yhat = k) / nullif(count(*) FILTER (WHERE yhat = k), 0), 0) AS precision,
  coalesce(count(*) FILTER (WHERE y = k AND yhat = k) / nullif(count(*) FILTER (WHERE y = k), 0), 0) AS recall,
  count(*) FILTER (WHERE y = k) AS support FROM scored, (SELECT unnest([0, 1]) AS k) GROUP BY model, k),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1_score FROM pc)
SELECT model, class, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score,
  support FROM f
UNION ALL SELECT model, 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
  CAST(sum(support) AS BIGINT) FROM f GROUP BY model
UNION ALL SELECT model, 'weighted avg', round(sum(precision * support) / sum(support), 6),
  round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
  CAST(sum(support) AS BIGINT) FROM f GROUP BY model""")
def g11(spark, sf):
    return _rounded(evaluate.class_report(inputs.scored(spark, sf)))


@query("g12_train_test", f"""WITH {SPLIT},
s AS (SELECT 'fever_' || t AS model, split, case_status AS y, CAST(fever_days >= t AS INTEGER) AS yhat
  FROM split, (SELECT unnest([1, 2, 3]) AS t))
SELECT model, round(avg(CAST(y = yhat AS INTEGER)) FILTER (WHERE split = 'train'), 6) AS train_accuracy,
  round(avg(CAST(y = yhat AS INTEGER)) FILTER (WHERE split = 'test'), 6) AS test_accuracy FROM s GROUP BY model""")
def g12(spark, sf):
    rules = inputs.split(spark, sf).select(
        "split", F.col("case_status").alias("y"), "fever_days", F.explode(F.array(*map(F.lit, (1, 2, 3)))).alias("t"))
    scored = rules.select(
        F.concat(F.lit("fever_"), F.col("t").cast("string")).alias("model"), "split", "y",
        (F.col("fever_days") >= F.col("t")).cast("int").alias("yhat"))
    return _rounded(evaluate.train_test_accuracy(scored), ("train_accuracy", "test_accuracy"))


@query("g13_calibration", f"""WITH {FIXED}
SELECT model, CAST(least(floor(p * 10), 9) AS INTEGER) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p,
  round(avg(y), 6) AS positive_share FROM scored GROUP BY 1, 2""")
def g13(spark, sf):
    return _rounded(evaluate.calibration(inputs.scored(spark, sf)), ("mean_p", "positive_share"))


@query("d10_subgroup_metrics", f"""WITH {FIXED},
x AS (SELECT model, residence, y, p, yhat FROM scored UNION ALL SELECT model, '(all)', y, p, yhat FROM scored),
conf AS ({_COUNTS.format(keys='model, residence', table='x')}), area AS ({_auc_sql('model, residence', 'x')})
SELECT model, residence, {_RATE_SQL}, round(roc_auc, 6) AS roc_auc FROM conf JOIN area USING (model, residence)""")
def d10(spark, sf):
    return _rounded(evaluate.subgroup_metrics(inputs.scored(spark, sf), "residence"))


def _gini_sql(c: str) -> str:
    return f"""SELECT '{c}' AS feature, threshold, impurity FROM (
  SELECT (x + nx) / 2 AS threshold, round((coalesce(2 * a * b / nullif(a + b, 0), 0)
    + coalesce(2 * (1 - a) * (1 - b) / nullif(2 - a - b, 0), 0)) / 2, 9) AS impurity
  FROM (SELECT x, lead(x) OVER (ORDER BY x) AS nx, sum(pos) OVER (ORDER BY x) / sum(pos) OVER () AS a,
      sum(neg) OVER (ORDER BY x) / sum(neg) OVER () AS b
    FROM (SELECT {c} AS x, sum(case_status) AS pos, sum(1 - case_status) AS neg FROM typed
      WHERE {c} IS NOT NULL GROUP BY 1)) WHERE nx IS NOT NULL) ORDER BY impurity, threshold LIMIT 1"""


@query("f9_gini_split", f"WITH {TYPED} " + " UNION ALL ".join(
    f"(SELECT feature, round(threshold, 6) AS threshold, round(impurity, 6) AS impurity FROM ({_gini_sql(c)}))"
    for c in CLINICAL.numeric))
def f9(spark, sf):
    return _rounded(
        evaluate.gini_split(inputs.typed(spark, sf), CLINICAL.numeric, CLINICAL.target), ("threshold", "impurity"))
