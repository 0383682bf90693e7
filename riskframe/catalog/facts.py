"""What can be said in SQL about fitted models: keys, counts, exact splits, and checks that must hold.

Each query fits at the production settings and returns what SQL derives from the tables by itself,
beside the outcome of checks that are computed from the fit and are true when it is right.
"""

from __future__ import annotations

from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, functions as F

from riskframe.catalog import inputs
from riskframe.catalog.learning import _CONFIG, _code, _folds, _frame
from riskframe.catalog.oracle import CATEGORICAL, CLEAN, FILLED, NUMERIC, SPLIT
from riskframe.catalog.registry import query
from riskframe.config import ForestConfig
from riskframe.functions.staging import new_path, stage
from riskframe.operators import balance, evaluate, explain, kernel, learn, prepare
from riskframe.operators.runs import append_run, run_record
from riskframe.plans.batch import score_json_records, score_table
from riskframe.plans.registry import ModelStore
from riskframe.plans.training import score_all, train
from riskframe.sources import readers
from riskframe.sources.sinks import write_metrics
from riskframe.spec import CLINICAL, TEXT_QUALITY
from riskframe.streaming import scoring as streaming

_TEST_ROWS = f"WITH {SPLIT} SELECT {{model}} AS model, case_status AS y, count(*) AS n, true AS checked FROM split WHERE split = 'test' GROUP BY case_status"


def _sound(scored: DataFrame, holds: bool) -> DataFrame:
    """Rows per model and class; ``checked`` when ``holds`` and every score is a probability that its label follows."""
    right = F.col("p").between(0, 1) & (F.col("yhat") == (F.col("p") > 0.5).cast("int"))
    return scored.groupBy("model", "y").agg(
        F.count("*").alias("n"), (F.min(F.coalesce(right, F.lit(False)).cast("int")) == 1).alias("_ok")
    ).select("model", "y", "n", (F.col("_ok") & F.lit(bool(holds))).alias("checked"))


def _gradient(model, frame: DataFrame, columns: list[str]) -> float:
    """Largest entry of the gradient of the penalised mean loss at the fit."""
    fit = model.model.stages[-1]
    p = model.predict(frame).withColumn("_r", F.col(learn.WEIGHT) * (F.col("p") - F.col(CLINICAL.target)))
    one = p.agg(F.sum(learn.WEIGHT).alias("_w"), F.sum("_r").alias("_b"),
                *[F.sum(F.col("_r") * F.col(f"`{c}`")).alias(f"g{i}") for i, c in enumerate(columns)]).first()
    reg, w = fit.getRegParam(), fit.coefficients.toArray()
    return max(abs(one["_b"] / one["_w"]), *[abs(one[f"g{i}"] / one["_w"] + reg * w[i]) for i in range(len(columns))])


@query("f1_logistic_facts", _TEST_ROWS.format(model="'logistic_regression'"))
def f1(spark, sf):
    """The gradient of the fit vanishes and every score is a probability."""
    tr, te, prep = _folds(spark, sf)
    frame = _frame(tr, prep)
    model = learn.fit_logistic(frame, CLINICAL.target, prep.order)
    return _sound(score_all({model.name: model}, te, CLINICAL), _gradient(model, frame, prep.order) < 1e-4)


_ORDER = ", ".join(f"'{c}'" for c in NUMERIC)
_UNPIVOTED = " UNION ALL ".join(
    [f"SELECT {i} AS pos, '{c}' AS feature, {c} AS v, case_status AS y FROM filled WHERE split = 'train'" for i, c in enumerate(NUMERIC)]
    + [f"SELECT {100 + i} + dense_rank() OVER (ORDER BY l.val) / 1000.0 AS pos, '{c}_' || l.val AS feature, CAST({c} = l.val AS DOUBLE) AS v, case_status AS y "
       f"FROM filled, (SELECT DISTINCT {c} AS val FROM split WHERE split = 'train' AND {c} IS NOT NULL) AS l WHERE split = 'train'"
       for i, c in enumerate(CATEGORICAL)])


@query("f2_tree_facts", f"""WITH {FILLED},
x AS ({_UNPIVOTED}),
w AS (SELECT count(*) / (2.0 * sum(y)) AS w1, count(*) / (2.0 * sum(1 - y)) AS w0, sum(y) AS t1, sum(1 - y) AS t0 FROM filled JOIN
  (SELECT patient_id, case_status AS y FROM filled) USING (patient_id) WHERE split = 'train'),
h AS (SELECT pos, feature, v, sum(1 - y) AS n0, sum(y) AS n1 FROM x GROUP BY pos, feature, v),
c AS (SELECT pos, feature, v, sum(n0) OVER o AS c0, sum(n1) OVER o AS c1, lead(v) OVER o AS nxt FROM h WINDOW o AS (PARTITION BY feature ORDER BY v)),
g AS (SELECT *, (c0*w0*c0*w0 + c1*w1*c1*w1) / (c0*w0 + c1*w1)
    + ((t0-c0)*w0*(t0-c0)*w0 + (t1-c1)*w1*(t1-c1)*w1) / ((t0-c0)*w0 + (t1-c1)*w1) AS gain FROM c, w
  WHERE nxt IS NOT NULL AND c0 + c1 >= 5 AND t0 + t1 - c0 - c1 >= 5)
SELECT feature, CAST(c0 AS BIGINT) AS lower_negative, CAST(c1 AS BIGINT) AS lower_positive, CAST(t0 - c0 AS BIGINT) AS upper_negative,
  CAST(t1 - c1 AS BIGINT) AS upper_positive, true AS leaves_add_up FROM g ORDER BY gain DESC, pos, v LIMIT 1""")
def f2(spark, sf):
    """The first split of the tree with the training rows on both sides, over all thresholds of all columns."""
    tr, _, prep = _folds(spark, sf)
    n = learn.fit_tree(_frame(tr, prep), CLINICAL.target, prep.order).nodes
    low, high, leaf = n.lower[0], n.upper[0], n.feature < 0
    adds = n.n0[leaf].sum() == n.n0[0] and n.n1[leaf].sum() == n.n1[0]
    return spark.createDataFrame(
        [(prep.order[n.feature[0]], int(n.n0[low]), int(n.n1[low]), int(n.n0[high]), int(n.n1[high]), bool(adds))],
        "feature string, lower_negative long, lower_positive long, upper_negative long, upper_positive long, leaves_add_up boolean")


@query("f3_forest_facts", _TEST_ROWS.format(model="'random_forest'"))
def f3(spark, sf):
    """All trees are there, each is its draw split without loss, and importances sum to 1."""
    tr, te, prep = _folds(spark, sf)
    model = learn.fit_forest(_frame(tr, prep, CLINICAL.id), CLINICAL.target, prep.order, id_col=CLINICAL.id)
    n, leaf = model.nodes, model.nodes.feature < 0
    per_tree = lambda c: np.bincount(n.tree[leaf], getattr(n, c)[leaf], model.trees)
    holds = model.trees == ForestConfig().trees and all((per_tree(c) == getattr(n, c)[:model.trees]).all() for c in ("n0", "n1"))
    return _sound(score_all({model.name: model}, te, CLINICAL), holds and abs(model.importances().sum() - 1) < 1e-9)


@query("f4_kernel_svm_facts", _TEST_ROWS.format(model="'svm'"))
def f4(spark, sf):
    """The kernel's scores order the held-out rows better than chance by far."""
    tr, te, prep = _folds(spark, sf)
    model = kernel.fit_kernel_svm(_frame(tr, prep), CLINICAL.target, prep.order)
    scored = score_all({model.name: model}, te, CLINICAL)
    return _sound(scored, evaluate.comparison(scored).first()["roc_auc"] > 0.9)


@query("f5_calibrated_facts", _TEST_ROWS.format(model="'svm'"))
def f5(spark, sf):
    """Calibrated scores rise with the decision and their mean is near the share of positives of balanced data."""
    tr, te, prep = _folds(spark, sf)
    model = kernel.fit_calibrated_svm(_frame(tr, prep, CLINICAL.id), CLINICAL.id, CLINICAL.target, prep.order)
    scored = score_all({model.name: model}, te, CLINICAL)
    gap = scored.agg(F.abs(F.avg("p") - F.avg("y"))).first()[0]
    return _sound(scored, model.slope > 0 and gap < 0.05)


@query("f7_train_all_facts", " UNION ALL ".join(
    f"SELECT * FROM ({_TEST_ROWS.format(model=repr(m))})" for m in ("logistic_regression", "decision_tree", "random_forest", "svm")))
def f7(spark, sf):
    """Rows per model and class of the training job; the best model is the first of its own metrics."""
    result = train(inputs.cohort(spark, sf), CLINICAL, _CONFIG)
    best = result.metrics.orderBy(F.desc("f1_score"), F.desc("roc_auc"), F.desc("accuracy"), "model").first()["model"]
    return _sound(result.scored, best == result.best)


@query("f8_predict_facts", f"WITH {SPLIT} SELECT patient_id, true AS checked FROM split WHERE split = 'test'")
def f8(spark, sf):
    """Each held-out record has the score that the coefficients give."""
    tr, te, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    fit = model.model.stages[-1]
    margin = F.lit(float(fit.intercept))
    for c, w in zip(prep.order, fit.coefficients.toArray().tolist()):
        margin = margin + F.lit(w) * F.col(f"`{c}`")
    same = F.abs(F.col("p") - 1 / (1 + F.exp(-margin))) < 1e-9
    return model.predict(te).select(CLINICAL.id, (same & (F.col("yhat") == (F.col("p") > 0.5).cast("int"))).alias("checked"))


def _two_models(spark, sf):
    tr, te, prep = _folds(spark, sf)
    frame = _frame(tr, prep)
    models = {m.name: m for m in (
        learn.fit_logistic(frame, CLINICAL.target, prep.order), learn.fit_tree(frame, CLINICAL.target, prep.order))}
    store = ModelStore(spark, new_path(spark, "store"), CLINICAL)
    store.save(models, prep, learn.LOGISTIC)
    return models, store, te


@query("a8_model_store_facts", f"""WITH {SPLIT} SELECT patient_id, m.model, true AS same FROM split,
  (SELECT unnest(['logistic_regression', 'decision_tree']) AS model) AS m WHERE split = 'test'""")
def a8(spark, sf):
    """Reloaded models score every held-out row as the fresh ones do."""
    models, store, te = _two_models(spark, sf)
    out = None
    for name, fresh in models.items():
        a = fresh.predict(te).select(CLINICAL.id, F.col("p").alias("a"), F.col("yhat").alias("ya"))
        b = store.model(name).predict(te).select(CLINICAL.id, F.col("p").alias("b"), F.col("yhat").alias("yb"))
        part = a.join(b, CLINICAL.id, "full").select(
            CLINICAL.id, F.lit(name).alias("model"),
            F.coalesce((F.col("a") == F.col("b")) & (F.col("ya") == F.col("yb")), F.lit(False)).alias("same"))
        out = part if out is None else out.unionByName(part)
    return out


@query("i3_choose_model_facts", """SELECT patient_id, true AS by_name, true AS by_default FROM (
  SELECT o_orderkey AS patient_id FROM orders JOIN customer ON o_custkey = c_custkey
  UNION ALL SELECT o_orderkey + 1000000000 FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 250 = 0)""")
def i3(spark, sf):
    """A record is scored by the named model, or by the best one when none is named."""
    models, store, _ = _two_models(spark, sf)
    rows = inputs.typed(spark, sf).select(
        "patient_id", F.to_json(F.struct("age_years", "has_fever", "sex")).alias("record"))
    whole = inputs.typed(spark, sf).select("patient_id", "age_years", "has_fever", "sex")
    prep = store.prep()
    out = rows.select("patient_id")
    for name, chosen, as_ in ((learn.TREE, learn.TREE, "by_name"), (None, learn.LOGISTIC, "by_default")):
        said = score_json_records(rows, "record", CLINICAL, store, name).select(
            "patient_id", F.when(F.col("model_used") == chosen, F.col("probability")).alias("_said"))
        want = models[chosen].predict(prep.transform(whole)).select("patient_id", F.round("p", 4).alias("_want"))
        out = out.join(said, "patient_id").join(want, "patient_id").withColumn(
            as_, F.coalesce(F.abs(F.col("_said") - F.col("_want")) < 2e-4, F.lit(False))).drop("_said", "_want")
    return out


@query("f10_retrain_trigger_facts", f"WITH {CLEAN} SELECT count(*) AS n_logged, CAST(1 AS BIGINT) AS n_runs, count(*) AS n_trained FROM clean")
def f10(spark, sf):
    """Every record is logged once, and one run sees all of them."""
    base = new_path(spark, "retrain")
    inputs.cleaned(spark, sf).write.parquet(f"{base}/in")
    schema = readers.read_parquet(spark, f"{base}/in").schema
    runs: list[int] = []
    labelled = streaming.read_stream(spark, f"{base}/in", schema)
    streaming.retrain_when(
        labelled, f"{base}/log", f"{base}/checkpoint", 500, lambda rows: runs.append(rows.count())).awaitTermination()
    logged = readers.read_parquet(spark, f"{base}/log/rows").select(CLINICAL.id).distinct()
    return logged.agg(F.count("*").alias("n_logged")).select(
        "n_logged", F.lit(len(runs)).cast("bigint").alias("n_runs"), F.lit(runs[-1] if runs else 0).cast("bigint").alias("n_trained"))


@query("h1_importance_facts", "SELECT unnest([" + _ORDER + ", 'sex_code', 'residence_code']) AS feature, true AS in_range, 1.0::DOUBLE AS total")
def h1(spark, sf):
    """One importance for each feature; all lie in [0, 1] and sum to 1."""
    df = inputs.cleaned(spark, sf)
    prep = prepare.fit_prep(df, CLINICAL)
    coded = [c for c in CLINICAL.categorical if c != "season"]
    encoded = prep.impute(df).withColumns({f"{c}_code": _code(c, prep.categories[c]) for c in coded})
    columns = [*CLINICAL.numeric, *[f"{c}_code" for c in coded]]
    frame = learn.training_frame(encoded, CLINICAL.target, [CLINICAL.id, *columns])
    forest = learn.fit_forest(
        frame, CLINICAL.target, columns, replace(ForestConfig(), trees=100, max_depth=None, min_leaf=1), CLINICAL.id)
    table = learn.importance_table(spark, forest, columns)
    total = table.agg(F.round(F.sum("importance"), 6)).scalar()
    return table.select("feature", F.col("importance").between(0, 1).alias("in_range"), total.alias("total"))


@query("h2_permutation_facts", f"WITH {FILLED} SELECT feature, CAST(r AS INTEGER) AS repeat, n, true AS same_values FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, count(*) AS n FROM filled WHERE split = 'test'" for c in (*NUMERIC, *CATEGORICAL)
) + "), (SELECT unnest(range(1, 9)) AS r)")
def h2(spark, sf):
    """Each permuted column holds exactly the values of the original, in every repeat."""
    df, prep = inputs.fitted(spark, sf)
    test = stage(prep.impute(df.where("split = 'test'")), "test_rows")
    features = list(CLINICAL.features)
    moved = explain.permute(test, CLINICAL.target, features, id_col=CLINICAL.id)
    own = F.coalesce(*[F.when(F.col("feature") == f, F.col(f).cast("string")) for f in features])
    counted = moved.select("feature", "repeat", own.alias("v")).groupBy("feature", "repeat", "v").agg(F.count("*").alias("n"))
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("v")) for f in features]))
    truth = test.select(pairs.alias("fv")).groupBy("fv.feature", "fv.v").agg(F.count("*").alias("m"))
    both = counted.join(truth, (counted["feature"] == truth["feature"]) & counted["v"].eqNullSafe(truth["v"]), "left").select(
        counted["feature"], "repeat", "n", (F.col("n") == F.coalesce("m", F.lit(0))).cast("int").alias("same"))
    return both.groupBy("feature", "repeat").agg(F.sum("n").alias("n"), (F.min("same") == 1).alias("same_values"))


@query("h3_coefficients_facts", f"WITH {FILLED} SELECT unnest([{_ORDER}]) AS feature, true AS finite UNION ALL " + " UNION ALL ".join(
    f"SELECT DISTINCT '{c}_' || {c}, true FROM split WHERE split = 'train' AND {c} IS NOT NULL" for c in CATEGORICAL))
def h3(spark, sf):
    """A finite coefficient for each column of the fitted order, one-hot columns by category."""
    tr, _, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    table = explain.coefficient_table(spark, prep.order, model.model.stages[-1].coefficients.toArray())
    return table.select("feature", (F.abs("coefficient") < 1e6).alias("finite"))


@query("e21_synthetic_minority_facts", """
WITH c AS (SELECT quality, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY quality),
gap AS (SELECT arg_min(quality, n) AS minor, min(n) AS n, max(n) - min(n) AS missing FROM c),
r AS (SELECT doc_id, row_number() OVER (ORDER BY md5(concat(doc_id, ':', 42))) AS k FROM documents JOIN labels USING (doc_id), gap WHERE quality = minor)
SELECT doc_id, CAST(missing // n + CASE WHEN k <= missing % n THEN 1 ELSE 0 END AS BIGINT) AS copies, true AS inside
FROM r, gap WHERE missing // n + CASE WHEN k <= missing % n THEN 1 ELSE 0 END > 0""")
def e21(spark, sf):
    """How often each minority row is drawn; every synthetic row lies inside the range of its class."""
    docs = inputs.documents(spark, sf)
    cols = ["n_chars", "n_words", "digit_share"]
    made = balance.synthesise_minority(docs, TEXT_QUALITY, cols)
    minor = made.agg(F.min("quality")).scalar()
    span = docs.where(F.col("quality") == minor).agg(*[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    inside = F.lit(True)
    for c in cols:
        inside = inside & F.col(c).between(F.col(f"lo_{c}") - 1e-9, F.col(f"hi_{c}") + 1e-9)
    # One row of bounds.
    return made.join(F.broadcast(span)).groupBy("doc_id").agg(
        F.count_distinct("copy").alias("copies"), (F.min(inside.cast("int")) == 1).alias("inside"))


@query("e22_top_features_facts", f"WITH {SPLIT} SELECT count(*) AS n, 5 AS n_columns, true AS ranked FROM split WHERE split = 'train'")
def e22(spark, sf):
    """Five columns of the training rows, those whose importance no other column exceeds."""
    tr, _, prep = _folds(spark, sf)
    model = learn.fit_tree(_frame(tr, prep), CLINICAL.target, prep.order)
    names = prepare.top_features(learn.importance_table(spark, model, prep.order), 5)
    by_name = dict(zip(prep.order, model.importances().tolist()))
    ranked = min(by_name[c] for c in names) >= max(v for c, v in by_name.items() if c not in names)
    rows = tr.select(CLINICAL.id, *[F.col(f"`{c}`") for c in names])
    return rows.agg(F.count("*").alias("n")).select("n", F.lit(len(rows.columns) - 1).alias("n_columns"), F.lit(ranked).alias("ranked"))


@query("j1_append_run_facts", f"""WITH {SPLIT} SELECT run_id, 'logistic_regression' AS best_model_name, n_test FROM
  (SELECT unnest(['run-0', 'run-1']) AS run_id), (SELECT count(*) AS n_test FROM split WHERE split = 'test')""")
def j1(spark, sf):
    """Each run record names the metrics file of its run, which holds the model's row and its test rows."""
    tr, te, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    scored = score_all({model.name: model}, te, CLINICAL)
    path = new_path(spark, "runs")
    for i in range(2):
        write_metrics(evaluate.comparison(scored), f"{path}/metrics-{i}")
        append_run(run_record(
            spark, run_id=f"run-{i}", best_model_name=model.name, metrics_path=f"{path}/metrics-{i}",
            explainability=("importance", None)), f"{path}/log")
    runs = readers.read_runs(spark, f"{path}/log")
    found = None
    for r in runs.select("run_id", "metrics_path").collect():  # two records
        part = readers.read_csv(spark, r["metrics_path"]).select(F.lit(r["run_id"]).alias("run_id"), F.col("model").alias("best_model_name"))
        found = part if found is None else found.unionByName(part)
    return runs.select("run_id", "best_model_name").join(found, ["run_id", "best_model_name"]).select(
        "*", scored.agg(F.count("*")).scalar().alias("n_test"))
