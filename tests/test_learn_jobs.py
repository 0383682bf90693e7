from dataclasses import replace
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.config import ForestConfig, KernelConfig, RunConfig
from riskframe.operators import evaluate, kernel, learn
from riskframe.operators.prepare import PrepModel
from riskframe.plans.batch import score_csv, score_json_records, score_table
from riskframe.plans.registry import ModelStore
from riskframe.plans.training import train
from riskframe.sources import readers
from riskframe.spec import CLINICAL
from riskframe.streaming import scoring as streaming

FAST = RunConfig(
    forest=ForestConfig(trees=10, max_depth=5),
    kernel=KernelConfig(components=64, max_iter=15, folds=3),
)


@pytest.fixture(scope="module")
def trained(spark, sf, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("run") / "out")
    result = train(inputs.cohort(spark, sf), CLINICAL, FAST, out)
    return result, out, ModelStore(spark, f"{out}/store", CLINICAL)


def test_metrics_table(trained, spark):
    result, out, _ = trained
    rows = {r["model"]: r for r in result.metrics.collect()}
    assert set(rows) == {learn.LOGISTIC, learn.TREE, learn.FOREST, learn.SVM}
    assert all(r["roc_auc"] > 0.9 and r["accuracy"] > 0.85 for r in rows.values())
    csv = readers.read_csv(spark, f"{out}/model_comparison")
    assert csv.columns == ["model", "accuracy", "precision", "recall", "f1_score", "roc_auc"]
    runs = readers.read_runs(spark, f"{out}/runs").first()
    assert runs["best_model_name"] == result.best
    snapshot = spark.read.text(runs["config_snapshot_path"]).first()[0]
    assert json.loads(snapshot)["split"]["seed"] == 42


def test_unknown_labels_are_stored_by_every_run(trained, spark, sf, monkeypatch):
    from riskframe.plans import training

    result, out, _ = trained
    assert result.rejected.count() == spark.read.parquet(f"{out}/rejected").count()
    raw = inputs.cohort(spark, sf).limit(300)
    odd = raw.limit(7).withColumns({"case_status": F.lit("maybe"), "patient_id": -F.col("patient_id")})
    monkeypatch.setattr(training, "fit_all", lambda train, spec, columns, config: {
        learn.LOGISTIC: learn.fit_logistic(learn.training_frame(train, spec.target, columns), spec.target, columns)})
    kept = training.train(raw.unionByName(odd), CLINICAL, FAST).rejected
    assert kept.count() == 7


def test_scores_are_probabilities(trained):
    scored = trained[0].scored
    assert scored.where("p < 0 OR p > 1 OR p IS NULL OR yhat NOT IN (0, 1)").count() == 0


def test_batch_keeps_columns_and_appends_two(trained, spark, tmp_path):
    _, _, store = trained
    src, dst = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [("X1", "Male", "25", "Rural", "true", "3"), ("X2", "Female", "", "Urban", "False", "0")]
    spark.createDataFrame(rows, "`Patient ID` string, Sex string, `Age Years` string, Residence string, "
                          "`Has Fever` string, `Fever_Days` string").write.option("header", True).csv(src)
    score_csv(spark, src, dst, CLINICAL, store)
    out = readers.read_csv(spark, dst)
    assert out.columns == ["Patient ID", "Sex", "Age Years", "Residence", "Has Fever", "Fever_Days",
                           "predicted_label", "predicted_probability"]
    got = {r["Patient ID"]: r for r in out.collect()}
    assert len(got) == 2 and got["X1"]["Has Fever"] == "true"
    assert all(r["predicted_label"] in CLINICAL.labels.values() for r in got.values())


def test_batch_scoring_plan_has_no_shuffle(trained, spark, sf):
    _, _, store = trained
    table = inputs.typed(spark, sf).drop(CLINICAL.target)
    plan = score_table(table, CLINICAL, store, learn.LOGISTIC)._jdf.queryExecution().executedPlan().toString()
    base = table._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == base.count("Exchange")


@pytest.mark.parametrize("name", [learn.LOGISTIC, learn.TREE, learn.FOREST, learn.SVM, None])
def test_partial_record_by_any_model(trained, spark, name):
    result, _, store = trained
    one = spark.createDataFrame([('{"sex": "Male", "age_years": 25, "has_fever": 1}',), ("{}",)], "r string")
    rows = score_json_records(one, "r", CLINICAL, store, name).collect()
    assert len(rows) == 2 and all(0 <= r["probability"] <= 1 for r in rows)
    assert rows[0]["model_used"] == (name or result.best)


def test_reloaded_models_score_the_same(trained, spark, sf):
    result, _, store = trained
    table = inputs.typed(spark, sf).limit(50)
    for name in (learn.LOGISTIC, learn.SVM):
        again = {r[0]: r[1] for r in score_table(table, CLINICAL, store, name).select(
            CLINICAL.id, "predicted_probability").collect()}
        fresh = result.models[name].predict(result.prep.transform(table)).select(CLINICAL.id, F.round("p", 4)).collect()
        assert again == dict(map(tuple, fresh))


def test_store_switches_whole_versions(spark, tmp_path):
    def prep(mean):
        spec = replace(CLINICAL, continuous=("age_years",), flags=(), categorical=())
        return PrepModel(spec, {"age_years": 0.0}, {"age_years": mean}, {"age_years": 1.0}, {})

    class Dying:
        def save(self, path):
            raise RuntimeError("lost")

    store = ModelStore(spark, str(tmp_path / "s"), prep(0.0).spec)
    store.save({}, prep(1.0), "a")
    reader = store.pinned()
    with pytest.raises(RuntimeError, match="lost"):
        store.save({"b": Dying()}, prep(9.0), "b")
    assert store.best_name() == "a" and store.prep().mean["age_years"] == 1.0
    store.save({}, prep(2.0), "c")
    assert store.best_name() == "c" and store.prep().mean["age_years"] == 2.0
    assert reader.best_name() == "a" and reader.prep().mean["age_years"] == 1.0


def test_missing_model_raises(spark, tmp_path, trained):
    with pytest.raises(FileNotFoundError):
        ModelStore(spark, str(tmp_path / "none"), CLINICAL).model()
    with pytest.raises(FileNotFoundError):
        trained[2].model("no_such_model")


def test_logistic_gradient_vanishes(spark):
    rng = random.Random(0)
    rows = [(i, int(rng.random() < 0.3), rng.gauss(0, 1), rng.gauss(0, 1)) for i in range(800)]
    rows = [(i, y, a + y, b - y) for i, y, a, b in rows]
    df = spark.createDataFrame(rows, "id int, y int, a double, b double")
    frame = learn.training_frame(df, "y", ["a", "b"])
    fit = learn.fit_logistic(frame, "y", ["a", "b"]).model.stages[-1]
    w = {r["y"]: r["_weight"] for r in frame.select("y", "_weight").distinct().collect()}
    x = np.array([[a, b] for _, _, a, b in rows])
    y = np.array([r[1] for r in rows])
    beta = fit.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ beta + fit.intercept)))
    weight = np.array([w[v] for v in y])
    # C * sum(w * loss) + |beta|^2 / 2 with C = 1
    grad = beta + x.T @ (weight * (p - y))
    assert np.abs(grad).max() < 1e-2 and abs((weight * (p - y)).sum()) < 1e-2


def test_kernel_beats_linear_on_a_ring(spark):
    rng = np.random.default_rng(3)
    pts = rng.normal(0, 1, (1200, 2))
    y = (np.hypot(*pts.T) > 1.2).astype(int)
    df = spark.createDataFrame([(i, int(c), float(a), float(b)) for i, (c, (a, b)) in enumerate(zip(y, pts))],
                               "id int, y int, a double, b double")
    frame = learn.training_frame(df, "y", ["id", "a", "b"])
    model = kernel.fit_calibrated_svm(frame, "id", "y", ["a", "b"], KernelConfig(components=128, folds=3))
    scored = model.predict(df).withColumn("model", F.lit("svm"))
    linear = learn.fit_logistic(frame, "y", ["a", "b"]).predict(df).withColumn("model", F.lit("lr"))
    assert evaluate.auc(scored).first()["roc_auc"] > 0.98
    assert evaluate.auc(linear).first()["roc_auc"] < 0.7
    assert model.slope > 0
    assert scored.where("p < 0 OR p > 1").count() == 0


def test_sigmoid_fit_matches_smoothed_likelihood(spark):
    rng = random.Random(4)
    rows = [(s, int(rng.random() < 1 / (1 + np.exp(-(2 * s + 0.5))))) for s in (rng.gauss(0, 1) for _ in range(1500))]
    a, b = kernel.fit_sigmoid(spark.createDataFrame(rows, "s double, y int"), "s", "y")
    pos = sum(y for _, y in rows)
    hi, lo = (pos + 1) / (pos + 2), 1 / (len(rows) - pos + 2)
    err = np.array([1 / (1 + np.exp(-(a * s + b))) - (hi if y else lo) for s, y in rows])
    s = np.array([r[0] for r in rows])
    assert abs(err.sum()) < 1 and abs((err * s).sum()) < 1


def test_monitor_append_mode_is_a_prefix_of_the_batch_result(spark, sf, tmp_path):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = streaming.read_stream(spark, sf, schema, only="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    agg = streaming.class_monitor(events, "ts", F.col("value") > 10)
    streaming.append_log(agg, str(tmp_path / "log"), str(tmp_path / "cp"), once=True).awaitTermination()
    closed = {r["window_start"]: r["n"] for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    whole = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/events.parquet").groupBy(
        F.date_trunc("day", F.col("ts").cast("timestamp"))).count().collect()}
    assert closed and all(whole[k] == n for k, n in closed.items()) and len(closed) < len(whole)


def test_monitor_state_is_not_gathered_in_one_task(spark, sf, tmp_path):
    from pyspark import TaskContext

    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    events = streaming.read_stream(spark, sf, schema, only="events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    task = F.udf(lambda _: TaskContext.get().taskAttemptId(), "long")
    agg = streaming.class_monitor(events, "ts", F.col("value") > 10).withColumn("task", task("n"))
    streaming.write_latest(agg, str(tmp_path / "table"), str(tmp_path / "cp")).awaitTermination()
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.select("task").distinct().count() > 1
    assert table.agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf}/events.parquet").count()


def test_retraining_waits_for_enough_rows(spark, tmp_path):
    schema = "id int, y int"
    seen = []

    def arrive(lo, hi, name):
        spark.range(lo, hi).selectExpr("int(id) AS id", "int(id % 2) AS y").coalesce(1).write.mode("append").parquet(
            str(tmp_path / "in"))
        stream = streaming.read_stream(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema)
        streaming.retrain_when(stream, str(tmp_path / "log"), str(tmp_path / "cp"), 100,
                               lambda rows: seen.append(rows.count())).awaitTermination()

    arrive(0, 60, "a")
    assert seen == []
    arrive(60, 130, "b")
    assert seen == [130]
    arrive(130, 150, "c")
    assert seen == [130]


def test_importance_forest_has_no_depth_limit(spark, sf, monkeypatch):
    from riskframe.catalog import learning

    fit, seen = learn.fit_forest, []

    def kept(*args):
        seen.append(fit(*args))
        return seen[-1]

    monkeypatch.setattr(learning.learn, "fit_forest", kept)
    table = learning.h1(spark, sf).collect()
    nodes = seen[0].nodes
    # Every leaf is pure, too small, or cannot be split by any of the features it may try.
    leaf = (nodes.feature < 0) & (nodes.n0 > 0) & (nodes.n1 > 0) & (nodes.n0 + nodes.n1 > 200)
    assert not leaf.any()
    assert sum(r["importance"] for r in table) == pytest.approx(1.0)
