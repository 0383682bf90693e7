"""Fitted-model queries. What SQL can say about them is in ``facts``."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.registry import query
from riskframe.config import ForestConfig, RunConfig
from riskframe.functions.staging import new_path, stage
from riskframe.operators import balance, evaluate, explain, kernel, learn, prepare
from riskframe.operators.runs import run_record
from riskframe.plans.batch import score_json_records, score_table
from riskframe.plans.registry import ModelStore
from riskframe.plans.training import prepare_folds, score_all, train
from riskframe.sources import readers
from riskframe.sources.sinks import write_metrics
from riskframe.spec import CLINICAL

_CONFIG = RunConfig()


def _folds(spark, sf):
    prepared, prep = prepare_folds(inputs.cohort(spark, sf), CLINICAL, _CONFIG)
    return prepared.where("split = 'train'"), prepared.where("split = 'test'"), prep


def _metrics(model, test):
    return evaluate.comparison(score_all({model.name: model}, test, CLINICAL))


def _frame(train_rows, prep, *extra):
    return learn.training_frame(train_rows, CLINICAL.target, [*extra, *prep.order])


@query("f1_logistic")
def f1(spark, sf):
    tr, te, prep = _folds(spark, sf)
    return _metrics(learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order), te)


@query("f2_tree")
def f2(spark, sf):
    tr, te, prep = _folds(spark, sf)
    return _metrics(learn.fit_tree(_frame(tr, prep), CLINICAL.target, prep.order), te)


@query("f3_forest")
def f3(spark, sf):
    tr, te, prep = _folds(spark, sf)
    return _metrics(learn.fit_forest(_frame(tr, prep, CLINICAL.id), CLINICAL.target, prep.order, id_col=CLINICAL.id), te)


@query("f4_kernel_svm")
def f4(spark, sf):
    """Uncalibrated kernel SVM; the score passes a plain sigmoid, which keeps its order."""
    tr, te, prep = _folds(spark, sf)
    return _metrics(kernel.fit_kernel_svm(_frame(tr, prep), CLINICAL.target, prep.order), te)


@query("f5_calibrated")
def f5(spark, sf):
    tr, te, prep = _folds(spark, sf)
    model = kernel.fit_calibrated_svm(
        _frame(tr, prep, CLINICAL.id), CLINICAL.id, CLINICAL.target, prep.order)
    return evaluate.calibration(score_all({model.name: model}, te, CLINICAL))


@query("f7_train_all")
def f7(spark, sf):
    """All four classifiers at their reference settings."""
    return train(inputs.cohort(spark, sf), CLINICAL, _CONFIG).metrics


@query("f8_predict")
def f8(spark, sf):
    tr, te, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    return model.predict(te).select(CLINICAL.id, "yhat", "p")


@query("a8_model_store")
def a8(spark, sf):
    """Save, reload, and score through the reloaded best model (i3: chosen by name or best)."""
    tr, te, prep = _folds(spark, sf)
    frame = _frame(tr, prep)
    models = {m.name: m for m in (
        learn.fit_logistic(frame, CLINICAL.target, prep.order),
        learn.fit_tree(frame, CLINICAL.target, prep.order),
    )}
    best = evaluate.best_model(evaluate.comparison(score_all(models, te, CLINICAL))).first()["model"]
    store = ModelStore(spark, new_path(spark, "store"), CLINICAL)
    store.save(models, prep, best)
    return score_table(inputs.cohort(spark, sf), CLINICAL, store).select(
        "patient_id", "predicted_label", "predicted_probability")


@query("i3_choose_model")
def i3(spark, sf):
    tr, _, prep = _folds(spark, sf)
    frame = _frame(tr, prep)
    models = {m.name: m for m in (
        learn.fit_logistic(frame, CLINICAL.target, prep.order),
        learn.fit_tree(frame, CLINICAL.target, prep.order),
    )}
    store = ModelStore(spark, new_path(spark, "store"), CLINICAL)
    store.save(models, prep, learn.LOGISTIC)
    sparse = inputs.typed(spark, sf).select(
        "patient_id", F.to_json(F.struct("age_years", "has_fever", "sex")).alias("record"))
    return score_json_records(sparse, "record", CLINICAL, store, learn.TREE).drop("record")


@query("h1_importance")
def h1(spark, sf):
    """Impurity importance of a 100-tree forest of any depth on imputed, label-encoded features without the season."""
    df = inputs.cleaned(spark, sf)
    prep = prepare.fit_prep(df, CLINICAL)
    coded = [c for c in CLINICAL.categorical if c != "season"]
    encoded = prep.impute(df).withColumns({f"{c}_code": _code(c, prep.categories[c]) for c in coded})
    columns = [*CLINICAL.numeric, *[f"{c}_code" for c in coded]]
    frame = learn.training_frame(encoded, CLINICAL.target, [CLINICAL.id, *columns])
    forest = learn.fit_forest(
        frame, CLINICAL.target, columns, replace(ForestConfig(), trees=100, max_depth=None, min_leaf=1), CLINICAL.id)
    return learn.importance_table(spark, forest, columns)


def _code(column, values):
    """Sorted label codes of a fitted category list, as literals."""
    out = F.lit(-1)
    for i, v in enumerate(values):
        out = F.when(F.col(column) == v, float(i)).otherwise(out)
    return out.cast("double")


@query("h2_permutation")
def h2(spark, sf):
    """Permuting one-hot members of a categorical together: the raw column is permuted, then encoded."""
    df, prep = inputs.fitted(spark, sf)
    test = prep.impute(df.where("split = 'test'"))
    tr = stage(prep.transform(df.where("split = 'train'")), "prepared")
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    return explain.permutation_importance(
        test, CLINICAL.target, list(CLINICAL.features),
        lambda rows: model.predict(prep.onehot(prep.scale(rows))), id_col=CLINICAL.id,
    )


@query("h3_coefficients")
def h3(spark, sf):
    tr, _, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    return explain.coefficient_table(spark, prep.order, model.model.stages[-1].coefficients.toArray())


@query("e21_synthetic_minority")
def e21(spark, sf):
    docs = inputs.documents(spark, sf)
    cols = ["n_chars", "n_words", "digit_share"]
    from riskframe.spec import TEXT_QUALITY

    return balance.synthesise_minority(docs, TEXT_QUALITY, cols)


@query("e22_top_features")
def e22(spark, sf):
    tr, _, prep = _folds(spark, sf)
    model = learn.fit_tree(_frame(tr, prep), CLINICAL.target, prep.order)
    names = prepare.top_features(learn.importance_table(spark, model, prep.order), 5)
    return tr.select(CLINICAL.id, *[F.col(f"`{c}`") for c in names])


@query("j1_append_run")
def j1(spark, sf):
    """A run of the logistic model, appended to a log and read back flat."""
    from riskframe.operators.runs import append_run

    tr, te, prep = _folds(spark, sf)
    model = learn.fit_logistic(_frame(tr, prep), CLINICAL.target, prep.order)
    metrics = stage(_metrics(model, te), "metrics")
    path = new_path(spark, "runs")
    for i in range(2):
        write_metrics(metrics, f"{path}/metrics-{i}")
        append_run(run_record(
            spark, run_id=f"run-{i}", best_model_name=model.name, metrics_path=f"{path}/metrics-{i}",
            explainability=("importance", None),
        ), f"{path}/log")
    return readers.read_runs(spark, f"{path}/log")
