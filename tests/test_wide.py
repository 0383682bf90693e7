"""Categorical columns of any width: against the narrow path, brute force and a forced shuffle."""

from dataclasses import replace
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.config import LogisticConfig
from riskframe.operators import learn, prepare
from riskframe.operators.prepare import fit_prep
from riskframe.operators.score import score
from riskframe.operators.wide import coefficients, fit_wide, fit_wide_logistic, load_wide
from riskframe.spec import FeatureSpec

SPEC = FeatureSpec(
    id="id", target="y", continuous=("x",), categorical=("a", "b"), target_codes={"1": 1, "0": 0}, labels={0: "no", 1: "yes"})
SCHEMA = "id long, x double, a string, b string, y int"


def _rows(n, seed=5):
    """A third of all rows share one category; some values are missing."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = None if i % 11 == 0 else "hot" if i % 3 == 0 else f"a{rng.randrange(12)}"
        b = None if i % 13 == 0 else f"b{rng.randrange(5)}"
        x = None if i % 17 == 0 else rng.gauss(0, 3)
        out.append((i, x, a, b, int(rng.random() < (0.8 if a in ("a1", "hot") else 0.3))))
    return out


@pytest.mark.parametrize("limit", [None, 0])
def test_same_fit_as_with_one_column_for_each_category(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(prepare, "BROADCAST_BYTES", limit)     # joins by shuffle
    df = spark.createDataFrame(_rows(1_500), SCHEMA)
    narrow = fit_prep(df, SPEC)
    table = narrow.transform(df)
    want = learn.fit_logistic(learn.training_frame(table, "y", narrow.order), "y", narrow.order)
    p_want = {r["id"]: r["p"] for r in want.predict(table).collect()}
    prep = fit_wide(df, SPEC)
    assembled = prep.assemble(df)
    model = fit_wide_logistic(assembled, "y", prep)
    p_got = {r["id"]: r["p"] for r in model.predict(prep.transform(df)).collect()}
    assert prep.width == len(narrow.order) and len(p_got) == 1_500
    assert max(abs(p_got[i] - p_want[i]) for i in p_want) < 1e-4
    vectors = learn.assembler(narrow.order).transform(table).select("id", "features").collect()
    stored = {r["id"]: r["features"] for r in assembled.collect()}
    for r in vectors:
        np.testing.assert_allclose(stored[r["id"]].toArray(), r["features"].toArray(), atol=1e-9)
    names = {(r["feature"], r["value"]) for r in coefficients(model).collect()}
    assert len(names) == prep.width and ("a", "hot") in names and ("x", None) in names


def test_hundred_thousand_categories_train_save_reload_score(spark, tmp_path):
    n = 100_000
    df = spark.range(2 * n).select(
        "id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % n).alias("a"),
        F.lit("one").alias("b"), (F.xxhash64(F.col("id") % n) % 2 == 0).cast("int").alias("y"))
    prep = fit_wide(df, SPEC)
    assert prep.sizes == {"a": n, "b": 1}
    model = fit_wide_logistic(prep.assemble(df), "y", prep, LogisticConfig(max_iter=20))
    model.save(str(tmp_path / "m"))
    again = load_wide(spark, str(tmp_path / "m"), SPEC)
    assert again.weights.count() == n + 1 and again.prep.width == prep.width
    got = again.predict(again.prep.transform(df))
    assert got.count() == 2 * n and got.where("yhat != y").isEmpty()


def test_unseen_null_and_absent_columns(spark):
    df = spark.createDataFrame(_rows(300), SCHEMA)
    prep = fit_wide(df, SPEC)
    model = fit_wide_logistic(prep.assemble(df), "y", prep)
    new = spark.createDataFrame([(1, "never", 0.5, "k"), (2, None, None, "k")], "id int, a string, x double, p_note string")
    out = {r["id"]: r for r in score(new, SPEC, prep, model.predict).collect()}
    assert out[1]["p_note"] == "k" and out[2]["a"] is None and len(out) == 2
    weight = {(r["feature"], r["value"]): r["coefficient"] for r in coefficients(model).collect()}
    margin = model.intercept + weight["b", prep.fills["b"]] + weight["x", None] * (0.5 - prep.numeric.mean["x"]) / prep.numeric.std["x"]
    assert out[1]["predicted_probability"] == pytest.approx(1 / (1 + np.exp(-margin)), abs=1e-4)


def test_columns_without_values_and_without_numbers(spark):
    rows = [(i, None, f"v{i % 4}", None, i % 2) for i in range(40)]
    spec = replace(SPEC, continuous=())
    df = spark.createDataFrame(rows, SCHEMA)
    prep = fit_wide(df, spec)
    assert prep.sizes == {"a": 4, "b": 1} and prep.fills["b"] == "unknown"
    model = fit_wide_logistic(prep.assemble(df), "y", prep)
    assert model.predict(prep.transform(df)).where("yhat != y").isEmpty()
    empty = prep.transform(df.limit(0))
    assert model.predict(empty).isEmpty()
