import numpy as np
from pyspark.ml.classification import LinearSVC
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from riskframe.operators import margins


def _rows(spark, n=3000, width=6, folds=4):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (n, width))
    y = (x @ rng.normal(0, 1, width) + rng.normal(0, 0.8, n) > 0.3).astype(int)
    data = [(a.tolist(), int(b), float(1 + (i % 3)), i % folds) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "x array<double>, y int, w double, fold int").repartition(5)
    return df, x, np.where(y == 1, 1.0, -1.0), np.array([d[2] for d in data])


def _blocks(df):
    return margins.pack(df, "x", "y", "w", "fold", lambda x: x).persist()


def _objective(beta, x, sign, w):
    hinge = np.maximum(0, 1 - sign * (x @ beta[:-1] + beta[-1]))
    return w @ hinge / w.sum() + beta[:-1] @ beta[:-1] / (2 * w.sum())


def test_folds_together_equal_separate_fits(spark, monkeypatch):
    df, *_ = _rows(spark)
    blocks = _blocks(df)
    together = margins.fit_margins(blocks, [0, 1, 2, 3, margins.ALL], 6)
    assert not np.allclose(together[0], together[1], atol=1e-3)
    for k, beta in zip([0, 1], together):
        alone = _blocks(df.where(F.col("fold") != k))
        (one,) = margins.fit_margins(alone, [margins.ALL], 6)
        np.testing.assert_allclose(beta, one, atol=1e-6)
    monkeypatch.setattr(margins, "FAN_IN", 2)
    np.testing.assert_allclose(margins.fit_margins(blocks, [1], 6)[0], together[1], atol=1e-6)


def test_objective_is_no_worse_than_that_of_the_library_fit(spark):
    df, x, sign, w = _rows(spark)
    (beta,) = margins.fit_margins(_blocks(df), [margins.ALL], 6)
    fit = LinearSVC(labelCol="y", weightCol="w", standardization=False, regParam=1 / w.sum(), maxIter=30, tol=1e-6).fit(
        df.withColumn("features", array_to_vector("x")))
    theirs = np.append(fit.coefficients.toArray(), fit.intercept)
    assert _objective(beta, x, sign, w) <= _objective(theirs, x, sign, w) + 0.02 / 4


def test_rounded_hinge_is_close_and_smooth():
    m = np.linspace(-1, 3, 4001)
    for width in margins.BANDS:
        got = margins.rounded_hinge(m, width)
        gap = got - np.maximum(0, 1 - m)
        assert gap.min() >= -1e-12 and gap.max() <= width / 4 + 1e-12
        assert np.abs(np.diff(got, 2)).max() <= (m[1] - m[0]) ** 2 / (2 * width) + 1e-12


def test_held_out_rows_are_scored_by_the_fit_without_them(spark):
    df, x, *_ = _rows(spark, n=40)
    fits = [np.append(np.full(6, float(k)), k) for k in range(4)]
    got = sorted(r["score"] for r in margins.held_out_scores(_blocks(df), range(4), fits).collect())
    want = sorted((i % 4) * (x[i].sum() + 1) for i in range(40))
    np.testing.assert_allclose(got, want, atol=1e-9)


def test_no_rows_and_one_class(spark):
    df, *_ = _rows(spark, n=40)
    (none,) = margins.fit_margins(_blocks(df.where("false")), [margins.ALL], 6)
    assert not none.any()
    (one,) = margins.fit_margins(_blocks(df.where("y = 1")), [margins.ALL], 6)
    assert np.isfinite(one).all() and one[-1] > 0.9


def test_rows_stay_narrow_and_are_widened_a_block_at_a_time(spark):
    df, x, *_ = _rows(spark)

    def features(a):
        if len(a) > margins.BLOCK_ROWS:
            raise ValueError("more than a block")
        return np.hstack([np.cos(a), np.sin(a)])

    narrow = margins.pack(df, "x", "y", "w", "fold").persist()
    assert narrow.select(F.max(F.size("x"))).first()[0] == 6
    wide = margins.pack(df, "x", "y", "w", "fold", features).persist()
    assert wide.select(F.max(F.size("x"))).first()[0] == 12
    folds = [0, 1, margins.ALL]
    got = margins.fit_margins(narrow, folds, 12, features=features)
    np.testing.assert_allclose(got, margins.fit_margins(wide, folds, 12), atol=1e-6)
    scores = [sorted(r["score"] for r in s.collect()) for s in (
        margins.held_out_scores(narrow, folds[:2], got, features), margins.held_out_scores(wide, folds[:2], got))]
    np.testing.assert_allclose(*scores, atol=1e-9)
