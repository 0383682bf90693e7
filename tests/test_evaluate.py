import random

import pytest
from pyspark.sql import functions as F

from riskframe.operators import evaluate, explain

# Published confusion counts and the metrics they resolve to.
GOLDEN = {
    "logistic_regression": ((804, 79, 93, 1023), (0.9139569784892446, 0.9105322763306908, 0.8963210702341137, 0.903370786516854), 0.9719259803296733),
    "decision_tree": ((797, 85, 100, 1017), (0.9074537268634317, 0.9036281179138322, 0.8885172798216276, 0.896008993816751), 0.9558373647184506),
    "random_forest": ((812, 92, 85, 1010), (0.9114557278639319, 0.8982300884955752, 0.9052396878483835, 0.9017212659633537), 0.9661343417360146),
    "svm": ((806, 75, 91, 1027), (0.9169584792396198, 0.9148694665153235, 0.8985507246376812, 0.906636670416198), 0.9669082462817175),
}


def test_golden_metrics_and_best_model(spark):
    counts = spark.createDataFrame(
        [(m, *c) for m, (c, _, _) in GOLDEN.items()], "model string, tp bigint, fp bigint, fn bigint, tn bigint")
    rows = {r["model"]: r for r in evaluate.rates(counts).collect()}
    for m, (_, want, _) in GOLDEN.items():
        got = [rows[m][c] for c in ("accuracy", "precision", "recall", "f1_score")]
        assert got == pytest.approx(want, abs=1e-12)
    areas = spark.createDataFrame([(m, a) for m, (_, _, a) in GOLDEN.items()], "model string, roc_auc double")
    assert evaluate.best_model(evaluate.rates(counts).join(areas, "model")).first()["model"] == "svm"


def _scored(spark, rows):
    return spark.createDataFrame(rows, "model string, y int, p double").withColumn(
        "yhat", F.when(F.col("p") >= 0.5, 1).otherwise(0))


def _pair_auc(rows):
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    wins = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return wins / (len(pos) * len(neg))


@pytest.mark.parametrize("per_range", [200_000, 20])
def test_auc_counts_pairs_with_a_hot_score(spark, monkeypatch, per_range):
    from riskframe.functions import ordering

    monkeypatch.setattr(ordering, "ROWS_PER_RANGE", per_range)
    rng = random.Random(5)
    rows = [("m", rng.randint(0, 1), 0.4 if i % 3 == 0 else rng.random()) for i in range(600)]
    got = evaluate.auc(_scored(spark, rows)).first()["roc_auc"]
    assert got == pytest.approx(_pair_auc(rows), abs=1e-12)
    binned = evaluate.auc_binned(_scored(spark, rows), 10_000).first()["roc_auc"]
    assert binned == pytest.approx(got, abs=1e-3)


def test_single_class_scores_zero(spark):
    out = evaluate.comparison(_scored(spark, [("m", 1, 0.2), ("m", 1, 0.9)])).first()
    assert out["roc_auc"] == 0.0 and out["recall"] == 0.5


def test_roc_area_equals_auc_and_starts_at_origin(spark):
    rng = random.Random(6)
    rows = [("m", rng.randint(0, 1), round(rng.random(), 2)) for _ in range(300)]
    for thin in (True, False):
        pts = sorted((r["fpr"], r["tpr"]) for r in evaluate.roc_points(_scored(spark, rows), thin=thin).collect())
        area = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(pts, pts[1:]))
        assert pts[0] == (0.0, 0.0) and pts[-1] == (1.0, 1.0)
        assert area == pytest.approx(_pair_auc(rows), abs=1e-12)


def test_sweep_ends(spark):
    rows = [("m", 1, 1.0), ("m", 0, 0.3), ("m", 1, 0.0)]
    out = {round(r["threshold"], 2): r for r in evaluate.threshold_sweep(_scored(spark, rows)).collect()}
    assert len(out) == 21
    assert out[0.0]["recall"] == 1.0 and out[1.0]["precision"] == 1.0 and out[0.3]["accuracy"] == pytest.approx(1 / 3)


def test_gini_split_against_brute_force(spark):
    rng = random.Random(7)
    rows = [(rng.randint(0, 1), float(rng.randint(0, 30))) for _ in range(400)]
    rows = [(y, x + 6 * y) for y, x in rows]
    got = evaluate.gini_split(spark.createDataFrame(rows, "y int, x double"), ["x"], "y").first()
    w = {c: len(rows) / (2 * sum(y == c for y, _ in rows)) for c in (0, 1)}
    xs = sorted({x for _, x in rows})

    def impurity(t):
        total = 0.0
        for side in (True, False):
            a, b = (sum(w[c] for y, x in rows if y == c and (x <= t) == side) for c in (0, 1))
            total += (a + b) * (1 - (a / (a + b)) ** 2 - (b / (a + b)) ** 2)
        return total / len(rows)

    best = min((round(impurity((a + b) / 2), 9), (a + b) / 2) for a, b in zip(xs, xs[1:]))
    assert (got["impurity"], got["threshold"]) == (pytest.approx(best[0], abs=1e-9), best[1])


def test_permutation_moves_only_one_feature_and_permutes(spark):
    n = 500
    df = spark.range(n).select("id", (F.col("id") % 2).cast("int").alias("y"),
                               F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("b"))
    out = explain.permute(df, "y", ["a", "b"], repeats=3).collect()
    assert len(out) == n * 2 * 3
    for f in ("a", "b"):
        for r in (1, 2, 3):
            part = [x for x in out if x["feature"] == f and x["repeat"] == r]
            assert sorted(x["a"] for x in part) == [float(i) for i in range(n)]
            moved = sum(x["b"] != 2 * x["a"] for x in part)
            assert moved == n


def test_permutation_blocks_stay_bounded_when_every_record_is_a_copy(spark, monkeypatch):
    monkeypatch.setattr(explain, "BLOCK_ROWS", 100)
    df = spark.range(3_000).select(F.lit(1).alias("y"), F.lit(2.0).alias("a"))
    assert explain.permute(df, "y", ["a"], repeats=2).count() == 6_000
    keys = spark.range(3_000).select(F.pmod(F.shiftright(F.xxhash64("id", F.lit(42)), 17), F.lit(30)).alias("b"))
    sizes = [r["count"] for r in keys.groupBy("b").count().collect()]
    assert len(sizes) == 30 and max(sizes) < 200


def test_permutation_importance_finds_the_informative_feature(spark):
    df = spark.range(2_000).select("id", (F.col("id") % 2).cast("int").alias("y"),
                                   (F.col("id") % 2).cast("double").alias("a"), F.rand(1).alias("b"))
    predict = lambda d: d.withColumn("yhat", F.col("a").cast("int"))
    got = {r["feature"]: r for r in explain.permutation_importance(df, "y", ["a", "b"], predict).collect()}
    assert 0.4 < got["a"]["importance_mean"] < 0.6 and got["b"]["importance_mean"] == 0.0
    assert got["b"]["importance_std"] == 0.0
