"""Evaluation of scored frames with columns (model, y, p, yhat).

Everything starts from counts that combine before the shuffle. Rank statistics
first reduce to one row per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskframe.functions.columns import safe_ratio
from riskframe.functions.ordering import running_sums
from riskframe.functions.staging import stage

# Display names of the metrics.
METRIC_NAMES = {
    "accuracy": "Accuracy",
    "precision": "Precision",
    "recall": "Recall",
    "f1_score": "F1-Score",
}


def confusion(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    y, h = F.col("y"), F.col("yhat")
    return scored.groupBy(*by).agg(
        F.count_if((y == 1) & (h == 1)).alias("tp"),
        F.count_if((y == 0) & (h == 1)).alias("fp"),
        F.count_if((y == 1) & (h == 0)).alias("fn"),
        F.count_if((y == 0) & (h == 0)).alias("tn"),
    )


def rates(counts: DataFrame) -> DataFrame:
    """accuracy, precision, recall and F1 of confusion counts; 0 on a zero divisor."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))
    keys = [c for c in counts.columns if c not in ("tp", "fp", "fn", "tn")]
    return counts.select(
        *keys,
        safe_ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        safe_ratio(tp, tp + fp).alias("precision"),
        safe_ratio(tp, tp + fn).alias("recall"),
        safe_ratio(2 * tp, 2 * tp + fp + fn).alias("f1_score"),
    )


def score_counts(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.where(F.col("p").isNotNull()).groupBy(*by, "p").agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"),
    )


def tally(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """Confusion counts per distinct score: all that rates and AUC need from the
    rows, so metrics cost one scan of the scored frame."""
    return stage(confusion(scored, [*by, "p"]), "tally")


def _area_of_tally(counts: DataFrame, by: Sequence[str], staged: bool) -> DataFrame:
    per_score = counts.where(F.col("p").isNotNull()).withColumns({
        "pos": F.col("tp") + F.col("fn"), "neg": F.col("fp") + F.col("tn"),
    })
    return auc_of_counts(per_score, by, staged)


def _total(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    return counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")])


def _pairs(a: Column, b: Column) -> Column:
    """Product of two counts beyond the range of a long."""
    return a.cast("decimal(18,0)") * b.cast("decimal(19,0)")


def auc(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Exact area under the ROC curve, ties counted half, 0 for a single class."""
    return auc_of_counts(score_counts(scored, by), by)


def auc_of_counts(counts: DataFrame, by: Sequence[str], staged: bool = False) -> DataFrame:
    run = running_sums(counts, by, "p", ["neg"], staged=staged)
    below = F.col("cum_neg") - F.col("neg")
    # Twice the pair count is an integer; as a decimal product its sum neither overflows nor drifts.
    twice = _pairs(F.col("pos"), 2 * below + F.col("neg"))
    return run.groupBy(*by).agg(
        F.sum(twice).alias("_w"), F.sum("pos").alias("_p"), F.sum("neg").alias("_n")
    ).select(
        *by,
        safe_ratio(
            F.col("_w").cast("double"), 2.0 * F.col("_p").cast("double") * F.col("_n").cast("double")
        ).alias("roc_auc"),
    )


def auc_binned(scored: DataFrame, bins: int = 10_000, by: Sequence[str] = ("model",)) -> DataFrame:
    """AUC over equal score bins: one pass, no sort of scores; error at most the
    share of pairs that fall into one bin."""
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("bigint")
    binned = scored.where(F.col("p").isNotNull()).groupBy(*by, at.alias("_b")).agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"),
    )
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("neg").over(before), F.lit(0))
    return binned.withColumn("_below", below).groupBy(*by).agg(
        F.sum(_pairs(F.col("pos"), 2 * F.col("_below") + F.col("neg"))).alias("_w"),
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"),
    ).select(
        *by,
        safe_ratio(
            F.col("_w").cast("double"), 2.0 * F.col("_p").cast("double") * F.col("_n").cast("double")
        ).alias("roc_auc"),
    )


def roc_points(scored: DataFrame, by: Sequence[str] = ("model",), thin: bool = True) -> DataFrame:
    """ROC points with their thresholds, origin included (its threshold is NULL).

    With ``thin``, an inner point is left out when the step to the next point
    repeats the step that led to it, since a plotted line stays the same.
    """
    by = list(by)
    counts = score_counts(scored, by)
    totals = counts.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    # Descending order: the running totals are the true and false positives.
    run = running_sums(counts.withColumn("down", -F.col("p")), by, "down", ["pos", "neg"])
    if thin:
        first = (F.col("cum_pos") == F.col("pos")) & (F.col("cum_neg") == F.col("neg"))
        last = F.col("next").isNull()
        turns = (F.col("next.pos") != F.col("pos")) | (F.col("next.neg") != F.col("neg"))
        run = run.where(first | last | turns)

    def share(part: str, whole: str):
        return safe_ratio(F.col(part).cast("double"), F.col(whole).cast("double"))

    points = run.join(totals, by).select(
        *by, share("cum_neg", "_n").alias("fpr"), share("cum_pos", "_p").alias("tpr"),
        F.col("p").alias("threshold"),
    )
    origin = totals.select(
        *by, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"),
        F.lit(None).cast("double").alias("threshold"),
    )
    return points.unionByName(origin)


def comparison(scored: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per model: model, accuracy, precision, recall, f1_score, roc_auc."""
    by = list(by)
    counts = tally(scored, by)
    area = _area_of_tally(counts, by, staged=True)
    return rates(_total(counts, by)).join(area, by, "left").select(
        *by, "accuracy", "precision", "recall", "f1_score",
        F.coalesce("roc_auc", F.lit(0.0)).alias("roc_auc"),
    )


def melt_metrics(metrics: DataFrame) -> DataFrame:
    cols = [c for c in METRIC_NAMES if c in metrics.columns]
    return metrics.unpivot("model", cols, "metric", "score").replace(METRIC_NAMES, subset=["metric"])


def best_model(metrics: DataFrame) -> DataFrame:
    """Highest F1, then AUC, then accuracy, then name."""
    return metrics.orderBy(
        F.desc("f1_score"), F.desc("roc_auc"), F.desc("accuracy"), "model"
    ).limit(1)


def threshold_sweep(scored: DataFrame, steps: int = 20, by: Sequence[str] = ("model",)) -> DataFrame:
    """Rates at thresholds 0, 1/steps, ..., 1.

    Each row lands once in the bucket of the thresholds it passes; the counts per
    threshold are suffix sums over at most ``steps + 2`` buckets.
    """
    by = list(by)
    passed = F.lit(0)
    for i in range(steps + 1):
        passed = passed + (F.col("p") >= F.lit(i / steps)).cast("int")
    buckets = scored.where(F.col("p").isNotNull()).groupBy(*by, passed.alias("passed")).agg(
        F.sum(F.col("y").cast("bigint")).alias("pos"),
        F.sum((1 - F.col("y")).cast("bigint")).alias("neg"),
    )
    # A bucket that passed j thresholds counts as predicted positive for the first j.
    grid = buckets.select(*by, "passed", "pos", "neg", F.explode(F.sequence(F.lit(0), F.lit(steps))).alias("i"))
    hit = F.col("passed") > F.col("i")
    counts = grid.groupBy(*by, "i").agg(
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hit, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    return rates(counts).withColumn("threshold", F.col("i") / F.lit(float(steps))).drop("i")


def class_report(scored: DataFrame) -> DataFrame:
    """precision, recall, F1 and support per class, plus macro and weighted means."""
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ("tp", "fp", "fn", "tn"))

    def row(name: str, hit, false_in, missed):
        return F.struct(
            F.lit(name).alias("class"),
            safe_ratio(hit, hit + false_in).alias("precision"),
            safe_ratio(hit, hit + missed).alias("recall"),
            safe_ratio(2 * hit, 2 * hit + false_in + missed).alias("f1_score"),
            (hit + missed).cast("bigint").alias("support"),
        )

    per_class = confusion(scored).select("model", F.inline(F.array(
        row("0", tn, fn, fp), row("1", tp, fp, fn)
    )))
    names = ("precision", "recall", "f1_score")
    w = F.col("support").cast("double")
    means = per_class.groupBy("model").agg(
        F.struct(
            F.lit("macro avg").alias("class"), *[F.avg(c).alias(c) for c in names],
            F.sum("support").alias("support"),
        ).alias("m"),
        F.struct(
            F.lit("weighted avg").alias("class"),
            *[safe_ratio(F.sum(F.col(c) * w), F.sum(w)).alias(c) for c in names],
            F.sum("support").alias("support"),
        ).alias("w"),
    ).select("model", F.inline(F.array("m", "w")))
    return per_class.unionByName(means)


def train_test_accuracy(scored: DataFrame) -> DataFrame:
    """Accuracy per model, one column per fold."""
    right = (F.col("y") == F.col("yhat")).cast("double")
    per_fold = scored.groupBy("model", "split").agg(F.avg(right).alias("acc"))
    return per_fold.groupBy("model").pivot("split", ["train", "test"]).agg(F.first("acc")).select(
        "model", F.col("train").alias("train_accuracy"), F.col("test").alias("test_accuracy")
    )


def calibration(scored: DataFrame, bins: int = 10) -> DataFrame:
    at = F.least(F.floor(F.col("p") * bins), F.lit(bins - 1)).cast("int")
    return scored.where(F.col("p").isNotNull()).groupBy("model", at.alias("bin")).agg(
        F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("positive_share")
    )


def subgroup_metrics(scored: DataFrame, group: str, overall: str = "(all)") -> DataFrame:
    """Comparison metrics per sub-group and for all rows together.

    The overall rows add up the sub-group counts; the scored rows are read once.
    """
    keys = ["model", group]
    counts = tally(scored, keys)
    everyone = _total(counts, ["model", "p"]).withColumn(group, F.lit(overall))
    both = stage(counts.unionByName(everyone), "tally")
    area = _area_of_tally(both, keys, staged=True)
    return rates(_total(both, keys)).join(area, keys, "left").withColumn(
        "roc_auc", F.coalesce("roc_auc", F.lit(0.0)))


def gini_split(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Best one-level split ``x <= threshold`` per feature under balanced weights.

    Class counts per distinct value, running totals over values, and the smallest
    weighted gini; ties take the smaller threshold. The threshold is the midpoint
    between the last value on the left and the next one.
    """
    long = df.select(target, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols
    ]))).where(F.col("x").isNotNull())
    y = F.col(target)
    per_value = long.groupBy("feature", "x").agg(
        F.sum(y.cast("bigint")).alias("pos"), F.sum((1 - y).cast("bigint")).alias("neg")
    )
    totals = per_value.groupBy("feature").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    run = running_sums(per_value, ["feature"], "x", ["pos", "neg"]).where(F.col("next").isNotNull())
    # Balanced weights give each class half of the mass: share of class on the left.
    a = F.col("cum_pos").cast("double") / F.col("_p")
    b = F.col("cum_neg").cast("double") / F.col("_n")

    def gini(pos, neg):
        mass = pos + neg
        return F.coalesce(F.try_divide(2 * pos * neg, mass), F.lit(0.0))

    impurity = F.round((gini(a, b) + gini(1 - a, 1 - b)) / 2, 9)
    scored = run.join(totals, "feature").where((F.col("_p") > 0) & (F.col("_n") > 0)).select(
        "feature", ((F.col("x") + F.col("next.x")) / 2).alias("threshold"), impurity.alias("impurity")
    )
    return scored.groupBy("feature").agg(
        F.min(F.struct("impurity", "threshold")).alias("best")
    ).select("feature", "best.threshold", "best.impurity")
