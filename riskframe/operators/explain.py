"""Explanations: importances, permutation importance, coefficients, linear contributions."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskframe.functions.staging import stage
from riskframe.operators.evaluate import confusion, rates

BLOCK_ROWS = 2_048


def ranked_importance(spark: SparkSession, names: Sequence[str], values: Sequence[float]) -> DataFrame:
    """Importances with their rank and whether they exceed the median."""
    table = spark.createDataFrame(
        [(n, float(v)) for n, v in zip(names, values, strict=True)], "feature string, importance double"
    )
    return rank_table(table)


def rank_table(table: DataFrame) -> DataFrame:
    """Rank a feature table (one row per feature, so a few hundred rows at most)."""
    from pyspark.sql import Window

    mid = table.agg(F.median("importance")).scalar()
    by_size = Window.orderBy(F.desc("importance"), "feature")
    return table.select(
        "feature", "importance",
        F.row_number().over(by_size).alias("rank"),
        (F.col("importance") > mid).cast("int").alias("above_median"),
    )


def coefficient_table(spark: SparkSession, names: Sequence[str], coef: Sequence[float]) -> DataFrame:
    return spark.createDataFrame(
        [(n, float(w)) for n, w in zip(names, coef, strict=True)], "feature string, coefficient double"
    )


def _terms(coef: Mapping[str, float]):
    return F.array(*[
        F.struct(F.lit(c).alias("feature"), (F.lit(w) * F.col(f"`{c}`")).alias("contribution"))
        for c, w in coef.items()
    ])


def contributions(scaled: DataFrame, id_col: str, coef: Mapping[str, float]) -> DataFrame:
    """coef * (x - mean) / std per row and feature; the scaled columns carry the rest."""
    return scaled.select(id_col, F.inline(_terms(coef)))


def top_contributions(scaled: DataFrame, id_col: str, coef: Mapping[str, float], n: int = 3) -> DataFrame:
    """The ``n`` largest contributions of each row by absolute value, without a shuffle."""
    keyed = F.transform(_terms(coef), lambda t: F.struct(
        (-F.round(F.abs(t["contribution"]), 9)).alias("k"), t["feature"].alias("feature"),
        t["contribution"].alias("contribution"),
    ))
    return scaled.select(id_col, F.slice(F.array_sort(keyed), 1, n).alias("top"))


def permute(
    df: DataFrame, target: str, features: Sequence[str], repeats: int = 8, seed: int = 42, id_col: str | None = None
) -> DataFrame:
    """Every row once per (feature, repeat), with that feature taken from another row.

    The hash of ``id_col``, which must be unique, deals rows into random blocks of about
    BLOCK_ROWS, so the result depends on the rows and the seed alone. Without an id the
    position in the staged table serves: no block grows with the data even when whole
    records repeat, but the draw then follows the layout of the files. Each repeat orders
    the block by a hash of its own and takes the value of the next row round the circle:
    independent random permutations that leave no row with its own value. One shuffle of
    the input; the repeats and features multiply rows in place.
    """
    named = [F.col(f"`{id_col}`").alias("_id")] if id_col else []
    table = stage(df.select(*named, target, *features), "permute")
    blocks = max(1, table.count() // BLOCK_ROWS)
    at = F.xxhash64(F.col("_id") if id_col else F.monotonically_increasing_id(), F.lit(seed))
    row = F.struct(F.col("_k"), F.col(target).alias("_y"), *[F.col(c) for c in features])
    packed = (
        table.withColumn("_k", at)
        .groupBy(F.pmod(F.shiftright("_k", 17), F.lit(blocks)).alias("_b"))
        .agg(F.array_sort(F.collect_list(row)).alias("rows"))
    )

    def ordered(r: int):
        keyed = F.transform("rows", lambda x: F.struct(F.xxhash64(x["_k"], F.lit(r)).alias("h"), x.alias("row")))
        return F.transform(F.array_sort(keyed), lambda x: x["row"])

    orders = F.array(*[F.struct(F.lit(r).alias("repeat"), ordered(r).alias("own")) for r in range(1, repeats + 1)])
    per_order = packed.select(F.inline(orders))
    turned = F.concat(F.slice("own", F.lit(2), F.size("own") - 1), F.slice("own", 1, 1))
    per_repeat = per_order.select(
        "repeat", F.explode(F.arrays_zip(F.col("own"), turned.alias("donor"))).alias("z")
    ).select("z.own", "z.donor", "repeat")
    names = F.array(*[F.lit(f) for f in features])
    each = per_repeat.select("own", "donor", "repeat", F.explode(names).alias("feature"))
    return each.select(
        "feature", "repeat", F.col("own._y").alias("y"),
        *[F.when(F.col("feature") == f, F.col(f"donor.{f}")).otherwise(F.col(f"own.{f}")).alias(f)
          for f in features],
    )


def permutation_importance(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    predict: Callable[[DataFrame], DataFrame],
    metric: str = "f1_score",
    repeats: int = 8,
    seed: int = 42,
    id_col: str | None = None,
) -> DataFrame:
    """Mean and population std of the metric drop per feature, in one job.

    ``predict`` takes rows with ``features`` and returns them with ``yhat``.
    """
    base = rates(confusion(predict(df.withColumn("y", F.col(target))), [])).select(metric).scalar()
    shuffled = predict(permute(df, target, features, repeats, seed, id_col))
    drops = rates(confusion(shuffled, ["feature", "repeat"]))
    return importance_of_drops(drops.select("feature", (base - F.col(metric)).alias("drop")))


def importance_of_drops(drops: DataFrame) -> DataFrame:
    return drops.groupBy("feature").agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    )
