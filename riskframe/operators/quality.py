"""Data-quality checks. Each returns a small table from one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskframe.functions import columns as C
from riskframe.spec import FeatureSpec


def melt_row(one: DataFrame, keys: Sequence[str], records: list[Column]) -> DataFrame:
    """Turn a wide aggregate into one row per struct in ``records``."""
    return one.select(*keys, F.inline(F.array(*records)))


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    counted = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return melt_row(counted, [], [
        F.struct(
            F.lit(c).alias("column"), F.col(c).alias("n_null"), F.col("n").alias("n_rows"),
        ) for c in cols
    ])


def null_shares(df: DataFrame, cols: Sequence[str], limit: float = 0.3) -> DataFrame:
    share = F.try_divide(F.col("n_null").cast("double"), F.col("n_rows"))
    return null_counts(df, cols).select(
        "column", share.alias("null_share"), (share > limit).cast("int").alias("over_limit")
    )


def duplicate_count(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows beyond the first of each distinct record."""
    return df.groupBy(*cols).count().agg(
        F.sum("count").alias("n_rows"),
        F.count("*").alias("n_distinct"),
        (F.sum("count") - F.count("*")).alias("n_duplicates"),
    )


def class_distribution(df: DataFrame, target: str) -> DataFrame:
    """Count and percent per class; the total comes from the tiny class table."""
    per_class = df.groupBy(target).agg(F.count("*").alias("n"))
    total = per_class.agg(F.sum("n")).scalar()
    return per_class.select(
        target, "n", total.alias("total"), (F.lit(100.0) * F.col("n") / total).alias("percent")
    )


def imbalance_ratio(df: DataFrame, target: str) -> DataFrame:
    y = F.col(target)
    return df.agg(
        F.sum(y).cast("bigint").alias("n_pos"),
        F.sum(1 - y).cast("bigint").alias("n_neg"),
    ).withColumn("ratio", F.try_divide(F.col("n_pos").cast("double"), F.col("n_neg")))


def out_of_range(c: str, bounds: Mapping[str, tuple[float, float]]) -> Column:
    lo, hi = bounds[c]
    return (F.col(c) < lo) | (F.col(c) > hi)


def range_check(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Per bounded column: how many values lie below and above. Bounds travel as literals."""
    cols = list(bounds)
    counted = df.agg(
        *[F.count(c).alias(f"n_{c}") for c in cols],
        *[F.count_if(F.col(c) < bounds[c][0]).alias(f"lo_{c}") for c in cols],
        *[F.count_if(F.col(c) > bounds[c][1]).alias(f"hi_{c}") for c in cols],
    )
    return melt_row(counted, [], [
        F.struct(
            F.lit(c).alias("feature"),
            F.lit(float(bounds[c][0])).alias("low"),
            F.lit(float(bounds[c][1])).alias("high"),
            F.col(f"n_{c}").alias("n_values"),
            F.col(f"lo_{c}").alias("n_below"),
            F.col(f"hi_{c}").alias("n_above"),
        ) for c in cols
    ])


def range_rejects(df: DataFrame, bounds: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Rows with any value out of bounds, with the names of the offending columns."""
    cols = list(bounds)
    broken = F.array_compact(F.array(*[F.when(out_of_range(c, bounds), F.lit(c)) for c in cols]))
    return df.withColumn("out_of_range", broken).where(F.size("out_of_range") > 0)


def allowed_values(df: DataFrame, allowed: Mapping[str, Sequence[str]]) -> DataFrame:
    """Count of every categorical value outside its accepted list, in one scan."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in allowed]
    listed = df.sparkSession.createDataFrame(
        [(c, v) for c, vs in allowed.items() for v in vs], "column string, value string"
    )
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(listed), ["column", "value"], "left_anti")
    )


def unknown_labels(df: DataFrame, column: str, codes: Mapping[str, int]) -> DataFrame:
    """Distinct normalised labels without a code, with their row counts."""
    known = df.sparkSession.createDataFrame([(k,) for k in codes], "label string")
    return (
        df.select(F.lower(F.trim(F.col(column).cast("string"))).alias("label"))
        .groupBy("label")
        .agg(F.count("*").alias("n"))
        .join(F.broadcast(known), "label", "left_anti")
    )


def separation(df: DataFrame, feature: str, target: str) -> DataFrame:
    """Per-class min/max/mean of a feature, its correlation with the target, and
    whether the negative class is constant zero."""
    x, y = F.col(feature), F.col(target)
    per_class = df.groupBy(target).agg(
        F.min(x).alias("min_value"), F.max(x).alias("max_value"), F.avg(x).alias("mean_value")
    )
    flat = (F.min(F.when(y == 0, x)) == 0) & (F.max(F.when(y == 0, x)) == 0)
    overall = df.agg(F.struct(
        pair_correlation(x, y).alias("r"), F.coalesce(flat.cast("int"), F.lit(0)).alias("flat")
    )).scalar()
    return per_class.select(
        target, "min_value", "max_value", "mean_value", overall["r"].alias("r"),
        overall["flat"].alias("negative_constant_zero"),
    )


def pair_correlation(a: Column, b: Column) -> Column:
    """Pearson over rows where both are present; NULL when either is constant.

    Plain ``corr`` raises on a constant column under ANSI mode.
    """
    sa = F.stddev_pop(F.when(b.isNotNull(), a))
    sb = F.stddev_pop(F.when(a.isNotNull(), b))
    return F.covar_pop(a.cast("double"), b.cast("double")) / F.nullif(sa * sb, F.lit(0.0))


def recode_audit(df: DataFrame, column: str, mapping: Mapping[str, str]) -> DataFrame:
    """Distinct values of a column before and after a recode, from one scan."""
    phases = F.array(
        F.struct(F.lit("before").alias("phase"), F.col(column).alias("value")),
        F.struct(F.lit("after").alias("phase"), C.recode(F.col(column), mapping).alias("value")),
    )
    return df.select(F.inline(phases)).groupBy("phase", "value").agg(F.count("*").alias("n"))


def split_overlap(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Feature vectors that occur in both folds, and each fold's label share.

    One aggregate per distinct vector replaces a self-intersection.
    """
    is_test = (F.col("split") == "test").cast("int")
    y = F.col(spec.target)
    per_vector = df.groupBy(*spec.features).agg(
        F.count_if(is_test == 1).alias("n_test"),
        F.count_if(is_test == 0).alias("n_train"),
        F.sum(y * is_test).alias("pos_test"),
        F.sum(y * (1 - is_test)).alias("pos_train"),
    )
    return per_vector.agg(
        F.count_if((F.col("n_test") > 0) & (F.col("n_train") > 0)).alias("n_shared"),
        F.sum("n_train").alias("n_train"),
        F.sum("n_test").alias("n_test"),
        F.try_divide(F.sum("pos_train").cast("double"), F.sum("n_train")).alias("share_train"),
        F.try_divide(F.sum("pos_test").cast("double"), F.sum("n_test")).alias("share_test"),
    )
