"""Feature preparation fitted on the training fold only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
import math

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from riskframe.functions.ordering import running_sums
from riskframe.functions.quantiles import exact_quantiles
from riskframe.functions.staging import stage
from riskframe.operators.clean import fill_defaults
from riskframe.operators.quality import melt_row
from riskframe.sources.readers import read_json
from riskframe.spec import FeatureSpec

# One-hot columns become literals in the plan; past this use ``operators.wide``.
MAX_CATEGORIES = 1_000
BROADCAST_BYTES = 64 * 1024 * 1024

_PARAMS = (
    "position int, feature string, kind string, fallback string, mean double, std double, "
    "categories array<string>"
)


@dataclass(frozen=True)
class PrepModel:
    """Fitted parameters: small driver-side values that enter plans as literals."""

    spec: FeatureSpec
    defaults: Mapping
    mean: Mapping[str, float]
    std: Mapping[str, float]
    categories: Mapping[str, tuple[str, ...]]

    @property
    def onehot_names(self) -> list[str]:
        return [f"{c}_{v}" for c in self.spec.categorical for v in self.categories[c]]

    @property
    def order(self) -> list[str]:
        return [*self.spec.numeric, *self.onehot_names]

    def impute(self, df: DataFrame) -> DataFrame:
        return fill_defaults(df, self.spec, self.defaults)

    def scale(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: (F.col(c).cast("double") - F.lit(self.mean[c])) / F.lit(self.std[c])
            for c in self.spec.numeric
        })

    def onehot(self, df: DataFrame) -> DataFrame:
        """Unseen and null values give all zeros."""
        return df.withColumns({
            f"{c}_{v}": F.coalesce((F.col(c) == v).cast("double"), F.lit(0.0))
            for c in self.spec.categorical for v in self.categories[c]
        })

    def transform(self, df: DataFrame) -> DataFrame:
        """Impute, scale and encode; the raw categorical columns remain."""
        return self.onehot(self.scale(self.impute(df)))

    def vector(self) -> VectorAssembler:
        return VectorAssembler(inputCols=self.order, outputCol="features", handleInvalid="error")

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The parameter table: one row per feature."""
        rows = []
        for i, c in enumerate(self.spec.features):
            cat = c in self.spec.categorical
            rows.append((
                i, c, "categorical" if cat else "numeric", str(self.defaults[c]),
                None if cat else self.mean[c], None if cat else self.std[c],
                list(self.categories[c]) if cat else None,
            ))
        return spark.createDataFrame(rows, _PARAMS)

    def save(self, spark: SparkSession, path: str) -> None:
        self.to_frame(spark).coalesce(1).write.mode("overwrite").json(path)


def load_prep(spark: SparkSession, path: str, spec: FeatureSpec) -> PrepModel:
    rows = read_json(spark, path, T.StructType.fromDDL(_PARAMS)).collect()
    cat = [r for r in rows if r["kind"] == "categorical"]
    num = [r for r in rows if r["kind"] == "numeric"]
    return PrepModel(
        spec=spec,
        defaults={**{r["feature"]: r["fallback"] for r in cat},
                  **{r["feature"]: float(r["fallback"]) for r in num}},
        mean={r["feature"]: r["mean"] for r in num},
        std={r["feature"]: r["std"] for r in num},
        categories={r["feature"]: tuple(r["categories"]) for r in cat},
    )


def medians(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return exact_quantiles(df, cols, [0.5]).select("feature", F.col("q")[0].alias("median"))


def category_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows (feature, value, n) over the present values."""
    pairs = [F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols]
    return (
        df.select(F.inline(F.array(*pairs)))
        .where(F.col("value").isNotNull())
        .groupBy("feature", "value")
        .agg(F.count("*").alias("n"))
    )


def modes(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Most frequent value, smallest on ties, "unknown" when all are missing.

    Two aggregates, so no buffer ever holds all values of a column.
    """
    return modes_of_counts(category_counts(df, cols), cols)


def modes_of_counts(counts: DataFrame, cols: Sequence[str]) -> DataFrame:
    best = counts.groupBy("feature").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), "value"))["value"].alias("mode")
    )
    names = counts.sparkSession.createDataFrame([(c,) for c in cols], "feature string")
    return names.join(best, "feature", "left").select(
        "feature", F.coalesce("mode", F.lit("unknown")).alias("mode")
    )


def scaler_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean and population std per column; a zero std becomes 1."""
    one = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.avg(c).alias("mean"),
            F.stddev_pop(c).alias("_s"),
        ).alias(c) for c in cols
    ])
    return melt_row(one, [], [F.col(c) for c in cols]).select(
        "feature", "mean", F.when(F.col("_s") == 0, 1.0).otherwise(F.col("_s")).alias("std")
    )


def _check_width(width: Mapping[str, int]) -> None:
    wide = [c for c, n in width.items() if n > MAX_CATEGORIES]
    if wide:
        raise ValueError(f"{wide} exceed {MAX_CATEGORIES} categories; use onehot_long or operators.wide")


def categories(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sorted category list per column; refuses columns too wide to encode as columns."""
    _check_width(df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first().asDict())
    return category_counts(df, cols).groupBy("feature").agg(
        F.array_sort(F.collect_list("value")).alias("categories")
    )


def fit_prep(train: DataFrame, spec: FeatureSpec) -> PrepModel:
    """Fit on ``train`` and nothing else, in three scans of it.

    Mean and std are those of the filled column. They follow from the moments of
    the present values, the number of nulls and the fill value, so scaling needs
    no scan of its own.
    """
    num, cat = list(spec.numeric), list(spec.categorical)
    one = train.agg(
        F.count("*").alias("_rows"),
        *[F.struct(F.count(c).alias("n"), F.avg(c).alias("m"), F.stddev_pop(c).alias("s"),
                   F.approx_count_distinct(c).alias("width")).alias(c) for c in num],
        *[F.approx_count_distinct(c).alias(c) for c in cat],
    ).first()
    empty = [c for c in num if one[c]["n"] == 0]
    if empty:
        raise ValueError(f"no training value for numeric columns {empty}")
    _check_width({c: one[c] for c in cat})
    fill = {
        r["feature"]: r["q"][0]
        for r in exact_quantiles(train, num, [0.5], widths={c: one[c]["width"] for c in num}).collect()
    }
    mean, std = {}, {}
    for c in num:
        n, nulls = one[c]["n"], one["_rows"] - one[c]["n"]
        mean[c] = (n * one[c]["m"] + nulls * fill[c]) / one["_rows"]
        var = (
            n * (one[c]["s"] ** 2 + (one[c]["m"] - mean[c]) ** 2) + nulls * (fill[c] - mean[c]) ** 2
        ) / one["_rows"]
        std[c] = math.sqrt(var) or 1.0
    seen: dict = {c: [] for c in cat}
    for r in category_counts(train, cat).collect() if cat else []:
        seen[r["feature"]].append((-r["n"], r["value"]))
    fill |= {c: min(seen[c])[1] if seen[c] else "unknown" for c in cat}
    return PrepModel(
        spec=spec, defaults=fill, mean=mean, std=std,
        categories={c: tuple(sorted(v for _, v in seen[c])) or ("unknown",) for c in cat},
    )


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """Sorted distinct values numbered from 0; missing counts as the text "nan".

    Numbering runs over key ranges, so the dictionary may be larger than a task.
    """
    values = df.select(
        F.coalesce(F.col(column).cast("string"), F.lit("nan")).alias("value")
    ).distinct().withColumn("one", F.lit(1))
    return running_sums(values, [], "value", ["one"]).select(
        "value", (F.col("cum_one") - 1).cast("bigint").alias("code")
    )


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Attach the code of each value.

    The dictionary is broadcast only while its counted rows and measured text stay
    under BROADCAST_BYTES. A larger one joins by shuffle, where adaptive execution
    splits the partition of a hot value.
    """
    codes = stage(label_codes(df, column).withColumnRenamed("code", out), "codes")
    size = codes.agg(F.sum(F.octet_length("value") + 16)).first()[0] or 0
    key = F.coalesce(F.col(column).cast("string"), F.lit("nan"))
    small = F.broadcast(codes) if size <= BROADCAST_BYTES else codes.hint("merge")
    return df.withColumn("value", key).join(small, "value").drop("value")


def onehot_long(df: DataFrame, id_col: str, column: str) -> DataFrame:
    """Sparse encoding (id, code) for columns with many categories."""
    return label_encode(df.select(id_col, column).where(F.col(column).isNotNull()), column, "code").select(
        id_col, "code"
    )


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """Balanced weight n / (k * n_class)."""
    per_class = df.where(F.col(target).isNotNull()).groupBy(target).agg(F.count("*").alias("n"))
    mean_size = per_class.agg(F.avg("n")).scalar()
    return per_class.select(target, "n", (mean_size / F.col("n")).alias("weight"))


def weight_expression(target: str, weights: Sequence[Row]) -> Column:
    """Collected ``class_weights`` rows as an expression on the target."""
    out = None
    for r in weights:
        hit = F.col(target) == r[target]
        out = F.when(hit, r["weight"]) if out is None else out.when(hit, r["weight"])
    return out


def top_features(importance: DataFrame, n: int) -> list[str]:
    rows = importance.orderBy(F.desc("importance"), "feature").limit(n).collect()
    return [r["feature"] for r in rows]
