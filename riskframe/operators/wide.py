"""Preparation and a logistic model for categorical columns of any width.

``PrepModel`` keeps categories as literals and gives each a column of its own. Here they are
rows (feature, value, code) of a written dictionary that joins by its measured size, and a
record is one sparse vector. A fitted model adds its coefficient to each row of the
dictionary, so scoring is one join for each categorical column and a sum: no vector, no
literal, and nothing on the driver that grows with the categories. Up to SHARED columns are
fitted by Spark's estimator; beyond, ``spread_logistic`` keeps the coefficients in a table too.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace
import math

import numpy as np
import pandas as pd
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskframe.config import LogisticConfig
from riskframe.functions.ordering import running_sums
from riskframe.functions.staging import new_path, stage
from riskframe.operators import prepare, spread_logistic
from riskframe.operators.clean import fill_defaults
from riskframe.operators.learn import WEIGHT, logistic
from riskframe.operators.prepare import PrepModel, class_weights, fit_prep, load_prep, weight_expression
from riskframe.operators.score import LinearScore
from riskframe.operators.spread_logistic import INTERCEPT, Blocks, fit_spread, narrow_rows
from riskframe.sources.readers import read_json
from riskframe.spec import FeatureSpec

_CODES = "feature string, value string, code bigint"
_WEIGHTS = f"{_CODES}, weight double"
_CARD = "fills map<string,string>, sizes map<string,bigint>, octets map<string,bigint>, intercept double, coef map<string,double>"
# A vector index is an int.
MAX_WIDTH = 2**31 - 1


@dataclass(frozen=True)
class WidePrep:
    """Fitted parameters; ``dictionary`` is a written table of (feature, value, code)."""

    spec: FeatureSpec
    numeric: PrepModel                  # the scaled block
    fills: Mapping[str, str]            # value of missing categories
    sizes: Mapping[str, int]            # categories of each column
    octets: Mapping[str, int]           # bytes of each column's dictionary
    dictionary: DataFrame

    @property
    def width(self) -> int:
        return len(self.spec.numeric) + sum(self.sizes[c] for c in self.spec.categorical)

    def offsets(self) -> dict[str, int]:
        """Where the block of each categorical column begins."""
        out, at = {}, len(self.spec.numeric)
        for c in self.spec.categorical:
            out[c] = at
            at += self.sizes[c]
        return out

    def transform(self, df: DataFrame) -> DataFrame:
        """Nulls and absent columns filled, numbers scaled, categories still text."""
        filled = fill_defaults(df, self.spec, {**self.numeric.defaults, **self.fills})
        return self.numeric.scale(filled)

    def look_up(self, df: DataFrame, table: DataFrame, what: str, out: Mapping[str, str]) -> DataFrame:
        """Attach ``what`` of each category under the names in ``out``; null for unseen ones.

        A part of the dictionary is broadcast only below BROADCAST_BYTES. A larger one joins by
        shuffle, where adaptive execution splits the partition of a hot value.
        """
        columns = df.columns
        for c in self.spec.categorical:
            part = table.where(F.col("feature") == c).select(F.col("value").alias(c), F.col(what).alias(out[c]))
            small = self.octets[c] <= prepare.BROADCAST_BYTES
            df = df.join(F.broadcast(part) if small else part.hint("merge"), c, "left")
        return df.select(*[F.col(f"`{c}`") for c in columns], *[out[c] for c in self.spec.categorical])

    def assemble(self, df: DataFrame) -> DataFrame:
        """``df`` prepared, with its sparse vector ``features``, as a written table.

        Unseen values give no entry. The vector is written in its stored form and read back as a
        vector, so no row leaves the JVM and no column metadata names the categories.
        """
        code = {c: f"_code_{c}" for c in self.spec.categorical}
        coded = self.look_up(self.transform(df), self.dictionary, "code", code)
        at = self.offsets()
        hot = F.array_compact(F.array(*[(F.col(code[c]) + at[c]).cast("int") for c in code]))
        numbers = len(self.spec.numeric)
        vector = F.struct(
            F.lit(0).cast("tinyint").alias("type"),
            F.lit(self.width).alias("size"),
            F.concat(F.array(*[F.lit(i) for i in range(numbers)]).cast("array<int>"), hot).alias("indices"),
            F.concat(
                F.array(*[F.col(c) for c in self.spec.numeric]).cast("array<double>"),
                F.transform(hot, lambda _: F.lit(1.0)),
            ).alias("values"),
        )
        written = coded.withColumn("features", vector).drop(*code.values())
        path = new_path(df.sparkSession, "assembled")
        written.write.parquet(path)
        fields = [f for f in written.schema if f.name != "features"]
        return df.sparkSession.read.schema(T.StructType([*fields, T.StructField("features", VectorUDT())])).parquet(path)


def fit_wide(train: DataFrame, spec: FeatureSpec) -> WidePrep:
    """Fit on ``train`` alone. A column without any value has the one category "unknown"."""
    spark, cat = train.sparkSession, list(spec.categorical)
    block = replace(spec, categorical=())
    numeric = fit_prep(train, block) if spec.numeric else PrepModel(block, {}, {}, {}, {})
    counts = stage(prepare.category_counts(train, cat), "categories")
    fills = {r["feature"]: r["mode"] for r in prepare.modes_of_counts(counts, cat).collect()}
    names = spark.createDataFrame([(c,) for c in cat], "feature string")
    empty = names.join(counts, "feature", "left_anti").select("feature", F.lit("unknown").alias("value"))
    values = counts.select("feature", "value").unionByName(empty).withColumn("one", F.lit(1).cast("bigint"))
    coded = running_sums(values, ["feature"], "value", ["one"])
    dictionary = stage(coded.select("feature", "value", (F.col("cum_one") - 1).cast("bigint").alias("code")), "dictionary")
    found = dictionary.groupBy("feature").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("value") + 16).cast("bigint").alias("octets")).collect()
    prep = WidePrep(
        spec, numeric, fills, {r["feature"]: r["n"] for r in found}, {r["feature"]: r["octets"] for r in found}, dictionary)
    if prep.width > MAX_WIDTH:
        raise ValueError(f"{prep.width} columns exceed the {MAX_WIDTH} of a vector")
    return prep


@dataclass(frozen=True)
class WideLogistic:
    """A logistic model over ``prep``; ``weights`` is its dictionary with a coefficient for each category."""

    prep: WidePrep
    intercept: float
    coef: Mapping[str, float]           # of the numeric columns
    weights: DataFrame
    name: str = "logistic_regression"

    def predict(self, prepared: DataFrame) -> DataFrame:
        """``p`` and ``yhat`` for rows of ``prep.transform``; unseen values weigh nothing."""
        out = {c: f"_weight_{c}" for c in self.prep.spec.categorical}
        looked = self.prep.look_up(prepared, self.weights, "weight", out)
        known = looked.withColumns({w: F.coalesce(F.col(w), F.lit(0.0)) for w in out.values()})
        return LinearScore(self.intercept, {**self.coef, **{w: 1.0 for w in out.values()}}).predict(known).drop(*out.values())

    def save(self, path: str) -> None:
        """Numeric parameters, the weighted dictionary, then the card that makes the store readable."""
        spark, p = self.weights.sparkSession, self.prep
        p.numeric.save(spark, f"{path}/numeric")
        self.weights.write.mode("overwrite").parquet(f"{path}/weights")
        card = [(dict(p.fills), dict(p.sizes), dict(p.octets), self.intercept, dict(self.coef))]
        spark.createDataFrame(card, _CARD).coalesce(1).write.mode("overwrite").json(f"{path}/card")


def load_wide(spark: SparkSession, path: str, spec: FeatureSpec) -> WideLogistic:
    card = read_json(spark, f"{path}/card", T.StructType.fromDDL(_CARD)).first()
    weights = spark.read.schema(_WEIGHTS).parquet(f"{path}/weights")
    block = replace(spec, categorical=())
    numeric = load_prep(spark, f"{path}/numeric", block) if spec.numeric else PrepModel(block, {}, {}, {}, {})
    prep = WidePrep(spec, numeric, card["fills"], card["sizes"], card["octets"], weights.drop("weight"))
    return WideLogistic(prep, card["intercept"], card["coef"] or {}, weights)


def _block_of(prep: WidePrep) -> Column:
    out = None
    for c, at in prep.offsets().items():
        hit = F.col("feature") == c
        out = F.when(hit, F.lit(at)) if out is None else out.when(hit, F.lit(at))
    return out


def fit_wide_logistic(
    assembled: DataFrame, target: str, prep: WidePrep, config: LogisticConfig = LogisticConfig()
) -> WideLogistic:
    """L2-penalised fit with balanced classes on rows of ``prep.assemble``."""
    classes = class_weights(assembled, target).collect()
    if not {r[target] for r in classes} <= {0, 1} or not classes:
        raise ValueError(f"{target} needs rows of the classes 0 and 1 alone, found {sorted(r[target] for r in classes)}")
    at, numbers = prep.offsets(), len(prep.spec.numeric)
    blocks = Blocks(numbers, tuple((at[c], at[c] + prep.sizes[c]) for c in prep.spec.categorical))
    if len(classes) == 1:
        # No finite intercept is best; the coefficients stay 0.
        weights = stage(prep.dictionary.select("feature", "value", "code", F.lit(0.0).alias("weight")), "weights")
        return WideLogistic(prep, math.inf if classes[0][target] else -math.inf, dict.fromkeys(prep.spec.numeric, 0.0), weights)
    if prep.width <= spread_logistic.SHARED:
        total = float(sum(r["n"] * r["weight"] for r in classes))
        found = logistic(target, total, config).fit(assembled.select(target, "features", weight_expression(target, classes).alias(WEIGHT)))
        w, intercept = found.coefficients.toArray(), float(found.intercept)
        head = {i: float(w[i]) for i in range(numbers)}
        fit = assembled.sparkSession.createDataFrame(pd.DataFrame({"place": np.arange(numbers, prep.width), "weight": w[numbers:]}))
    else:
        rows = narrow_rows(assembled, target, weight_expression(target, classes), blocks)
        fit = fit_spread(rows, blocks, prep.width, config).select("place", F.col("w").alias("weight"))
        head = {r["place"]: r["weight"] for r in fit.where(F.col("place") < numbers).collect()}
        intercept = head[INTERCEPT]
    places = prep.dictionary.withColumn("place", F.col("code") + _block_of(prep))
    weights = stage(places.join(fit.hint("shuffle_hash"), "place").select("feature", "value", "code", "weight"), "weights")
    return WideLogistic(prep, intercept, {c: head[i] for i, c in enumerate(prep.spec.numeric)}, weights)


def coefficients(model: WideLogistic) -> DataFrame:
    """Rows (feature, value, coefficient); numeric columns have a null value."""
    numbers = model.weights.sparkSession.createDataFrame(
        [(c, None, w) for c, w in model.coef.items()], "feature string, value string, coefficient double")
    return numbers.unionByName(model.weights.select("feature", "value", F.col("weight").alias("coefficient")))
