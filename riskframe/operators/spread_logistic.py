"""The logistic fit over a ``WidePrep`` with its coefficients spread over the cluster.

Coefficients, gradient, curvature and the last steps are columns of a written table with one
row for each place of the vectors. An evaluation joins the coefficients to the rows and sums
each row's share of the gradient by place; a quasi-Newton step (L-BFGS, scaled by the bound of
the curvature at each place) needs only inner products of those columns, so the driver gets one
row of sums whatever the width. Rows stay dealt by the widest column, so its coefficients come
to them by one shuffle of the coefficients, not of the rows.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import partial
import math

import numpy as np
from pyspark.sql import Column, DataFrame, Row, functions as F

from riskframe.config import LogisticConfig
from riskframe.functions.staging import stage

# Columns of at most so many categories are broadcast, as are the categories of a wider one with more rows than HOT_ROWS.
SHARED = 16_384
HOT_ROWS = 100_000
PAIRS = 3               # steps remembered
INTERCEPT = -1
_TRIALS = 30            # halvings of a step
_SPREAD = 2**31 - 1


@dataclass(frozen=True)
class Blocks:
    """``numbers`` numeric places, then one block of places for each categorical column."""

    numbers: int
    spans: tuple[tuple[int, int], ...]

    def wide(self) -> list[int]:
        """Columns whose coefficients join by shuffle, the widest first."""
        size = [hi - lo for lo, hi in self.spans]
        return sorted((j for j, n in enumerate(size) if n > SHARED), key=lambda j: (-size[j], j))

    def inside(self, j: int, place: Column) -> Column:
        lo, hi = self.spans[j]
        return (place >= lo) & (place < hi)


def narrow_rows(assembled: DataFrame, target: str, weight: Column, blocks: Blocks) -> DataFrame:
    """Label ``y``, weight ``c``, numbers ``x<i>`` and the place ``at<j>`` of each column's category, null if unseen; written."""
    label = F.when(F.col(target).isNull(), F.raise_error(F.lit(f"{target} must not be null"))).otherwise(F.col(target))
    v = assembled.select(
        label.cast("double").alias("y"), weight.cast("double").alias("c"), F.unwrap_udt(F.col("features")).alias("v"))
    return stage(v.select(
        F.monotonically_increasing_id().alias("row"), "y", "c",
        *[F.get("v.values", F.lit(i)).alias(f"x{i}") for i in range(blocks.numbers)],
        *[F.get(F.filter("v.indices", partial(blocks.inside, j)), F.lit(0)).cast("bigint").alias(f"at{j}")
          for j in range(len(blocks.spans))],
    ), "rows")


def _by_place(rows: DataFrame, blocks: Blocks, share: Column, **more: tuple[Column, bool]) -> DataFrame:
    """Sums by place: ``g`` of ``share`` times the row's entry; of ``more``, times its square or only at the intercept."""
    def entry(place: Column, x: Column) -> Column:
        rest = [(v * x * x if squared else F.when(place == INTERCEPT, v)).alias(k) for k, (v, squared) in more.items()]
        return F.struct(place.cast("bigint").alias("place"), (share * x).alias("g"), *rest)

    one = F.lit(1.0)
    entries = F.array(
        entry(F.lit(INTERCEPT), one), *[entry(F.lit(i), F.col(f"x{i}")) for i in range(blocks.numbers)],
        *[entry(F.col(f"at{j}"), one) for j in range(len(blocks.spans))])
    return rows.select(F.inline(entries)).where(F.col("place").isNotNull()).groupBy("place").agg(
        F.sum("g").alias("g"), *[F.sum(k).alias(k) for k in more])


def _start(rows: DataFrame, blocks: Blocks, width: int, penalty: float) -> DataFrame:
    """The written state at coefficients of 0; ``h`` bounds the curvature, ``shared`` places are broadcast."""
    c, y = F.col("c"), F.col("y")
    found = _by_place(rows, blocks, c * (0.5 - y), h=(c * 0.25, True), n=(F.lit(1.0), True), loss=(c * math.log(2.0), False))
    place, wide = F.col("place"), F.lit(False)
    for j in blocks.wide():
        wide = wide | blocks.inside(j, place)
    grown = F.when(place == INTERCEPT, 0.0).otherwise(penalty)
    places = rows.sparkSession.range(INTERCEPT, width).withColumnRenamed("id", "place")
    return stage(places.join(found.hint("shuffle_hash"), "place", "left").select(
        "place", (~wide | (F.coalesce("n", F.lit(0.0)) > HOT_ROWS)).alias("shared"),
        (F.coalesce("h", F.lit(0.0)) + grown).alias("h"), F.lit(0.0).alias("w"), F.coalesce("g", F.lit(0.0)).alias("g"), "loss",
    ), "state")


def deal(rows: DataFrame, state: DataFrame, blocks: Blocks) -> DataFrame:
    """Rows with a join key ``key<j>`` for each wide column, dealt by that of the widest.

    A row without a category, or with a broadcast one, gets a key that no place has, so these spread too.
    """
    wide = blocks.wide()
    for j in wide:
        hot = state.where(blocks.inside(j, F.col("place")) & F.col("shared")).select(F.col("place").alias(f"at{j}"), F.lit(True).alias("_hot"))
        none = F.lit(INTERCEPT - 1) - F.pmod(F.xxhash64("row", F.lit(j)), F.lit(_SPREAD))
        rows = rows.join(F.broadcast(hot), f"at{j}", "left").withColumn(
            f"key{j}", F.when(F.col("_hot") | F.col(f"at{j}").isNull(), none).otherwise(F.col(f"at{j}"))).drop("_hot")
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), f"key{wide[0]}") if wide else rows


def margins(rows: DataFrame, trial: DataFrame, blocks: Blocks) -> DataFrame:
    """``rows`` with the margin ``z`` at the coefficients (place, shared, w) of ``trial``."""
    place = F.col("place")
    head = {r["place"]: r["w"] for r in trial.where(place < blocks.numbers).select("place", "w").collect()}
    z = F.lit(head[INTERCEPT])
    for i in range(blocks.numbers):
        z = z + F.lit(head[i]) * F.col(f"x{i}")
    for j in blocks.wide():
        mine = trial.where(blocks.inside(j, place) & ~F.col("shared")).select(place.alias(f"key{j}"), F.col("w").alias(f"_s{j}"))
        rows, z = rows.join(mine.hint("shuffle_hash"), f"key{j}", "left"), z + F.coalesce(f"_s{j}", F.lit(0.0))
    for j in range(len(blocks.spans)):
        few = trial.where(blocks.inside(j, place) & F.col("shared")).select(place.alias(f"at{j}"), F.col("w").alias(f"_b{j}"))
        rows, z = rows.join(F.broadcast(few), f"at{j}", "left"), z + F.coalesce(f"_b{j}", F.lit(0.0))
    return rows.withColumn("z", z)


def _products(state: DataFrame, pairs: int) -> Row:
    """Loss, sum of squares and the inner products a step needs; ``M`` divides by ``h``."""
    def dot(a: str, b: str, scaled: bool) -> Column:
        return F.sum(F.col(a) * F.col(b) / F.col("h") if scaled else F.col(a) * F.col(b))

    k = range(pairs)
    return state.agg(
        F.sum("loss").alias("loss"), F.sum(F.when(F.col("place") > INTERCEPT, F.col("w") * F.col("w"))).alias("ww"),
        dot("g", "g", True).alias("gMg"),
        *[dot(f"s{i}", "g", False).alias(f"sg{i}") for i in k], *[dot(f"d{i}", "g", True).alias(f"dMg{i}") for i in k],
        *[dot(f"s{i}", f"d{j}", False).alias(f"sd{i}_{j}") for i in k for j in k],
        *[dot(f"d{i}", f"d{j}", True).alias(f"dMd{i}_{j}") for i in k for j in k if i <= j],
    ).first()


def _direction(r: Row, pairs: int) -> tuple[float, np.ndarray, np.ndarray, float]:
    """Factors of g/h, d<i>/h and s<i> in the quasi-Newton step, and the slope along it."""
    k = range(pairs)
    sg, dmg = (np.array([r[f"{name}{i}"] for i in k]) for name in ("sg", "dMg"))
    sd = np.array([[r[f"sd{i}_{j}"] for j in k] for i in k])
    dmd = np.array([[r[f"dMd{min(i, j)}_{max(i, j)}"] for j in k] for i in k])
    a, b = np.zeros(pairs), np.zeros(pairs)
    for i in reversed(k):
        a[i] = (sg[i] - sd[i] @ a) / sd[i, i]
    scale = sd[-1, -1] / dmd[-1, -1] if pairs else 1.0
    for i in k:
        b[i] = a[i] - (scale * (dmg[i] - dmd[i] @ a) + sd[:, i] @ b) / sd[i, i]
    return -scale, scale * a, -b, -scale * (r["gMg"] - a @ dmg) - b @ sg


def _step(by_g: float, by_d: np.ndarray, by_s: np.ndarray) -> Column:
    out = F.lit(by_g) * F.col("g") / F.col("h")
    for i, (d, s) in enumerate(zip(by_d, by_s, strict=True)):
        out = out + F.lit(float(d)) * F.col(f"d{i}") / F.col("h") + F.lit(float(s)) * F.col(f"s{i}")
    return out


def _evaluate(rows: DataFrame, state: DataFrame, step: Column, pairs: int, blocks: Blocks, penalty: float) -> DataFrame:
    """The written state after ``step``: its pair is the last of at most PAIRS."""
    moved = state.withColumn("_step", step).withColumn("_w", F.col("w") + F.col("_step"))
    at = margins(rows, moved.select("place", "shared", F.col("_w").alias("w")), blocks)
    z, y, c = F.col("z"), F.col("y"), F.col("c")
    loss = c * (F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z)
    found = _by_place(at, blocks, c * (1.0 / (1.0 + F.exp(-z)) - y), loss=(loss, False)).select(
        "place", F.col("g").alias("_g"), F.col("loss").alias("_loss"))
    slope = F.coalesce("_g", F.lit(0.0)) + F.when(F.col("place") == INTERCEPT, 0.0).otherwise(penalty) * F.col("_w")
    first = max(0, pairs - PAIRS + 1)
    kept = [F.col(f"{v}{i}").alias(f"{v}{i - first}") for i in range(first, pairs) for v in "sd"]
    return stage(moved.join(found.hint("shuffle_hash"), "place", "left").withColumn("_slope", slope).select(
        "place", "shared", "h", F.col("_w").alias("w"), F.col("_slope").alias("g"), F.col("_loss").alias("loss"),
        *kept, F.col("_step").alias(f"s{pairs - first}"), (F.col("_slope") - F.col("g")).alias(f"d{pairs - first}"),
    ), "state")


def fit_spread(rows: DataFrame, blocks: Blocks, width: int, config: LogisticConfig) -> DataFrame:
    """The minimum of the weighted loss plus the penalty, as a written table (place, w, ...); the intercept is place -1.

    Ends when the scaled gradient is within 10 times ``tol`` of the loss's root, or after ``max_iter`` steps.
    """
    penalty = 1.0 / config.c
    state, pairs = _start(rows, blocks, width, penalty), 0
    dealt = deal(rows, state, blocks)
    dealt = dealt.persist() if blocks.wide() else dealt

    def value(r: Row) -> float:
        return r["loss"] + 0.5 * penalty * (r["ww"] or 0.0)

    try:
        here = _products(state, pairs)
        if not (math.isfinite(value(here)) and math.isfinite(here["gMg"])):
            raise ValueError("numeric features must not be NaN or infinite")
        for _ in range(config.max_iter):
            if here["gMg"] <= (10 * config.tol) ** 2 * value(here):
                break
            by_g, by_d, by_s, slope = _direction(here, pairs)
            t = 1.0
            for _ in range(_TRIALS):
                trial = _evaluate(dealt, state, _step(t * by_g, t * by_d, t * by_s), pairs, blocks, penalty)
                there = _products(trial, min(pairs + 1, PAIRS))
                rise = value(there) - value(here)
                if rise <= 1e-4 * t * slope + 1e-13 * value(here):
                    break
                t = min(0.5 * t, max(0.1 * t, -slope * t * t / (2 * (rise - slope * t)))) if math.isfinite(rise) else 0.1 * t
            else:
                break
            pairs = min(pairs + 1, PAIRS)
            last = there[f"sd{pairs - 1}_{pairs - 1}"]
            state, here = trial, there
            if not last > 0:        # rounding is all that is left
                break
    finally:
        if blocks.wide():
            dealt.unpersist()
    return state
