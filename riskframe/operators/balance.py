"""Class-imbalance correction by resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from riskframe.functions.columns import order_hash
from riskframe.functions.staging import stage
from riskframe.operators.neighbours import nearest_whole
from riskframe.operators.split import class_counts, find_cuts
from riskframe.spec import FeatureSpec


def oversample(df: DataFrame, id_col: str, target: str, seed: int = 42) -> DataFrame:
    """Repeat the rows of the smallest class until it equals the largest; ``copy`` numbers the repeats.

    Classes in between stay as they are.

    Every minority row appears floor(ratio) times and those with the smallest
    hash ranks once more, so the total is exact and the plan stays narrow.
    """
    counts = class_counts(df, target)
    minor = min(counts, key=lambda c: (counts[c], str(c)))
    major = max(counts.values())
    whole, extra = divmod(major, counts[minor])
    cuts = find_cuts(df, id_col, target, lambda _: {minor: [extra]}, seed).cuts[minor]
    key = order_hash(F.col(id_col), seed)
    times = F.when(
        F.col(target) == minor, F.lit(whole) + (key <= F.lit(cuts[0])).cast("int")
    ).otherwise(1)
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def synthesise_minority(
    df: DataFrame, spec: FeatureSpec, cols: list[str], seed: int = 42, neighbours: int = 5, **search
) -> DataFrame:
    """Synthetic minority rows between a row and one of its near neighbours.

    The nearest ``neighbours`` rows of the class are looked for by hashing with exact distances
    (``riskframe.operators.neighbours``); a hash picks one of them. Yields exactly as many rows as the
    majority leads by.
    """
    counts = class_counts(df, spec.target)
    minor = min(counts, key=lambda c: (counts[c], str(c)))
    missing = max(counts.values()) - counts[minor]
    if missing and counts[minor] < 2:
        raise ValueError("synthetic rows need two rows of the smallest class")
    at = [f"x{i}" for i in range(len(cols))]
    base = stage(df.where(F.col(spec.target) == minor).select(
        F.col(spec.id).alias("of"), F.xxhash64(spec.id).alias("id"),
        *[F.col(f"`{c}`").cast("double").alias(a) for c, a in zip(cols, at)],
    ), "minority")
    n = counts[minor]
    if base.select("id").distinct().count() != n:
        raise ValueError("synthetic rows need distinct ids in the smallest class")
    whole, extra = divmod(missing, n)
    cut = find_cuts(base, "of", None, lambda _: {None: [extra]}, seed).cuts[None][0]
    times = F.lit(whole) + (order_hash(F.col("of"), seed) <= F.lit(cut)).cast("int")
    drawn = base.withColumn("times", times).where("times > 0")
    near = nearest_whole(base, at, neighbours, drawn.select("id", *at), seed=seed, **search)
    drawn = drawn.join(near.withColumnRenamed("q", "id"), "id").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    h = F.xxhash64("of", "copy", F.lit(seed))
    pick = F.get("near", F.pmod(h, F.size("near")).cast("int"))["v"]
    u = F.pmod(F.shiftright(h, 20), F.lit(1_000_003)) / F.lit(1_000_003.0)
    return drawn.select(
        F.col("of").alias(spec.id), "copy", F.lit(minor).alias(spec.target),
        *[(F.col(a) + (pick[i] - F.col(a)) * u).alias(c) for i, (a, c) in enumerate(zip(at, cols))],
    )
