"""Exact quantiles with linear interpolation, at any column cardinality.

``percentile`` keeps every distinct value of a group in one buffer. That is
fine for bounded columns and wrong for continuous ones, so cardinality is
measured first. Wide columns are bracketed with ``percentile_approx`` (bounded
memory), rows below the bracket are only counted, and the few values inside it
are ranked exactly. A bracket that misses its rank is replaced by the full range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import math

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskframe.functions.ordering import ROWS_PER_RANGE, running_sums

DISTINCT_LIMIT = 50_000
ACCURACY = 10_000


def exact_quantiles(
    df: DataFrame,
    cols: Sequence[str],
    probs: Sequence[float],
    by: Sequence[str] = (),
    distinct_limit: int = DISTINCT_LIMIT,
    widths: Mapping[str, int] | None = None,
) -> DataFrame:
    """One row per (by, feature) with ``q``: the quantiles in ``probs`` order.

    ``by`` is a bounded grouping such as a class label; rows with a null group
    are left out. ``widths`` passes distinct counts the caller already has.
    """
    by, cols, probs = list(by), list(cols), [float(p) for p in probs]
    if by:
        df = df.na.drop(subset=by)
    distinct = widths or df.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    narrow = [c for c in cols if (distinct[c] or 0) <= distinct_limit]
    wide = [c for c in cols if c not in narrow]
    parts = []
    if narrow:
        parts.append(_buffered(df, by, narrow, probs))
    if wide:
        parts.append(_ranked(df, by, wide, probs))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _buffered(df: DataFrame, by: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    wanted = F.array(*[F.lit(p) for p in probs])
    wide = df.groupBy(*by).agg(*[F.percentile(F.col(c).cast("double"), wanted).alias(c) for c in cols])
    return wide.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("q")) for c in cols
    ])).alias("_fq")).select(*by, "_fq.feature", "_fq.q")


def _ranked(df: DataFrame, by: list[str], cols: list[str], probs: list[float]) -> DataFrame:
    """Three scans: brackets, the rows below and up to each, the values inside.

    Brackets are literals, or columns of one row per group; no scan multiplies rows but by those
    inside a bracket. Few values are ranked in one window per quantile, more over key ranges.
    """
    spark = df.sparkSession
    keys = [*by, "feature"]
    values = df.select(*by, *[F.col(c).cast("double").alias(f"_v{i}") for i, c in enumerate(cols)])
    eps = 2.0 / ACCURACY
    around = [min(max(p + d, 0.0), 1.0) for p in probs for d in (-eps, eps)]

    def summary(v: str) -> Column:
        return F.struct(
            F.count(v).alias("n"), F.min(v).alias("least"), F.max(v).alias("most"),
            F.percentile_approx(v, around, ACCURACY).alias("near"),
        ).alias(v)

    # One target per (group, column, probability): its two ranks and its bracket.
    targets = {}
    for r in values.groupBy(*by).agg(*[summary(f"_v{i}") for i in range(len(cols))]).collect():
        for i in range(len(cols)):
            found = r[f"_v{i}"]
            for slot, p in enumerate(probs if found["n"] else []):
                at = p * (found["n"] - 1)
                targets[(*[r[k] for k in by], i, slot)] = {
                    "below": 0, "inside": found["n"], "least": found["least"], "most": found["most"],
                    "rank_lo": math.floor(at), "rank_hi": math.ceil(at), "frac": at - math.floor(at),
                    "lo": found["least"] if p <= eps else found["near"][2 * slot],
                    "hi": found["most"] if p >= 1 - eps else found["near"][2 * slot + 1],
                }
    slots = sorted({k[-2:] for k in targets})
    groups = sorted({k[:-2] for k in targets}, key=str)

    def bracketed() -> DataFrame:
        """The values beside the brackets of their group."""
        edges = [(e, i, slot) for i, slot in slots for e in ("lo", "hi")]
        if not by:
            return values.withColumns({f"_{e}{i}_{slot}": F.lit(targets[i, slot][e]).cast("double") for e, i, slot in edges})
        schema = T.StructType([df.schema[c] for c in by] + [T.StructField(f"_{e}{i}_{s}", T.DoubleType()) for e, i, s in edges])
        table = [(*g, *[targets[(*g, i, slot)][e] if (*g, i, slot) in targets else None for e, i, slot in edges]) for g in groups]
        return values.join(spark.createDataFrame(table, schema), by)

    reach = [F.count_if(F.col(f"_v{i}") < F.col(f"_lo{i}_{slot}")).alias(f"_below{i}_{slot}") for i, slot in slots]
    reach += [F.count_if(F.col(f"_v{i}") <= F.col(f"_hi{i}_{slot}")).alias(f"_upto{i}_{slot}") for i, slot in slots]
    for r in bracketed().groupBy(*by).agg(*reach).collect() if targets else []:
        for i, slot in slots:
            t = targets.get((*[r[k] for k in by], i, slot))
            if t is None:
                continue
            below, upto = r[f"_below{i}_{slot}"], r[f"_upto{i}_{slot}"]
            if below <= t["rank_lo"] and t["rank_hi"] < upto:
                t["below"], t["inside"] = below, upto - below
            else:
                t["lo"], t["hi"] = t["least"], t["most"]
    cells = [
        F.struct(
            F.lit(cols[i]).alias("feature"), F.lit(slot).alias("slot"), F.col(f"_v{i}").alias("value"),
            F.col(f"_v{i}").between(F.col(f"_lo{i}_{slot}"), F.col(f"_hi{i}_{slot}")).alias("_in"))
        for i, slot in slots
    ]
    schema = T.StructType(
        [df.schema[c] for c in by]
        + [T.StructField("feature", T.StringType()), T.StructField("slot", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("below", "rank_lo", "rank_hi")]
        + [T.StructField("frac", T.DoubleType())]
    )
    ranks = spark.createDataFrame(
        [(*k[:-2], cols[k[-2]], k[-1], t["below"], t["rank_lo"], t["rank_hi"], t["frac"]) for k, t in targets.items()], schema)
    if not targets:
        return ranks.select(*keys, F.array("frac").alias("q"))
    inside = (
        bracketed().select(*by, F.inline(F.filter(F.array(*cells), lambda c: c["_in"])))
        .groupBy(*keys, "slot", "value")
        .agg(F.count("*").alias("n"))
    )
    if max(t["inside"] for t in targets.values()) <= ROWS_PER_RANGE:
        upto = Window.partitionBy(*keys, "slot").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
        ranked = inside.withColumn("cum_n", F.sum("n").over(upto))
    else:
        ranked = running_sums(inside, [*keys, "slot"], "value", ["n"])
    last = F.col("below") + F.col("cum_n") - 1
    first = F.col("below") + F.col("cum_n") - F.col("n")
    per_slot = ranked.join(ranks, [*keys, "slot"]).groupBy(*keys, "slot", "frac").agg(
        F.max(F.when(F.col("rank_lo").between(first, last), F.col("value"))).alias("v_lo"),
        F.max(F.when(F.col("rank_hi").between(first, last), F.col("value"))).alias("v_hi"),
    )
    value = F.col("v_lo") + (F.col("v_hi") - F.col("v_lo")) * F.col("frac")
    return per_slot.groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("slot", value.alias("v")))), lambda s: s["v"]
        ).alias("q")
    )
