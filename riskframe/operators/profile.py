"""Profiling: the tables behind the usual exploratory charts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.quantiles import exact_quantiles
from riskframe.operators.quality import melt_row, pair_correlation
from riskframe.spec import FeatureSpec


def describe(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles and max; one row per column."""
    stats = df.agg(*[
        F.struct(
            F.lit(c).alias("feature"),
            F.count(c).alias("n"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(F.col(c).cast("double")).alias("min"),
            F.max(F.col(c).cast("double")).alias("max"),
        ).alias(c) for c in cols
    ])
    rows = melt_row(stats, [], [F.col(c) for c in cols])
    q = exact_quantiles(df, cols, (0.25, 0.5, 0.75))
    return rows.join(F.broadcast(q), "feature", "left").select(
        "feature", "n", "mean", "std", "min",
        F.col("q")[0].alias("p25"), F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max",
    )


def value_counts(df: DataFrame, column: str, by_value: bool = False) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(column) if by_value else counts.orderBy(F.desc("n"), column)


def value_shares(df: DataFrame, column: str) -> DataFrame:
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(
        column, "n", F.round(F.col("n").cast("double") / total, 4).alias("share")
    )


#: Above so many columns pair sums come from matrix products; Spark would otherwise plan thousands of sums.
WIDE = 40


def _moments(df: DataFrame, cols: list[str], first) -> DataFrame:
    """Sums of each pair i < j over the rows that have both columns: n, ti, tj, pii, pjj and pij."""
    k = range(len(cols))
    unit = df.selectExpr(
        " + ".join(f"int(`{c}` IS NULL) * {1 << i}" for i, c in enumerate(cols)) + " AS mask",
        *[f"coalesce((`{c}` - {first[f'm{i}'] or 0.0!r}D) / {first[f's{i}'] or 1.0!r}D, 0D) AS d{i}"
          for i, c in enumerate(cols)],
    )
    groups = unit.groupBy("mask").agg(
        F.count("*").alias("n"),
        *[F.expr(f"sum(d{i}) AS t{i}") for i in k],
        *[F.expr(f"sum(d{i} * d{j}) AS p{i}_{j}") for i in k for j in k if j >= i],
    )
    moments = [
        "named_struct('i', {i}, 'j', {j}, 'n', n, 'ti', t{i}, 'tj', t{j}, "
        "'pii', p{i}_{i}, 'pjj', p{j}_{j}, 'pij', p{i}_{j}, 'both', (mask & {m}) = 0)".format(
            i=i, j=j, m=(1 << i) | (1 << j)
        ) for i in k for j in k if j > i
    ]
    return groups.selectExpr(f"inline(array({', '.join(moments)}))").where("both").groupBy("i", "j").agg(
        *[F.sum(c).alias(c) for c in ("n", "ti", "tj", "pii", "pjj", "pij")]
    )


def _gram(df: DataFrame, cols: list[str], first) -> DataFrame:
    """As ``_moments``, for many columns: matrix products of the values and of their presence, by task."""
    wide = len(cols)
    mean = np.array([first[f"m{i}"] or 0.0 for i in range(wide)])
    spread = np.array([first[f"s{i}"] or 1.0 for i in range(wide)])
    at = np.triu_indices(wide, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, wide, wide))
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, wide)
            here = ~np.isnan(x)
            x = np.where(here, (x - mean) / spread, 0.0)
            here = here.astype(float)
            total += np.stack([here.T @ here, x.T @ here, (x * x).T @ here, x.T @ x])
        n, t, p, c = total
        out = [n[at].astype(np.int64), t[at], t.T[at], p[at], p.T[at], c[at]]
        yield pa.RecordBatch.from_arrays(
            [pa.array(at[0].astype(np.int32)), pa.array(at[1].astype(np.int32)), *map(pa.array, out)],
            names=["i", "j", "n", "ti", "tj", "pii", "pjj", "pij"])

    cells = F.array(*[F.col(f"`{c}`").cast("double") for c in cols])
    sums = df.select(cells.alias("x")).mapInArrow(
        run, "i int, j int, n bigint, ti double, tj double, pii double, pjj double, pij double")
    return sums.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "ti", "tj", "pii", "pjj", "pij")]).where("n > 0")


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson, pairwise-complete: every ordered pair, upper triangle flagged.

    One scan for means and one for sums of centred products, grouped by which
    columns are missing. A pair then adds up the groups where both are present,
    so nulls cost a few groups instead of separate aggregates per pair. Above ``WIDE``
    columns the second scan takes matrix products instead. NULL when a column is
    constant over the pair's rows.
    """
    cols = list(cols)
    k = range(len(cols))
    first = df.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(cols)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(cols)],
    ).first()
    # Dividing by the spread puts every column on one scale, so one tolerance fits all.
    if len(cols) > WIDE:
        moments = _gram(df, cols, first)
    else:
        moments = _moments(df, cols, first)
    pairs = moments.selectExpr(
        "i", "j", "pii", "pjj", "pii - ti * ti / n AS vi", "pjj - tj * tj / n AS vj", "pij - ti * tj / n AS cov"
    ).selectExpr("i", "j", "CASE WHEN vi > 1e-10 * pii AND vj > 1e-10 * pjj THEN cov / sqrt(vi * vj) END AS r")
    names = "array(" + ", ".join(f"'{c}'" for c in cols) + ")"
    every = df.sparkSession.createDataFrame([(i, j) for i in k for j in k], "x int, y int").selectExpr(
        "x", "y", "least(x, y) AS i", "greatest(x, y) AS j")
    return every.join(F.broadcast(pairs), ["i", "j"], "left").selectExpr(
        f"{names}[x] AS a", f"{names}[y] AS b", "CASE WHEN x = y THEN 1D ELSE r END AS r",
        "int(y > x) AS is_upper",
    )


def target_correlation(df: DataFrame, feature: str, target: str) -> DataFrame:
    return df.agg(pair_correlation(F.col(feature), F.col(target)).alias("r"))


def prevalence(df: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Percent of each class that carries each flag."""
    wide = df.groupBy(target).agg(*[(F.avg(c) * 100).alias(c) for c in flags])
    return wide.unpivot(target, list(flags), "flag", "percent")


def histogram(df: DataFrame, cols: Sequence[str], bins: int = 20) -> DataFrame:
    """Equal-width bins from min to max, last bin closed; one scan for the bounds
    and one for the counts, whatever the number of columns."""
    edges = df.agg(
        *[F.min(F.col(c).cast("double")).alias(f"lo_{c}") for c in cols],
        *[F.max(F.col(c).cast("double")).alias(f"hi_{c}") for c in cols],
    ).first()
    parts = []
    for c in cols:
        lo, hi = edges[f"lo_{c}"], edges[f"hi_{c}"]
        if lo is None:
            continue
        x = F.col(c).cast("double")
        width = (hi - lo) / bins
        at = F.lit(1) if lo == hi else F.least(
            F.floor((x - F.lit(lo)) / F.lit(width)).cast("int") + 1, F.lit(bins)
        )
        parts.append(F.struct(F.lit(c).alias("feature"), F.when(x.isNotNull(), at).alias("bin")))
    if not parts:
        return df.sparkSession.createDataFrame([], "feature string, bin int, n long")
    return (
        df.select(F.inline(F.array(*parts)))
        .where(F.col("bin").isNotNull())
        .groupBy("feature", "bin")
        .agg(F.count("*").alias("n"))
    )


def box_summary(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """Quartiles, whiskers inside 1.5 IQR and outlier counts per class."""
    q = exact_quantiles(df, cols, (0.25, 0.5, 0.75), by=[target])
    quart = F.broadcast(q.select(
        F.col(target), "feature",
        F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"),
    ))
    long = df.select(target, F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in cols
    ]))).where(F.col("x").isNotNull())
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("x").between(F.col("q1") - reach, F.col("q3") + reach)
    return long.join(quart, [target, "feature"]).groupBy(target, "feature", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("x"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("x"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def profile_tables(df: DataFrame, spec: FeatureSpec) -> dict[str, DataFrame]:
    """All exploratory tables of one cleaned frame."""
    return {
        "target_counts": value_counts(df, spec.target),
        "correlation": correlation_matrix(df, [*spec.numeric, spec.target]),
        "histogram": histogram(df, spec.continuous),
        "prevalence": prevalence(df, spec.flags, spec.target),
        "box_summary": box_summary(df, spec.continuous, spec.target),
        "describe": describe(df, spec.numeric),
    }
