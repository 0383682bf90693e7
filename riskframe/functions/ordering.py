"""Running totals and previous-row lookups over an order, without one-task windows.

A plain window without a fine partition key sends every row of a group to one
task. Here the group is cut into key ranges first: splits come from values whose
hash falls on a fixed residue (so the choice is the same in every recompute),
each range is summed, the few range totals get a small window, and the row-level
window runs inside one range only. Tables with more than MAX_RANGES ranges are cut
twice: into coarse ranges, and each of these into ranges of its own, so that neither a
split table nor a window over totals outgrows MAX_RANGES (about 5e13 keys a group).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from riskframe.functions.staging import stage

ROWS_PER_RANGE = 200_000
MAX_RANGES = 16_384
#: Lengths tried for a text boundary; the shortest that tells two neighbours apart is taken.
SPLIT_CHARS = (16, 64, 256, 1_024, 4_096, 16_384)


def _range_id(splits: Column, key: Column, n_max: int) -> Column:
    """How many splits are <= key, by binary search over the sorted array."""
    steps = []
    step = 1
    while step <= n_max:
        steps.append(step)
        step *= 2
    return F.aggregate(
        F.array(*[F.lit(s) for s in reversed(steps)]),
        F.lit(0),
        lambda at, s: F.when(F.get(splits, at + s - 1) <= key, at + s).otherwise(at),
    )


def _boundaries(splits: Column) -> Column:
    """Sorted texts, each cut to a prefix that is still above the text before it."""
    def cut(s: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(splits, i - 1)).otherwise(F.lit(""))
        prefixes = [F.when(F.left(s, F.lit(n)) > F.left(before, F.lit(n)), F.left(s, F.lit(n))) for n in SPLIT_CHARS]
        return F.coalesce(*prefixes, s)

    return F.transform(splits, cut)


def _cut(df: DataFrame, by: list[str], key: str, size: int, wanted: int, out: str) -> DataFrame:
    """Add ``out``: the range of each row within its ``by`` group, ranges of about ``size`` keys.

    The split table has one key in ``size``; text splits are cut to a prefix that still separates
    neighbours, so keys that share a long beginning are split too. How it is joined is left to the planner.
    """
    splits = (
        df.where(F.pmod(F.xxhash64(key), F.lit(size)) == 0)
        .groupBy(*by)
        .agg(F.array_sort(F.collect_set(key)).alias("_splits"))
    )
    if isinstance(df.schema[key].dataType, T.StringType):
        splits = splits.withColumn("_splits", _boundaries(F.col("_splits")))
    if by:
        tagged = df.join(splits, by, "left")
    else:
        tagged = df.withColumn("_splits", splits.scalar())
    return tagged.withColumn(
        out, F.coalesce(_range_id(F.col("_splits"), F.col(key), wanted), F.lit(0))
    ).drop("_splits")


def with_ranges(
    df: DataFrame, by: Sequence[str], key: str, rows: int, rows_per_range: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Add the key range of each row within its ``by`` group; also the names of the range columns.

    One column, ``_range``, up to MAX_RANGES ranges; beyond, ``_coarse`` and the ``_range`` in it.
    Ranges keep their size whatever the number of rows.
    """
    by = list(by)
    size = rows_per_range or ROWS_PER_RANGE
    if rows <= size:
        return df.withColumn("_range", F.lit(0)), ["_range"]
    if rows // size <= MAX_RANGES:
        return _cut(df, by, key, size, 4 * (rows // size + 1) + 64, "_range"), ["_range"]
    large = size * MAX_RANGES
    coarse = _cut(df, by, key, large, 4 * (rows // large + 1) + 64, "_coarse")
    # Coarse ranges vary in size; their splits are searched up to 32 times the mean number.
    return _cut(coarse, [*by, "_coarse"], key, size, 32 * MAX_RANGES, "_range"), ["_coarse", "_range"]


def _offsets(totals: DataFrame, by: list[str], places: list[str], sums: Sequence[str]) -> DataFrame:
    """What precedes each range (``_o_<s>``) and the first key behind it (``_next``).

    A range in a coarse one adds what precedes both.
    """
    *outer, place = places
    across = Window.partitionBy(*by, *outer).orderBy(place)
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    here = totals.select(
        *by, *places,
        *[F.coalesce(F.sum(f"_t_{s}").over(before), F.lit(0)).alias(f"_o_{s}") for s in sums],
        F.lead("_first").over(across).alias("_next"),
    )
    if not outer:
        return here
    coarse = totals.groupBy(*by, *outer).agg(
        *[F.sum(f"_t_{s}").alias(f"_t_{s}") for s in sums], F.min("_first").alias("_first"))
    above = _offsets(coarse, by, outer, sums).select(
        *by, *outer, *[F.col(f"_o_{s}").alias(f"_c_{s}") for s in sums], F.col("_next").alias("_beyond"))
    return here.join(above, [*by, *outer]).select(
        *by, *places, *[(F.col(f"_o_{s}") + F.col(f"_c_{s}")).alias(f"_o_{s}") for s in sums],
        F.coalesce("_next", "_beyond").alias("_next"),
    )


def _carried(lasts: DataFrame, by: list[str], places: list[str]) -> DataFrame:
    """The value ``_carry`` before each range: the ``_last`` of the range before, over coarse ones too."""
    *outer, place = places
    across = Window.partitionBy(*by, *outer).orderBy(place)
    here = lasts.withColumns({"_carry": F.lag("_last").over(across), "_n": F.row_number().over(across)})
    if not outer:
        return here.select(*by, *places, "_carry")
    coarse = lasts.groupBy(*by, *outer).agg(F.max_by("_last", place).alias("_last"))
    above = _carried(coarse, by, outer).withColumnRenamed("_carry", "_before")
    return here.join(above, [*by, *outer]).select(
        *by, *places, F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_carry")).alias("_carry"))


def running_sums(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    sums: Sequence[str],
    rows_per_range: int | None = None,
    staged: bool = False,
) -> DataFrame:
    """Add ``cum_<s>``, the total of ``s`` over keys up to and including this one,
    and ``next``, the key and sums of the following row as a struct.

    ``df`` must hold one row per (by, key) with a non-null key, so aggregate
    before calling: copies of a hot key are then already one row. ``by`` is a
    short list such as models or features. ``staged`` says that ``df`` is already a
    written table.
    """
    by = list(by)
    t = df if staged else stage(df, "ordered")
    t, places = with_ranges(t, by, key, t.count(), rows_per_range)
    totals = t.groupBy(*by, *places).agg(
        *[F.sum(s).alias(f"_t_{s}") for s in sums], F.min(F.struct(key, *sums)).alias("_first")
    )
    offsets = _offsets(totals, by, places, sums)
    inside = Window.partitionBy(*by, *places).orderBy(key)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        t.join(offsets, [*by, *places])
        .select(
            *df.columns,
            *[(F.col(f"_o_{s}") + F.sum(s).over(upto)).alias(f"cum_{s}") for s in sums],
            F.coalesce(F.lead(F.struct(key, *sums)).over(inside), F.col("_next")).alias("next"),
        )
    )


def previous_value(
    df: DataFrame,
    by: Sequence[str],
    key: str,
    value: str,
    out: str,
    rows_per_range: int | None = None,
) -> DataFrame:
    """Add ``out``: ``value`` of the preceding row in key order within the group.

    ``key`` must be unique within the group (use a struct with a tie breaker).
    """
    by = list(by)
    t = stage(df, "ordered")
    t, places = with_ranges(t, by, key, t.count(), rows_per_range)
    lasts = t.groupBy(*by, *places).agg(F.max_by(value, key).alias("_last"))
    inside = Window.partitionBy(*by, *places).orderBy(key)
    return t.join(_carried(lasts, by, places), [*by, *places]).select(
        *df.columns,
        F.when(F.row_number().over(inside) == 1, F.col("_carry"))
        .otherwise(F.lag(value).over(inside))
        .alias(out),
    )
