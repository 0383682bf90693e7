"""Nearest rows by locality-sensitive hashing with p-stable projections.

Each of ``tables`` hashes a point to a cell of a randomly turned and shifted grid (Datar et al., 2004): one
projection per axis, floored at a cell width. Queries also probe the cells next to theirs on the axes
whose walls they are nearest to. Points meet queries of their cell by one shuffle; hot cells are split: the
points of a cell above ``cell_rows`` are dealt over sub-cells that its queries all visit, so no task
holds a whole hot cell. Distances of all that meet are exact, and each query keeps its ``k`` nearest.

Only the cells are approximate: a near row that shares no probed cell in any table is missed. ``recall``
measures that against all pairs for a given set of queries.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskframe.functions.staging import stage

TABLES = 6
CELL_ROWS = 1_024
#: The points that a cell should hold on average decide its width.
POINTS_A_CELL = 64
SAMPLE_ROWS = 4_096


def cell_width(points: DataFrame, cols: Sequence[str], points_a_cell: int = POINTS_A_CELL) -> float:
    """Width at which a cell around a typical point holds about ``points_a_cell`` points.

    Of a bounded sample (SAMPLE_ROWS rows of smallest hash) the distances to the neighbour of the
    matching rank are taken, and their median is the width.
    """
    n = points.count()
    key = F.xxhash64(*cols)
    sample = points.select(key.alias("h"), F.array(*[F.col(c) for c in cols]).alias("v")).orderBy("h").limit(SAMPLE_ROWS)
    v = np.array([r["v"] for r in sample.collect()], dtype=float).reshape(-1, len(cols))
    if len(v) < 2:
        return 1.0
    rank = min(len(v) - 1, max(1, round(points_a_cell * len(v) / max(n, 1))))
    some = v[:512]
    away = np.sqrt(((some[:, None, :] - v[None, :, :]) ** 2).sum(axis=2))
    width = float(np.median(np.partition(away, rank, axis=1)[:, rank])) * 2.0
    return width if width > 0 else 1.0


def _cells(df: DataFrame, cols: Sequence[str], width: float, axes: int, tables: int, probes: int, seed: int) -> DataFrame:
    """(key, id, v): one row per row, table and probe; the first probe is the row's own cell."""
    rng = np.random.default_rng(seed)
    turns = rng.normal(size=(tables, axes, len(cols)))
    turns /= np.linalg.norm(turns, axis=2, keepdims=True)
    shifts = rng.uniform(0, 1, (tables, axes))
    factors = rng.integers(1, 1 << 62, axes, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    wide = len(cols)

    def named(t: int, cell: np.ndarray) -> np.ndarray:
        """A 64-bit name of a cell. Two cells of one name only meet more."""
        h = (cell.astype(np.int64).view(np.uint64) * factors).sum(axis=1, dtype=np.uint64) + np.uint64((t + 1) << 40)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            v = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(ids), wide)
            if not np.isfinite(v).all():
                raise ValueError("points need finite coordinates")
            for t in range(tables):
                at = v @ (turns[t] / width).T + shifts[t]
                own = np.floor(at)
                keys = [named(t, own)]
                # Walls in order of nearness: each of the first is crossed alone, the two nearest together too.
                away = np.concatenate([at - own, own + 1 - at], axis=1)
                order = np.argsort(away, axis=1, kind="stable")
                steps = []
                for w in range(min(probes, 2 * axes)):
                    step = np.zeros_like(own)
                    step[np.arange(len(ids)), order[:, w] % axes] = np.where(order[:, w] < axes, -1, 1)
                    steps.append(step)
                keys += [named(t, own + step) for step in steps]
                if len(steps) > 1 and axes > 1:
                    keys.append(named(t, own + steps[0] + steps[1]))
                many = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.stack(keys, axis=1).ravel()), pa.array(np.repeat(ids, many)),
                     pa.ListArray.from_arrays(np.arange(len(ids) * many + 1, dtype=np.int32) * wide,
                                              pa.array(np.repeat(v, many, axis=0).ravel()))],
                    names=["key", "id", "v"])

    return df.select("id", F.array(*[F.col(c).cast("double") for c in cols]).alias("v")).mapInArrow(
        run, "key bigint, id bigint, v array<double>")


def _meet(width: int, k: int):
    """Of cells sorted by (key, part): the nearest points of each query in the cell."""
    def close(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        ids = np.array([r[0] for r in rows], dtype=np.int64)
        asks = np.array([r[1] for r in rows])
        v = np.array([r[2] for r in rows], dtype=float).reshape(len(rows), width)
        q, p = np.flatnonzero(asks), np.flatnonzero(~asks)
        if not len(q) or not len(p):
            return
        for lo in range(0, len(q), 256):
            some = q[lo:lo + 256]
            d = ((v[some][:, None, :] - v[p][None, :, :]) ** 2).sum(axis=2)
            d[ids[some][:, None] == ids[p][None, :]] = np.inf
            few = min(k, len(p))
            order = np.lexsort((np.broadcast_to(ids[p], d.shape), d), axis=1)[:, :few]
            near = np.take_along_axis(d, order, axis=1).ravel()
            keep = np.isfinite(near)
            at = p[order.ravel()[keep]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(ids[some], few)[keep]), pa.array(near[keep]), pa.array(ids[at]),
                 pa.ListArray.from_arrays(np.arange(len(at) + 1, dtype=np.int32) * width, pa.array(v[at].ravel()))],
                names=["q", "d", "id", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for key, part, *row in zip(*[c.to_pylist() for c in batch.columns]):
                if (key, part) != cell:
                    if len(rows) > 1:
                        yield from close(rows)
                    cell, rows = (key, part), []
                rows.append(row)
                if len(rows) >= 16 * CELL_ROWS:
                    # Many queries of one cell: points stay, answered queries go.
                    yield from close(rows)
                    rows = [r for r in rows if not r[1]]
        if len(rows) > 1:
            yield from close(rows)

    return run


def nearest(points: DataFrame, cols: Sequence[str], k: int, queries: DataFrame | None = None, tables: int = TABLES,
            axes: int | None = None, probes: int = 4, width: float | None = None, cell_rows: int = CELL_ROWS,
            seed: int = 42) -> DataFrame:
    """(q, near): the ``k`` nearest other points of each query, ascending, as structs (d, id, v).

    ``points`` and ``queries`` (points themselves by default) hold distinct long ids ``id`` and the
    double columns ``cols``; d is the squared distance and v the point. Ties go to the smaller id.
    Queries that meet no point are left out.
    """
    axes = axes or min(len(cols), 3)
    queries = points if queries is None else queries
    width = width or cell_width(points, cols)
    homes = _cells(points, cols, width, axes, tables, 0, seed)
    visits = _cells(queries, cols, width, axes, tables, probes, seed)
    sizes = stage(homes.groupBy("key").agg(F.ceil(F.count("*") / F.lit(cell_rows)).cast("int").alias("parts")), "cell_sizes")
    # Points of a hot cell are dealt over its parts; queries visit every part. Points come first in each.
    dealt = homes.join(sizes, "key").select(
        "key", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.lit(False).alias("asks"), "v")
    asked = visits.join(sizes, "key").select(
        "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "id", F.lit(True).alias("asks"), "v")
    cells = dealt.unionByName(asked).repartition("key", "part").sortWithinPartitions("key", "part", "asks", "id")
    met = cells.mapInArrow(_meet(len(cols), k), "q bigint, d double, id bigint, v array<double>")
    best = F.slice(F.array_sort(F.collect_set(F.struct("d", "id", "v"))), 1, k)
    # At most k a table and probe come together for a query.
    return met.groupBy("q").agg(best.alias("near"))


def nearest_whole(points: DataFrame, cols: Sequence[str], k: int, queries: DataFrame | None = None,
                  width: float | None = None, axes: int | None = None, **options) -> DataFrame:
    """As ``nearest``, with ``k`` neighbours (or all other points, if fewer) for every query.

    Queries that met too few points look again in cells four times as wide.
    """
    axes = axes or min(len(cols), 3)
    todo = points if queries is None else queries
    width = width or cell_width(points, cols)
    want = min(k, points.count() - 1)
    parts = []
    while want > 0 and not todo.isEmpty():
        found = stage(nearest(points, cols, k, todo, axes=axes, width=width, **options), "near_rows")
        parts.append(found.where(F.size("near") >= want))
        todo = stage(todo.join(parts[-1].select(F.col("q").alias("id")), "id", "left_anti"), "not_near")
        width *= 4
        if len(parts) > 60:
            raise ValueError("points need finite coordinates")
    if not parts:
        return nearest(points.limit(0), cols, k, points.limit(0), axes=axes, width=1.0, **options)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def exact_nearest(points: DataFrame, cols: Sequence[str], k: int, queries: DataFrame) -> DataFrame:
    """As ``nearest``, by comparing a stated set of queries with all points block by block.

    Meant for measuring: the queries are sent to every task and must be few.
    """
    asked = queries.select("id", *cols).toArrow()
    ids, v = asked["id"].to_numpy(), np.stack([asked[c].to_numpy().astype(float) for c in cols], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_numpy()
            w = np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            few = min(k + 1, len(own))
            for lo in range(0, len(ids), 256):
                some = slice(lo, lo + 256)
                d = ((v[some][:, None, :] - w[None, :, :]) ** 2).sum(axis=2)
                d[ids[some][:, None] == own[None, :]] = np.inf
                order = np.lexsort((np.broadcast_to(own, d.shape), d), axis=1)[:, :few]
                near = np.take_along_axis(d, order, axis=1).ravel()
                keep = np.isfinite(near)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(ids[some], few)[keep]), pa.array(near[keep]), pa.array(own[order.ravel()[keep]])],
                    names=["q", "d", "id"])

    met = points.select("id", *[F.col(c).cast("double") for c in cols]).mapInArrow(run, "q bigint, d double, id bigint")
    return met.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "id"))), 1, k).alias("near"))


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the true nearest distances that ``found`` holds: ties at the last place count as found."""
    last = F.element_at("near", -1)["d"]
    truth = exact.select("q", F.size("near").alias("n"), last.alias("last"))
    got = found.select("q", F.transform("near", lambda x: x["d"]).alias("ds"))
    both = truth.join(got, "q", "left").select(
        "n", F.coalesce(F.size(F.filter("ds", lambda d: d <= F.col("last") * (1 + 1e-12))), F.lit(0)).alias("hits"))
    return float(both.agg((F.sum(F.least("hits", "n")) / F.sum("n")).alias("r")).first()["r"])
