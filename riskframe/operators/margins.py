"""Several linear margin classifiers over the same vectors, fitted in one job per step.

The folds of a cross-fit and the fit on all rows differ only in the rows they leave out. The
rows are kept narrow, as they came; each step reads every row once, widens a block of rows at a time
by ``features`` and adds up, for all open problems, loss, gradient and curvature, as one partial sum
per task, merged in a tree. No task holds more than one Arrow batch of narrow rows and one wide block.
The driver holds one vector and one square matrix per problem, whose size is the width of the
vectors whatever the number of rows. With the fit on all rows among them, folds start from it in
the last bands, where few rows bend the loss.

The hinge is rounded off over a band of ``width`` around the margin, so Newton steps apply
(Chapelle, 2007). Fits start from a band that holds every row and end with the last of ``BANDS``, where the loss of
a row differs from the hinge by at most a quarter of the width. A problem without rows has
coefficients of zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Rows widened at a time, partial sums that one task or the driver adds up, band widths in turn.
BLOCK_ROWS = 2048
FAN_IN = 32
BANDS = (2.0, 0.5, 0.1, 0.02)
STEPS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125)
#: A step that no trial length improves is damped more, up to this.
MOST_DAMPING = 10.0
#: What is left to gain when a fit goes on to the next band but the last.
ON_THE_WAY = 1e-2
#: The share of ``tol`` at which the last band ends. Its steps end in few by themselves, and fits
#: that came from different starts then agree.
AT_THE_END = 1e-6
#: The problem that leaves no fold out.
ALL = -1

#: The band in which folds start from the fit on all rows.
REFINED = len(BANDS) - 2

_ROW = "x array<double>, sign double, weight double, fold double"
_SUM = "part int, sums binary"


def _same(x: np.ndarray) -> np.ndarray:
    return x


def pack(rows: DataFrame, vector: str, target: str, weight: str, fold: str | None,
         features: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Rows (vector, sign of the label, weight, fold), spread evenly.

    ``features`` widens the vectors before they are kept; a wide map is better left to ``fit_margins``.
    """
    chosen = rows.select(
        F.col(vector).cast("array<double>").alias("x"), F.when(F.col(target) == 1, 1.0).otherwise(-1.0).alias("sign"),
        F.col(weight).cast("double").alias("weight"), (F.col(fold) if fold else F.lit(ALL - 1)).cast("double").alias("fold"),
    )

    # One narrow shuffle: tasks and partial sums then follow the cluster, not the input's files.
    chosen = chosen.repartition(rows.sparkSession.sparkContext.defaultParallelism)
    if features is None:
        return chosen

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, *others in _unpacked(batches, features):
            wide = pa.FixedSizeListArray.from_arrays(pa.array(x[:, :-1].ravel()), x.shape[1] - 1).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([wide, *map(pa.array, others)], names=["x", "sign", "weight", "fold"])

    return chosen.mapInArrow(widen, _ROW)


def _unpacked(batches: Iterator[pa.RecordBatch],
              features: Callable[[np.ndarray], np.ndarray] = _same) -> Iterator[tuple[np.ndarray, ...]]:
    """(features with a column of ones, sign, weight, fold) of at most BLOCK_ROWS rows."""
    for whole in batches:
        for at in range(0, whole.num_rows, BLOCK_ROWS):
            b = whole.slice(at, BLOCK_ROWS)
            x = features(b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1))
            sign, weight, fold = (b.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3))
            yield np.hstack([x, np.ones((b.num_rows, 1))]), sign, weight, fold


def rounded_hinge(margin: np.ndarray, width: float) -> np.ndarray:
    near = (1 + width - margin) ** 2 / (4 * width)
    return np.where(margin > 1 + width, 0.0, np.where(margin < 1 - width, 1 - margin, near))


@dataclass
class _Problem:
    """State of one fit: ``at`` is accepted, ``move`` is under trial."""

    left_out: int
    at: np.ndarray
    move: np.ndarray
    band: int = 0
    value: float = np.inf
    slope: float = 0.0
    damping: float = 1e-10
    done: bool = False
    gradient: np.ndarray = field(default=None, repr=False)
    curvature: np.ndarray = field(default=None, repr=False)


def _sums(problems: list[tuple[int, np.ndarray, np.ndarray, float]],
          features: Callable[[np.ndarray], np.ndarray]) -> Callable:
    """Per task: for each problem the loss at all trial steps, and gradient and curvature at the whole step."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = None
        at = np.array([p[1] for p in problems]).T
        move = np.array([p[2] for p in problems]).T
        for x, sign, weight, fold in _unpacked(batches, features):
            here, go = x @ at * sign[:, None], x @ move * sign[:, None]
            parts = []
            for j, (left_out, _, _, width) in enumerate(problems):
                w = np.where(fold == left_out, 0.0, weight)
                parts.append([w @ rounded_hinge(here[:, j] + t * go[:, j], width) for t in STEPS])
                m = here[:, j] + go[:, j]
                pull = -np.clip((1 + width - m) / (2 * width), 0.0, 1.0)
                parts.append(x.T @ (w * pull * sign))
                bent = (np.abs(1 - m) <= width) & (w > 0)
                # Single precision of the curvature only bends the direction; values and gradients decide.
                xb = (x[bent] * np.sqrt(w[bent] / (2 * width))[:, None]).astype(np.float32)
                parts.append((xb.T @ xb).ravel().astype(np.float64))
            one = np.concatenate(parts)
            total = one if total is None else total + one
        if total is not None:
            yield _sum_row(TaskContext.get().partitionId(), total)

    return of


def _sum_row(part: int, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, part = None, 0
    for batch in batches:
        for i in range(batch.num_rows):
            one = np.frombuffer(batch.column(1)[i].as_buffer())
            total, part = (one, batch.column(0)[i].as_py()) if total is None else (total + one, part)
    if total is not None:
        yield _sum_row(part, total)


def tree_sum(partials: DataFrame, parts: int) -> np.ndarray | None:
    """The sum of one vector per task; no task and not the driver adds up more than about ``FAN_IN``."""
    while parts > FAN_IN:
        parts = -(-parts // FAN_IN)
        partials = partials.repartition(parts, F.pmod(F.col("part"), F.lit(parts))).mapInArrow(_merge, _SUM)
    rows = sorted(partials.collect(), key=lambda r: r["part"])
    return sum(np.frombuffer(r["sums"]) for r in rows) if rows else None


def fit_margins(blocks: DataFrame, left_out: Sequence[int], width: int, c: float = 1.0, max_steps: int = 30,
                tol: float = 1e-6, features: Callable[[np.ndarray], np.ndarray] = _same) -> list[np.ndarray]:
    """Coefficients, the intercept last, of each problem: weighted mean hinge plus a ridge of 1 / (c * weight).

    ``width`` is that of the vectors after ``features``. ``blocks`` should be persisted or staged, as
    every step scans it once. A problem ends when the decrease that a Newton step still promises is far
    below ``tol`` of its objective in the last band, or after ``max_steps`` steps.
    """
    parts = blocks.rdd.getNumPartitions()
    n = width + 1
    weights = _fold_weights(blocks)
    whole = sum(weights.values())
    open_weight = {k: whole - weights.get(float(k), 0.0) for k in left_out}
    problems = [_Problem(k, np.zeros(n), np.zeros(n), done=open_weight[k] <= 0) for k in left_out]

    def solve(some: list[_Problem]) -> None:
        _descend(blocks, parts, some, open_weight, n, c, max_steps, tol, features)

    first = next((p for p in problems if p.left_out == ALL), None)
    if first is None:
        solve(problems)
    else:
        solve([first])
        rest = [p for p in problems if p is not first]
        for p in rest:
            if not p.done:
                p.at, p.band = first.at.copy(), REFINED
        solve(rest)
    return [p.at for p in problems]


def _descend(blocks: DataFrame, parts: int, problems: list[_Problem], open_weight: dict[int, float], n: int, c: float,
             max_steps: int, tol: float, features: Callable[[np.ndarray], np.ndarray]) -> None:
    ridge = np.append(np.ones(n - 1), 0.0)
    for _ in range(max_steps * 2):
        active = [p for p in problems if not p.done]
        if not active:
            break
        sums = tree_sum(
            blocks.mapInArrow(_sums([(p.left_out, p.at, p.move, BANDS[p.band]) for p in active], features), _SUM), parts)
        for p, s in zip(active, sums.reshape(len(active), -1)):
            total = open_weight[p.left_out]
            reg = ridge / (c * total)
            trial = [p.at + t * p.move for t in STEPS]
            values = s[:len(STEPS)] / total + [(reg * b * b).sum() / 2 for b in trial]
            if values[0] <= p.value + 1e-4 * p.slope:
                p.at, p.value = trial[0], values[0]
                p.gradient = s[len(STEPS):len(STEPS) + n] / total + reg * p.at
                p.curvature = s[len(STEPS) + n:].reshape(n, n) / total + np.diag(reg)
                p.damping = max(p.damping / 10, 1e-10)
                _aim(p, tol)
            else:
                best = int(np.argmin(values))
                if values[best] < p.value:
                    p.at = trial[best]
                    p.value, p.slope, p.move = np.inf, 0.0, np.zeros(n)
                elif p.damping < MOST_DAMPING:
                    p.damping = max(100 * p.damping, 1e-4)
                    _aim(p, tol)
                else:
                    _narrow(p)


def _aim(p: _Problem, tol: float) -> None:
    """Set the next Newton step, or go on to the next band when little is left to gain."""
    p.move = -np.linalg.solve(p.curvature + p.damping * np.eye(len(p.at)), p.gradient)
    p.slope = float(p.gradient @ p.move)
    if -p.slope / 2 <= (AT_THE_END * tol if p.band == len(BANDS) - 1 else max(tol, ON_THE_WAY)) * max(p.value, 1e-12):
        _narrow(p)


def _narrow(p: _Problem) -> None:
    p.band += 1
    p.done = p.band == len(BANDS)
    p.value, p.slope, p.damping, p.move = np.inf, 0.0, 1e-10, np.zeros(len(p.at))


def _fold_weights(blocks: DataFrame) -> dict[float, float]:
    rows = blocks.groupBy("fold").agg(F.sum("weight").alias("weight"))
    return {r["fold"]: r["weight"] for r in rows.collect()}


def held_out_scores(blocks: DataFrame, left_out: Sequence[int], fits: Sequence[np.ndarray],
                    features: Callable[[np.ndarray], np.ndarray] = _same) -> DataFrame:
    """(label, score) of every row by the fit that left its fold out."""
    by_fold = dict(zip(left_out, fits))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, sign, _, fold in _unpacked(batches, features):
            out = np.zeros(len(sign))
            for k, beta in by_fold.items():
                rows = fold == k
                out[rows] = x[rows] @ beta
            yield pa.RecordBatch.from_arrays(
                [pa.array((sign > 0).astype(np.int32)), pa.array(out)], names=["label", "score"])

    return blocks.mapInArrow(score, "label int, score double")
