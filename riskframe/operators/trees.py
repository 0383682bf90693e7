"""Decision trees and forests grown level by level from keyed counts.

All open nodes of all trees are split at once. Per level one job sends every row down the trees
grown so far and counts classes by (node, feature, value); running counts over the values of each node and
feature then give the gain of every threshold, and one aggregate keeps the best of each node.
Thresholds lie half-way between neighbouring values that occur, so a tree without bins is exact.
With bins, rows are staged as bin numbers, a byte each, and a task counts a tree at a time into one dense
table, so what goes to the search is one short record for each node and task, whatever the number of rows.
Counts of a node with bins or few rows are searched by one task; the values of larger nodes go through
key ranges, so no task holds all values of a node.

Counts are integers and class weights are applied to their sums; a row's share in a tree is a Poisson
draw from the hash of its id and the tree. Neither depends on partitions or cores, so the
same rows give the same trees anywhere. Nothing is kept between levels but the trees themselves:
a lost task only counts again.

The trees are held by the driver and sent to the tasks: at most ``trees * 2 ** (max_depth + 1)``
nodes. A forest with bins and no depth limit may have two nodes for each row and tree, so there only nodes of more than
``HAND_OVER`` drawn rows are split that way. The rows of each smaller node go to one task, which grows the
subtree to its end; the driver gets the sums that importances need, or the nodes if they are asked for.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from riskframe.functions.ordering import running_sums
from riskframe.functions.quantiles import exact_quantiles
from riskframe.functions.staging import stage
from riskframe.sources.readers import read_json

#: Rows that a task counts at a time, and the cells of a dense count.
PIECE_ROWS = 65_536
DENSE_CELLS = 1 << 24
#: With bins: rows that are counted into one table of a tree, rows walked at a time, and the most cells of that table; levels with more
#: open nodes send sparse counts.
TABLE_ROWS = 1 << 20
BLOCK_ROWS = 32_768
TABLE_CELLS = 1 << 22
#: Without a depth limit: drawn rows of a node that one task grows to its end, and bytes of rows in a record on the way there.
HAND_OVER = 1 << 19
SHIP_BYTES = 4_096
#: Nodes searched at a time.
SEARCH_NODES = 1_024
#: Without bins, the values of nodes with more of them are cut into key ranges; others fit into a task.
LOCAL_ROWS = 200_000
#: By how much an estimate of distinct values may be short.
ESTIMATE_SLACK = 1.5
#: Counts that a task searches at a time, whole nodes each.
PIECE_COUNTS = 1 << 20
_NODES = "tree int, feature int, threshold double, lower int, upper int, n0 bigint, n1 bigint"
_BEST = "node int, feature int, threshold double, cum_n0 bigint, cum_n1 bigint"
_BEST_TYPES = pa.schema([("node", pa.int32()), ("feature", pa.int32()), ("threshold", pa.float64()), ("cum_n0", pa.int64()), ("cum_n1", pa.int64())])
_CARD = "name string, columns array<string>, w0 double, w1 double"
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod(np.concatenate([[1.0], np.arange(1, 12)])))
#: The draw by the first 12 bits of a hash, -1 where the other bits decide.
_EDGES = np.searchsorted(_POISSON, np.arange(4_097) / 4_096)
_DRAWS = np.where((_EDGES[1:] == _EDGES[:-1]) & (_EDGES[:-1] < len(_POISSON)), _EDGES[:-1], -1)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def bootstrap(ids: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row, given by the hash of its id, is drawn for a tree: Poisson with mean 1."""
    salt = _mixed(np.array([(seed << 32) + tree + 1], dtype=np.uint64))[0]
    h = _mixed(ids.astype(np.uint64) ^ salt)
    w = _DRAWS[(h >> np.uint64(52)).astype(np.int64)]
    edge = np.flatnonzero(w < 0)
    w[edge] = np.searchsorted(_POISSON, (h[edge] >> np.uint64(11)) / float(1 << 53))
    return w


def _walk(flat: np.ndarray, rows: np.ndarray, root: int, feature: np.ndarray, limit: np.ndarray, lower: np.ndarray,
          most: int | None = None) -> np.ndarray:
    """The node in which ``rows`` end after ``most`` steps, or at a leaf, from ``root`` on.

    ``flat`` holds the cells of each feature in turn and ``feature`` where these begin. A leaf leads
    to itself: its limit is no cell's to exceed, its ``lower`` is the leaf.
    """
    at = np.full(len(rows), root, dtype=np.int64)
    while most is None or most > 0:
        cell = feature.take(at)
        cell += rows
        node = lower.take(at)
        node += flat.take(cell) > limit.take(at)
        if most is None and np.array_equal(node, at):
            break
        at, most = node, None if most is None else most - 1
    return at


@dataclass(frozen=True)
class Nodes:
    """The nodes of all trees, roots first; a leaf has feature -1."""

    tree: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    lower: np.ndarray
    upper: np.ndarray
    n0: np.ndarray
    n1: np.ndarray

    def leaves(self, x: np.ndarray, trees: int) -> np.ndarray:
        """The node (row, tree) in which each row of ``x`` ends."""
        # A missing value goes to the upper side.
        flat, rows = np.ascontiguousarray(np.where(np.isnan(x), np.inf, x).T).ravel(), np.arange(len(x))
        limit = np.where(self.feature >= 0, self.threshold, np.inf)
        feature, limit, lower = self._steps(limit)
        return np.stack([_walk(flat, rows, t, feature * len(x), limit, lower) for t in range(trees)], axis=1)

    def _steps(self, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        leaf = self.feature < 0
        return np.where(leaf, 0, self.feature).astype(np.int64), limit, np.where(leaf, np.arange(len(leaf)), self.lower).astype(np.int64)

    def coded(self, cuts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Feature, last bin of the lower side and lower node, as ``_walk`` takes them."""
        limit = np.full(len(self.feature), max(map(len, cuts)) + 1, dtype=np.int32)
        for k, c in enumerate(cuts):
            mine = self.feature == k
            limit[mine] = np.searchsorted(c, self.threshold[mine])
        return self._steps(limit)


def _pieces(batches: Iterator[pa.RecordBatch], width: int, code: str | None = None,
            most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash of id, class, features) of at most about ``most`` rows; with ``code`` the features are bins of that type."""
    held: list[pa.RecordBatch] = []
    most = most or PIECE_ROWS

    def joined() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        t = pa.Table.from_batches(held).combine_chunks()
        x = t["x"].combine_chunks()
        if code:
            x = _matrix(x, code)
        else:
            x = x.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(t), width)
            if np.isnan(x).any():
                raise ValueError("trees need features without missing values")
        return t["h"].to_numpy().view(np.uint64), t["y"].to_numpy().astype(np.int64), x

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= most:
            piece = joined()
            held.clear()
            yield piece
            del piece
    if held:
        piece = joined()
        held.clear()
        yield piece


def _binary(table: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    n, size = len(table), table.shape[1] * table.itemsize
    ends = np.arange(0, (n + 1) * size, size, dtype=np.int32) if size else np.zeros(n + 1, np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(table))])


def _joined(values: pa.Array) -> memoryview:
    """The bytes of binary ``values`` one after the other, on their own buffer."""
    _, ends, data = values.buffers()
    first, last = np.frombuffer(ends, np.int32)[[values.offset, values.offset + len(values)]]
    return memoryview(data)[first:last]


def _matrix(values: pa.Array, code: str) -> np.ndarray:
    """The rows of ``values``, binary and equally long, as a matrix on their own buffer."""
    return np.frombuffer(_joined(values), code).reshape(len(values), -1)


def _code_type(cuts: list[np.ndarray]) -> str:
    return "u1" if max(map(len, cuts)) < 256 else "u4"


def _coded(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """``rows`` with the bin of each feature in place of its value."""
    code = _code_type(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, x in _pieces(batches, len(cuts)):
            bins_of = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], axis=1).astype(code)
            yield pa.RecordBatch.from_arrays([pa.array(ids.view(np.int64)), pa.array(y.astype(np.int32)), _binary(bins_of)], names=["h", "y", "x"])

    return rows.mapInArrow(run, "h bigint, y int, x binary")


def _node_features(nodes: np.ndarray, tree: np.ndarray, width: int, few: int, seed: int) -> np.ndarray:
    """The ``few`` features that each node may split on, ascending; a hash of tree and node chooses."""
    if few >= width:
        return np.broadcast_to(np.arange(width), (len(nodes), width))
    key = (tree.astype(np.uint64) << np.uint64(32)) ^ nodes.astype(np.uint64) ^ np.uint64(seed << 8)
    return _features_of(_mixed(key), width, few)


def _features_of(keys: np.ndarray, width: int, few: int) -> np.ndarray:
    """The ``few`` features that the nodes with these keys may split on, ascending."""
    if few >= width:
        return np.broadcast_to(np.arange(width), (len(keys), width))
    ranked = _mixed(keys[:, None] + np.arange(1, width + 1, dtype=np.uint64)[None, :])
    return np.sort(np.argsort(ranked, axis=1, kind="stable")[:, :few], axis=1)


def _root_keys(trees: int, seed: int) -> np.ndarray:
    return _mixed((np.arange(trees, dtype=np.uint64) << np.uint64(32)) ^ np.uint64((seed << 8) + 1))


def _child_keys(keys: np.ndarray) -> np.ndarray:
    """Keys of the lower and upper child of each node, in turn: a node's key follows from its tree and path alone."""
    return np.stack([_mixed(keys ^ np.uint64(c)) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)], axis=1).ravel()


def _counter(nodes: Nodes, opened: np.ndarray, may: np.ndarray, trees: int, cuts: list[np.ndarray] | None,
             width: int, sampled: bool, seed: int):
    """A job that counts both classes by (node, feature, value or bin)."""
    place = np.full(len(nodes.tree), -1, dtype=np.int32)
    place[opened] = np.arange(len(opened), dtype=np.int32)
    live = np.unique(nodes.tree[opened])
    steps = nodes.coded(cuts) if cuts else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, x in _pieces(batches, width, _code_type(cuts) if cuts else None):
            if cuts:
                values, codes = [np.arange(len(c) + 1, dtype=float) for c in cuts], x.astype(np.int32)
            else:
                both = [np.unique(x[:, k], return_inverse=True) for k in range(width)]
                values, codes = [v for v, _ in both], np.stack([c for _, c in both], axis=1).astype(np.int32)
            span = max(map(len, values))
            ends = nodes.leaves(x, trees) if steps is None else None
            if steps:
                flat, every, (feature_at, limit, lower) = np.ascontiguousarray(codes.T).ravel(), np.arange(len(x)), steps
                feature_at = feature_at * len(x)
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for t in live.tolist():
                at = place[ends[:, t] if steps is None else _walk(flat, every, t, feature_at, limit, lower)]
                w = bootstrap(ids, t, seed) if sampled else np.ones(len(x), dtype=np.int64)
                rows = np.flatnonzero((at >= 0) & (w > 0))
                if not len(rows):
                    continue
                at, w, c = at[rows], w[rows], y[rows]
                base = int(at.min())
                which = may[at]
                key = ((at - base)[:, None] * np.int64(which.shape[1]) + np.arange(which.shape[1])) * span + codes[rows[:, None], which]
                key = (key * 2 + c[:, None]).ravel()
                weight = np.repeat(w, which.shape[1])
                cells = (int(at.max()) - base + 1) * which.shape[1] * span * 2
                if cells <= DENSE_CELLS:
                    n = np.bincount(key, weight, cells)
                    hit = np.flatnonzero(n)
                    n = n[hit]
                else:
                    hit, inverse = np.unique(key, return_inverse=True)
                    n = np.bincount(inverse, weight)
                found.append((hit + np.int64(base) * which.shape[1] * span * 2, n))
            if not found:
                continue
            key, n = (np.concatenate(p) for p in zip(*found))
            cls, key = key & 1, key >> 1
            code, key = key % span, key // span
            at, slot = key // may.shape[1], key % may.shape[1]
            feature = may[at, slot]
            value = np.zeros(len(at))
            for k in range(width):
                mine = feature == k
                value[mine] = values[k][code[mine]]
            n = n.astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(opened[at].astype(np.int32)), pa.array(feature.astype(np.int32)), pa.array(value),
                 pa.array(np.where(cls == 0, n, 0)), pa.array(np.where(cls == 1, n, 0))],
                names=["node", "feature", "value", "n0", "n1"],
            )

    return run


def _table_counter(nodes: Nodes, opened: np.ndarray, may: np.ndarray, cuts: list[np.ndarray], depth: int, sampled: bool, seed: int):
    """A job that counts, for each open node, both classes by (feature tried, bin) in one record."""
    place = np.full(len(nodes.tree), -1, dtype=np.int64)
    place[opened] = np.arange(len(opened))
    live, first, many = np.unique(nodes.tree[opened], return_index=True, return_counts=True)
    (feature, limit, lower), code, width, few = nodes.coded(cuts), _code_type(cuts), len(cuts), may.shape[1]
    span = max(map(len, cuts)) + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, x in _pieces(batches, width, code, TABLE_ROWS):
            blocks = [(np.ascontiguousarray(x[lo:lo + BLOCK_ROWS].T).ravel(), ids[lo:lo + BLOCK_ROWS], y[lo:lo + BLOCK_ROWS])
                      for lo in range(0, len(x), BLOCK_ROWS)]
            starts = {n: (feature * n, may.T * np.int64(n)) for n in {len(cls) for _, _, cls in blocks}}
            keys, weights = np.empty(len(x) * few, dtype=np.int64), np.empty(len(x) * few)
            for t, base, n in zip(live.tolist(), first.tolist(), many.tolist()):
                used = 0
                for flat, h, cls in blocks:
                    feature_at, tried_at = starts[len(h)]
                    w = bootstrap(h, t, seed) if sampled else np.ones(len(h), dtype=np.int64)
                    rows = np.flatnonzero(w)
                    at = place.take(_walk(flat, rows, t, feature_at, limit, lower, depth))
                    some = np.flatnonzero(at >= 0)
                    rows, at = rows.take(some), at.take(some)
                    cell, w = (at - base) * (few * span * 2) + cls.take(rows), w.take(rows)
                    for k in range(few):
                        of = tried_at[k].take(at)
                        of += rows
                        bin_ = flat.take(of).astype(np.int64)
                        bin_ *= 2
                        bin_ += cell
                        np.add(bin_, k * span * 2, out=keys[used:used + len(rows)])
                        weights[used:used + len(rows)] = w
                        used += len(rows)
                table = np.bincount(keys[:used], weights[:used], n * few * span * 2).reshape(n, -1).astype(np.int32)
                some = np.flatnonzero(table.any(axis=1))
                if len(some):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(opened[base + some].astype(np.int32)), _binary(table[some])], names=["node", "counts"])

    return run


def _table_searcher(opened: np.ndarray, may: np.ndarray, t0: np.ndarray, t1: np.ndarray, w0: float, w1: float, min_leaf: int, span: int):
    """As ``_searcher``, for records of ``_table_counter`` that arrive sorted by node, those of a node together."""
    few = may.shape[1]

    def search(node: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        at = np.searchsorted(opened, node)
        all0, all1 = t0[at][:, None], t1[at][:, None]
        upto = np.cumsum(counts.reshape(len(node), few, span, 2), axis=2).reshape(len(node), few * span, 2)
        c0, c1 = upto[..., 0], upto[..., 1]
        left = c0 + c1
        use = (left >= min_leaf) & (all0 + all1 - left >= min_leaf)
        l0, l1, r0, r1 = c0 * w0, c1 * w1, (all0 - c0) * w0, (all1 - c1) * w1
        whole = _purity(all0 * w0, all1 * w1)
        with np.errstate(invalid="ignore"):
            gain = np.where(use, _purity(l0, l1) + _purity(r0, r1) - whole, -np.inf)
        # The first of the largest is that of the first feature and lowest bin.
        best, every = gain.argmax(axis=1), np.arange(len(node))
        pick = np.flatnonzero(gain[every, best] > 1e-12 * whole[:, 0])
        best = best[pick]
        return pa.RecordBatch.from_arrays(
            [pa.array(node[pick]), pa.array(may[at[pick], best // span].astype(np.int32)), pa.array((best % span).astype(float)),
             pa.array(c0[pick, best]), pa.array(c1[pick, best])], names=["node", "feature", "threshold", "cum_n0", "cum_n1"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept_node, kept = np.empty(0, np.int32), np.empty((0, few * span * 2), np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, SEARCH_NODES):
                part = batch.slice(lo, SEARCH_NODES)
                node = np.concatenate([kept_node, part.column(0).to_numpy()])
                data = np.concatenate([kept, _matrix(part.column(1), "i4")])
                start = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
                node, data = node[start], np.add.reduceat(data, start, axis=0)
                kept_node, kept = node[-1:], data[-1:]
                if len(node) > 1:
                    yield search(node[:-1], data[:-1])
        if len(kept_node):
            yield search(kept_node, kept)

    return run


def _purity(a, b):
    """Class weights squared over their sum: the higher the sum of both sides, the lower the gini impurity."""
    return (a * a + b * b) / (a + b)


def _searcher(opened: np.ndarray, t0: np.ndarray, t1: np.ndarray, w0: float, w1: float, min_leaf: int, between: bool):
    """As ``best_splits``, for counts that arrive sorted by (node, feature, value), whole nodes together."""
    names = ["node", "feature", "threshold", "cum_n0", "cum_n1"]

    def search(cols: list[np.ndarray]) -> pa.RecordBatch:
        node, feature, value, n0, n1 = cols
        at = np.searchsorted(opened, node)
        all0, all1 = t0[at], t1[at]
        new = np.ones(len(node), dtype=bool)
        new[1:] = (node[1:] != node[:-1]) | (feature[1:] != feature[:-1])
        start = np.maximum.accumulate(np.where(new, np.arange(len(node)), 0))
        upto = lambda n: np.cumsum(n) - (np.cumsum(n) - n)[start]
        c0, c1 = upto(n0), upto(n1)
        last = np.append(new[1:], True)
        above = np.append(value[1:], 0.0)
        left = c0 + c1
        use = np.flatnonzero(~last & (left >= min_leaf) & (all0 + all1 - left >= min_leaf))
        l0, l1 = c0[use] * w0, c1[use] * w1
        r0, r1 = (all0 - c0)[use] * w0, (all1 - c1)[use] * w1
        whole = _purity(all0[use] * w0, all1[use] * w1)
        gain = _purity(l0, l1) + _purity(r0, r1) - whole
        better = gain > 1e-12 * whole
        use, gain = use[better], gain[better]
        # The first of the largest in each node is that of the first feature and lowest value.
        order = np.lexsort((use, -gain, node[use]))
        first = np.ones(len(order), dtype=bool)
        first[1:] = node[use[order[1:]]] != node[use[order[:-1]]]
        pick = use[order[first]]
        middle = (value[pick] + above[pick]) / 2
        threshold = np.where(middle < above[pick], middle, value[pick]) if between else value[pick]
        return pa.RecordBatch.from_arrays(
            [pa.array(c) for c in (node[pick], feature[pick], threshold, c0[pick], c1[pick])], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([c.to_numpy() for c in batch.columns])
            if sum(len(h[0]) for h in held) >= PIECE_COUNTS:
                cols = [np.concatenate(c) for c in zip(*held)]
                cut = int(np.searchsorted(cols[0], cols[0][-1]))
                held = [[c[cut:] for c in cols]]
                if cut:
                    yield search([c[:cut] for c in cols])
        if held:
            yield search([np.concatenate(c) for c in zip(*held)])

    return run


def best_splits(counts: DataFrame, totals: DataFrame, w0: float, w1: float, min_leaf: int) -> DataFrame:
    """Of (node, feature, value, n0, n1), a written table: the split of each node that lowers weighted gini impurity most.

    ``totals`` holds (node, t0, t1). Both sides keep ``min_leaf`` rows. Ties go to the first feature,
    then to the lowest threshold. Nodes that no split improves are left out.
    """
    run = running_sums(counts, ["node", "feature"], "value", ["n0", "n1"], staged=True)
    next_value = F.col("next.value")
    middle = (F.col("value") + next_value) / 2
    # Rounding must not put the threshold on the upper value.
    threshold = F.when(middle < next_value, middle).otherwise(F.col("value"))
    sides = run.where(next_value.isNotNull()).join(totals, "node")
    l0, l1 = F.col("cum_n0") * F.lit(w0), F.col("cum_n1") * F.lit(w1)
    r0, r1 = (F.col("t0") - F.col("cum_n0")) * F.lit(w0), (F.col("t1") - F.col("cum_n1")) * F.lit(w1)
    whole = _purity(F.col("t0") * F.lit(w0), F.col("t1") * F.lit(w1))
    left = F.col("cum_n0") + F.col("cum_n1")
    allowed = (left >= min_leaf) & (F.col("t0") + F.col("t1") - left >= min_leaf)
    scored = sides.where(allowed).withColumn("gain", _purity(l0, l1) + _purity(r0, r1) - whole)
    best = F.min(F.struct((-F.col("gain")).alias("loss"), "feature", threshold.alias("threshold"), "cum_n0", "cum_n1"))
    return scored.where(F.col("gain") > F.lit(1e-12) * whole).groupBy("node").agg(best.alias("b")).select(
        "node", "b.feature", "b.threshold", "b.cum_n0", "b.cum_n1")


def bins(train: DataFrame, columns: Sequence[str], max_bins: int) -> list[np.ndarray]:
    """Thresholds of each column: between all its values while they are few, else exact quantiles."""
    cells = [F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    df = train.select(*cells)
    names = df.columns
    width = df.agg(*[F.approx_count_distinct(c).alias(c) for c in names]).first()
    # The estimate is a few percent off; columns near the limit are looked at exactly.
    near = [c for c in names if width[c] <= 2 * max_bins]
    sets = df.agg(*[F.sort_array(F.collect_set(c)).alias(c) for c in near]).first() if near else {}
    values = {c: np.array(sets[c], dtype=float) for c in near if len(sets[c]) <= max_bins}
    wide = [c for c in names if c not in values]
    cuts = {c: (v[:-1] + v[1:]) / 2 for c, v in values.items()}
    if wide:
        probs = [k / max_bins for k in range(1, max_bins)]
        found = exact_quantiles(df, wide, probs, widths={c: width[c] for c in wide})
        cuts |= {r["feature"]: np.unique(np.array(r["q"], dtype=float)) for r in found.collect()}
    return [cuts[c] for c in names]


def _values(train: DataFrame, columns: Sequence[str]) -> float:
    """About the distinct values of all columns together, rather too many than too few."""
    cells = [F.col(f"`{c}`").cast("double").alias(f"c{k}") for k, c in enumerate(columns)]
    found = train.select(*cells).agg(*[F.approx_count_distinct(f"c{k}") for k in range(len(columns))]).first()
    return ESTIMATE_SLACK * sum(found)


def grow(train: DataFrame, target: str, columns: Sequence[str], weights: tuple[float, float], max_depth: int | None,
         min_leaf: int, trees: int = 1, few: int | None = None, max_bins: int | None = None,
         id_col: str | None = None, seed: int = 42) -> Nodes:
    """Trees on ``train``; with ``trees`` above 1 each on its own draw of the rows.

    ``id_col`` tells rows apart in the draw; without it rows equal in all columns are drawn alike.
    ``few`` features are tried at a node. ``max_bins`` bounds the thresholds of a column; None tries all.
    """
    return _grow(train, target, columns, weights, max_depth, min_leaf, trees, few, max_bins, id_col, seed)[0]


def _grow(train: DataFrame, target: str, columns: Sequence[str], weights: tuple[float, float], max_depth: int | None,
          min_leaf: int, trees: int, few: int | None, max_bins: int | None, id_col: str | None, seed: int,
          hand_over: int | None = None) -> tuple[Nodes, "_Rest | None"]:
    """The trees and, with ``hand_over``, which of their leaves of at most so many rows are still to be grown."""
    width, sampled = len(columns), trees > 1
    cells = [F.col(f"`{c}`").cast("double") for c in columns]
    key = F.xxhash64(F.col(f"`{id_col}`")) if id_col else F.xxhash64(F.col(target), *cells)
    rows = train.where(F.col(target).isNotNull()).select(key.alias("h"), F.col(target).cast("int").alias("y"), F.array(*cells).alias("x"))
    cuts = bins(train, columns, max_bins) if max_bins else None
    cores = rows.sparkSession.sparkContext.defaultParallelism
    # Trees do much work for each row and pass.
    rows = rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows
    rows = stage(_coded(rows, cuts) if cuts else rows, "tree_rows")
    code = _code_type(cuts) if cuts else None
    span = max(map(len, cuts)) + 1 if cuts else 0
    # However many rows a node has, its counts are no more than the values of all columns.
    values = 0 if cuts else _values(train, columns)

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, _ in _pieces(batches, width, code):
            w = [bootstrap(ids, t, seed) if sampled else np.ones(len(y), dtype=np.int64) for t in range(trees)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(trees), pa.int32()), *[pa.array([int(v[y == c].sum()) for v in w], pa.int64()) for c in (0, 1)]],
                names=["tree", "n0", "n1"])

    first = {r["tree"]: r for r in rows.mapInArrow(roots, "tree int, n0 bigint, n1 bigint").groupBy("tree").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    count = lambda c: np.array([first[t][c] if t in first else 0 for t in range(trees)], dtype=np.int64)
    none = np.full(trees, -1, dtype=np.int32)
    nodes = Nodes(np.arange(trees, dtype=np.int32), none, np.zeros(trees), none, none, count("n0"), count("n1"))
    opened, depth = np.arange(trees), 0
    keys, handed, handed_keys = _root_keys(trees, seed), [np.arange(0)], [np.arange(0, dtype=np.uint64)]
    while max_depth is None or depth < max_depth:
        some = (nodes.n0[opened] > 0) & (nodes.n1[opened] > 0) & (nodes.n0[opened] + nodes.n1[opened] >= 2 * min_leaf)
        opened, keys = opened[some], keys[some] if hand_over is not None else keys
        if hand_over is not None:
            small = nodes.n0[opened] + nodes.n1[opened] <= hand_over
            handed.append(opened[small])
            handed_keys.append(keys[small])
            opened, keys = opened[~small], keys[~small]
        if not len(opened):
            break
        may = _node_features(opened, nodes.tree[opened], width, few or width, seed) if hand_over is None else _features_of(keys, width, few or width)
        if cuts and np.bincount(nodes.tree[opened]).max() * may.shape[1] * span * 2 <= TABLE_CELLS:
            tables = rows.mapInArrow(_table_counter(nodes, opened, may, cuts, depth, sampled, seed), "node int, counts binary")
            search = _table_searcher(opened, may, nodes.n0[opened], nodes.n1[opened], *weights, min_leaf, span)
            best = tables.repartition("node").sortWithinPartitions("node").mapInArrow(search, _BEST).toArrow()
            best = best.cast(_BEST_TYPES).sort_by("node")
            keys = _child_keys(keys[np.searchsorted(opened, best["node"].to_numpy())]) if hand_over is not None else keys
            nodes, opened = _split(nodes, best, cuts)
            depth += 1
            continue
        counted = rows.mapInArrow(
            _counter(nodes, opened, may, trees, cuts, width, sampled, seed), "node int, feature int, value double, n0 bigint, n1 bigint")
        summed = counted.groupBy("node", "feature", "value").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        wide = cuts is None and values > LOCAL_ROWS
        big = opened[nodes.n0[opened] + nodes.n1[opened] > LOCAL_ROWS] if wide else opened[:0]
        best = []
        if len(big):
            summed = stage(summed, "node_counts")
            totals = rows.sparkSession.createDataFrame(
                pa.table({"node": big.astype(np.int32), "t0": nodes.n0[big], "t1": nodes.n1[big]}))
            # So many rows are in each that these are few nodes.
            best.append(best_splits(summed.where(F.col("node").isin(big.tolist())), F.broadcast(totals), *weights, min_leaf).toArrow())
            summed = summed.where(~F.col("node").isin(big.tolist()))
        if len(big) < len(opened):
            search = _searcher(opened, nodes.n0[opened], nodes.n1[opened], *weights, min_leaf, cuts is None)
            whole_nodes = summed.repartition("node").sortWithinPartitions("node", "feature", "value")
            best.append(whole_nodes.mapInArrow(search, _BEST).toArrow())
        best = pa.concat_tables(t.cast(_BEST_TYPES) for t in best).sort_by("node")
        keys = _child_keys(keys[np.searchsorted(opened, best["node"].to_numpy())]) if hand_over is not None else keys
        nodes, opened = _split(nodes, best, cuts)
        depth += 1
    if hand_over is None:
        return nodes, None
    at, keys = np.concatenate(handed), np.concatenate(handed_keys)
    return nodes, _Rest(rows, cuts, at, keys, depth, few or width, min_leaf, sampled, seed)


def grow_deep(name: str, train: DataFrame, target: str, columns: Sequence[str], weights: tuple[float, float], min_leaf: int,
              trees: int, few: int | None, max_bins: int, id_col: str | None = None, seed: int = 42) -> "DeepForest":
    """As ``grow`` without a depth limit: nodes of at most ``HAND_OVER`` rows are grown to their end by one task each.

    Which features a node tries depends on its tree and path, so the same forest grows wherever a node is split.
    """
    top, rest = _grow(train, target, columns, weights, None, min_leaf, trees, few, max_bins, id_col, seed, HAND_OVER)
    return DeepForest(name, tuple(columns), top, rest, weights)


def _split(nodes: Nodes, best: pa.Table, cuts: list[np.ndarray] | None) -> tuple[Nodes, np.ndarray]:
    """``nodes`` with the chosen splits, and the new nodes."""
    at, feature, threshold, left0, left1 = (best[c].to_numpy() for c in best.column_names)
    if cuts:
        threshold = np.array([cuts[f][int(v)] for f, v in zip(feature.tolist(), threshold.tolist())])
    size, many = len(nodes.tree), len(at)
    lower = np.arange(size, size + 2 * many, 2, dtype=np.int32)
    out = replace(nodes, **{k: getattr(nodes, k).copy() for k in ("feature", "threshold", "lower", "upper")})
    out.feature[at], out.threshold[at], out.lower[at], out.upper[at] = feature, threshold, lower, lower + 1
    leaf = np.full(2 * many, -1, dtype=np.int32)
    pair = lambda l, r: np.stack([l, r], axis=1).ravel()
    grown = Nodes(
        np.concatenate([out.tree, np.repeat(out.tree[at], 2)]), np.concatenate([out.feature, leaf]),
        np.concatenate([out.threshold, np.zeros(2 * many)]), np.concatenate([out.lower, leaf]), np.concatenate([out.upper, leaf]),
        np.concatenate([out.n0, pair(left0, out.n0[at] - left0)]), np.concatenate([out.n1, pair(left1, out.n1[at] - left1)]),
    )
    return grown, np.arange(size, size + 2 * many)


@dataclass(frozen=True)
class _Rest:
    """Leaves ``at`` that are still to be grown, on the staged ``rows``."""

    rows: DataFrame
    cuts: list[np.ndarray]
    at: np.ndarray
    keys: np.ndarray
    depth: int
    few: int
    min_leaf: int
    sampled: bool
    seed: int


def _shipper(top: Nodes, rest: _Rest):
    """A job that brings the drawn rows of each handed node together: records of (node, weight, class and bins of some rows)."""
    place = np.full(len(top.tree), -1, dtype=np.int32)
    place[rest.at] = rest.at
    live = np.unique(top.tree[rest.at])
    (feature, limit, lower), code, width = top.coded(rest.cuts), _code_type(rest.cuts), len(rest.cuts)
    size = (width + 1) * np.dtype(code).itemsize
    depth, sampled, seed, most = rest.depth, rest.sampled, rest.seed, max(1, SHIP_BYTES // size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, y, x in _pieces(batches, width, code):
            flat, feature_at = np.ascontiguousarray(x.T).ravel(), feature * len(x)
            for t in live.tolist():
                w = bootstrap(ids, t, seed) if sampled else np.ones(len(x), dtype=np.int64)
                rows = np.flatnonzero(w)
                node = place.take(_walk(flat, rows, t, feature_at, limit, lower, depth))
                order = np.argsort(node, kind="stable")
                order = order[np.searchsorted(node, 0, sorter=order):]
                if not len(order):
                    continue
                rows, node = rows.take(order), node.take(order)
                sent = np.empty((len(rows), width + 1), dtype=code)
                sent[:, 0] = w[rows] * 2 + y[rows]
                sent[:, 1:] = x[rows]
                every = np.arange(len(rows))
                run_start = np.maximum.accumulate(np.where(np.append(True, node[1:] != node[:-1]), every, 0))
                start = np.flatnonzero((every - run_start) % most == 0)
                ends = (np.append(start, len(rows)) * size).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(sent)])
                yield pa.RecordBatch.from_arrays([pa.array(node[start]), data], names=["node", "data"])

    return run


def _counts_of(x: np.ndarray, width: int, rows: np.ndarray, at: np.ndarray, w: np.ndarray, y: np.ndarray, may: np.ndarray,
               span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ascending cells (node, feature tried, bin) that occur, and both classes in each; ``x`` holds the rows in turn."""
    few = may.shape[1]
    cells = len(may) * few * span
    kind = np.uint32 if cells * 32 <= 1 << 32 else np.uint64
    key = np.empty((few, len(rows)), dtype=kind)
    for k in range(few):
        key[k] = (at * few + k) * span + x.take(rows * width + may[:, k].take(at))
    if cells <= 4 * len(rows):
        both = [np.bincount(key.ravel(), np.tile(w * (y == c), few), cells).astype(np.int64) for c in (0, 1)]
        cell = np.flatnonzero(both[0] + both[1])
        return cell, both[0][cell], both[1][cell]
    # A weight is at most 12, so weight and class fit into five bits below the cell.
    key <<= kind(5)
    key += (w * 2 + y).astype(kind)
    key = np.sort(key.ravel())
    cell = key >> kind(5)
    start = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
    n = ((key >> kind(1)) & kind(15)).astype(np.int64)
    both = np.add.reduceat(n, start)
    ones = np.add.reduceat(n * (key & kind(1)).astype(np.int64), start)
    return cell[start].astype(np.int64), both - ones, ones


def _subtree(x: np.ndarray, w: np.ndarray, y: np.ndarray, key: int, few: int, span: int, w0: float, w1: float, min_leaf: int):
    """Levels of (rank of each split node in its level, feature, bin, gain, n0, n1 of both children in turn) of one node's subtree."""
    width = x.shape[1]
    flat, rows, at = x.ravel(), np.arange(len(x)), np.zeros(len(x), dtype=np.int64)
    keys = np.array([key], dtype=np.uint64)
    n0, n1 = np.array([w[y == 0].sum()]), np.array([w[y == 1].sum()])
    opened = np.zeros(1, dtype=np.int64)
    while len(keys):
        may = _features_of(keys, width, few)
        cell, c0, c1 = _counts_of(flat, width, rows, at, w, y, may, span)
        column = cell // span
        first = np.flatnonzero(np.append(True, column[1:] != column[:-1]))
        length = np.diff(np.append(first, len(cell)))
        upto = lambda c: np.cumsum(c) - np.repeat((np.cumsum(c) - c)[first], length)
        c0, c1, node = upto(c0), upto(c1), column // few
        left, all0, all1 = c0 + c1, n0[node], n1[node]
        use = np.flatnonzero((left >= min_leaf) & (all0 + all1 - left >= max(min_leaf, 1)))
        if not len(use):
            return
        node, c0, c1, all0, all1 = node[use], c0[use], c1[use], all0[use], all1[use]
        whole = _purity(all0 * w0, all1 * w1)
        gain = _purity(c0 * w0, c1 * w1) + _purity((all0 - c0) * w0, (all1 - c1) * w1) - whole
        # The first of the largest is that of the first feature and lowest bin.
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        most = np.repeat(np.maximum.reduceat(gain, first), np.diff(np.append(first, len(node))))
        best = np.flatnonzero(gain == most)
        best = best[np.append(True, node[best[1:]] != node[best[:-1]])]
        best = best[gain[best] > 1e-12 * whole[best]]
        if not len(best):
            return
        split, cell = node[best], cell[use[best]]
        feature, bin_ = may[split, (cell // span) % few], cell % span
        pair = lambda l, a: np.stack([l, a - l], axis=1).ravel()
        below0, below1 = pair(c0[best], all0[best]), pair(c1[best], all1[best])
        yield opened[split], feature, bin_, gain[best], below0, below1
        opened = np.flatnonzero((below0 > 0) & (below1 > 0) & (below0 + below1 >= 2 * min_leaf))
        # Rows go on to the open children only.
        lower = np.full(len(keys), -1, dtype=np.int64)
        lower[split] = 2 * np.arange(len(split))
        feature_of, bin_of = np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=np.int64)
        feature_of[split], bin_of[split] = feature, bin_
        child = lower.take(at)
        rank = np.full(2 * len(split) + 1, -1, dtype=np.int64)
        rank[opened] = np.arange(len(opened))
        child = rank.take(np.where(child < 0, 2 * len(split), child + (flat.take(rows * width + feature_of.take(at)) > bin_of.take(at))))
        go = np.flatnonzero(child >= 0)
        rows, at, w, y = rows.take(go), child.take(go), w.take(go), y.take(go)
        keys, n0, n1 = _child_keys(keys[split])[opened], below0[opened], below1[opened]


def _finisher(rest: _Rest, weights: tuple[float, float], whole: bool):
    """A job that grows handed nodes, whose records arrive sorted by node, to their end.

    It sends the sum of gains by feature for each, or with ``whole`` the nodes below, in the order of levels.
    """
    order = np.argsort(rest.at)
    at, keys, width, code = rest.at[order], rest.keys[order], len(rest.cuts), _code_type(rest.cuts)
    few, min_leaf, span = rest.few, rest.min_leaf, max(map(len, rest.cuts)) + 1

    def grown(node: int, held: list[bytes]) -> pa.RecordBatch:
        sent = np.frombuffer(b"".join(held), code).reshape(-1, width + 1)
        own, x = sent[:, 0].astype(np.int64), np.ascontiguousarray(sent[:, 1:])
        levels = _subtree(x, own >> 1, own & 1, int(keys[np.searchsorted(at, node)]), few, span, *weights, min_leaf)
        if not whole:
            sums = np.zeros((1, width))
            for _, feature, _, gain, _, _ in levels:
                sums[0] += np.bincount(feature, gain, width)
            return pa.RecordBatch.from_arrays([pa.array([node], pa.int32()), _binary(sums)], names=["node", "gains"])
        parts, size, before = [], 1, 0
        for split, feature, bin_, _, n0, n1 in levels:
            parts.append((before + split, feature, bin_, np.full(len(split), size) + 2 * np.arange(len(split)), n0[::2], n1[::2], n0[1::2], n1[1::2]))
            before, size = size, size + 2 * len(split)
        cols = [np.concatenate(c) if parts else np.empty(0, np.int64) for c in (zip(*parts) if parts else [()] * 8)]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(cols[0]), node, dtype=np.int32)), *[pa.array(c.astype(np.int64)) for c in cols]], names=_BELOW_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            node = batch.column(0).to_numpy()
            start = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else []
            for lo, hi in zip(start, [*start[1:], len(node)]):
                if last is not None and node[lo] != last:
                    yield grown(int(last), held)
                    held = []
                last = node[lo]
                held.append(bytes(_joined(batch.column(1).slice(lo, hi - lo))))
        if held:
            yield grown(int(last), held)

    return run


_BELOW_NAMES = ["node", "at", "feature", "bin", "lower", "l0", "l1", "u0", "u1"]


@dataclass(frozen=True)
class DeepForest:
    """A forest whose nodes below ``top`` are grown by tasks, again for each use; it has the interface of ``TreeModel``.

    ``importances`` keeps nothing on the driver that grows with the rows of a tree but one sum for each handed node and
    feature. ``nodes``, and with it scores and saving, brings all nodes to the driver.
    """

    name: str
    columns: tuple[str, ...]
    top: Nodes
    rest: _Rest
    weights: tuple[float, float]

    def _finished(self, whole: bool, schema: str) -> pa.Table:
        cores = self.rest.rows.sparkSession.sparkContext.defaultParallelism
        parts = max(cores, min(64 * cores, 2 * len(self.rest.at)))
        sent = self.rest.rows.mapInArrow(_shipper(self.top, self.rest), "node int, data binary")
        return sent.repartition(parts, "node").sortWithinPartitions("node").mapInArrow(
            _finisher(self.rest, self.weights, whole), schema).toArrow()

    @cached_property
    def nodes(self) -> Nodes:
        top, (tree, at, feature, bin_, lower, l0, l1, u0, u1) = self.top, (
            c.to_numpy() for c in self._finished(True, "node int, " + ", ".join(f"{c} bigint" for c in _BELOW_NAMES[1:])).sort_by(
                [("node", "ascending"), ("lower", "ascending")]).columns)
        # Nodes below a handed node come after all others, those of one subtree together.
        new = np.append(True, tree[1:] != tree[:-1]) if len(tree) else np.empty(0, bool)
        base = len(top.tree) + 2 * np.maximum.accumulate(np.where(new, np.arange(len(tree)), 0)) - 1
        own, low = np.where(at == 0, tree, base + at), base + lower
        many = 2 * len(tree)
        leaf, none = np.full(many, -1, dtype=np.int32), np.zeros(many)
        pair = lambda l, u: np.stack([l, u], axis=1).ravel()
        n = Nodes(
            np.concatenate([top.tree, np.repeat(top.tree[tree], 2)]), np.concatenate([top.feature, leaf]), np.concatenate([top.threshold, none]),
            np.concatenate([top.lower, leaf]), np.concatenate([top.upper, leaf]),
            np.concatenate([top.n0, pair(l0, u0)]), np.concatenate([top.n1, pair(l1, u1)]))
        n.feature[own], n.lower[own], n.upper[own] = feature, low, low + 1
        n.threshold[own] = [self.rest.cuts[f][b] for f, b in zip(feature.tolist(), bin_.tolist())]
        return n

    def _whole(self) -> "TreeModel":
        return TreeModel(self.name, self.columns, self.nodes, self.weights)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self._whole().probability(x)

    def predict(self, prepared: DataFrame) -> DataFrame:
        return self._whole().predict(prepared)

    def save(self, path: str) -> None:
        self._whole().save(path)

    def importances(self) -> np.ndarray:
        """As those of ``TreeModel``."""
        by_tree = TreeModel(self.name, self.columns, self.top, self.weights).gains()
        if len(self.rest.at):
            found = self._finished(False, "node int, gains binary").sort_by("node").combine_chunks()
            gains = np.frombuffer(b"".join(found["gains"].to_pylist())).reshape(-1, len(self.columns))
            np.add.at(by_tree, self.top.tree[found["node"].to_numpy()], gains)
        return _shares(by_tree)


def _shares(by_tree: np.ndarray) -> np.ndarray:
    """Mean over the trees of each feature's share of the gains."""
    total = by_tree.sum(axis=1, keepdims=True)
    mean = np.divide(by_tree, total, out=np.zeros_like(by_tree), where=total > 0).mean(axis=0)
    return mean / mean.sum() if mean.sum() > 0 else mean


@dataclass(frozen=True)
class TreeModel:
    """A fitted tree or forest with the interface of ``Classifier``."""

    name: str
    columns: tuple[str, ...]
    nodes: Nodes
    weights: tuple[float, float]

    @property
    def trees(self) -> int:
        return int(self.nodes.tree.max()) + 1

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The mean over the trees of the weighted share of class 1 in each row's leaf."""
        a, b = self.nodes.n0 * self.weights[0], self.nodes.n1 * self.weights[1]
        share = np.divide(b, a + b, out=np.full(len(a), 0.5), where=a + b > 0)
        out = np.empty(len(x))
        for lo in range(0, len(x), 4_096):
            out[lo:lo + 4_096] = share[self.nodes.leaves(x[lo:lo + 4_096], self.trees)].mean(axis=1)
        return out

    def predict(self, prepared: DataFrame) -> DataFrame:
        width = len(self.columns)

        @F.arrow_udf(T.DoubleType())
        def of(x: pa.Array) -> pa.Array:
            flat = x.flatten().to_numpy(zero_copy_only=False).astype(float)
            return pa.array(self.probability(flat.reshape(len(x), width)))

        p = of(F.array(*[F.col(f"`{c}`").cast("double") for c in self.columns]))
        return prepared.withColumn("p", p).withColumn("yhat", F.when(F.col("p") > 0.5, 1).otherwise(0))

    def importances(self) -> np.ndarray:
        """Share of each feature in the impurity that the splits take away, mean over the trees."""
        return _shares(self.gains())

    def gains(self) -> np.ndarray:
        """The impurity that the splits take away, by tree and feature."""
        n, (w0, w1) = self.nodes, self.weights
        a, b = n.n0 * w0, n.n1 * w1
        purity = np.divide(a * a + b * b, a + b, out=np.zeros(len(a)), where=a + b > 0)
        inner = np.flatnonzero(n.feature >= 0)
        gain = purity[n.lower[inner]] + purity[n.upper[inner]] - purity[inner]
        by_tree = np.zeros((self.trees, len(self.columns)))
        np.add.at(by_tree, (n.tree[inner], n.feature[inner]), gain)
        return by_tree

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        n = self.nodes
        table = pa.table({f: getattr(n, f) for f in ("tree", "feature", "threshold", "lower", "upper", "n0", "n1")}
                         | {"node": np.arange(len(n.tree), dtype=np.int64)})
        spark.createDataFrame(table).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        spark.createDataFrame([(self.name, list(self.columns), *map(float, self.weights))], _CARD).coalesce(1).write.mode(
            "overwrite").json(f"{path}/card")


def load_trees(spark: SparkSession, path: str) -> TreeModel:
    card = read_json(spark, f"{path}/card", T.StructType.fromDDL(_CARD)).first()
    t = spark.read.schema(f"{_NODES}, node bigint").parquet(f"{path}/nodes").toArrow().sort_by("node")
    nodes = Nodes(*[t[f].to_numpy() for f in ("tree", "feature", "threshold", "lower", "upper", "n0", "n1")])
    return TreeModel(card["name"], tuple(card["columns"]), nodes, (card["w0"], card["w1"]))
