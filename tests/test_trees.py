"""Trees and forests by keyed counts against brute force, and on other partitionings."""

from dataclasses import fields

import numpy as np
import pytest

from riskframe.operators import learn, trees
from riskframe.config import ForestConfig, TreeConfig

COLUMNS = ["a", "b", "c", "d"]
WEIGHTS = (1.0, 1.3)


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(size=(600, 4)), 1)
    x[:, 3] = rng.integers(0, 2, 600)
    x[:, 2] = x[:, 0]  # equal columns: ties go to the first
    y = ((x[:, 0] + x[:, 1] * x[:, 3] + rng.normal(size=600) * 0.5) > 0).astype(int)
    rows = [(i, int(y[i]), *map(float, x[i])) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double, c double, d double").repartition(5).cache()
    return df, x, y


def purity(a, b):
    a, b = a * WEIGHTS[0], b * WEIGHTS[1]
    return (a * a + b * b) / (a + b)


def brute(x, y, w, rows, depth, leaf):
    """(feature, threshold, lower, upper) or (n0, n1)."""
    n0, n1 = int(w[rows][y[rows] == 0].sum()), int(w[rows][y[rows] == 1].sum())
    if not depth or not n0 or not n1 or n0 + n1 < 2 * leaf:
        return n0, n1
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[rows, f])
        for low, high in zip(values, values[1:]):
            side = rows[x[rows, f] <= low]
            a0, a1 = int(w[side][y[side] == 0].sum()), int(w[side][y[side] == 1].sum())
            if a0 + a1 < leaf or n0 + n1 - a0 - a1 < leaf:
                continue
            gain = purity(a0, a1) + purity(n0 - a0, n1 - a1) - purity(n0, n1)
            if gain > 1e-12 * purity(n0, n1) and (best is None or (-gain, f, (low + high) / 2) < best):
                best = (-gain, f, (low + high) / 2)
    if best is None:
        return n0, n1
    _, f, t = best
    return f, t, brute(x, y, w, rows[x[rows, f] <= t], depth - 1, leaf), brute(x, y, w, rows[x[rows, f] > t], depth - 1, leaf)


def nested(n, at):
    if n.feature[at] < 0:
        return int(n.n0[at]), int(n.n1[at])
    return int(n.feature[at]), float(n.threshold[at]), nested(n, n.lower[at]), nested(n, n.upper[at])


def shape(tree):
    """Without thresholds: bins lie between the values of all rows, not only of those in the node."""
    return tree if len(tree) == 2 else (tree[0], shape(tree[2]), shape(tree[3]))


def same(a, b):
    return all((getattr(a, f.name) == getattr(b, f.name)).all() for f in fields(trees.Nodes))


@pytest.mark.parametrize("local_rows", [200_000, 150])
def test_one_tree_is_exact(data, monkeypatch, local_rows):
    """Also where nodes above 150 rows go through key ranges."""
    df, x, y = data
    monkeypatch.setattr(trees, "LOCAL_ROWS", local_rows)
    nodes = trees.grow(df, "y", COLUMNS, WEIGHTS, 4, 3)
    assert nested(nodes, 0) == brute(x, y, np.ones(600, dtype=int), np.arange(600), 4, 3)


def test_forest_trees_are_exact_on_their_draws_and_alike_on_any_partitioning(data, spark):
    df, x, y = data
    grow = lambda rows: trees.grow(rows, "y", COLUMNS, WEIGHTS, 3, 3, trees=5, max_bins=128, id_col="id")
    one = grow(df)
    hashes = df.selectExpr("id", "xxhash64(id) AS h").orderBy("id").toPandas()["h"].to_numpy().view(np.uint64)
    for t in range(5):
        w = trees.bootstrap(hashes, t, 42)
        assert shape(nested(one, t)) == shape(brute(x, y, w, np.flatnonzero(w), 3, 3))
    for parts in (1, 4, 8):
        assert same(one, grow(df.repartition(parts)))


def test_draws_have_mean_and_variance_one():
    w = trees.bootstrap(np.arange(200_000, dtype=np.uint64), 3, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    other = trees.bootstrap(np.arange(200_000, dtype=np.uint64), 4, 42)
    assert abs(np.corrcoef(w, other)[0, 1]) < 0.01


def test_few_bins_bound_the_thresholds(data):
    df, x, _ = data
    cuts = trees.bins(df, COLUMNS, 8)
    assert [len(c) <= 8 for c in cuts] == [True] * 4 and cuts[3].tolist() == [0.5]
    nodes = trees.grow(df, "y", COLUMNS, WEIGHTS, 5, 3, max_bins=8)
    for f in range(4):
        assert set(nodes.threshold[nodes.feature == f]) <= set(cuts[f])


def test_model_scores_saves_and_explains(data, spark, tmp_path):
    df, x, y = data
    for model in (learn.fit_tree(df, "y", COLUMNS, TreeConfig(max_depth=None, min_leaf=1)),
                  learn.fit_forest(df, "y", COLUMNS, ForestConfig(trees=20, max_depth=6), "id")):
        model.save(str(tmp_path / model.name))
        again = trees.load_trees(spark, str(tmp_path / model.name))
        a, b = (m.predict(df).select("id", "p", "yhat", "y").orderBy("id").toPandas() for m in (model, again))
        assert (a == b).all().all() and a["p"].between(0, 1).all()
        assert ((a["p"] > 0.5) == (a["yhat"] == 1)).all() and (a["yhat"] == a["y"]).mean() > 0.85
        assert model.importances().sum() == pytest.approx(1.0)


def test_one_class_and_no_rows(data, spark):
    df, _, _ = data
    for rows in (df.where("y = 1"), df.where("false")):
        model = learn.fit_tree(rows, "y", COLUMNS)
        assert len(model.nodes.tree) == 1 and model.importances().sum() == 0
        assert {r["p"] for r in model.predict(df).select("p").collect()} == {1.0 if rows.count() else 0.5}
    with pytest.raises(Exception, match="without missing values"):
        learn.fit_tree(df.selectExpr("y", "CAST(NULL AS double) AS a", "b", "c", "d"), "y", COLUMNS)


def test_tables_and_sparse_counts_grow_the_same_forest(data, monkeypatch):
    """One record a node and piece, whatever its rows; levels with too many nodes send sparse counts."""
    df, *_ = data
    grow = lambda: trees.grow(df, "y", COLUMNS, WEIGHTS, 5, 2, trees=4, few=2, max_bins=32, id_col="id")
    whole = grow()
    monkeypatch.setattr(trees, "TABLE_ROWS", 50)
    monkeypatch.setattr(trees, "BLOCK_ROWS", 16)
    monkeypatch.setattr(trees, "SEARCH_NODES", 3)
    assert same(whole, grow())
    monkeypatch.setattr(trees, "TABLE_CELLS", 4 * 2 * 33 * 2)
    assert same(whole, grow())


def test_a_task_sends_one_record_for_each_open_node(data):
    import pyarrow as pa

    _, x, y = data
    cuts = [np.arange(-2.05, 2.1, 0.1)] * 4
    codes = np.stack([np.searchsorted(c, x[:, k]) for k, c in enumerate(cuts)], axis=1).astype("u1")
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(600)), pa.array(y.astype(np.int32)), trees._binary(codes)], names=["h", "y", "x"])
    none = np.full(1, -1, dtype=np.int32)
    root = trees.Nodes(np.zeros(1, np.int32), none, np.zeros(1), none, none, np.array([(y == 0).sum()]), np.array([y.sum()]))
    run = trees._table_counter(root, np.arange(1), np.arange(4)[None, :], cuts, 0, False, 42)
    (batch,) = run(iter([rows.slice(0, 100), rows.slice(100, 500)]))
    counts = np.frombuffer(batch.column(1)[0].as_py(), np.int32).reshape(4, len(cuts[0]) + 1, 2)
    assert batch.num_rows == 1 and (counts.sum(axis=(1, 2)) == 600).all() and (counts.sum(axis=1)[:, 1] == y.sum()).all()


def test_nodes_of_many_rows_and_few_values_need_no_key_ranges(data, monkeypatch):
    df, x, y = data
    monkeypatch.setattr(trees, "LOCAL_ROWS", 500)

    def no_ranges(*_):
        raise AssertionError("few values fit into a task")

    monkeypatch.setattr(trees, "best_splits", no_ranges)
    nodes = trees.grow(df, "y", COLUMNS, WEIGHTS, 4, 3)
    assert nested(nodes, 0) == brute(x, y, np.ones(600, dtype=int), np.arange(600), 4, 3)


def test_a_piece_makes_no_object_for_each_row():
    import tracemalloc

    import pyarrow as pa

    codes = np.arange(200_000 * 3, dtype=np.uint32).astype("u1").reshape(-1, 3)
    rows = pa.RecordBatch.from_arrays(
        [pa.array(np.arange(200_000)), pa.array(np.ones(200_000, np.int32)), trees._binary(codes)], names=["h", "y", "x"])
    tracemalloc.start()
    (ids, y, x), = trees._pieces(iter([rows.slice(0, 7), rows.slice(7)]), 3, "u1", 200_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (x == codes).all() and len(ids) == len(y) == 200_000
    assert most < 8 << 20


def test_subtrees_grown_by_tasks_equal_level_by_level(data, spark, monkeypatch):
    """The same forest whether tasks or levels grow its nodes; importances bring no nodes to the driver."""
    df, x, y = data
    forest = lambda rows: trees.grow_deep("f", rows, "y", COLUMNS, WEIGHTS, 1, 6, 2, 32, "id")
    made = []
    for hand_over in (0, 40, 1 << 19):
        monkeypatch.setattr(trees, "HAND_OVER", hand_over)
        made.append((forest(df), forest(df.repartition(3))))
    (one, _), _, (whole, _) = made
    assert len(one.rest.at) == 0 and len(whole.top.tree) == 6
    monkeypatch.setattr(trees, "SHIP_BYTES", 11)
    want = [nested(one.top, t) for t in range(6)]
    assert all(len(str(w)) > 200 for w in want)
    for a in (f for both in made for f in both):
        assert a.importances() == pytest.approx(one.importances(), abs=1e-12)
        assert "nodes" not in vars(a)
        assert [nested(a.nodes, t) for t in range(6)] == want
        assert a.importances() == pytest.approx(trees.TreeModel("f", tuple(COLUMNS), a.nodes, WEIGHTS).importances(), abs=1e-12)
    none = trees.grow_deep("f", df.where("y = 1"), "y", COLUMNS, WEIGHTS, 1, 2, 2, 32, "id")
    assert none.importances().sum() == 0 and len(none.nodes.tree) == 2
