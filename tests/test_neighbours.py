"""Neighbour search by hashing: recall against all pairs, hot cells, ties and small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import neighbours
from riskframe.operators.balance import synthesise_minority
from riskframe.sources.cohort import labelled_documents
from riskframe.spec import TEXT_QUALITY

COLS = ["x", "y", "z"]


def table(spark, v):
    rows = [(i, *map(float, p)) for i, p in enumerate(v)]
    return spark.createDataFrame(rows, "id long, x double, y double, z double").repartition(4).cache()


@pytest.fixture(scope="module")
def clouds(spark):
    """Dense and thin clouds with scales far apart, and a third of all rows in one place."""
    rng = np.random.default_rng(5)
    v = np.concatenate([
        rng.normal(0, 1, (1_500, 3)), rng.normal([50, 0, 0], 0.01, (500, 3)), rng.uniform(-100, 100, (1_000, 3)),
        np.repeat([[7.0, 7.0, 7.0]], 1_500, axis=0),
    ])
    return table(spark, v)


def test_recall_of_five_nearest(clouds):
    asked = clouds.where("id % 20 = 0")
    found = neighbours.nearest_whole(clouds, COLS, 5, asked, cell_rows=256)
    assert found.count() == asked.count()
    assert neighbours.recall(found, neighbours.exact_nearest(clouds, COLS, 5, asked)) >= 0.9


def test_distances_are_exact_and_no_row_is_its_own_neighbour(clouds):
    rows = neighbours.nearest(clouds.where("id < 300"), COLS, 4).collect()
    at = {r["id"]: np.array([r[c] for c in COLS]) for r in clouds.where("id < 300").collect()}
    for r in rows:
        assert [n["d"] for n in r["near"]] == sorted(n["d"] for n in r["near"])
        assert len({n["id"] for n in r["near"]}) == len(r["near"]) <= 4
        for n in r["near"]:
            assert n["id"] != r["q"] and n["d"] == pytest.approx(((at[r["q"]] - at[n["id"]]) ** 2).sum())
            assert n["v"] == list(at[n["id"]])


def test_split_cells_change_nothing(clouds):
    some = clouds.where("id % 3 = 0")
    width = neighbours.cell_width(some, COLS)
    keyed = lambda rows: {n: neighbours.nearest(some, COLS, 3, width=width, cell_rows=n) for n in rows}
    a, b = [{r["q"]: [(n["d"], n["id"]) for n in r["near"]] for r in df.collect()} for df in keyed((50_000, 40)).values()]
    assert a == b


def test_small_tables(spark):
    one = table(spark, [[1, 2, 3]])
    assert neighbours.nearest_whole(one, COLS, 5).count() == 0
    assert neighbours.nearest_whole(one.where("false"), COLS, 5).count() == 0
    far = neighbours.nearest_whole(table(spark, [[0, 0, 0], [1e6, 0, 0], [0, 1e9, 0]]), COLS, 5).collect()
    assert sorted((r["q"], [n["id"] for n in r["near"]]) for r in far) == [(0, [1, 2]), (1, [0, 2]), (2, [0, 1])]


def test_synthetic_rows_add_up_and_lie_between_near_rows(spark, sf):
    docs = labelled_documents(spark, sf)
    cols = ["n_chars", "n_words", "digit_share"]
    counts = sorted(r["count"] for r in docs.groupBy("quality").count().collect())
    made = synthesise_minority(docs, TEXT_QUALITY, cols).collect()
    assert len(made) == counts[-1] - counts[0]
    assert len({(r["doc_id"], r["copy"]) for r in made}) == len(made)
    minor = {r["doc_id"]: np.array([float(r[c]) for c in cols]) for r in docs.join(
        docs.groupBy("quality").count().orderBy("count").limit(1).select("quality"), "quality").collect()}
    v = np.array(list(minor.values()))
    for r in made[:200]:
        own = minor[r["doc_id"]]
        away = np.sort(((v - own) ** 2).sum(axis=1))
        assert ((np.array([r[c] for c in cols]) - own) ** 2).sum() <= away[min(5, len(away) - 1)] * 1.0001 + 1e-9
