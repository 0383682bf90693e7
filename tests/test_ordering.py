"""Scale primitives against brute force, with several key ranges and hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.functions import ordering
from riskframe.functions.ordering import previous_value, running_sums, with_ranges
from riskframe.functions.quantiles import exact_quantiles


def _hot_values(n, seed):
    """A third of all rows share one value; the rest spread over many magnitudes."""
    rng = random.Random(seed)
    return [7.25 if i % 3 == 0 else rng.gauss(0, 1) * 10 ** rng.randint(-3, 6) for i in range(n)]


@pytest.mark.parametrize("per_range, most", [(None, None), (40, None), (10, 8)])
def test_running_sums(spark, monkeypatch, per_range, most):
    if most:
        monkeypatch.setattr(ordering, "MAX_RANGES", most)      # ranges within coarse ranges
    rng = random.Random(1)
    rows = [(g, k, rng.randint(0, 9)) for g in ("a", "b") for k in rng.sample(range(10_000), 700)]
    df = spark.createDataFrame(rows, "g string, k int, n int")
    got = {(r["g"], r["k"]): (r["cum_n"], r["next"]) for r in running_sums(df, ["g"], "k", ["n"], per_range).collect()}
    for g in ("a", "b"):
        total = 0
        ordered = sorted((k, n) for x, k, n in rows if x == g)
        for i, (k, n) in enumerate(ordered):
            total += n
            cum, nxt = got[g, k]
            assert cum == total
            assert (nxt is None) if i + 1 == len(ordered) else (tuple(nxt) == ordered[i + 1])
    assert len(got) == len(rows)


@pytest.mark.parametrize("most", [None, 4])
def test_running_sums_over_text_without_groups(spark, monkeypatch, most):
    if most:
        monkeypatch.setattr(ordering, "MAX_RANGES", most)
    words = [f"w{i:05d}" for i in range(500)]
    df = spark.createDataFrame([(w, 1) for w in words], "w string, one int")
    got = {r["w"]: r["cum_one"] for r in running_sums(df, [], "w", ["one"], 30).collect()}
    assert got == {w: i + 1 for i, w in enumerate(words)}


@pytest.mark.parametrize("per_range, most", [(None, None), (25, None), (10, 8)])
def test_previous_value(spark, monkeypatch, per_range, most):
    if most:
        monkeypatch.setattr(ordering, "MAX_RANGES", most)
    rng = random.Random(2)
    rows = [(rng.choice("xy"), i, None if rng.random() < 0.2 else rng.randint(0, 5)) for i in range(600)]
    df = spark.createDataFrame(rows, "g string, k int, v int")
    got = {(r["g"], r["k"]): r["p"] for r in previous_value(df, ["g"], "k", "v", "p", per_range).collect()}
    last = {}
    for g, k, v in rows:
        assert got[g, k] == last.get(g)
        last[g] = v


def test_ranges_keep_their_size_at_any_number_of_rows(spark, monkeypatch):
    """Forced small limits: many more ranges than one split table may hold, none far above its size."""
    monkeypatch.setattr(ordering, "MAX_RANGES", 16)
    df = spark.range(20_000).select((F.col("id") * 7 % 20_011).alias("k"))
    placed, names = with_ranges(df, [], "k", 20_000, 50)
    assert names == ["_coarse", "_range"]
    sizes = [r["n"] for r in placed.groupBy(*names).agg(F.count("*").alias("n")).collect()]
    assert sum(sizes) == 20_000 and len(sizes) > 300 and max(sizes) < 50 * 12
    spans = placed.groupBy(*names).agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy(*names).collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(spans, spans[1:]))


@pytest.mark.parametrize("limit", [50_000, 0])
@pytest.mark.parametrize("by", [(), ("g",)])
def test_exact_quantiles(spark, limit, by):
    values = _hot_values(4_000, 3)
    rows = [(i % 2, v, None if i % 7 == 0 else float(i % 5)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = {
        (*[r[c] for c in by], r["feature"]): r["q"]
        for r in exact_quantiles(df, ["a", "b"], probs, by, distinct_limit=limit).collect()
    }
    for g in (0, 1) if by else (None,):
        for at, name in ((1, "a"), (2, "b")):
            xs = [r[at] for r in rows if r[at] is not None and (g is None or r[0] == g)]
            key = (name,) if g is None else (g, name)
            np.testing.assert_allclose(got[key], np.quantile(xs, probs), rtol=1e-12)


def test_quantile_brackets_that_miss_fall_back(spark, monkeypatch):
    from riskframe.functions import quantiles

    monkeypatch.setattr(quantiles, "ACCURACY", 10)  # coarse enough to miss ranks
    xs = _hot_values(3_000, 4)
    df = spark.createDataFrame([(x,) for x in xs], "a double")
    got = exact_quantiles(df, ["a"], [0.05, 0.5, 0.93], distinct_limit=0).first()["q"]
    np.testing.assert_allclose(got, np.quantile(xs, [0.05, 0.5, 0.93]), rtol=1e-12)


def test_quantiles_over_key_ranges_and_empty_groups(spark, monkeypatch):
    from riskframe.functions import quantiles

    monkeypatch.setattr(quantiles, "ROWS_PER_RANGE", 0)    # ranked over key ranges, not in one window
    xs = _hot_values(2_000, 6)
    rows = [(i % 2, x, None if i % 2 else x / 2) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "g int, a double, b double")
    got = {(r["g"], r["feature"]): r["q"] for r in exact_quantiles(df, ["a", "b"], [0.1, 0.5], ["g"], distinct_limit=0).collect()}
    assert set(got) == {(0, "a"), (1, "a"), (0, "b")}       # no value, no row
    np.testing.assert_allclose(got[0, "b"], np.quantile([r[2] for r in rows if r[2] is not None], [0.1, 0.5]), rtol=1e-12)
    assert exact_quantiles(df.limit(0), ["a"], [0.5], distinct_limit=-1).collect() == []


def test_staging_never_uses_local_folder_on_a_cluster(spark, monkeypatch):
    from riskframe.functions import staging

    class Context:
        master, applicationId = "yarn", "app"

        def getConf(self):
            return type("C", (), {"get": staticmethod(lambda k: None)})

    class Session:
        sparkContext = Context()
        conf = type("R", (), {"get": staticmethod(lambda k, d=None: d)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        staging.shared_dir(Session())
