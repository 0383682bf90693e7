"""Malformed CSV records, wide correlation matrices, rejected labels and the retraining counts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskframe.operators import profile
from riskframe.sources import readers
from riskframe.streaming import scoring as streaming


def test_records_with_other_field_counts_are_kept_apart(spark, tmp_path):
    (tmp_path / "in.csv").write_text('id,sex,note\n1,Male,"a, ""b"""\n2,Female\n3,Male,4,surplus\n4,,\n\n5,Female,x\n')
    good, rejects = readers.read_csv_checked(spark, str(tmp_path / "in.csv"))
    assert good.columns == ["id", "sex", "note"]
    assert sorted(tuple(r) for r in good.collect()) == [("1", "Male", 'a, "b"'), ("4", None, None), ("5", "Female", "x")]
    assert rejects.count() == 2
    assert sorted(r["record"] for r in rejects.collect()) == ["2,Female", "3,Male,4,surplus"]
    (tmp_path / "other.csv").write_text("_record\na\n")
    good, rejects = readers.read_csv_checked(spark, str(tmp_path / "other.csv"))
    assert good.columns == ["_record"] and good.count() == 1 and rejects.count() == 0
    with pytest.raises(FileNotFoundError):
        readers.read_csv_checked(spark, str(tmp_path / "none"))


@pytest.mark.parametrize("wide", [70, 200])
def test_wide_correlations_with_nulls(spark, wide):
    rng = np.random.default_rng(wide)
    x = rng.normal(size=(120, wide)) * rng.uniform(0.1, 1e4, wide) + rng.uniform(-1e5, 1e5, wide)
    x[:, 1] = x[:, 0] * 2 + rng.normal(size=120) * 0.1
    x[rng.random(x.shape) < 0.1] = np.nan
    x[:, 5], x[:, 6] = 7.0, np.nan
    names = [f"c{i}" for i in range(wide)]
    df = spark.createDataFrame([[None if np.isnan(v) else float(v) for v in r] for r in x], ", ".join(f"{n} double" for n in names))
    got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df.repartition(3), names).collect()}
    assert len(got) == wide * wide
    for i in range(0, wide, 7):
        for j in range(wide):
            both = ~np.isnan(x[:, i]) & ~np.isnan(x[:, j])
            if i == j:
                want = 1.0
            elif both.sum() < 2 or np.ptp(x[both, i]) == 0 or np.ptp(x[both, j]) == 0:
                want = None
            else:
                want = np.corrcoef(x[both, i], x[both, j])[0, 1]
            assert got[names[i], names[j]] == (want if want is None else pytest.approx(want, abs=1e-8)), (i, j)


def test_both_forms_of_the_correlation_agree(spark, monkeypatch):
    df = spark.range(500).selectExpr(
        "double(id) AS a", "CASE WHEN id % 9 != 0 THEN double(id * id % 101) END AS b", "CASE WHEN id % 4 != 1 THEN sin(id) END AS c", "1D AS d")
    form = lambda: {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, ["a", "b", "c", "d"]).collect()}
    narrow = form()
    monkeypatch.setattr(profile, "WIDE", 1)
    assert form() == {k: v if v is None else pytest.approx(v, abs=1e-12) for k, v in narrow.items()}


def test_retraining_counts_each_batch_once(spark, tmp_path, monkeypatch):
    """Batches are counted from their own folder; the log as a whole is read by the job alone."""
    seen = []
    schema = spark.range(1).schema
    for k, n in enumerate((40, 70, 30)):
        spark.range(n).write.mode("append").parquet(str(tmp_path / "in"))
        streaming.retrain_when(
            streaming.read_stream(spark, str(tmp_path / "in"), schema), str(tmp_path / "log"), str(tmp_path / "state"), 100,
            lambda rows: seen.append(rows.count())).awaitTermination()
    assert seen == [110]
    counts = readers.read_json(spark, str(tmp_path / "log/counts"), streaming._COUNT)
    assert counts.agg(F.sum("n"), F.count("*")).first()[:] == (140, 3)
