import hashlib
import math

import pytest
from pyspark.sql import functions as F

from riskframe.operators import balance, prepare, split as S
from riskframe.spec import CLINICAL, FeatureSpec


def _cohort(spark, n=36):
    rows = [(
        i, "Male" if i % 2 else "Female", "Rural" if i % 3 else "Urban", "Rainy" if i % 5 < 3 else "Dry",
        float(i), None if i % 6 == 0 else 9.0 + i % 7, float(i % 5), *[(i >> b) & 1 for b in range(7)], i % 2,
    ) for i in range(1, n + 1)]
    cols = [CLINICAL.id, *CLINICAL.categorical, *CLINICAL.continuous, *CLINICAL.flags, CLINICAL.target]
    kinds = ["bigint", *["string"] * 3, *["double"] * 3, *["int"] * 8]
    return spark.createDataFrame(rows, ", ".join(f"{c} {k}" for c, k in zip(cols, kinds)))


@pytest.mark.parametrize("n", [36, 501])
def test_stratified_sizes_and_members(spark, n):
    df = _cohort(spark, n)
    out = S.apply_split(df, S.fit_split(df, CLINICAL.id, CLINICAL.target))
    rows = [(r[CLINICAL.id], r[CLINICAL.target], r["split"]) for r in out.collect()]
    assert sum(s == "test" for *_, s in rows) == math.ceil(n * 0.2)
    key = lambda i: hashlib.md5(f"{i}:42".encode()).hexdigest()
    for cls in (0, 1):
        members = sorted((i for i, y, _ in rows if y == cls), key=key)
        k = sum(1 for _, y, s in rows if y == cls and s == "test")
        assert {i for i, y, s in rows if y == cls and s == "test"} == set(members[:k])


def test_split_keeps_copies_of_an_id_together(spark):
    df = spark.createDataFrame([(7, 0)] * 60 + [(i, 0) for i in range(100, 220)], "id int, y int")
    out = S.apply_split(df, S.fit_split(df, "id", "y"))
    assert out.where("id = 7").select("split").distinct().count() == 1


def test_quota_matches_published_sizes():
    assert sum(S.stratified_quota({0: 5511, 1: 4481}, 0.2).values()) == 1999
    assert sum(S.stratified_quota({0: 600, 1: 1022}, 0.2).values()) == 325


def test_fold_sizes_differ_by_at_most_one(spark):
    df = _cohort(spark, 103)
    folds = S.apply_folds(df, S.fit_folds(df, CLINICAL.id, CLINICAL.target, 5))
    for cls in (0, 1):
        sizes = [r["count"] for r in folds.where(F.col(CLINICAL.target) == cls).groupBy("fold").count().collect()]
        assert len(sizes) == 5 and max(sizes) - min(sizes) <= 1


def test_fit_uses_training_rows_only(spark):
    df = _cohort(spark)
    marked = S.apply_split(df, S.fit_split(df, CLINICAL.id, CLINICAL.target))
    clean_fit = prepare.fit_prep(marked.where("split = 'train'"), CLINICAL)
    poisoned = marked.withColumns({
        c: F.when(F.col("split") == "test", F.lit(1e9)).otherwise(F.col(c)) for c in CLINICAL.continuous
    })
    assert prepare.fit_prep(poisoned.where("split = 'train'"), CLINICAL) == clean_fit


def test_transform_has_no_nulls_and_contract_order(spark):
    df = _cohort(spark)
    prep = prepare.fit_prep(df, CLINICAL)
    assert prep.order == [
        *CLINICAL.numeric, "sex_Female", "sex_Male", "residence_Rural", "residence_Urban", "season_Dry", "season_Rainy"]
    out = prep.transform(df).select(*prep.order)
    assert out.where(" OR ".join(f"{c} IS NULL" for c in prep.order)).count() == 0
    stats = out.agg(*[F.avg(c).alias(c) for c in CLINICAL.numeric]).first()
    assert all(abs(stats[c]) < 1e-9 for c in CLINICAL.numeric)


def test_derived_scaler_moments_equal_direct_ones(spark):
    df = _cohort(spark)
    prep = prepare.fit_prep(df, CLINICAL)
    direct = {r["feature"]: r for r in prepare.scaler_stats(prep.impute(df), CLINICAL.numeric).collect()}
    for c in CLINICAL.numeric:
        assert prep.mean[c] == pytest.approx(direct[c]["mean"], abs=1e-12)
        assert prep.std[c] == pytest.approx(direct[c]["std"], abs=1e-12)


def test_constant_column_scales_by_one_and_empty_category_is_unknown(spark):
    df = _cohort(spark).withColumn("fever_days", F.lit(2.0)).withColumn("sex", F.lit(None).cast("string"))
    prep = prepare.fit_prep(df, CLINICAL)
    assert prep.std["fever_days"] == 1.0
    assert prep.defaults["sex"] == "unknown" and prep.categories["sex"] == ("unknown",)


def test_unseen_category_is_all_zeros(spark):
    df = _cohort(spark)
    prep = prepare.fit_prep(df, CLINICAL)
    row = prep.onehot(df.limit(1).withColumn("residence", F.lit("PeriUrban"))).first()
    assert (row["residence_Rural"], row["residence_Urban"]) == (0.0, 0.0)


def test_mode_tie_takes_smallest(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    assert prepare.modes(df, ["v"]).first()["mode"] == "a"


def test_prep_round_trip(spark, tmp_path):
    prep = prepare.fit_prep(_cohort(spark), CLINICAL)
    prep.save(spark, str(tmp_path / "prep"))
    assert prepare.load_prep(spark, str(tmp_path / "prep"), CLINICAL) == prep


def test_too_many_categories_is_refused(spark):
    df = spark.range(3000).select(F.col("id").cast("string").alias("v"))
    with pytest.raises(ValueError, match="onehot_long"):
        prepare.categories(df, ["v"])


def test_oversample_equalises(spark):
    df = spark.createDataFrame([(i, int(i % 7 == 0)) for i in range(100)], "id int, y int")
    counts = {r["y"]: r["count"] for r in balance.oversample(df, "id", "y").groupBy("y").count().collect()}
    assert counts[0] == counts[1] == 85


def test_synthetic_rows_fill_the_gap_between_near_neighbours(spark):
    spec = FeatureSpec(id="id", target="y", continuous=("a", "b"))
    rows = [(i, float(i % 10), float(i // 10), 0) for i in range(120)] + [
        (1000 + i, 50.0 * (i % 2) + 0.1 * i, 0.0, 1) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, a double, b double, y int")
    made = balance.synthesise_minority(df, spec, ["a", "b"]).collect()
    assert len(made) == 90
    for r in made:  # two clusters at 0-3 and 50-53: a point in between would join strangers
        assert r["a"] < 4 or 49 < r["a"] < 54
