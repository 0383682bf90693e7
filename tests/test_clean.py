import pytest
from pyspark.sql import functions as F

from riskframe.config import CleanConfig
from riskframe.functions import columns as C
from riskframe.operators import clean as ops, quality
from riskframe.operators.score import input_report
from riskframe.sources import readers, sinks
from riskframe.spec import CLINICAL

RAW = [
    ("P1", 30, 360, "Male", "Rural", "Rainy", True, "Positive", "10.2", 3, True, True, True, False, False, True, 10000),
    ("P2", 45, 540, "Female", "Urban", "Dry", False, "Negative", "13.5", 0, False, False, True, False, False, False, 0),
    ("P3", 60, 720, "Male", "Rural", "Rainy", True, " positive ", "n/a", 2, True, False, False, True, True, None, 500),
    ("P4", 25, 300, "Female", "Urban", "Dry", False, "0", None, 0, False, False, False, False, False, False, 0),
]
NAMES = (
    "Patient_ID Age_Years Age_Months Sex Residence Season Uses_Mosquito_Net Case_Status Hemoglobin_g_dl "
    "Fever_Days Has_Fever Has_Chills Has_Headache Has_Vomiting Has_Diarrhea Has_Weakness Parasitemia_Count"
).split()


@pytest.fixture
def raw(spark):
    types = ["string", "int", "int"] + ["string"] * 3 + ["boolean", "string", "string", "int"] + ["boolean"] * 6 + ["int"]
    return spark.createDataFrame(RAW, ", ".join(f"{n} {t}" for n, t in zip(NAMES, types)))


@pytest.mark.parametrize("header,want", [
    ("Age_Years", "age_years"), ("  Has_Chills  ", "has_chills"), ("Hemoglobin(Hb%)", "hemoglobin_hb"),
    ("HTC/PCV(%)", "htc_pcv"), ("Patient ID", "patient_id"), ("__x__", "x"),
])
def test_headers(header, want):
    assert C.normalise_name(header) == want


def test_header_collision_raises(spark):
    with pytest.raises(ValueError, match="collide"):
        ops.normalise_headers(spark.createDataFrame([(1, 2)], "`a b` int, `A-B` int"))


def test_clean_drops_leakage_and_encodes(raw):
    out = ops.clean(raw, CLINICAL)
    assert set(out.columns) == {CLINICAL.id, CLINICAL.target, *CLINICAL.features}
    rows = {r[CLINICAL.id]: r for r in out.collect()}
    assert [rows[f"P{i}"][CLINICAL.target] for i in (1, 2, 3, 4)] == [1, 0, 1, 0]
    assert rows["P3"]["hemoglobin_g_dl"] is None and rows["P1"]["hemoglobin_g_dl"] == 10.2
    assert rows["P3"]["has_weakness"] is None and rows["P1"]["has_fever"] == 1


def test_flag_modes(spark):
    df = spark.createDataFrame([("True",), (" true",), ("1",), ("yes",), ("no",), ("?",), (None,)], "v string")
    got = [tuple(r) for r in df.select(C.flag_strict(F.col("v")), C.flag_lenient(F.col("v"))).collect()]
    assert got == [(1, 1), (1, 1), (0, 1), (0, 1), (0, 0), (0, None), (0, None)]


def test_unknown_label_raises_or_is_quarantined(raw):
    bad = raw.withColumn("Case_Status", F.when(F.col("Patient_ID") == "P1", "maybe").otherwise(F.col("Case_Status")))
    with pytest.raises(ValueError, match="maybe"):
        ops.clean(bad, CLINICAL, CleanConfig(fail_on_unknown=True))
    assert ops.clean(bad, CLINICAL).count() == 3
    assert [r[0] for r in ops.rejected(bad, CLINICAL).select("patient_id").collect()] == ["P1"]


def test_missing_target_column_raises(raw):
    with pytest.raises(ValueError, match="not found"):
        ops.clean(raw.drop("Case_Status"), CLINICAL, CleanConfig(fail_on_unknown=True))


def test_dedup_keeps_smallest_id(raw):
    twice = raw.unionByName(raw.withColumn("Patient_ID", F.concat(F.lit("A"), "Patient_ID")))
    out = ops.clean(twice, CLINICAL)
    assert sorted(r[0] for r in out.select("patient_id").collect()) == ["AP1", "AP2", "AP3", "AP4"]
    kept = ops.clean(twice, CLINICAL, CleanConfig(remove_duplicates=False))
    assert kept.count() == 8
    assert quality.duplicate_count(kept, [*CLINICAL.features, CLINICAL.target]).first()["n_duplicates"] == 4


def test_number_coercion(spark):
    df = spark.createDataFrame([("1.5",), (" 7 ",), ("abc",), ("NaN",), (None,)], "v string")
    assert [r[0] for r in df.select(C.to_number(F.col("v"))).collect()] == [1.5, 7.0, None, None, None]


def test_csv_missing_path_raises(spark):
    with pytest.raises(FileNotFoundError):
        readers.read_csv(spark, "/nonexistent/table.csv")


def test_wrong_schema_batch_reports_every_missing_feature(spark):
    batch = spark.createDataFrame([("Male", 26, 15.3), ("Female", 23, 15.4)], "Sex string, Age int, `Hemoglobin(Hb%)` double")
    assert input_report(batch, CLINICAL).count() == 12
    assert input_report(batch.limit(1), CLINICAL).count() == 0


def test_age_bins_are_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 5.0, 5.1, 15.0, 50.0, 100.0, 100.1)], "a double")
    assert [r[0] for r in df.select(C.age_group(F.col("a"))).collect()] == [
        None, "0-5", "6-15", "6-15", "16-50", "50+", None]


def test_processed_sink_keeps_split_column(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test"), (3, "train")], "id int, split string")
    sinks.write_processed(df, str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("id", "split").collect())) == [
        (1, "train"), (2, "test"), (3, "train")]
