"""Inputs at the edges: big counts, constant and empty columns, CSV quoting."""

from pyspark.sql import functions as F
import pytest

from riskframe.functions.ordering import with_ranges
from riskframe.operators import evaluate, explain, profile
from riskframe.operators.clean import record_from_json
from riskframe.sources.readers import read_csv
from riskframe.sources.sinks import append_scored
from riskframe.spec import CLINICAL


def test_auc_of_huge_counts(spark):
    counts = spark.createDataFrame([("m", 0.2, 5 * 10**9, 5 * 10**9), ("m", 0.8, 5 * 10**9, 5 * 10**9)],
                                   "model string, p double, pos long, neg long")
    assert evaluate.auc_of_counts(counts, ["model"]).first().roc_auc == 0.5


def test_constant_column_has_no_correlation(spark):
    df = spark.range(100_000).selectExpr("if(id % 2 = 0, 0.1D, null) AS a", "double(id) AS b", "double(-id) AS c")
    df = df.unionByName(spark.sql("SELECT 0.7D AS a, CAST(null AS double) AS b, 1D AS c"))
    got = {(r.a, r.b): r.r for r in profile.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] is None and got["b", "c"] == pytest.approx(-1)


def test_histogram_of_empty_columns(spark):
    df = spark.sql("SELECT CAST(null AS double) AS x")
    assert profile.histogram(df, ["x"]).collect() == []


def test_csv_quotes_and_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,name\n1,"say ""hi"", ok"\n2,"two\nlines"\n')
    rows = read_csv(spark, str(tmp_path / "a.csv"), multi_line=True).collect()
    assert [tuple(r) for r in rows] == [("1", 'say "hi", ok'), ("2", "two\nlines")]
    (tmp_path / "b.csv").write_text("name,id\nx,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_csv(spark, str(tmp_path)).collect()


def test_keys_with_a_long_common_start_are_split(spark):
    df = spark.range(20_000).select(F.concat(F.repeat(F.lit("x"), 300), F.col("id").cast("string")).alias("k"))
    ranged = with_ranges(df, [], "k", 20_000, rows_per_range=400)[0]
    sizes = [r["count"] for r in ranged.groupBy("_range").count().collect()]
    assert len(sizes) > 20 and max(sizes) < 5_000
    ends = ranged.groupBy("_range").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("_range").collect()
    assert all(a["hi"] < b["lo"] for a, b in zip(ends, ends[1:]))


def test_permutation_does_not_depend_on_the_layout(spark):
    df = spark.range(5_000).selectExpr("id", "int(id % 2) AS y", "double(id * 7 % 1013) AS a")
    runs = [
        sorted(map(tuple, explain.permute(df.repartition(n), "y", ["a"], repeats=2, id_col="id").collect()))
        for n in (1, 4)
    ]
    assert runs[0] == runs[1]


def test_append_matches_columns_by_name(spark, tmp_path):
    path = str(tmp_path / "log")
    append_scored(spark.createDataFrame([(1, "a")], "n int, s string"), path)
    append_scored(spark.createDataFrame([("b", 2)], "s string, n int"), path)
    assert sorted(map(tuple, spark.read.parquet(path).select("n", "s").collect())) == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError):
        append_scored(spark.createDataFrame([("b", 2)], "t string, n int"), path)


def test_records_follow_the_flag_mode(spark):
    df = spark.createDataFrame([('{"has_fever": "yes"}',), ('{"sex": "Male"}',)], "record string")
    read = lambda mode: [r[0] for r in record_from_json(df, "record", CLINICAL, mode).select("has_fever").collect()]
    assert read("lenient") == [1, None] and read("strict") == [0, None]
