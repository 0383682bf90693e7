"""The logistic fit whose coefficients stay in a table: against the narrow path, hot categories, and what the driver gets."""

import json
import math
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from riskframe.operators import learn, spread_logistic
from riskframe.operators.prepare import fit_prep
from riskframe.operators.wide import fit_wide, fit_wide_logistic
from tests.test_wide import SCHEMA, SPEC, _rows


def test_joined_and_hot_categories_give_the_narrow_fit(spark, monkeypatch):
    """Both columns join by shuffle, all but the one frequent category."""
    df = spark.createDataFrame(_rows(1_500), SCHEMA)
    narrow = fit_prep(df, SPEC)
    table = narrow.transform(df)
    fit = learn.fit_logistic(learn.training_frame(table, "y", narrow.order), "y", narrow.order)
    want = {r["id"]: r["p"] for r in fit.predict(table).collect()}
    prep = fit_wide(df, SPEC)
    assembled = prep.assemble(df)
    monkeypatch.setattr(spread_logistic, "SHARED", 2)
    monkeypatch.setattr(spread_logistic, "HOT_ROWS", 400)
    got = fit_wide_logistic(assembled, "y", prep).predict(prep.transform(df)).collect()
    assert len(got) == 1_500 and max(abs(r["p"] - want[r["id"]]) for r in got) < 1e-4


def test_rows_of_a_hot_category_are_spread(spark, monkeypatch):
    monkeypatch.setattr(spread_logistic, "SHARED", 2)
    monkeypatch.setattr(spread_logistic, "HOT_ROWS", 1_000)
    blocks = spread_logistic.Blocks(0, ((0, 50),))
    rows = spark.range(20_000).select(
        F.col("id").alias("row"), (F.col("id") % 2).cast("double").alias("y"), F.lit(1.0).alias("c"),
        F.when(F.col("id") % 10 < 8, 7).when(F.col("id") % 10 == 8, F.col("id") % 50).cast("bigint").alias("at0"))
    state = spread_logistic._start(rows, blocks, 50, 1.0)
    assert [r["place"] for r in state.where("shared and place >= 0").collect()] == [7]
    dealt = spread_logistic.deal(rows, state, blocks)
    parts = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(parts) == 20_000 and max(parts) < 2 * 20_000 / dealt.rdd.getNumPartitions()


def test_one_class_and_null_labels(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i), f"a{i % 3}", "b", 1) for i in range(12)], SCHEMA)
    prep = fit_wide(df, SPEC)
    assembled = prep.assemble(df)
    model = fit_wide_logistic(assembled, "y", prep)
    assert model.intercept == math.inf and model.weights.where("weight != 0").isEmpty() and model.weights.count() == 4
    assert model.predict(prep.transform(df)).where("p != 1").isEmpty()
    with pytest.raises(ValueError, match="classes 0 and 1"):
        fit_wide_logistic(assembled.withColumn("y", F.col("y") + 1), "y", prep)
    monkeypatch.setattr(spread_logistic, "SHARED", 2)
    with pytest.raises(Exception, match="must not be null"):
        fit_wide_logistic(assembled.withColumn("y", F.when(F.col("id") > 0, F.col("id") % 2).cast("int")), "y", prep)


_FIT = """
import sys
from pyspark.sql import SparkSession, functions as F
from riskframe.operators.wide import fit_wide, fit_wide_logistic
from tests.test_wide import SPEC
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
    .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", "file://" + sys.argv[1]).config("spark.eventLog.compress", "false")
    .config("spark.eventLog.rolling.enabled", "false").getOrCreate())
df = spark.range(100_000).select("id", (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("v"), F.col("id") % 50_000).alias("a"),
    F.lit("one").alias("b"), (F.xxhash64("id") % 2 == 0).cast("int").alias("y"))
prep = fit_wide(df, SPEC)
rows = prep.assemble(df)
spark.sparkContext.setJobGroup("fit", "fit")
assert fit_wide_logistic(rows, "y", prep).weights.count() == 50_001
spark.stop()
"""


def test_driver_gets_no_vector_of_the_width(tmp_path):
    """50,000 coefficients are 400 kB; the whole fit sends the driver less than one such vector from its tasks, bar what a task sends anyway."""
    subprocess.run([sys.executable, "-c", _FIT, str(tmp_path)], check=True, timeout=300)
    (log,) = tmp_path.iterdir()
    events = [json.loads(line) for line in log.open()]
    fit = {s for e in events if e["Event"] == "SparkListenerJobStart" and e["Properties"].get("spark.jobGroup.id") == "fit" for s in e["Stage IDs"]}
    sent = [e["Task Metrics"]["Result Size"] for e in events if e["Event"] == "SparkListenerTaskEnd" and e["Stage ID"] in fit]
    assert sent and sum(max(0, n - 20_000) for n in sent) < 400_000
