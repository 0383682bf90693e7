from datetime import datetime

import pytest
from pyspark.sql import functions as F

from riskframe.sources.commits import BatchLog
from riskframe.streaming import windows

SCHEMA = "id int, ts timestamp, v double"


def _day(d, h=12):
    return datetime(2024, 1, d, h)


def _judge(spark, rows, batch_id, log):
    windows.judge_batch(spark.createDataFrame(rows, SCHEMA), batch_id, log, "ts", F.col("v") > 1, "1 day", "1 day")


def _closed(spark, log):
    return {r["window_start"].day: (r["n"], r["positive_share"]) for r in windows.closed_windows(spark, log).collect()}


def _late(spark, log):
    schema = spark.createDataFrame([], SCHEMA).schema
    return sorted(r["id"] for r in windows.late_rows(spark, log, schema).collect())


def test_late_rows_are_set_aside_and_closed_windows_stay(spark, tmp_path):
    log = str(tmp_path / "log")
    _judge(spark, [(1, _day(1), 2.0), (2, _day(3), 0.0), (3, None, 2.0)], 0, log)
    assert _closed(spark, log) == {1: (1, 1.0)} and _late(spark, log) == [3]
    second = [(4, _day(1), 0.0), (5, _day(2), None), (6, _day(3), 2.0), (7, _day(5), 2.0)]
    _judge(spark, second, 1, log)
    # Day 2 was open before the second batch, day 1 was not.
    assert _late(spark, log) == [3, 4]
    assert _closed(spark, log) == {1: (1, 1.0), 2: (1, None), 3: (2, 0.5)}
    _judge(spark, second, 1, log)
    assert _late(spark, log) == [3, 4] and _closed(spark, log)[3] == (2, 0.5)


def test_a_batch_that_died_halfway_is_judged_again_alike(spark, tmp_path):
    log = str(tmp_path / "log")
    _judge(spark, [(1, _day(3), 2.0)], 0, log)
    counts = spark.createDataFrame([], windows._COUNTS)
    BatchLog(spark, f"{log}/counts").write(counts, 1)
    _judge(spark, [(2, _day(3), 0.0), (3, _day(1), 0.0), (4, _day(9), 0.0)], 1, log)
    assert _late(spark, log) == [3] and _closed(spark, log) == {3: (2, 0.5)}


def test_empty_log_and_empty_batch(spark, tmp_path):
    log = str(tmp_path / "log")
    assert _closed(spark, log) == {} and _late(spark, log) == []
    _judge(spark, [], 0, log)
    assert _closed(spark, log) == {} and _late(spark, log) == []


def test_commits(spark, tmp_path):
    log = BatchLog(spark, str(tmp_path / "log"))
    rows = spark.range(5).selectExpr("int(id) AS n")
    assert log.read(rows.schema).count() == 0
    log.write(rows, 0)
    assert log.read(rows.schema).count() == 0
    assert log.append(rows, 0) and not log.append(rows, 0)
    assert log.append(rows.where("n > 2"), 1)
    assert log.read(rows.schema).count() == 7 and log.read(rows.schema, before=1).count() == 5
    assert sorted(r[0] for r in log.committed().collect()) == [0, 1]
    with pytest.raises(ValueError):
        log.write(rows.withColumnRenamed("n", "log_batch"), 2)
