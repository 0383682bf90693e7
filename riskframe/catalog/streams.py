"""Structured Streaming queries, checked against the batch form of the same result."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskframe.catalog import inputs
from riskframe.catalog.registry import ORACLES, query
from riskframe.catalog.scoring import MODEL
from riskframe.functions.staging import new_path
from riskframe.operators.prepare import fit_prep
from riskframe.plans.training import train
from riskframe.sources import readers
from riskframe.sources.sinks import METRIC_COLUMNS
from riskframe.spec import CLINICAL
from riskframe.streaming import scoring as streaming, windows


@query("i4_stream_score", ORACLES["i1_batch_score"].replace('"Patient ID"', "patient_id"))
def i4(spark, sf):
    """The cohort as files, scored as a stream into an append log."""
    df = inputs.split(spark, sf)
    prep = fit_prep(df.where("split = 'train'"), CLINICAL)
    base = new_path(spark, "stream")
    inputs.cohort(spark, sf).write.parquet(f"{base}/in")
    schema = readers.read_parquet(spark, f"{base}/in").schema
    scored = streaming.score_stream(
        streaming.read_stream(spark, f"{base}/in", schema), CLINICAL, prep, MODEL.predict)
    streaming.append_log(scored, f"{base}/log", f"{base}/checkpoint", once=True).awaitTermination()
    return readers.read_parquet(spark, f"{base}/log").select(
        "patient_id", "predicted_label", "predicted_probability")


@query("i5_stream_monitor", """SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n,
  round(avg(CAST(value > 10 AS INTEGER)), 6) AS positive_share FROM events GROUP BY 1""")
def i5(spark, sf):
    base = new_path(spark, "monitor")
    path = f"{sf}/events.parquet"
    schema = readers.read_parquet(spark, path).schema
    # A pattern matches the table whether it is one file or a folder.
    events = streaming.read_stream(spark, f"{sf}/events.parque[t]", schema)
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    agg = streaming.class_monitor(events, "ts", F.col("value") > 10)
    streaming.write_latest(agg, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return readers.read_parquet(spark, f"{base}/table").withColumn(
        "positive_share", F.round("positive_share", 6))


#: The first batch lacks every tenth event, the second brings them: most are late by then.
_ARRIVED = """WITH a AS (SELECT *, event_id % 10 = 0 AS second, date_trunc('day', ts) + INTERVAL 1 DAY AS ends FROM events),
m AS (SELECT max(ts) FILTER (NOT second) - INTERVAL 1 DAY AS m1, max(ts) - INTERVAL 1 DAY AS m2 FROM a)"""


def _watched(spark, sf):
    base = new_path(spark, "windows")
    events = readers.read_parquet(spark, f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    in_time = F.pmod("event_id", F.lit(10)) != 0
    for i, part in enumerate((events.where(in_time), events.where(~in_time))):
        part.write.parquet(f"{base}/in/a{i}")
        arrived = streaming.read_stream(spark, f"{base}/in/*", events.schema)
        windows.watch_windows(
            arrived, "ts", F.col("value") > 10, f"{base}/log", f"{base}/checkpoint", late="1 day").awaitTermination()
    return f"{base}/log", events.schema


@query("i5_closed_windows", _ARRIVED + """ SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS window_start, count(*) AS n,
  round(avg(CAST(value > 10 AS INTEGER)), 6) AS positive_share FROM a, m WHERE ends <= m2 AND NOT (second AND ends <= m1) GROUP BY 1""")
def i5_closed(spark, sf):
    """Windows that are closed for good, without the rows that came after that."""
    log, _ = _watched(spark, sf)
    return windows.closed_windows(spark, log).withColumn("positive_share", F.round("positive_share", 6))


@query("i5_late_rows", _ARRIVED + """ SELECT event_id, CAST(ts AS TIMESTAMP) AS ts, value FROM a, m WHERE second AND ends <= m1""")
def i5_late(spark, sf):
    """The rows that came after their window had closed."""
    return windows.late_rows(spark, *_watched(spark, sf)).select("event_id", "ts", "value")


@query("f10_retrain_trigger")
def f10(spark, sf):
    """Labelled records arrive as files; all models are trained once enough are there."""
    base = new_path(spark, "retrain")
    inputs.cleaned(spark, sf).write.parquet(f"{base}/in")
    schema = readers.read_parquet(spark, f"{base}/in").schema

    def job(rows):
        train(rows, CLINICAL, out_dir=f"{base}/out")

    labelled = streaming.read_stream(spark, f"{base}/in", schema)
    streaming.retrain_when(labelled, f"{base}/log", f"{base}/checkpoint", 500, job).awaitTermination()
    measures = ", ".join(f"{c} double" for c in METRIC_COLUMNS[1:])
    return spark.read.schema(f"model string, {measures}").option("header", True).csv(f"{base}/out/model_comparison")
