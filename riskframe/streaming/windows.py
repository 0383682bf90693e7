"""Tumbling windows over a stream that lose no late row.

A watermark alone drops late rows without a trace. Here each micro-batch leaves three things in
logs with commits: counts of its rows per open window, the rows that came after their window had
closed, and the mark up to which windows are closed from then on. A replayed batch adds nothing,
as its id is committed, and a batch that died halfway is judged again by the same earlier mark.
Nothing of the past is held as state; a batch reads only the marks.

The mark is the greatest event time of all earlier batches less ``late``. A row is late when its
window ends at or before the mark, or when it has no event time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.sources.commits import BatchLog

_COUNTS = "window_start timestamp, window_end timestamp, n long, n_known long, n_positive long"
_MARK = "mark timestamp"


def _mark(spark: SparkSession, log: str, before: int | None = None):
    return BatchLog(spark, f"{log}/marks").read(_MARK, before).agg(F.max("mark")).first()[0]


def judge_batch(batch: DataFrame, batch_id: int, log: str, ts: str, positive: Column, late: str, window: str) -> None:
    """Count the rows of open windows, set the late ones aside and move the mark."""
    spark = batch.sparkSession
    mark = _mark(spark, log, batch_id)
    # Windowing leaves out rows without a time, so they get one that is not used.
    timed = F.coalesce(F.col(ts).cast("timestamp"), F.timestamp_seconds(F.lit(0)))
    rows = batch.withColumn("_w", F.window(timed, window)).persist()
    try:
        on_time = F.col(ts).isNotNull()
        if mark is not None:
            on_time = on_time & (F.col("_w.end") > F.lit(mark))
        on_time = F.coalesce(on_time, F.lit(False))
        counts = rows.where(on_time).groupBy("_w").agg(
            F.count("*").alias("n"), F.count(positive).alias("n_known"), F.count_if(positive).alias("n_positive")
        ).select(F.col("_w.start").alias("window_start"), F.col("_w.end").alias("window_end"), "n", "n_known", "n_positive")
        BatchLog(spark, f"{log}/counts").append(counts, batch_id)
        BatchLog(spark, f"{log}/late").append(rows.where(~on_time).drop("_w"), batch_id)
        seen = rows.agg((F.max(ts) - F.expr(f"INTERVAL {late}")).cast("timestamp").alias("mark"))
        BatchLog(spark, f"{log}/marks").append(seen, batch_id)
    finally:
        rows.unpersist()


def watch_windows(records: DataFrame, ts: str, positive: Column, log: str, checkpoint: str, late: str = "1 hour",
                  window: str = "1 day") -> StreamingQuery:
    """Judge every micro-batch of ``records`` until the input that is there has been read."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        judge_batch(batch, batch_id, log, ts, positive, late, window)

    return records.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(
        availableNow=True).start()


def closed_windows(spark: SparkSession, log: str) -> DataFrame:
    """window_start, n and positive_share of windows that no later row can change."""
    mark = _mark(spark, log)
    counts = BatchLog(spark, f"{log}/counts").read(_COUNTS).where(F.col("window_end") <= F.lit(mark).cast("timestamp"))
    return counts.groupBy("window_start").agg(
        F.sum("n").alias("n"), F.try_divide(F.sum("n_positive"), F.sum("n_known")).alias("positive_share"))


def late_rows(spark: SparkSession, log: str, schema: T.StructType) -> DataFrame:
    """The rows that came too late, whole."""
    return BatchLog(spark, f"{log}/late").read(schema)
