"""Streams: scored append log, class monitor, retraining trigger."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery

from riskframe.operators.prepare import PrepModel
from riskframe.operators.score import score
from riskframe.sources.readers import read_json
from riskframe.spec import FeatureSpec

_COUNT = T.StructType([T.StructField("id", T.LongType()), T.StructField("n", T.LongType())])
_MARK = T.StructType([T.StructField("upto", T.LongType())])


def read_stream(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", only: str | None = None
) -> DataFrame:
    """Files arriving under ``path``; ``only`` is a file-name pattern."""
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("pathGlobFilter", only) if only else reader).load(path)


def score_stream(
    records: DataFrame, spec: FeatureSpec, prep: PrepModel, predict: Callable[[DataFrame], DataFrame]
) -> DataFrame:
    """Stateless: the batch scoring plan applied to a stream."""
    return score(records, spec, prep, predict)


def append_log(scored: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Exactly-once append to a parquet log."""
    writer = scored.writeStream.outputMode("append").format("parquet").option(
        "path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def class_monitor(
    records: DataFrame, ts: str, positive: Column, late: str = "1 hour", window: str = "1 day"
) -> DataFrame:
    """Rows and positive share per tumbling window; state is one row per open window."""
    return (
        records.withWatermark(ts, late)
        .groupBy(F.window(ts, window).alias("w"))
        .agg(F.count("*").alias("n"), F.avg(positive.cast("double")).alias("positive_share"))
        .select(F.col("w.start").alias("window_start"), "n", "positive_share")
    )


def write_latest(agg: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Complete-mode sink for a small aggregate: each batch replaces the table.

    The rows move once more to get few files: a plain ``coalesce`` would put the state of all partitions into one task.
    """

    def replace(batch: DataFrame, _: int) -> None:
        cores = batch.sparkSession.sparkContext.defaultParallelism
        batch.repartition(cores).write.mode("overwrite").parquet(path)

    return (
        agg.writeStream.outputMode("complete").option("checkpointLocation", checkpoint)
        .foreachBatch(replace).trigger(availableNow=True).start()
    )


def retrain_when(
    labelled: DataFrame, log: str, checkpoint: str, min_rows: int, job: Callable[[DataFrame], object]
) -> StreamingQuery:
    """Collect labelled rows in a log and run ``job`` on all of it whenever at least
    ``min_rows`` arrived since the last run.

    Each batch goes to its own folder, overwritten on replay, and its row count beside it, so a
    retried batch is counted once and no batch reads the log again to count it. The batch that
    triggers a run is marked after the run.
    """

    def known(spark: SparkSession, what: str, schema: T.StructType) -> DataFrame:
        try:
            return read_json(spark, f"{log}/{what}", schema)
        except FileNotFoundError:
            return spark.createDataFrame([], schema)

    def note(spark: SparkSession, what: str, row: tuple, schema: T.StructType, batch_id: int) -> None:
        spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").json(f"{log}/{what}/batch={batch_id}")

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        here = f"{log}/rows/batch={batch_id}"
        batch.write.mode("overwrite").parquet(here)
        note(spark, "counts", (batch_id, spark.read.schema(batch.schema).parquet(here).count()), _COUNT, batch_id)
        last = known(spark, "marks", _MARK).agg(F.max("upto")).first()[0]
        since = known(spark, "counts", _COUNT).where(F.col("id") > (-1 if last is None else last))
        if (since.agg(F.sum("n")).first()[0] or 0) >= min_rows:
            job(spark.read.parquet(f"{log}/rows").drop("batch"))
            note(spark, "marks", (batch_id,), _MARK, batch_id)

    return labelled.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch).trigger(
        availableNow=True).start()
