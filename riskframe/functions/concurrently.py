"""Run independent Spark fits from a few driver threads, as CrossValidator does.

An iterative fit is a chain of short jobs; overlapping chains keep executors busy
between them. Each call still runs as distributed jobs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession


def run_together(spark: SparkSession, jobs: Sequence[Callable], parallelism: int) -> list:
    """Results of ``jobs`` in order."""
    if parallelism <= 1 or len(jobs) <= 1:
        return [job() for job in jobs]
    tasks = [inheritable_thread_target(spark)(job) for job in jobs]
    with ThreadPool(min(parallelism, len(tasks))) as pool:
        return pool.map(lambda task: task(), tasks)
