"""Submit independent Spark jobs at the same time, so that small ones share the executors."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import SparkSession

MAX_JOBS = 6


def run_all(spark: SparkSession, jobs: dict[str, Callable[[], object]]) -> dict[str, object]:
    """Results by name; the first failure is raised once all jobs have ended."""
    with ThreadPoolExecutor(max_workers=MAX_JOBS) as pool:
        running = {name: pool.submit(inheritable_thread_target(spark)(job)) for name, job in jobs.items()}
    return {name: future.result() for name, future in running.items()}
