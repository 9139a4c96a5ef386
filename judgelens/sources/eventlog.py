"""Spark event logs (JSON lines) and their counters.

A log is one file, or a directory of rolling files ``events_<number>_<application>``.
Files may be plain or packed with Zstandard (``.zstd``), the codec Spark writes by
default, and older rolling files may have been compacted into one (``.compact``),
which stands for all numbers up to its own. Logs that are not complete are refused
by name: still in progress, with a number missing, packed by another codec,
or without the start or end of the application.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.sources.streams import list_files, packed_lines

# Field and event names of the Spark event log.
EVENT_SCHEMA = """
    `Event` string, `App ID` string, `App Name` string, `Timestamp` bigint,
    `Task Info` struct<`Executor ID`: string>,
    `Task Metrics` struct<
        `Executor Run Time`: bigint,
        `Shuffle Read Metrics`: struct<`Remote Bytes Read`: bigint, `Local Bytes Read`: bigint>,
        `Shuffle Write Metrics`: struct<`Shuffle Bytes Written`: bigint>>,
    `Spark Properties` struct<`spark.master`: string, `spark.driver.memory`: string>
"""
APPLICATION_START = "SparkListenerApplicationStart"
APPLICATION_END = "SparkListenerApplicationEnd"
JOB_START = "SparkListenerJobStart"
STAGE_COMPLETED = "SparkListenerStageCompleted"
TASK_END = "SparkListenerTaskEnd"
ENVIRONMENT_UPDATE = "SparkListenerEnvironmentUpdate"


# Names of rolling files and codecs.
ROLLING_FILE = re.compile(r"events_(\d+)_.+")
PACKED, COMPACT, IN_PROGRESS, STATUS = ".zstd", ".compact", ".inprogress", "appstatus_"
OTHER_CODECS = (".lz4", ".lzf", ".snappy")


def current_files(log: str, names: list[str]) -> list[str]:
    """The files of a log that hold its events, in order; an incomplete log is refused."""
    if any(name.endswith(IN_PROGRESS) for name in names):
        raise ValueError(f"{log}: the application was still writing this log")
    names = [name for name in names if not name.startswith(STATUS)]
    for name in names:
        if name.removesuffix(COMPACT).endswith(OTHER_CODECS):
            raise ValueError(f"{log}: {name} is packed by a codec that is not read here")
    numbers = {name: int(found[1]) for name in names if (found := ROLLING_FILE.fullmatch(name))}
    if not numbers:
        return sorted(names)
    compacted = [n for name, n in numbers.items() if name.endswith(COMPACT)]
    first = max(compacted, default=0)
    # The last compacted file stands for all before it.
    kept = sorted((n, name) for name, n in numbers.items() if n > first or (n == first and name.endswith(COMPACT)))
    expected = list(range(first or 1, first + len(kept) + (0 if first else 1)))
    if [n for n, _ in kept] != expected:
        raise ValueError(f"{log}: rolling files {[n for n, _ in kept]} are not {expected}")
    return [name for _, name in kept]


def read_event_logs(spark: SparkSession, path: str, rolling: bool = False) -> DataFrame:
    """Events of all logs below a directory, with the log each came from.

    A log is one file, or one directory of files when logs are ``rolling``. Plain
    files are read by Spark in splits, packed ones each as a stream.
    """
    logs: dict[str, list[str]] = {}
    for name, _ in list_files(path):
        folder, _, file = name.rpartition("/")
        if not file.startswith("_"):
            logs.setdefault(folder if rolling else name, []).append(file)
    files = [
        f"{log if rolling else log.rpartition('/')[0]}/{name}".lstrip("/")
        for log, names in logs.items()
        for name in current_files(log, names)
    ]
    packed = [name for name in files if name.removesuffix(COMPACT).endswith(PACKED)]
    plain = [name for name in files if name not in set(packed)]
    root = path.rstrip("/")
    none = spark.createDataFrame([], "path string, value string")
    lines = packed_lines(spark, root, packed) if packed else none
    if plain:
        own = F.substring_index(F.col("_metadata.file_path"), f"{root.rpartition('/')[2]}/", -1)
        lines = lines.unionByName(spark.read.text([f"{root}/{name}" for name in plain]).select(own.alias("path"), "value"))
    log = F.regexp_replace("path", "/?[^/]*$", "") if rolling else F.col("path")
    return lines.select(F.from_json("value", EVENT_SCHEMA).alias("event"), log.alias("log_file")).select("event.*", "log_file")


def eventlog_summary(events: DataFrame) -> DataFrame:
    """Execution counters of each application, from one pass over the events; fails on a log without its start or end."""
    kind = F.col("Event")
    at_task = kind == TASK_END
    metrics = F.col("Task Metrics")
    read = metrics["Shuffle Read Metrics"]
    zero = F.lit(0).cast("bigint")

    def task_sum(*values):
        parts = [F.coalesce(value, zero) for value in values]
        return F.coalesce(F.sum(F.when(at_task, sum(parts[1:], parts[0]))), zero)

    def from_event(event: str, column):
        return F.max(F.when(kind == event, column))

    return (
        events.groupBy("log_file")
        .agg(
            from_event(APPLICATION_START, F.col("App ID")).alias("application_id"),
            from_event(APPLICATION_START, F.col("App Name")).alias("application_name"),
            F.count_if(kind == JOB_START).alias("jobs"),
            F.count_if(kind == STAGE_COMPLETED).alias("completed_stages"),
            F.count_if(at_task).alias("completed_tasks"),
            task_sum(read["Remote Bytes Read"], read["Local Bytes Read"]).alias("shuffle_read_bytes"),
            task_sum(metrics["Shuffle Write Metrics"]["Shuffle Bytes Written"]).alias("shuffle_write_bytes"),
            task_sum(metrics["Executor Run Time"]).alias("executor_run_time_ms_sum"),
            from_event(ENVIRONMENT_UPDATE, F.col("Spark Properties")["spark.master"]).alias("master"),
            from_event(ENVIRONMENT_UPDATE, F.col("Spark Properties")["spark.driver.memory"]).alias("driver_memory"),
            from_event(APPLICATION_START, F.col("Timestamp")).alias("start_ms"),
            from_event(APPLICATION_END, F.col("Timestamp")).alias("end_ms"),
            F.array_sort(F.collect_set(F.when(at_task, F.col("Task Info")["Executor ID"]))).alias("executor_ids"),
        )
        .withColumn("application_wall_seconds", (complete("end_ms") - F.col("start_ms")) / 1000)
        .withColumn("start_ms", complete("start_ms"))
        .drop("end_ms", "log_file")
    )


def complete(time: str) -> Column:
    """A time that the log must hold; raises the name of the log where it does not."""
    refused = F.raise_error(F.concat("log_file", F.lit(": the application has no start or end in this log"))).cast("bigint")
    return F.when(F.col(time).isNull(), refused).otherwise(F.col(time))
