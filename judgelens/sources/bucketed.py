"""Tables stored by a key, so that grouping and joining by it need no shuffle.

Rows are dealt to buckets by the key once, when they are saved; each bucket is one
sorted file (of each partition). A table keeps its layout beside it, as one JSON
row, so another session reads it back with its buckets.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _layout_path(path: str) -> str:
    return path.rstrip("/") + "_layout"


def _table_name(path: str) -> str:
    return "judgelens_" + hashlib.sha256(path.encode()).hexdigest()[:24]


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, *partitions: str) -> None:
    """Save rows at a new path in ``buckets`` files (of each partition) by ``key``."""
    if buckets < 1:
        raise ValueError("the number of buckets must be positive")
    # The same hash places a row in its task and in its bucket, so a task writes whole buckets.
    writer = df.repartition(buckets, key).write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", path)
    if partitions:
        writer = writer.partitionBy(*partitions)
    writer.saveAsTable(_table_name(path))
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema]
    row = df.sparkSession.range(0, 1, 1, 1).select(
        F.lit(", ".join(columns)).alias("columns"),
        F.lit(key).alias("key"),
        F.lit(buckets).alias("buckets"),
        F.lit(", ".join(partitions)).alias("partitions"),
    )
    row.write.json(_layout_path(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    """A saved table with its buckets."""
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        layout = spark.read.schema("columns string, key string, buckets int, partitions string").json(_layout_path(path)).first()
        by_partition = f"PARTITIONED BY ({layout['partitions']})" if layout["partitions"] else ""
        spark.sql(
            f"CREATE TABLE {name} ({layout['columns']}) USING parquet {by_partition} "
            f"CLUSTERED BY ({layout['key']}) SORTED BY ({layout['key']}) INTO {layout['buckets']} BUCKETS LOCATION '{path}'"
        )
        if by_partition:
            spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
    return spark.table(name)
