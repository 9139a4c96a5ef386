"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from judgelens.operators.numbering import number_rows

# Words are runs of anything but ASCII white space. bytes.split() cuts at the same six bytes.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text) -> Column:
    """Words of a text, counted by the JVM; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so that others cannot clash."""
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def keyed_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc`` (all columns of a row, so that no name clashes), ``key`` (one to a row), ``text``.

    The key is the id, or if ids are missing or repeated the number of the row in the
    order of ids, missing ones last.
    """
    ids = docs.select(F.col(f"`{id_col}`").alias("id"))
    unclear = ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1 OR id IS NULL")
    doc = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    rows = docs.select(doc, F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    if unclear.isEmpty():
        return rows
    numbered = number_rows(rows.select("doc", "key", F.xxhash64("text").alias("mixed")), [F.col("key").asc_nulls_last(), "mixed"], "number")
    return numbered.select("doc", F.col("number").alias("key"), F.col("doc")[text_col].alias("text"))


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table], schema) -> DataFrame:
    """Apply ``function`` to each Arrow batch of a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield from out.to_batches() if isinstance(out, pa.Table) else [out]

    return df.mapInArrow(run, schema)


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a text column, empty for null."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def as_texts(column: pa.Array) -> list[str]:
    return [x or "" for x in column.to_pylist()]


def field_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    """A public vocabulary file: an own path, or a name in the installed package of vocabularies."""
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)
