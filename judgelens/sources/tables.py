"""Scans and sinks of the study tables.

Schemas are declared, so a scan never opens footers to infer them, and every
reader selects its columns by name, so unused columns (long descriptions,
index residue) never leave the file.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.constants import FEATURE_TABLE_COLUMNS, FEATURES, SCORED_COLUMNS
from judgelens.operators.features import require_columns
from judgelens.sources.bucketed import write_bucketed

PAIR_SCHEMA = (
    "example_id bigint, query string, query_id bigint, product_id string, product_locale string, "
    "esci_label string, large_version bigint, split string"
)
PRODUCT_SCHEMA = (
    "product_locale string, product_id string, product_title string, "
    "product_brand string, product_color string"
)
FEATURE_SCHEMA = (
    "example_id bigint, query_id bigint, query_norm string, query string, product_id string, "
    "product_title string, product_brand string, label string, product_seen_train boolean, "
    + ", ".join(f"{name} double" for name in FEATURES)
    + ", dataset_split string"
)
SCORED_SCHEMA = (
    "example_id bigint, query_id bigint, label string, prediction string, p_e double, "
    "query_token_count double, query_has_number double, numeric_mismatch double, "
    "brand_missing double, title_missing double, product_seen_train boolean"
)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PAIR_SCHEMA).parquet(path)


def read_products(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRODUCT_SCHEMA).parquet(path)


def read_columns(spark: SparkSession, path: str, columns) -> DataFrame:
    """Only the named columns of a Parquet table."""
    return spark.read.parquet(path).select(*columns)


def feature_projection(featured: DataFrame) -> DataFrame:
    """The stored columns of the feature table; ``esci_label`` becomes ``label``."""
    return featured.withColumnRenamed("esci_label", "label").select(*FEATURE_TABLE_COLUMNS)


def write_features(features: DataFrame, path: str) -> None:
    """Overwrite the feature table, one directory per dataset split."""
    features.write.mode("overwrite").partitionBy("dataset_split").parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEATURE_SCHEMA).parquet(path).select(*FEATURE_TABLE_COLUMNS)


def read_split(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One dataset split; partition pruning leaves the other directories unread."""
    return read_features(spark, path).filter(F.col("dataset_split") == split)


def write_features_by_query(features: DataFrame, path: str, buckets: int) -> None:
    """The feature table in buckets of queries, for work that groups by query; ``read_bucketed`` reads it."""
    write_bucketed(features.select(*FEATURE_TABLE_COLUMNS), path, "query_id", buckets, "dataset_split")


def write_scored_by_query(scored: DataFrame, path: str, buckets: int) -> None:
    """Scored pairs in buckets of queries; ``read_bucketed`` reads them."""
    require_columns(scored, SCORED_COLUMNS, "write_scored_by_query")
    write_bucketed(scored.select(*SCORED_COLUMNS), path, "query_id", buckets)


def write_scored(scored: DataFrame, path: str) -> None:
    require_columns(scored, SCORED_COLUMNS, "write_scored")
    scored.select(*SCORED_COLUMNS).write.mode("overwrite").parquet(path)


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCORED_SCHEMA).parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """Metric rows as JSON lines; nulls are kept and NaN or infinity is refused."""
    doubles = [name for name, kind in metrics.dtypes if kind == "double"]
    infinite = float("inf")
    checked = metrics
    for name in doubles:
        value = F.col(name)
        wrong = F.isnan(value) | (F.abs(value) == F.lit(infinite))
        refused = F.raise_error(f"metric {name} is not finite").cast("double")
        checked = checked.withColumn(name, F.when(wrong, refused).otherwise(value))
    checked.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").option("header", True).csv(path)


def read_cases(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def register_views(pairs: DataFrame, products: DataFrame, joined: DataFrame) -> None:
    """Expose the audited tables to Spark SQL under the names the audits use."""
    pairs.createOrReplaceTempView("judged_pairs")
    products.createOrReplaceTempView("judged_products")
    joined.createOrReplaceTempView("judged_joined")
