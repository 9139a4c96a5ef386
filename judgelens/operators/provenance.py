"""Digests, manifests and frozen records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import BOOTSTRAP_BUDGET, CONFIDENCE, REVIEW_BUDGETS, SEED
from judgelens.operators.classification import class_weights, majority_baseline

WORDS = 8


def query_digest(df: DataFrame, group: str = "dataset_split") -> DataFrame:
    """Order-independent fingerprint of the distinct (query_id, query_norm) set of each group.

    Each distinct pair is hashed; the eight 32-bit words of the hashes are
    added up as exact decimals and the sums are hashed again. Sums combine on
    the map side, so no set is ever sorted or collected.
    """
    row = F.sha2(F.concat_ws("\u001f", F.col("query_id").cast("string"), "query_norm"), 256)
    hashed = df.select(group, "query_id", "query_norm").distinct().select(group, row.alias("_hash"))
    words = [
        F.conv(F.substring("_hash", 1 + 8 * i, 8), 16, 10).cast("decimal(10,0)") for i in range(WORDS)
    ]
    sums = hashed.groupBy(group).agg(
        F.count("*").cast("string").alias("_n"),
        *[F.sum(word).cast("string").alias(f"_w{i}") for i, word in enumerate(words)],
    )
    parts = F.concat_ws(":", "_n", *[f"_w{i}" for i in range(WORDS)])
    return sums.select(group, F.sha2(parts, 256).alias("digest"))


def manifest_diff(frozen: DataFrame, current: DataFrame) -> DataFrame:
    """Files that are missing, added or changed between two (path, sha256) manifests."""
    left = frozen.select("path", F.col("sha256").alias("_frozen"), F.lit(True).alias("_in_frozen"))
    right = current.select("path", F.col("sha256").alias("_current"), F.lit(True).alias("_in_current"))
    status = (
        F.when(F.col("_in_current").isNull(), "missing")
        .when(F.col("_in_frozen").isNull(), "added")
        .when(~F.col("_frozen").eqNullSafe(F.col("_current")), "changed")
    )
    return left.join(right, "path", "full").select("path", status.alias("status")).dropna()


def verify_freeze(frozen: DataFrame, current: DataFrame) -> None:
    """Refuse to go on when any frozen file was altered, removed or added."""
    changed = manifest_diff(frozen, current).limit(5).collect()
    if changed:
        raise ValueError(f"files changed since the freeze, for example {[tuple(row) for row in changed]}")


def metric_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """Metric rows of one run that the other does not have, with the side they are on."""
    only_left = left.exceptAll(right).withColumn("side", F.lit("left"))
    return only_left.unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def manifest_digest(manifest: DataFrame) -> DataFrame:
    """One fingerprint over all files of a manifest, independent of their order."""
    named = manifest.select(F.lit("files").alias("scope"), F.col("path").alias("query_id"), F.col("sha256").alias("query_norm"))
    return query_digest(named, "scope").select("digest")


def freeze_record(
    selection: DataFrame, train: DataFrame, features: DataFrame, manifest: DataFrame, seed: int = SEED
) -> DataFrame:
    """One row that fixes what was selected, on which data, before the test split is scored."""
    counts = class_weights(train).select(F.map_from_entries(F.collect_list(F.struct("label", "class_count"))))
    digests = query_digest(features).select(F.map_from_entries(F.collect_list(F.struct("dataset_split", "digest"))))
    baseline = majority_baseline(train)
    return selection.filter("selected").select(
        F.lit("frozen_before_test").alias("status"),
        F.col("model").alias("selected_model"),
        F.col("macro_f1").alias("validation_macro_f1"),
        baseline.select("prediction").scalar().alias("majority_label"),
        baseline.select("p_e").scalar().alias("majority_p_e"),
        train.agg(F.count("*")).scalar().alias("training_rows"),
        counts.scalar().alias("training_class_counts"),
        digests.scalar().alias("split_digests"),
        manifest_digest(manifest).scalar().alias("manifest_digest"),
        F.lit(seed).alias("seed"),
        F.array(*[F.lit(b) for b in REVIEW_BUDGETS]).alias("review_budgets"),
        F.lit(BOOTSTRAP_BUDGET).alias("bootstrap_budget"),
        F.lit(CONFIDENCE).alias("confidence"),
    )
