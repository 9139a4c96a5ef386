"""Leak-free train / validation / test assignment by query group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import HASH_BUCKETS, SEED, VALIDATION_BUCKETS
from judgelens.functions.hashing import KeyHash, hash_bucket, xxhash_key
from judgelens.functions.text import normalize_query
from judgelens.sources.staging import stage


def with_query_norm(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("query_norm", normalize_query("query"))


def query_profile(pairs: DataFrame) -> DataFrame:
    """One row per (query_id, query_norm): seen in train, seen in test.

    All leakage questions are about queries, so pairs are reduced to this
    table once, with map-side combine; a hot query is one row here.
    """
    return (
        with_query_norm(pairs)
        .groupBy("query_id", "query_norm")
        .agg(
            F.bool_or(F.col("split") == "train").alias("in_train"),
            F.bool_or(F.col("split") == "test").alias("in_test"),
        )
    )


def staged_profile(pairs: DataFrame) -> DataFrame:
    """The profile as a stored table, for callers that ask it several questions."""
    return stage(query_profile(pairs), "query-profile")


def _on_both_sides(profile: DataFrame, key: str) -> DataFrame:
    sides = profile.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.bool_or("in_train").alias("in_train"), F.bool_or("in_test").alias("in_test")
    )
    return sides.filter("in_train AND in_test").select(key)


def overlap_ids_of(profile: DataFrame) -> DataFrame:
    return _on_both_sides(profile, "query_id")


def overlap_texts_of(profile: DataFrame) -> DataFrame:
    return _on_both_sides(profile, "query_norm")


def leaky_ids_of(profile: DataFrame) -> DataFrame:
    by_text = (
        profile.filter("in_train")
        .join(overlap_texts_of(profile), "query_norm", "left_semi")
        .select("query_id")
    )
    return by_text.union(overlap_ids_of(profile)).distinct()


def text_conflicts_of(profile: DataFrame) -> DataFrame:
    """A profile row is one text of one query id, so counting rows counts texts."""
    texts = profile.filter(F.col("query_id").isNotNull()).groupBy("query_id")
    return texts.agg(F.count("*").alias("text_count")).filter("text_count > 1")


def split_overlap_ids(pairs: DataFrame) -> DataFrame:
    """Query ids present in both official splits."""
    return overlap_ids_of(query_profile(pairs))


def split_overlap_texts(pairs: DataFrame) -> DataFrame:
    """Normalised query texts present in both official splits."""
    return overlap_texts_of(query_profile(pairs))


def leaky_query_ids(pairs: DataFrame) -> DataFrame:
    """Ids of train queries that share their id or their text with test."""
    return leaky_ids_of(staged_profile(pairs))


def query_text_conflicts(pairs: DataFrame) -> DataFrame:
    """Query ids that carry more than one normalised text."""
    return text_conflicts_of(query_profile(pairs))


def drop_leaky_groups(pairs: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """Train pairs without any pair of a leaky query group."""
    profile = staged_profile(pairs) if profile is None else profile
    train = with_query_norm(pairs).filter(F.col("split") == "train")
    return train.join(leaky_ids_of(profile), "query_id", "left_anti").select(*train.columns)


def _with_leaks(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs with their normalised query; ``_leaky`` is true in leaky groups and null elsewhere.

    The leaky ids are stored first: where they are few, their size is then known and the pairs need no shuffle.
    """
    leaky = stage(leaky_ids_of(profile), "leaky-ids").withColumn("_leaky", F.lit(True))
    return with_query_norm(pairs).join(leaky, "query_id", "left")


def _dataset_split(seed: int, key_hash: KeyHash):
    """Split of a row of ``_with_leaks``; null if the pair is left out."""
    validation = hash_bucket("query_norm", HASH_BUCKETS, seed, key_hash) < VALIDATION_BUCKETS
    return F.when(F.col("split") == "test", "test").when(
        (F.col("split") == "train") & F.col("_leaky").isNull(),
        F.when(validation, "validation").otherwise("train"),
    )


def assign_splits(
    pairs: DataFrame,
    seed: int = SEED,
    key_hash: KeyHash = xxhash_key,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Keep test whole, drop leaky train groups, hash the rest by query text, in one scan.

    ``profile`` is the staged query profile, where the caller already has it.
    """
    profile = staged_profile(pairs) if profile is None else profile
    kept = (F.col("split") == "test") | ((F.col("split") == "train") & F.col("_leaky").isNull())
    columns = with_query_norm(pairs).columns
    split = _dataset_split(seed, key_hash).alias("dataset_split")
    return _with_leaks(pairs, profile).filter(kept).select(*columns, split)


def marked_splits(
    pairs: DataFrame, profile: DataFrame, seed: int = SEED, key_hash: KeyHash = xxhash_key
) -> DataFrame:
    """All pairs from one scan, with the split of ``assign_splits``; it is null for the pairs that are left out."""
    split = _dataset_split(seed, key_hash).alias("dataset_split")
    return _with_leaks(pairs, profile).select(*pairs.columns, "query_norm", split)


def saved_profile(features: DataFrame) -> DataFrame:
    """One staged row per split and query of a feature table, with its number of pairs."""
    keys = ("dataset_split", "query_id", "query_norm")
    return stage(features.groupBy(*keys).agg(F.count("*").alias("n_pairs")), "saved-profile")


def split_label_counts(features: DataFrame) -> DataFrame:
    return (
        features.groupBy("dataset_split", "label")
        .agg(F.count("*").alias("row_count"))
        .orderBy("dataset_split", "label")
    )


def split_summary(features: DataFrame) -> DataFrame:
    return features.groupBy("dataset_split").agg(
        F.count("*").alias("row_count"), F.countDistinct("query_id").alias("query_count")
    )


def split_summary_of(profile: DataFrame) -> DataFrame:
    """The split summary from a saved profile."""
    return profile.groupBy("dataset_split").agg(
        F.sum("n_pairs").alias("row_count"), F.countDistinct("query_id").alias("query_count")
    )


def split_disjointness(assigned: DataFrame) -> DataFrame:
    """Query ids and texts found in more than one dataset split; empty when sound."""
    def shared(key: str) -> DataFrame:
        return (
            assigned.groupBy(key)
            .agg(F.countDistinct("dataset_split").alias("split_count"))
            .filter("split_count > 1")
            .select(F.lit(key).alias("key_name"), F.col(key).cast("string").alias("key_value"), "split_count")
        )

    return shared("query_id").unionByName(shared("query_norm"))


def assert_disjoint(assigned: DataFrame) -> None:
    leaks = split_disjointness(assigned).limit(1)
    if not leaks.isEmpty():
        raise ValueError("a query id or text occurs in more than one dataset split")


def pair_overlap(pairs: DataFrame, profile: DataFrame | None = None) -> DataFrame:
    """(query_id, product_id) pairs judged in both official splits.

    Only queries of both splits can hold such pairs; with the staged profile,
    pairs of other queries are left out before the grouping.
    """
    if profile is not None:
        pairs = pairs.join(overlap_ids_of(profile), "query_id", "left_semi")
    return (
        pairs.dropna(subset=["query_id", "product_id"])
        .groupBy("query_id", "product_id")
        .agg(
            F.bool_or(F.col("split") == "train").alias("in_train"),
            F.bool_or(F.col("split") == "test").alias("in_test"),
        )
        .filter("in_train AND in_test")
        .select("query_id", "product_id")
    )
