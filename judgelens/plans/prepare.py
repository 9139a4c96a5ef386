"""Two input tables to one audited, leak-free feature table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from judgelens.constants import SEED
from judgelens.functions.hashing import KeyHash, xxhash_key
from judgelens.operators import audits, joins, sampling
from judgelens.operators.features import lexical_features, product_forms
from judgelens.operators.provenance import query_digest
from judgelens.operators.splits import assert_disjoint, assign_splits, marked_splits, saved_profile, split_summary_of, staged_profile
from judgelens.plans.parallel import run_all
from judgelens.sources.staging import stage
from judgelens.sources.tables import feature_projection, read_features, write_features, write_metrics


def prepare_features(
    pairs: DataFrame,
    products: DataFrame,
    seed: int = SEED,
    key_hash: KeyHash = xxhash_key,
    profile: DataFrame | None = None,
) -> DataFrame:
    """Split, join, flag and featurise in-scope pairs, without the gates.

    The assigned pairs are stored, as their train products are wanted ahead of the join.
    """
    assigned = stage(assign_splits(pairs, seed, key_hash, profile), "assigned")
    joined = joins.attach_products_and_seen(assigned, product_forms(products))
    return feature_projection(lexical_features(joined))


def prepare(
    spark: SparkSession,
    pairs: DataFrame,
    products: DataFrame,
    locale: str,
    path: str,
    seed: int = SEED,
    key_hash: KeyHash = xxhash_key,
    reports: str | None = None,
) -> DataFrame:
    """Validate, try a sample, build and save the feature table; return it as read back from storage.

    The counts of the audit are observed on the write itself. The saved rows are
    held against the pairs that were to be kept. With ``reports``, a folder, the
    audit counts, the split summary and the query digests are stored there.
    """
    pairs = joins.scope_pairs(pairs, locale)
    products = joins.scope_products(products, locale)
    profile = staged_profile(pairs)
    checked = audits.assert_valid(pairs, products, profile)
    sample = sampling.sample_queries(pairs, seed=seed, key_hash=key_hash)
    sampling.assert_sample(prepare_features(sample, products, seed, key_hash, profile), sample)
    observation = Observation("prepare")
    joined = joins.attach_products_and_seen(marked_splits(pairs, profile, seed, key_hash), product_forms(products))
    kept = audits.observe_join(joined, observation).filter("dataset_split IS NOT NULL")
    write_features(feature_projection(lexical_features(kept)), path)
    observed = observation.get
    saved = read_features(spark, path)
    saved_queries = saved_profile(saved)
    assert_disjoint(saved_queries)
    n_saved = saved_queries.agg(F.sum("n_pairs")).first()[0] or 0
    if n_saved != observed["joined_rows"] - observed["excluded_rows"] or observed["joined_rows"] != checked["n_pairs"]:
        raise ValueError(f"rows were lost or multiplied: {n_saved} saved, {checked}, {observed}")
    if reports:
        made = {
            "data_audit": lambda: audits.observed_audit(checked, observed, pairs, profile),
            "split_summary": lambda: split_summary_of(saved_queries),
            "query_digests": lambda: query_digest(saved_queries),
            "label_balance": lambda: audits.label_balance(pairs),
        }
        run_all(spark, {name: lambda name=name: write_metrics(made[name](), f"{reports}/{name}") for name in made})
    return saved
