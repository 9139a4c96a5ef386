"""Hash samples and quantile intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from judgelens.constants import (
    CASES_PER_CELL,
    EVIDENCE_COLUMNS,
    EXAMPLE_KEY,
    REVIEW_FORM_FIELDS,
    SAMPLE_MODULUS,
    SEED,
)
from judgelens.functions.hashing import KeyHash, hash_bucket, xxhash_key
from judgelens.operators.classification import error_rows
from judgelens.operators.quantiles import exact_quantiles

MAX_PER_CELL = 10_000


def sample_queries(
    pairs: DataFrame, modulus: int = SAMPLE_MODULUS, seed: int = SEED, key_hash: KeyHash = xxhash_key
) -> DataFrame:
    """Whole query groups whose hash is 0: a deterministic sample of one in ``modulus``."""
    return pairs.filter(hash_bucket("query_id", modulus, seed, key_hash) == 0)


def sample_smoke(features: DataFrame) -> DataFrame:
    """Rows of each split in a featurised sample, and rows without a coverage value."""
    return features.groupBy("dataset_split").agg(
        F.count("*").alias("row_count"),
        F.count_if(F.col("query_coverage").isNull()).alias("missing_coverage"),
    )


def assert_sample(features: DataFrame, sample: DataFrame) -> None:
    """A sample that holds rows must come out with rows, all with a coverage value."""
    counts = sample_smoke(features).agg(
        F.sum("row_count").alias("rows"), F.sum("missing_coverage").alias("missing")
    ).first()
    if counts["missing"] or (not counts["rows"] and not sample.isEmpty()):
        raise ValueError("the sample transformation produced no rows or null coverage")


def check_per_cell(per_cell: int) -> None:
    if not 1 <= per_cell <= MAX_PER_CELL:
        raise ValueError(f"per_cell must be between 1 and {MAX_PER_CELL}")


def stratified_error_sample(
    scored: DataFrame, per_cell: int = CASES_PER_CELL, seed: int = SEED, identity=EXAMPLE_KEY
) -> DataFrame:
    """The first ``per_cell`` (1 to ``MAX_PER_CELL``) errors of each (label, prediction) cell in SHA-256 order.

    Spark keeps only the first rows of a cell on the map side before the
    shuffle, so a hot cell does not end up in one task. All columns of
    ``identity`` are kept; they break ties of the hash.
    """
    check_per_cell(per_cell)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("example_id").cast("string")), 256)
    in_cell = Window.partitionBy("label", "prediction").orderBy("_digest", *identity)
    return (
        error_rows(scored)
        .select(*identity, "label", "prediction", "p_e", digest.alias("_digest"))
        .withColumn("sample_rank", F.row_number().over(in_cell).cast("bigint"))
        .filter(F.col("sample_rank") <= per_cell)
        .drop("_digest")
    )


def attach_evidence(
    cases: DataFrame, features: DataFrame, per_cell: int = CASES_PER_CELL, identity=EXAMPLE_KEY
) -> DataFrame:
    """Give every sampled case its text and evidence columns from the feature table.

    A sample holds at most 12 cells times ``per_cell`` rows, and ``per_cell``
    is bounded, so its ids are broadcast and the feature table is filtered
    in place.
    """
    check_per_cell(per_cell)
    ids = F.broadcast(cases.select(*identity))
    evidence = (
        features.join(ids, list(identity), "left_semi")
        .select(
            *identity,
            "query",
            "product_title",
            F.col("label").alias("source_label"),
            *EVIDENCE_COLUMNS,
        )
        .withColumn("source_matched", F.lit(True))
    )
    return cases.join(evidence, list(identity), "left").fillna({"source_matched": False})


def assert_evidence(cases: DataFrame, identity=EXAMPLE_KEY) -> None:
    """Every case needs exactly one source row with the same label."""
    check = cases.agg(
        F.count_if(~F.col("source_matched")).alias("unmatched"),
        F.count_if(F.col("source_matched") & (F.col("label") != F.col("source_label"))).alias("relabelled"),
        (F.count("*") - F.count_distinct(*identity)).alias("repeated"),
    ).first()
    if check["unmatched"] or check["relabelled"] or check["repeated"]:
        raise ValueError(f"cases do not agree with the feature table: {check.asDict()}")


def annotate_cases(cases: DataFrame, per_cell: int = CASES_PER_CELL) -> DataFrame:
    """Add the selection reason, the pending status and the empty review fields."""
    reason = F.concat(
        F.lit("judged "),
        "label",
        F.lit(", predicted "),
        "prediction",
        F.lit(f": one of the first {per_cell} such errors by hash"),
    )
    return cases.select(
        "*",
        reason.alias("selection_reason"),
        F.lit("pending").alias("human_review_status"),
        *[F.lit("").alias(name) for name in REVIEW_FORM_FIELDS],
    )


def percentile_interval(df: DataFrame, column: str, confidence: float, *groups: str) -> DataFrame:
    """Linear-interpolated interval of the non-null values, and how many there are."""
    if not 0 < confidence < 1:
        raise ValueError("confidence must be in (0, 1)")
    alpha = (1 - confidence) / 2
    found = exact_quantiles(df, column, (alpha, 1 - alpha), *groups)
    return found.select(
        *groups,
        F.col("quantiles")[0].alias("low"),
        F.col("quantiles")[1].alias("high"),
        "n_valid",
    )
