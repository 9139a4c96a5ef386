"""Metrics of overlapping slices of the scored pairs, all slices in one pass."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import REVIEW_BUDGETS
from judgelens.functions.text import ratio_or_null
from judgelens.operators import classification as C
from judgelens.operators.cuts import weighted_queue_yield
from judgelens.operators.review import budget_count, budget_list, is_error, review_queue
from judgelens.sources.staging import stage

# Slice names of the study.
SLICES = {
    "query_0_2_tokens": "query_token_count <= 2",
    "query_3_plus_tokens": "query_token_count >= 3",
    "query_contains_digits": "query_has_number = 1",
    "query_no_digits": "query_has_number = 0",
    "numeric_mismatch": "numeric_mismatch = 1",
    "brand_missing": "brand_missing = 1",
    "brand_present": "brand_missing = 0",
    "product_seen_train": "product_seen_train",
    "product_unseen_train": "NOT product_seen_train",
}
SLICE_INPUTS = ("query_token_count", "query_has_number", "numeric_mismatch", "brand_missing", "product_seen_train")


def slice_tags(rows: DataFrame) -> DataFrame:
    """One row per pair and slice it belongs to, with the slice name in ``slice``."""
    names = [F.when(F.expr(rule), F.lit(name)) for name, rule in SLICES.items()]
    return rows.select("*", F.explode(F.array_compact(F.array(*names))).alias("slice"))


def percent(budget: float) -> str:
    """A column suffix of its own for every budget: 0.05 is 05, 0.051 is 5_1."""
    return f"{budget * 100:.10g}".replace(".", "_").zfill(2)


def slice_grid(spark) -> DataFrame:
    names = F.array(*[F.lit(name) for name in SLICES])
    return spark.range(0, 1, 1, 1).select(F.explode(names).alias("slice"))


def slice_cube(scored: DataFrame) -> DataFrame:
    """The 16 cells of every set of slices that pairs have in common (``slices``), as a staged table.

    One pass over the pairs gives at most 2^9 rows, and they hold the cells of
    each slice and of all pairs.
    """
    names = [F.when(F.expr(rule), F.lit(name)) for name, rule in SLICES.items()]
    return stage(C.contingency(scored.withColumn("slices", F.array_compact(F.array(*names))), "slices"), "slice-cube")


def cells_of(cube: DataFrame) -> DataFrame:
    """The cells of all pairs: one row, also for none."""
    zero = F.lit(0).cast("bigint")
    return cube.agg(*[F.coalesce(F.sum(name), zero).alias(name) for name in C.CELLS])


def slice_cells(cube: DataFrame) -> DataFrame:
    """The cells of each slice that has pairs."""
    return cube.withColumn("slice", F.explode("slices")).groupBy("slice").agg(*[F.sum(name).alias(name) for name in C.CELLS])


def slice_metrics(
    scored: DataFrame, budgets=REVIEW_BUDGETS, cells: DataFrame | None = None, found: DataFrame | None = None
) -> DataFrame:
    """Classification and review metrics of every slice; empty slices stay as rows.

    ``cells`` (``slice_cells``) and ``found`` (``slice_yields``) where the caller has them.
    """
    exact = C.LABELS[0]
    cells = slice_cells(slice_cube(scored)) if cells is None else cells
    quality = cells.select(
        "slice",
        C.n_rows().alias("n_rows"),
        C.predicted(exact).alias("pool_size"),
        (C.predicted(exact) - F.col(C.cell(exact, exact))).alias("pool_errors"),
        C.accuracy().alias("accuracy"),
        C.macro_f1().alias("macro_f1"),
    )
    found = slice_yields(scored, budgets) if found is None else found
    columns = [
        F.max(F.when(F.col("budget_fraction") == budget, F.col("priority_yield"))).alias(f"yield_{percent(budget)}")
        for budget in dict.fromkeys(budgets)
    ]
    yields = found.groupBy("slice").agg(*columns)
    zero = {"n_rows": 0, "pool_size": 0, "pool_errors": 0}
    return (
        slice_grid(scored.sparkSession)
        .join(quality, "slice", "left")
        .join(yields, "slice", "left")
        .fillna(zero)
    )


def slice_yields(scored: DataFrame, budgets, queue: DataFrame | None = None) -> DataFrame:
    """What each budget finds in the queue of each slice, cut by run sums."""
    queue = review_queue(scored, *SLICE_INPUTS) if queue is None else queue
    rows = slice_tags(queue).select(
        "slice",
        "queue_rank",
        F.lit(1).cast("bigint").alias("weight"),
        is_error().cast("bigint").alias("is_error"),
    )
    return weighted_queue_yield(rows, "slice", budgets)


def slice_classes(scored: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Support, predictions, precision, recall and F1 of each class in each slice that has rows."""
    return C.per_class_of(slice_cells(slice_cube(scored)) if cells is None else cells, "slice")


def slice_confusion(scored: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """The 16 cells of each slice that has rows."""
    return C.matrix_of(slice_cells(slice_cube(scored)) if cells is None else cells, "slice")


def slice_review(scored: DataFrame, budgets=REVIEW_BUDGETS, found: DataFrame | None = None) -> DataFrame:
    """One row per slice and budget that reviews at least one pair."""
    yields = slice_yields(scored, budgets) if found is None else found
    found, errors = F.col("n_errors_found"), F.col("queue_errors")
    rest = F.col("queue_items") - F.col("n_reviewed")
    return yields.select(
        "slice",
        "budget_fraction",
        "n_reviewed",
        "n_errors_found",
        F.col("priority_yield").alias("audit_yield"),
        ratio_or_null(found, errors).alias("error_recall"),
        rest.alias("n_remaining"),
        (errors - found).alias("n_remaining_errors"),
        ratio_or_null(errors - found, rest).alias("remaining_error_rate"),
    )


def slice_random(scored: DataFrame, budgets=REVIEW_BUDGETS, cells: DataFrame | None = None) -> DataFrame:
    """Expectation and variance of the yield of a random review of each slice and budget."""
    exact = C.LABELS[0]
    cells = slice_cells(slice_cube(scored)) if cells is None else cells
    pools = cells.select(
        "slice", C.predicted(exact).alias("pool_size"), (C.predicted(exact) - F.col(C.cell(exact, exact))).alias("pool_errors")
    )
    rows = pools.select("*", F.explode(budget_list(budgets)).alias("budget_fraction"))
    n, e = F.col("pool_size").cast("double"), F.col("pool_errors").cast("double")
    k = budget_count(F.col("pool_size"), F.col("budget_fraction"))
    variance = ratio_or_null(e * (n - e) * (n - k), k * n * n * (n - 1))
    return rows.select(
        "slice",
        "budget_fraction",
        k.alias("n_reviewed"),
        F.coalesce(ratio_or_null(k * e, n), F.lit(0.0)).alias("expected_errors"),
        F.when(k > 0, e / n).alias("expected_yield"),
        F.when(k > 0, variance).alias("yield_variance"),
    )
