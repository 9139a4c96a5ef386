"""Fixed-budget review of the pool predicted as exact.

The queue is ordered by ascending p_e, then example id; labels only score
what a budget finds. Row-level data is ranked once (see ``numbering``) and
then only filtered and summed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelens.constants import LABELS, RANDOM_REPEATS, REVIEW_BUDGETS, SEED
from judgelens.functions.hashing import sha_key
from judgelens.functions.text import ratio_or_null
from judgelens.operators.classification import predicted_exact_pool
from judgelens.operators.numbering import number_rows

ERROR_LABELS = LABELS[1:]
QUEUE_COLUMNS = ("example_id", "query_id", "p_e", "label")


def check_budgets(budgets) -> tuple[float, ...]:
    values = tuple(float(budget) for budget in budgets)
    if not all(math.isfinite(value) and 0 <= value <= 1 for value in values):
        raise ValueError("budget fractions must be finite and in [0, 1]")
    return values


def budget_list(budgets) -> Column:
    return F.array(*[F.lit(budget) for budget in check_budgets(budgets)])


def budget_count(size: Column, fraction: Column | float) -> Column:
    """floor(size * fraction) items."""
    fraction = fraction if isinstance(fraction, Column) else F.lit(fraction)
    return F.floor(size.cast("double") * fraction).cast("bigint")


def review_queue(scored: DataFrame, *extra: str) -> DataFrame:
    """The predicted-exact pool with its exact ``queue_rank``, counted from 1."""
    pool = predicted_exact_pool(scored).select(*QUEUE_COLUMNS, *extra)
    return number_rows(pool, ["p_e", "example_id"], "queue_rank")


def is_error() -> Column:
    return F.col("label") != LABELS[0]


def _pool_row(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count("*").alias("pool_size"),
        F.count_if(is_error()).alias("pool_errors"),
        *[F.count_if(F.col("label") == label).alias(f"pool_{label.lower()}") for label in ERROR_LABELS],
    )


def _scores(rows: DataFrame, found: Column, by_label: dict[str, Column], *more: Column) -> DataFrame:
    """Yield, recall and remainder columns; a zero denominator gives null."""
    size, errors, reviewed = F.col("pool_size"), F.col("pool_errors"), F.col("n_reviewed")
    return rows.select(
        "budget_fraction",
        "n_reviewed",
        found.alias("n_errors_found"),
        *[value.alias(name) for name, value in by_label.items()],
        ratio_or_null(found, reviewed).alias("audit_yield"),
        F.when(reviewed > 0, ratio_or_null(found, errors)).alias("error_recall"),
        (size - reviewed).alias("n_remaining"),
        (errors - found).alias("n_remaining_errors"),
        ratio_or_null(errors - found, size - reviewed).alias("remaining_error_rate"),
        *more,
    )


def pool_summary(queue: DataFrame) -> DataFrame:
    return _pool_row(queue).select(
        "pool_size", "pool_errors", ratio_or_null(F.col("pool_errors"), F.col("pool_size")).alias("pool_error_rate")
    )


def review_metrics(queue: DataFrame, budgets=REVIEW_BUDGETS) -> DataFrame:
    """What each budget finds when the head of the queue is reviewed.

    The cut rank of every budget is one number, so all budgets are summed in
    the same pass over the ranked queue.
    """
    budgets = check_budgets(budgets)
    size = queue.agg(F.count("*").alias("n")).scalar()
    sums = []
    for place, budget in enumerate(budgets):
        reached = F.col("queue_rank") <= budget_count(size, budget)
        sums += [
            F.count_if(reached & (F.col("label") == label)).alias(f"_{label}{place}")
            for label in ERROR_LABELS
        ]
    totals = queue.agg(F.count("*").alias("pool_size"), F.count_if(is_error()).alias("pool_errors"), *sums)
    rows = [
        F.struct(
            F.lit(budget).alias("budget_fraction"),
            budget_count(F.col("pool_size"), budget).alias("n_reviewed"),
            *[F.col(f"_{label}{place}").alias(f"errors_{label.lower()}") for label in ERROR_LABELS],
        )
        for place, budget in enumerate(budgets)
    ]
    per_budget = totals.select("pool_size", "pool_errors", F.inline(F.array(*rows)))
    by_label = {f"errors_{label.lower()}": F.col(f"errors_{label.lower()}") for label in ERROR_LABELS}
    found = sum(by_label.values(), F.lit(0).cast("bigint"))
    return _scores(per_budget, found, by_label)


def _budget_rows(pool: DataFrame, budgets) -> DataFrame:
    """One row per listed budget; ``budget_no``, its place in the list, tells equal budgets apart."""
    rows = pool.select("*", F.posexplode(budget_list(budgets)).alias("budget_no", "budget_fraction"))
    return rows.withColumn("n_reviewed", budget_count(F.col("pool_size"), F.col("budget_fraction")))


def review_expected_random(queue: DataFrame, budgets=REVIEW_BUDGETS) -> DataFrame:
    """Expectation and variance of the yield when the same budget is drawn at random."""
    rows = _budget_rows(_pool_row(queue), budgets)
    size, errors, reviewed = (F.col(n).cast("double") for n in ("pool_size", "pool_errors", "n_reviewed"))
    share = lambda count: F.coalesce(ratio_or_null(reviewed * count, size), F.lit(0.0))
    by_label = {
        f"errors_{label.lower()}": share(F.col(f"pool_{label.lower()}").cast("double"))
        for label in ERROR_LABELS
    }
    variance = ratio_or_null(
        errors * (size - errors) * (size - reviewed), reviewed * size * size * (size - 1)
    )
    return _scores(rows, share(errors), by_label, F.when(reviewed > 0, variance).alias("yield_variance"))


def review_random_draws(
    queue: DataFrame, budgets=REVIEW_BUDGETS, repeats: int = RANDOM_REPEATS, seed: int = SEED
) -> DataFrame:
    """Spread of the yield over repeated random reviews of the same size.

    The number of errors in a random review is hypergeometric, so only the
    pool counts are read from the data. Each repeat inverts the distribution
    at one seeded uniform number. The uniform numbers lie on a grid of 2^-32,
    and so no draw can fall where less than that is left: the support is
    listed 12 deviations and 40 values around the mean, beyond which lies less
    than 1e-30 of the mass. It grows with the deviation and not with the pool.
    """
    if repeats < 1:
        raise ValueError("repeats must be positive")
    rows = _budget_rows(_pool_row(queue), budgets)
    size, errors, k = (F.col(n).cast("double") for n in ("pool_size", "pool_errors", "n_reviewed"))
    mean = k * errors / size
    deviation = F.sqrt(mean * (size - errors) / size)
    reach = F.ceil(12 * deviation + 40).cast("bigint")
    bounded = rows.filter("n_reviewed > 0").select(
        "budget_no",
        "n_reviewed",
        "pool_size",
        "pool_errors",
        "budget_fraction",
        F.greatest(
            F.lit(0).cast("bigint"),
            F.col("n_reviewed") - (F.col("pool_size") - F.col("pool_errors")),
            F.floor(mean).cast("bigint") - reach,
        ).alias("low"),
        F.least("n_reviewed", "pool_errors", F.ceil(mean).cast("bigint") + reach).alias("high"),
    )
    support = bounded.select("*", F.explode(F.sequence("low", "high")).alias("found"))
    x = F.col("found").cast("double")
    step = F.log((errors - x + 1) * (k - x + 1) / (x * (size - errors - k + x)))
    by_budget = Window.partitionBy("budget_no")
    upto = by_budget.orderBy("found").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    mass = (
        support.withColumn("step", F.when(F.col("found") > F.col("low"), step).otherwise(0.0))
        .withColumn("log_mass", F.sum("step").over(upto))
        .withColumn("mass", F.exp(F.col("log_mass") - F.max("log_mass").over(by_budget)))
        .withColumn("level", F.sum("mass").over(upto) / F.sum("mass").over(by_budget))
    )
    key = F.concat_ws(":", F.col("budget_fraction").cast("string"), F.col("repeat").cast("string"))
    uniforms = bounded.select(
        "budget_no", "budget_fraction", "n_reviewed", "low", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")
    ).withColumn("level", (sha_key(key, seed) + 0.5) / 4294967296.0)
    steps = mass.select("budget_no", "level", F.lit(1).alias("is_step"), F.lit(None).cast("bigint").alias("low"), F.lit(None).cast("bigint").alias("n_reviewed"))
    asked = uniforms.select("budget_no", "level", F.lit(0).alias("is_step"), "low", "n_reviewed")
    below = by_budget.orderBy("level", "is_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    draws = (
        steps.unionByName(asked)
        .withColumn("passed", F.sum("is_step").over(below))
        .filter("is_step = 0")
        .select("budget_no", "n_reviewed", (F.col("low") + F.col("passed")).alias("found"))
    )
    audit_yield = F.col("found") / F.col("n_reviewed")
    spread = draws.groupBy("budget_no").agg(
        F.count("*").alias("repeats"),
        (F.sum("found") / F.sum("n_reviewed")).alias("yield_mean"),
        F.percentile(audit_yield, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
    )
    return (
        rows.select("budget_no", "budget_fraction")
        .join(spread, "budget_no", "left")
        .select(
            "budget_fraction",
            F.coalesce("repeats", F.lit(0).cast("bigint")).alias("repeats"),
            "yield_mean",
            F.col("q")[0].alias("yield_p025"),
            F.col("q")[1].alias("yield_p975"),
        )
    )
