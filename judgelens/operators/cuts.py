"""Budget cuts of many weighted queues at once, by descent on ranks.

The ranks of a queue are cut into at most ``FAN`` runs of equal width; the sums
of the runs tell in which one a budget ends. That run is cut into ``FAN`` narrower
ones, and so on down to a single rank, which may be taken in part. Widths are
powers of the fan, so a run has the same number in every queue. Each turn deals
the rows of open runs only, and no window holds more than ``FAN`` rows, whatever
the length of the queue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelens.functions.text import ratio_or_null
from judgelens.operators.review import budget_count, budget_list
from judgelens.sources.staging import stage

FAN = 256
CUT = ("budget_no", "budget_fraction", "n_reviewed", "queue_items", "queue_errors")


def run_widths(n_ranks: int, fan: int = FAN) -> list[int]:
    """Ranks of a run in each turn: at most ``fan`` runs at first, single ranks at last."""
    if fan < 2:
        raise ValueError("a run must be cut into at least two")
    widths = [1]
    while widths[-1] * fan < n_ranks:
        widths.append(widths[-1] * fan)
    return widths[::-1]


def run_of(width: int) -> Column:
    return F.expr(f"(queue_rank - 1) div {width}L")


def run_sums(rows: DataFrame, group: str, width: int) -> DataFrame:
    """(group, run) sums of rows that carry queue_rank, weight and is_error."""
    return rows.groupBy(group, run_of(width).alias("run")).agg(
        F.sum("weight").alias("items"), F.sum(F.col("weight") * F.col("is_error")).alias("errors")
    )


def _descend(open_: DataFrame, group: str) -> DataFrame:
    """The run in which each open budget ends, from rows (group, CUT, errors_ahead, still_needed, run, items, errors)."""
    ahead = Window.partitionBy(group, "budget_no").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    placed = open_.withColumns(
        {"_items": F.coalesce(F.sum("items").over(ahead), zero), "_errors": F.coalesce(F.sum("errors").over(ahead), zero)}
    )
    ends_here = (F.col("_items") < F.col("still_needed")) & (F.col("still_needed") <= F.col("_items") + F.col("items"))
    return placed.where(ends_here).select(
        group,
        *CUT,
        "run",
        (F.col("errors_ahead") + F.col("_errors")).alias("errors_ahead"),
        (F.col("still_needed") - F.col("_items")).alias("still_needed"),
        F.col("errors").alias("run_errors"),
    )


def first_cuts(sums: DataFrame, group: str, budgets) -> DataFrame:
    """For each group and budget: its size, and the widest run where the budget ends; groups without budget are left out."""
    whole = Window.partitionBy(group)
    totals = sums.select(
        "*", F.sum("items").over(whole).alias("queue_items"), F.sum("errors").over(whole).alias("queue_errors")
    )
    zero = F.lit(0).cast("bigint")
    counted = (
        totals.select("*", F.posexplode(budget_list(budgets)).alias("budget_no", "budget_fraction"))
        .withColumn("n_reviewed", budget_count(F.col("queue_items"), F.col("budget_fraction")))
        .withColumns({"errors_ahead": zero, "still_needed": F.col("n_reviewed")})
    )
    return _descend(counted, group)


def next_cuts(cuts: DataFrame, sums: DataFrame, group: str, fan: int = FAN) -> DataFrame:
    """The same budgets in the narrower runs of ``sums``."""
    parents = cuts.select(group, *CUT, F.col("run").alias("_parent"), "errors_ahead", "still_needed")
    children = sums.withColumn("_parent", F.expr(f"run div {fan}L"))
    return _descend(children.join(parents, [group, "_parent"]), group)


def yields_at(cuts: DataFrame, group: str) -> DataFrame:
    """Yields of cuts that have come down to single ranks; all of a rank is an error, or nothing."""
    found = F.col("errors_ahead") + F.when(F.col("run_errors") > 0, F.col("still_needed")).otherwise(0)
    return cuts.select(group, *CUT, found.alias("n_errors_found")).select(
        "*",
        ratio_or_null(F.col("n_errors_found"), F.col("n_reviewed")).alias("priority_yield"),
        ratio_or_null(F.col("queue_errors"), F.col("queue_items")).alias("random_yield"),
    )


def weighted_queue_yield(rows: DataFrame, group: str, budgets, fan: int = FAN) -> DataFrame:
    """Priority and random yield of each weighted queue; groups without budget are left out.

    ``rows`` carry group, queue_rank, a positive weight and is_error (0 or 1); a rank occurs
    at most once in a group.
    """
    rows = rows.select(group, "queue_rank", "weight", "is_error")
    widths = run_widths(rows.agg(F.max("queue_rank")).first()[0] or 0, fan)
    # One row per group and budget; stored, so that its size is known to the joins.
    cuts = stage(first_cuts(run_sums(rows, group, widths[0]), group, budgets), "cuts")
    for wide, width in zip(widths, widths[1:]):
        open_runs = cuts.select(group, F.col("run").alias("_parent")).distinct()
        rows = rows.withColumn("_parent", run_of(wide)).join(open_runs, [group, "_parent"], "left_semi").drop("_parent")
        rows = stage(rows, "cut-rows")
        cuts = stage(next_cuts(cuts, run_sums(rows, group, width), group, fan), "cuts")
    return yields_at(cuts, group).drop("budget_no")
