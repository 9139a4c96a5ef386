"""Long tables behind the two result charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.operators import classification as C
from judgelens.operators.review import review_expected_random, review_metrics


def budget_comparison(queue: DataFrame, intervals: DataFrame, budgets, interval_budget: float) -> DataFrame:
    """Errors found and yield per policy and budget; bounds where they were resampled."""
    found = F.col("n_errors_found").cast("double").alias("n_errors_found")
    columns = ["budget_fraction", "n_reviewed", found, "audit_yield"]
    priority = review_metrics(queue, budgets).select(F.lit("priority").alias("policy"), *columns)
    random = review_expected_random(queue, budgets).select(F.lit("random").alias("policy"), *columns)
    names = F.when(F.col("statistic") == "audit_yield", "priority").when(
        F.col("statistic") == "random_expected_yield", "random"
    )
    bounds = intervals.select(names.alias("policy"), F.lit(interval_budget).alias("budget_fraction"), "low", "high")
    return priority.unionByName(random).join(bounds.dropna(subset=["policy"]), ["policy", "budget_fraction"], "left")


def class_tradeoff(scored: DataFrame, baseline: DataFrame) -> DataFrame:
    """Accuracy, macro-F1 and per-class F1 of the model and the majority baseline."""
    def series(name: str, frame: DataFrame) -> DataFrame:
        values = [("accuracy", C.accuracy()), ("macro_f1", C.macro_f1())]
        values += [(f"f1_{label.lower()}", C.class_f1(label)) for label in C.LABELS]
        rows = [F.struct(F.lit(metric).alias("metric"), value.alias("value")) for metric, value in values]
        return C.contingency(frame).select(F.lit(name).alias("series"), F.inline(F.array(*rows)))

    return series("model", scored).unionByName(series("majority_baseline", baseline))
