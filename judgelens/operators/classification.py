"""Fixed-label classification metrics of scored pairs.

Everything follows from one contingency row per group: 16 counts, one per
(label, prediction) cell, from a single pass with map-side combine. Absent
classes are zeros by construction, so no grid has to be joined in.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from judgelens.constants import EXAMPLE_KEY, LABELS
from judgelens.functions.text import ratio_or_null
from judgelens.operators.audits import outside
from judgelens.operators.features import require_columns


def cell(label: str, prediction: str) -> str:
    return f"n_{label}{prediction}".lower()


CELLS = tuple(cell(label, prediction) for label in LABELS for prediction in LABELS)


def total(names) -> Column:
    return reduce(add, [F.col(name) for name in names])


def validate_scored(scored: DataFrame, identity=EXAMPLE_KEY) -> DataFrame:
    """Violations of each rule on scored pairs, from one pass plus the count of repeated ``identity`` columns."""
    require_columns(scored, [*identity, "example_id", "query_id", "label", "prediction", "p_e"], "validate_scored")
    p_e = F.col("p_e")
    unsound = p_e.isNull() | F.isnan(p_e) | ~F.coalesce(p_e.between(0.0, 1.0), F.lit(False))
    repeated = (
        scored.filter(F.col("example_id").isNotNull())
        .groupBy(*identity)
        .agg(F.count("*").alias("n"))
        .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("n"))
    )
    return scored.agg(
        F.count("*").alias("row_count"),
        F.count_if(outside("label", LABELS)).alias("unknown_label"),
        F.count_if(outside("prediction", LABELS)).alias("unknown_prediction"),
        F.count_if(F.col("query_id").isNull()).alias("missing_query_id"),
        F.count_if(F.col("example_id").isNull()).alias("missing_example_id"),
        F.count_if(unsound).alias("unsound_p_e"),
    ).select("*", repeated.scalar().alias("repeated_example_id"))


def assert_scored(scored: DataFrame, identity=EXAMPLE_KEY) -> None:
    found = validate_scored(scored, identity).first().asDict()
    broken = {name: n for name, n in found.items() if name != "row_count" and n}
    if broken:
        raise ValueError(f"scored pairs are not sound (ids must be unique, p_e in [0, 1]): {broken}")


def contingency(scored: DataFrame, *groups: str) -> DataFrame:
    """The 16 cell counts of each group; without groups one row, even for no input.

    Rows with an unknown or missing label or prediction are in no cell: reading
    the counts of their group then raises an error.
    """
    counts = [
        F.count_if((F.col("label") == label) & (F.col("prediction") == prediction)).alias(
            cell(label, prediction)
        )
        for label in LABELS
        for prediction in LABELS
    ]
    counted = scored.groupBy(*groups).agg(*counts, F.count("*").alias("_rows")).withColumn("_cells", total(CELLS))
    whole = F.col("_cells") == F.col("_rows")
    refuse = F.raise_error(F.lit("scored pairs hold unknown or missing labels or predictions")).cast("bigint")
    return counted.select(*groups, *[F.when(whole, F.col(name)).otherwise(refuse).alias(name) for name in CELLS])


def query_contingency(scored: DataFrame) -> DataFrame:
    return contingency(scored, "query_id")


def matrix_of(cells: DataFrame, *groups: str) -> DataFrame:
    rows = [
        F.struct(
            F.lit(label).alias("label"),
            F.lit(prediction).alias("prediction"),
            F.col(cell(label, prediction)).alias("n"),
        )
        for label in LABELS
        for prediction in LABELS
    ]
    return cells.select(*groups, F.inline(F.array(*rows)))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Dense 16-row matrix: label is the judged class, prediction the predicted one."""
    return matrix_of(contingency(scored))


def support(label: str) -> Column:
    return total(cell(label, other) for other in LABELS)


def predicted(label: str) -> Column:
    return total(cell(other, label) for other in LABELS)


def class_f1(label: str) -> Column:
    score = ratio_or_null(2 * F.col(cell(label, label)), support(label) + predicted(label))
    return F.coalesce(score, F.lit(0.0))


def n_rows() -> Column:
    return total(CELLS)


def accuracy() -> Column:
    return ratio_or_null(total(cell(label, label) for label in LABELS), n_rows())


def macro_f1() -> Column:
    """Mean F1 over all four classes, absent ones included; null without rows."""
    mean = reduce(add, [class_f1(label) for label in LABELS]) / len(LABELS)
    return F.when(n_rows() > 0, mean)


def per_class_of(cells: DataFrame, *groups: str) -> DataFrame:
    rows = []
    for label in LABELS:
        correct = F.col(cell(label, label))
        rows.append(
            F.struct(
                F.lit(label).alias("label"),
                support(label).alias("support"),
                predicted(label).alias("predicted"),
                ratio_or_null(correct, predicted(label)).alias("precision"),
                ratio_or_null(correct, support(label)).alias("recall"),
                class_f1(label).alias("f1"),
            )
        )
    return cells.select(*groups, F.inline(F.array(*rows)))


def per_class_metrics(scored: DataFrame) -> DataFrame:
    """Support, predictions, precision, recall and F1 of each of the four classes."""
    return per_class_of(contingency(scored))


def summary_of(cells: DataFrame, *groups: str) -> DataFrame:
    return cells.select(
        *groups,
        n_rows().alias("n_rows"),
        accuracy().alias("accuracy"),
        macro_f1().alias("macro_f1"),
    )


def classification_summary(scored: DataFrame, *groups: str) -> DataFrame:
    return summary_of(contingency(scored, *groups), *groups)


def exact_of(cells: DataFrame) -> DataFrame:
    exact = LABELS[0]
    errors = predicted(exact) - F.col(cell(exact, exact))
    return cells.select(
        predicted(exact).alias("pool_size"),
        ratio_or_null(predicted(exact), n_rows()).alias("coverage"),
        errors.alias("errors"),
        ratio_or_null(errors, predicted(exact)).alias("error_rate"),
        *[F.col(cell(label, exact)).alias(f"errors_{label.lower()}") for label in LABELS[1:]],
    )


def predicted_exact_summary(scored: DataFrame) -> DataFrame:
    """Size, coverage and errors of the pool predicted as the first class."""
    return exact_of(contingency(scored))


def error_rows(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("label") != F.col("prediction"))


def predicted_exact_pool(scored: DataFrame) -> DataFrame:
    return scored.filter(F.col("prediction") == LABELS[0])


def encode_label(df: DataFrame) -> DataFrame:
    """Add ``target``, the class index of the label as a double; null if unknown."""
    pairs = [part for i, label in enumerate(LABELS) for part in (F.lit(label), F.lit(float(i)))]
    return df.withColumn("target", F.try_element_at(F.create_map(*pairs), F.col("label")))


def class_weights(df: DataFrame) -> DataFrame:
    """Count and balancing weight n / (4 * count) of each class in the data."""
    counts = df.groupBy("label").agg(F.count("*").alias("class_count"))
    # A window over the few grouped counts, not a second scan.
    whole = F.sum("class_count").over(Window.partitionBy(F.lit(0)))
    weight = whole.cast("double") / (len(LABELS) * F.col("class_count")).cast("double")
    return counts.withColumn("weight", weight)


def with_weights(df: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Add ``fit_weight`` from a class-to-weight mapping; 1.0 without one."""
    if weights is None:
        return df.withColumn("fit_weight", F.lit(1.0))
    pairs = [part for label, weight in weights.items() for part in (F.lit(label), F.lit(weight))]
    return df.withColumn("fit_weight", F.try_element_at(F.create_map(*pairs), F.col("label")))


def majority_baseline(df: DataFrame) -> DataFrame:
    """The most frequent label (ties in class order) and the share of the first class."""
    counts = {label: F.count_if(F.col("label") == label) for label in LABELS}
    tally = df.agg(
        F.count("*").alias("n"), *[count.alias(f"n_{label}") for label, count in counts.items()]
    )
    largest = F.greatest(*[F.col(f"n_{label}") for label in LABELS])
    majority = F.coalesce(*[F.when(F.col(f"n_{label}") == largest, label) for label in LABELS])
    return tally.select(
        F.when(F.col("n") > 0, majority).alias("prediction"),
        ratio_or_null(F.col(f"n_{LABELS[0]}"), F.col("n")).alias("p_e"),
    )


def baseline_scored(train: DataFrame, rows: DataFrame) -> DataFrame:
    """Score rows with the constant majority prediction of the train split."""
    baseline = majority_baseline(train)
    return rows.drop("prediction", "p_e").select(
        "*",
        baseline.select("prediction").scalar().alias("prediction"),
        baseline.select("p_e").scalar().alias("p_e"),
    )
