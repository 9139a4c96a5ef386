"""Train, select, freeze, and evaluate once on the test split.

Every scored table is written and read back, so its metrics, slices and
replicates share one scoring pass and nothing but metric rows reaches the
driver.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from judgelens.constants import BOOTSTRAP_BUDGET, BOOTSTRAP_REPLICATES, REVIEW_BUDGETS
from judgelens.operators import classification as C
from judgelens.operators import modelling as M
from judgelens.operators import charts, provenance, review, slices
from judgelens.operators.bootstrap import bootstrap_intervals
from judgelens.operators.slices import SLICE_INPUTS
from judgelens.plans.parallel import run_all
from judgelens.sources.files import artifact_manifest
from judgelens.sources.staging import stage
from judgelens.sources.tables import read_features, read_scored, read_split, write_metrics, write_scored


def train(spark: SparkSession, root: str) -> DataFrame:
    """Fit both candidates on train, compare on validation, freeze; returns the comparison.

    Expects the feature table in ``root/features``; writes models, scored
    validation tables, metrics, the manifest and the frozen record below root.
    """
    features = f"{root}/features"
    fit_rows = read_split(spark, features, "train")
    valid = read_split(spark, features, "validation")
    scored = {"majority": C.baseline_scored(fit_rows, valid)}
    models = M.fit_candidates(fit_rows)

    def keep(name: str) -> None:
        M.save_model(models[name], f"{root}/models/{name}")
        write_scored(M.score(models[name], valid), f"{root}/scored/{name}_validation")
        write_metrics(M.model_coefficients(spark, models[name]), f"{root}/metrics/{name}_coefficients")

    run_all(spark, {name: partial(keep, name) for name in models})
    for name in models:
        scored[name] = read_scored(spark, f"{root}/scored/{name}_validation")

    def report(name: str) -> None:
        C.assert_scored(scored[name])
        write_metrics(review.review_metrics(review.review_queue(scored[name])), f"{root}/metrics/{name}_validation_review")
        if name in models:
            write_metrics(M.fit_summary(spark, name, models[name], fit_rows), f"{root}/metrics/{name}_fit")

    run_all(spark, {name: partial(report, name) for name in scored})
    write_metrics(C.class_weights(fit_rows), f"{root}/metrics/class_weights")
    comparison = M.compare_models(scored)
    write_metrics(comparison, f"{root}/metrics/validation")
    comparison = spark.read.schema(comparison.schema).json(f"{root}/metrics/validation")
    selected = comparison.filter("selected").first()["model"]
    manifest = artifact_manifest(spark, root, [f"models/{selected}", "features"])
    manifest.write.mode("overwrite").parquet(f"{root}/manifest")
    record = provenance.freeze_record(
        comparison, fit_rows, read_features(spark, features), spark.read.parquet(f"{root}/manifest")
    )
    write_metrics(record, f"{root}/freeze")
    return comparison


def evaluate(
    spark: SparkSession,
    root: str,
    budgets=REVIEW_BUDGETS,
    replicates: int = BOOTSTRAP_REPLICATES,
) -> dict[str, DataFrame]:
    """Score the test split once with the frozen model and measure it."""
    record = spark.read.json(f"{root}/freeze").first()
    selected = record["selected_model"]
    frozen = spark.read.parquet(f"{root}/manifest")
    provenance.verify_freeze(frozen, artifact_manifest(spark, root, [f"models/{selected}", "features"]))
    test = read_split(spark, f"{root}/features", "test")
    write_scored(M.score(M.load_model(f"{root}/models/{selected}"), test), f"{root}/scored/test")
    scored = read_scored(spark, f"{root}/scored/test")
    C.assert_scored(scored)
    queue = review.review_queue(scored, *SLICE_INPUTS)
    cube = slices.slice_cube(scored)
    cells, by_slice = slices.cells_of(cube), slices.slice_cells(cube)
    found = stage(slices.slice_yields(scored, budgets, queue), "slice-yields")
    majority = C.baseline_scored(read_split(spark, f"{root}/features", "train"), test)
    measures = {
        "classification": lambda: C.summary_of(cells),
        "per_class": lambda: C.per_class_of(cells),
        "confusion": lambda: C.matrix_of(cells),
        "predicted_exact": lambda: C.exact_of(cells),
        "review": lambda: review.review_metrics(queue, budgets),
        "review_expected_random": lambda: review.review_expected_random(queue, budgets),
        "review_random_draws": lambda: review.review_random_draws(queue, budgets),
        "uncertainty": lambda: bootstrap_intervals(scored, BOOTSTRAP_BUDGET, replicates, queue=queue),
        "slices": lambda: slices.slice_metrics(scored, budgets, by_slice, found),
        "slice_classes": lambda: slices.slice_classes(scored, by_slice),
        "slice_confusion": lambda: slices.slice_confusion(scored, by_slice),
        "slice_review": lambda: slices.slice_review(scored, budgets, found),
        "slice_random": lambda: slices.slice_random(scored, budgets, by_slice),
        "majority": lambda: C.classification_summary(majority),
        "class_tradeoff": lambda: charts.class_tradeoff(scored, majority),
    }

    def measure(name: str) -> DataFrame:
        metrics, path = measures[name](), f"{root}/metrics/test_{name}"
        write_metrics(metrics, path)
        return spark.read.schema(metrics.schema).json(path)

    results = run_all(spark, {name: partial(measure, name) for name in measures})
    measures["budget_comparison"] = lambda: charts.budget_comparison(queue, results["uncertainty"], budgets, BOOTSTRAP_BUDGET)
    return results | {"budget_comparison": measure("budget_comparison")}
