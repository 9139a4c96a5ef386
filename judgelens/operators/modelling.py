"""Multinomial relevance classifier on the lexical features (Spark ML)."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from judgelens.constants import (
    CANDIDATES,
    FEATURES,
    LABELS,
    MAX_ITER,
    REG_PARAM,
    SCORED_COLUMNS,
    TOLERANCE,
)
from judgelens.operators import classification as C
from judgelens.sources.staging import stage


def feature_stages() -> Pipeline:
    """Assemble and standardise; the scaler learns from the fitted rows only."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="raw_features"),
            StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        ]
    )


def classifier(reg_param: float = REG_PARAM) -> LogisticRegression:
    return LogisticRegression(
        featuresCol="features",
        labelCol="target",
        weightCol="fit_weight",
        family="multinomial",
        regParam=reg_param,
        elasticNetParam=0.0,
        maxIter=MAX_ITER,
        tol=TOLERANCE,
    )


def training_weights(train: DataFrame) -> dict[str, float]:
    """Balancing weight of each class (at most four rows); all classes must occur."""
    classes = C.class_weights(train).limit(len(LABELS) + 1).collect()
    counted = {row["label"]: row["weight"] for row in classes}
    if set(counted) != set(LABELS):
        raise ValueError("training data must hold exactly the four classes")
    return {label: counted[label] for label in LABELS}


def fit_candidates(train: DataFrame, candidates=CANDIDATES) -> dict[str, PipelineModel]:
    """Fit every candidate; they share one scaler and differ in their row weights.

    Rows of one label and the same features add the same to the loss, so the
    solver gets each such vector once, with the weight of all its rows; the
    scaler, which knows no weights, learns from the rows. Nothing is cached
    here: the solver keeps its own standardised blocks.
    """
    weights = training_weights(train)
    encoded = C.encode_label(train).select("label", "target", *FEATURES)
    scaling = feature_stages().fit(encoded)
    alike = stage(encoded.groupBy("label", "target", *FEATURES).agg(F.count("*").alias("n_alike")), "training-vectors")
    vectors = scaling.transform(alike).select("label", "target", "features", "n_alike")
    models = {}
    for name, balanced in candidates:
        row_weight = C.with_weights(vectors, weights if balanced else None)
        solver = classifier(REG_PARAM * penalty_share(row_weight))
        fitted = solver.fit(row_weight.withColumn("fit_weight", F.col("fit_weight") * F.col("n_alike")))
        models[name] = PipelineModel([*scaling.stages, fitted])
    return models


def penalty_share(vectors: DataFrame) -> float:
    """What the penalty on vectors with the weights of all their rows must be, as a share of that on the rows.

    The solver penalises coefficients of features with unit deviation, and its
    variance is the weighted sum of squares over W - (sum of squared weights) / W.
    That sum and W are those of the rows; only the squared weights are not.
    """
    w, n = F.col("fit_weight"), F.col("n_alike")
    total, of_rows, of_vectors = vectors.agg(F.sum(n * w), F.sum(n * w * w), F.sum(n * w * n * w)).first()
    freedom = total - of_rows / total
    return (total - of_vectors / total) / freedom if freedom > 0 else 1.0


def fit_relevance_model(train: DataFrame, balanced: bool) -> PipelineModel:
    return fit_candidates(train, [("model", balanced)])["model"]


def score(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """Predicted label and probability of the first class, narrowed to the scored columns."""
    labels = F.array(*[F.lit(label) for label in LABELS])
    scored = model.transform(rows)
    return (
        scored.withColumn("p_e", F.get(vector_to_array("probability"), F.lit(0)))
        .withColumn("prediction", F.get(labels, F.col("prediction").cast("int")))
        .select(*SCORED_COLUMNS)
    )


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_coefficients(spark, model: PipelineModel) -> DataFrame:
    """Standardised coefficient of each label and feature, with the label's intercept.

    The model itself is the input: 4 x 17 numbers that the driver already holds.
    """
    fitted = model.stages[-1]
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    rows = [
        (label, feature, float(matrix[i, j]), float(intercepts[i]))
        for i, label in enumerate(LABELS)
        for j, feature in enumerate(FEATURES)
    ]
    return spark.createDataFrame(rows, "label string, feature string, coefficient double, intercept double")


def fit_summary(spark, name: str, model: PipelineModel, train: DataFrame) -> DataFrame:
    """Iterations of a fit with the rows and classes it saw."""
    iterations = model.stages[-1].summary.totalIterations
    return train.agg(
        F.count("*").alias("training_rows"), F.countDistinct("label").alias("class_count")
    ).select(F.lit(name).alias("model"), F.lit(iterations).alias("iterations"), "*")


def feature_moments(train: DataFrame) -> DataFrame:
    """Mean and sample deviation of every feature, as the scaler learns them."""
    moments = [
        part
        for name in FEATURES
        for part in (F.avg(name).alias(f"{name}_mean"), F.stddev_samp(name).alias(f"{name}_sd"))
    ]
    rows = [
        F.struct(F.lit(name).alias("feature"), F.col(f"{name}_mean").alias("mean"), F.col(f"{name}_sd").alias("sd"))
        for name in FEATURES
    ]
    return train.agg(*moments).select(F.inline(F.array(*rows)))


def compare_models(scored: dict[str, DataFrame]) -> DataFrame:
    """Accuracy and macro-F1 of each scored candidate; the best trained one is selected.

    Candidates keep their order, so the first wins a tie. The majority
    baseline is listed but never selected.
    """
    named = None
    for place, (name, frame) in enumerate(scored.items()):
        row = C.classification_summary(frame).select(F.lit(place).alias("place"), F.lit(name).alias("model"), "*")
        named = row if named is None else named.unionByName(row)
    named = stage(named, "compared")
    trained = F.col("model").isin(*[name for name, _ in CANDIDATES])
    best = named.filter(trained).agg(F.max_by("model", F.struct("macro_f1", -F.col("place")))).scalar()
    return named.withColumn("selected", F.col("model") == best).drop("place")


def recomputed(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """``p_check`` and ``label_check`` of each row by plain column arithmetic from the fitted numbers."""
    scaler, fitted = model.stages[-2], model.stages[-1]
    matrix, intercepts = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    mean, sd = scaler.mean.toArray(), scaler.std.toArray()
    scaled = [(F.col(name) - float(mean[j])) / float(sd[j]) if sd[j] else F.lit(0.0) for j, name in enumerate(FEATURES)]
    margins = [reduce(add, [float(matrix[i, j]) * x for j, x in enumerate(scaled)], F.lit(float(intercepts[i]))) for i in range(len(LABELS))]
    shifted = rows.withColumn("_z", F.array(*margins)).withColumn("_top", F.array_max("_z"))
    weights = F.transform("_z", lambda z: F.exp(z - F.col("_top")))
    share = F.get(weights, F.lit(0)) / F.aggregate(weights, F.lit(0.0), lambda a, b: a + b)
    best = F.get(F.array(*[F.lit(label) for label in LABELS]), (F.array_position("_z", F.col("_top")) - 1).cast("int"))
    return shifted.select(*rows.columns, share.alias("p_check"), best.alias("label_check"))


def objective_slopes(model: PipelineModel, train: DataFrame, weights: dict[str, float] | None) -> DataFrame:
    """Slope of the penalised, weighted log loss at the fitted coefficients: label, feature, slope.

    The penalty acts on coefficients of features with unit weighted deviation.
    """
    fitted = model.stages[-1]
    matrix = fitted.coefficientMatrix.toArray()
    rows = C.with_weights(PipelineModel(model.stages).transform(train), weights).select(
        "label", F.col("fit_weight").alias("w"), vector_to_array("features").alias("x"), vector_to_array("probability").alias("p")
    )
    x = [F.get("x", F.lit(j)) for j in range(len(FEATURES))]
    sums = [F.sum("w").alias("w"), F.sum(F.col("w") * F.col("w")).alias("ww")]
    sums += [F.sum(F.col("w") * v).alias(f"m{j}") for j, v in enumerate(x)] + [F.sum(F.col("w") * v * v).alias(f"s{j}") for j, v in enumerate(x)]
    for i, label in enumerate(LABELS):
        miss = F.col("w") * (F.get("p", F.lit(i)) - (F.col("label") == label).cast("double"))
        sums += [F.sum(miss * v).alias(f"g{i}_{j}") for j, v in enumerate(x)]
    total = rows.agg(*sums)
    out = []
    for j, feature in enumerate(FEATURES):
        variance = (F.col(f"s{j}") - F.col(f"m{j}") * F.col(f"m{j}") / F.col("w")) / (F.col("w") - F.col("ww") / F.col("w"))
        for i, label in enumerate(LABELS):
            slope = F.col(f"g{i}_{j}") / F.col("w") + REG_PARAM * float(matrix[i, j]) * variance
            out.append(F.struct(F.lit(label).alias("label"), F.lit(feature).alias("feature"), slope.alias("slope")))
    return total.select(F.inline(F.array(*out)))
