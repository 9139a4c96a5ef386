"""A certified minimum of the penalised loss behind a fitted model.

The solver stops once the loss hardly falls, which says little about how far its
coefficients are from the best ones. Newton steps from there take gradient and
curvature of all coefficients from one pass each: tasks add up fixed-size sums,
and a few thousand numbers reach the driver, whatever the number of rows. The
penalty makes the loss strongly convex in the coefficients u of features with
unit weighted deviation, with modulus ``reg``, and so is the loss with the best
intercepts for u. So |u - best u| <= |slope| / reg for the slope of the latter,
which is that of the former once the intercepts are moved to their best (in
first order; they are there up to rounding when the steps end).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from judgelens.constants import FEATURES, LABELS, REG_PARAM
from judgelens.operators import classification as C

BOUND, TURNS = 1e-9, 12


@dataclass
class Optimum:
    """Coefficients (labels x features) and intercepts near the minimum; how far the minimum can be, and how far the fit was."""

    coefficients: np.ndarray
    intercepts: np.ndarray
    error_bounds: np.ndarray  # per feature, for the coefficients of every label
    fit_errors: np.ndarray  # fitted less certified coefficients
    intercept_slope: float
    turns: int


def _sums(rows: DataFrame, mean: np.ndarray, sd: np.ndarray, matrix: np.ndarray, intercepts: np.ndarray) -> list[np.ndarray]:
    """Weights, squared weights, first and second moments, gradient and curvature over all rows."""
    k, d = matrix.shape
    shapes = [(1,), (1,), (d,), (d,), (k, d + 1), (k * (d + 1), k * (d + 1))]
    both = np.column_stack([matrix, intercepts])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [np.zeros(shape) for shape in shapes]
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            w = batch.column(1).to_numpy(zero_copy_only=False)
            x = np.column_stack([batch.column(2 + j).to_numpy(zero_copy_only=False) for j in range(d)])
            x = np.divide(x - mean, sd, out=np.zeros_like(x), where=sd > 0)
            one = np.column_stack([x, np.ones(len(x))])
            z = one @ both.T
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            miss = w[:, None] * (p - np.eye(k)[label])
            curvature = np.zeros((k, d + 1, k, d + 1))
            for a in range(k):
                for b in range(k):
                    share = w * p[:, a] * ((a == b) - p[:, b])
                    curvature[a, :, b, :] = one.T @ (share[:, None] * one)
            parts = [w.sum(keepdims=True), (w * w).sum(keepdims=True), w @ x, w @ (x * x), miss.T @ one, curvature.reshape(shapes[-1])]
            total = [t + part for t, part in zip(total, parts)]
        flat = np.concatenate([t.ravel() for t in total])
        yield pa.RecordBatch.from_pydict({"place": np.arange(len(flat)), "value": flat})

    n = sum(int(np.prod(shape)) for shape in shapes)
    flat = np.zeros(n)
    for place, value in rows.mapInArrow(add_up, "place long, value double").groupBy("place").agg(F.sum("value")).collect():  # n rows
        flat[place] = value
    out, at = [], 0
    for shape in shapes:
        size = int(np.prod(shape))
        out.append(flat[at : at + size].reshape(shape))
        at += size
    return out


def certify(
    model: PipelineModel, train: DataFrame, weights: dict[str, float] | None, reg: float = REG_PARAM, bound: float = BOUND, turns: int = TURNS
) -> Optimum:
    """Newton steps from a fitted model until its distance from the minimum is proven to be at most ``bound``."""
    scaler, fitted = model.stages[-2], model.stages[-1]
    mean, sd = scaler.mean.toArray(), scaler.std.toArray()
    first = fitted.coefficientMatrix.toArray()
    matrix, intercepts = first.copy(), fitted.interceptVector.toArray().copy()
    places = F.create_map(*[F.lit(x) for i, label in enumerate(LABELS) for x in (label, i)])
    rows = C.with_weights(train, weights).select(places[F.col("label")].alias("label"), "fit_weight", *FEATURES)
    k, d = matrix.shape
    for turn in range(turns + 1):
        w, ww, m, s, gradient, curvature = _sums(rows, mean, sd, matrix, intercepts)
        variance = np.maximum((s - m * m / w) / (w - ww / w), 0)
        moving = variance > 0
        slope = gradient / w
        slope[:, :d] += reg * matrix * variance
        deviation = np.sqrt(np.where(moving, variance, 1))
        full = curvature / w + np.diag(np.column_stack([np.tile(reg * variance, (k, 1)), np.zeros(k)]).ravel())
        by_part = full.reshape(k, d + 1, k, d + 1)
        to_best = np.linalg.pinv(by_part[:, d, :, d], rcond=1e-12, hermitian=True) @ slope[:, d]
        reduced = slope[:, :d] - by_part[:, :d, :, d] @ to_best
        distance = np.linalg.norm(reduced[:, moving] / deviation[moving]) / reg
        if distance <= bound or turn == turns:
            break
        # A constant added to all intercepts, and a feature that never varies, change nothing: the pseudo-inverse leaves them alone.
        step = (np.linalg.pinv(full, rcond=1e-12, hermitian=True) @ -slope.ravel()).reshape(k, d + 1)
        matrix, intercepts = matrix + step[:, :d], intercepts + step[:, d]
    return Optimum(matrix, intercepts, np.where(moving, distance / deviation, 0.0), first - matrix, float(np.abs(slope[:, d]).max()), turn)


def optimum_table(spark: SparkSession, optimum: Optimum) -> DataFrame:
    """(label, feature, coefficient, error_bound, fit_error), one row per coefficient."""
    rows = [
        (label, feature, float(optimum.coefficients[i, j]), float(optimum.error_bounds[j]), float(optimum.fit_errors[i, j]))
        for i, label in enumerate(LABELS)
        for j, feature in enumerate(FEATURES)
    ]
    return spark.createDataFrame(rows, "label string, feature string, coefficient double, error_bound double, fit_error double")
