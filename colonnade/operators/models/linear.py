"""Linear models: logistic regression, least squares and its penalised forms, discriminant
analysis, and margin models (support vectors)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, functions as F

from colonnade.operators.models.common import (
    FEATURES, LABEL, Scored, class_count, class_moments, linear_score, ml_classifier, ml_regressor, scorer, with_array, with_class_scores, within_scatter,
)


def logistic_regression(df: DataFrame, c: float = 1.0, max_iter: int = 200, weight: str | None = None) -> Scored:
    """L2-penalised (multinomial) logistic regression; the penalty is 1/(C n) per row."""
    options = {"weightCol": weight} if weight else {}
    n = df.agg(F.sum(weight)).first()[0] if weight else df.count()
    return ml_classifier(LogisticRegression(regParam=1.0 / (c * n), standardization=False, maxIter=max_iter, tol=1e-8, **options).fit(df))


def linear_discriminant(df: DataFrame) -> Scored:
    """Gaussian classes with one pooled covariance (n - k degrees of freedom)."""
    n, mean, _ = class_moments(df)
    cov = within_scatter(df, mean) / (n.sum() - len(n))
    inverse = np.linalg.pinv(cov)
    weights = mean @ inverse
    offsets = np.log(n / n.sum()) - 0.5 * np.einsum("ij,ij->i", weights, mean)
    return Scored("class lines", weights=weights, intercepts=offsets)


@scorer("class lines")
def score_class_lines(state: dict, rows: DataFrame) -> DataFrame:
    """Softmax of one linear score per class."""
    lines = [linear_score(F.col("_x"), w, b) for w, b in zip(state["weights"], state["intercepts"])]
    return with_class_scores(with_array(rows), lines).drop("_x")


TIGHT = {"maxIter": 500, "tol": 1e-10}  # of the iterative solver
NORMAL_WIDTH = 4096  # fixed value: features up to which MLlib solves the normal equations


def solver_for(df: DataFrame) -> str:
    """Normal equations up to their width, l-bfgs beyond."""
    first = df.select(F.size(vector_to_array(FEATURES)).alias("n")).first()
    return "normal" if first is None or first["n"] <= NORMAL_WIDTH else "l-bfgs"


def least_squares(df: DataFrame) -> Scored:
    solver = solver_for(df)
    return ml_regressor(LinearRegression(solver=solver, **({} if solver == "normal" else TIGHT)).fit(df))


def label_spread(df: DataFrame, solver: str = "normal") -> tuple[int, float]:
    """(rows, sd of the label) by which MLlib scales a penalty: population sd with the
    normal equations, sample sd with l-bfgs."""
    sd = F.stddev_pop(LABEL) if solver == "normal" else F.stddev_samp(LABEL)
    row = df.agg(F.count(F.lit(1)), sd).first()
    return row[0], row[1] or 1.0


def ridge(df: DataFrame, alpha: float = 1.0) -> Scored:
    """||y - Xw||^2 + alpha ||w||^2. MLlib scales its L2 part by sd(y) and by n."""
    solver = solver_for(df)
    n, sd = label_spread(df, solver)
    more = {} if solver == "normal" else TIGHT
    return ml_regressor(LinearRegression(solver=solver, regParam=alpha * sd / n, elasticNetParam=0.0, standardization=False, **more).fit(df))


def elastic_net(df: DataFrame, alpha: float = 1.0, l1_ratio: float = 0.5) -> Scored:
    """||y - Xw||^2 / 2n + alpha (l1 |w| + (1 - l1)/2 ||w||^2)."""
    solver = solver_for(df)
    _, sd = label_spread(df, solver)
    l1, l2 = alpha * l1_ratio, alpha * (1 - l1_ratio) * sd
    lam = l1 + l2
    return ml_regressor(LinearRegression(solver=solver, regParam=lam, elasticNetParam=l1 / lam if lam else 0.0, standardization=False, maxIter=500, tol=1e-10).fit(df))


def lasso(df: DataFrame, alpha: float = 1.0) -> Scored:
    return elastic_net(df, alpha, 1.0)


def platt(train: DataFrame, margin: str, hit: str) -> tuple[float, float]:
    """Sigmoid of a margin: (slope, intercept) of a one-feature logistic fit."""
    frame = train.select(array_to_vector(F.array(margin)).alias(FEATURES), F.col(hit).cast("double").alias(LABEL))
    model = LogisticRegression(maxIter=25, tol=1e-6).fit(frame)
    return float(model.coefficients[0]), float(model.intercept)


def linear_svc(df: DataFrame, c: float = 1.0, max_iter: int = 100) -> Scored:
    """Linear support vector classifier with probabilities: one margin per class against
    the rest (one in total when binary), each mapped through a fitted sigmoid."""
    k, n = class_count(df), df.count()
    parts = []
    for cls in [1] if k == 2 else range(k):
        binary = df.select(FEATURES, (F.col(LABEL) == cls).cast("double").alias(LABEL))
        model = LinearSVC(regParam=1.0 / (c * n), standardization=False, maxIter=max_iter).fit(binary)
        weights, intercept = model.coefficients.toArray(), float(model.intercept)
        margins = with_array(binary).select(linear_score(F.col("_x"), weights, intercept).alias("m"), F.col(LABEL).alias("hit"))
        slope, shift = platt(margins, "m", "hit")
        parts.append([*(slope * weights), slope * intercept + shift])
    return Scored("class margins", parts=np.array(parts))


@scorer("class margins")
def score_class_margins(state: dict, rows: DataFrame) -> DataFrame:
    """Sigmoid of each class margin, normalised; one margin only when there are two classes."""
    hits = [1 / (1 + F.exp(-linear_score(F.col("_x"), part[:-1], part[-1]))) for part in state["parts"]]
    return with_class_scores(with_array(rows), [1 - hits[0], hits[0]] if len(hits) == 1 else hits, softmax=False).drop("_x")


def linear_svr(df: DataFrame, c: float = 1.0, rounds: int = 12, floor: float = 1e-3) -> Scored:
    """Absolute loss with an L2 penalty by reweighted least squares: the weights of a round
    are an expression of the last coefficients, so the plan does not grow with the rounds."""
    scale = df.agg(F.stddev_pop(LABEL)).first()[0] or 1.0
    base = with_array(df).select(FEATURES, LABEL, "_x").persist()
    weights, intercept, model, solver = None, 0.0, None, solver_for(base)
    try:
        for _ in range(rounds):
            if weights is None:
                frame = base.withColumn("_w", F.lit(1.0))
            else:
                gap = F.abs(F.col(LABEL) - linear_score(F.col("_x"), weights, intercept))
                frame = base.withColumn("_w", 1 / F.greatest(gap, F.lit(floor * scale)))
            mass = frame.agg(F.sum("_w")).first()[0]
            model = LinearRegression(solver=solver, weightCol="_w", regParam=scale / (c * mass), standardization=False).fit(frame)
            old, weights, intercept = weights, model.coefficients.toArray(), float(model.intercept)
            if old is not None and np.max(np.abs(old - weights)) <= 1e-8 * (1 + np.max(np.abs(weights))):
                break
    finally:
        base.unpersist()
    return ml_regressor(model)


def kernel_width(df: DataFrame) -> tuple[int, float]:
    """(p, gamma) with gamma = 1 / (p * variance of all entries)."""
    cells = with_array(df).select(F.size("_x").alias("p"), F.explode("_x").alias("v"))
    row = cells.agg(F.max("p"), F.var_pop("v")).first()
    return row[0], 1.0 / (row[0] * (row[1] or 1.0))


def lift(df: DataFrame, p: int, gamma: float, dimensions: int, seed: int = 42) -> DataFrame:
    """Random Fourier features of the RBF kernel (Rahimi and Recht 2007).

    The p x D matrix follows from the seed, and is applied to Arrow batches.
    """
    draw = np.random.RandomState(seed)
    matrix = draw.normal(scale=math.sqrt(2 * gamma), size=(p, dimensions))
    shift = draw.uniform(0, 2 * math.pi, dimensions)

    @F.pandas_udf("array<double>")
    def project(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.cos(np.stack(x.to_numpy()) @ matrix + shift) * math.sqrt(2.0 / dimensions)))

    return df.withColumn(FEATURES, array_to_vector(project(vector_to_array(FEATURES))))


def lifted(fit, df: DataFrame, dimensions: int, **options) -> Scored:
    p, gamma = kernel_width(df)
    train = lift(df.select(FEATURES, LABEL), p, gamma, dimensions).persist()
    try:
        return Scored("kernel features", inner=fit(train, **options), p=p, gamma=gamma, dimensions=dimensions)
    finally:
        train.unpersist()


@scorer("kernel features")
def score_kernel_features(state: dict, rows: DataFrame) -> DataFrame:
    kept = rows.withColumn("_features", F.col(FEATURES))
    out = state["inner"].score(lift(kept, state["p"], state["gamma"], state["dimensions"]))
    return out.drop(FEATURES).withColumnRenamed("_features", FEATURES)


def rbf_svc(df: DataFrame, c: float = 1.0, dimensions: int = 256) -> Scored:
    return lifted(linear_svc, df, dimensions, c=c)


def rbf_svr(df: DataFrame, c: float = 1.0, dimensions: int = 256) -> Scored:
    return lifted(linear_svr, df, dimensions, c=c)
