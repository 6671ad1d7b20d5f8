"""Naive Bayes from per-class sufficient statistics."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.feature import Binarizer
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from colonnade.operators.models.common import FEATURES, Scored, class_moments, linear_score, scorer, total, with_array, with_class_scores


def binarized(df: DataFrame, threshold: float) -> DataFrame:
    cut = Binarizer(threshold=threshold, inputCol=FEATURES, outputCol="_b").transform(df)
    return cut.drop(FEATURES).withColumnRenamed("_b", FEATURES)


def bernoulli_nb(df: DataFrame, alpha: float = 1.0, threshold: float = 0.0) -> Scored:
    """Features above the threshold count as 1; smoothed rates, empirical class priors."""
    n, mean, _ = class_moments(binarized(df, threshold))
    rate = (mean * n[:, None] + alpha) / (n + 2 * alpha)[:, None]
    weights = np.log(rate) - np.log1p(-rate)
    offsets = np.log(n / n.sum()) + np.log1p(-rate).sum(axis=1)
    return Scored("bernoulli", weights=weights, intercepts=offsets, threshold=threshold)


@scorer("bernoulli")
def score_bernoulli(state: dict, rows: DataFrame) -> DataFrame:
    flags = with_array(rows).withColumn("_x", F.transform("_x", lambda v: F.when(v > state["threshold"], 1.0).otherwise(0.0)))
    lines = [linear_score(F.col("_x"), w, b) for w, b in zip(state["weights"], state["intercepts"])]
    return with_class_scores(flags, lines).drop("_x")


def gaussian_nb(df: DataFrame, smoothing: float = 1e-9) -> Scored:
    """Per-class normal densities; every variance is raised by smoothing * largest variance."""
    n, mean, variance = class_moments(df)
    whole = df.agg(Summarizer.variance(F.col(FEATURES)).alias("v")).first()["v"].toArray() * (n.sum() - 1) / n.sum()
    var = variance * ((n - 1) / n)[:, None] + smoothing * whole.max()
    offsets = np.log(n / n.sum()) - 0.5 * np.log(2 * math.pi * var).sum(axis=1)
    return Scored("gaussian", mean=mean, variance=var, intercepts=offsets)


@scorer("gaussian")
def score_gaussian(state: dict, rows: DataFrame) -> DataFrame:
    def density(mean, var, offset):
        gaps = [F.col("_x")[j] - float(m) for j, m in enumerate(mean)]
        return total([g * g * F.lit(-0.5 / float(v)) for g, v in zip(gaps, var)]) + float(offset)

    logs = [density(*part) for part in zip(state["mean"], state["variance"], state["intercepts"])]
    return with_class_scores(with_array(rows), logs).drop("_x")
