"""Scoring pieces that the model families share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

FEATURES, LABEL = "features", "label"


def total(terms: Sequence[Column]) -> Column:
    """Balanced sum, so that a wide model does not nest as deep as it is wide."""
    terms = list(terms)
    while len(terms) > 1:
        terms = [reduce(lambda a, b: a + b, terms[i:i + 2]) for i in range(0, len(terms), 2)]
    return terms[0] if terms else F.lit(0.0)


def linear_score(x: Column, weights: Sequence[float], intercept: float) -> Column:
    """Dot product written out: stays inside generated code, zero weights cost nothing."""
    terms = [x[i] * F.lit(float(w)) for i, w in enumerate(weights) if w != 0]
    return total(terms) + F.lit(float(intercept))


def with_array(df: DataFrame, out: str = "_x") -> DataFrame:
    return df.withColumn(out, vector_to_array(FEATURES))


def argmax(values: Column) -> Column:
    """0-based position of the largest entry, ties to the first."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("double")


def with_class_scores(df: DataFrame, scores: list[Column], softmax: bool = True) -> DataFrame:
    """Log-scores (or plain weights) per class -> probability array and prediction."""
    raw = df.withColumn("_s", F.array(*scores))
    if softmax:
        raw = raw.withColumn("_s", F.transform("_s", lambda v: F.exp(v - F.array_max("_s"))))
    mass = total([F.col("_s")[i] for i in range(len(scores))])
    p = F.array(*[F.when(mass > 0, F.col("_s")[i] / F.nullif(mass, F.lit(0.0))).otherwise(1.0 / len(scores)) for i in range(len(scores))])
    scored = raw.withColumn("probability", p)
    return scored.withColumn("prediction", argmax(F.col("probability"))).drop("_s")


SCORERS: dict[str, Callable[[dict, DataFrame], DataFrame]] = {}


def scorer(kind: str):
    """Register how a kind of fitted model scores rows, given its state."""
    def register(fn):
        SCORERS[kind] = fn
        return fn

    return register


@dataclass
class Table:
    """A table that a model keeps as part of its state, by its path."""

    path: str


class Scored:
    """A fitted model: its kind and what it learnt (numbers, arrays, MLlib models)."""

    def __init__(self, kind: str, **state):
        self.kind, self.state = kind, state

    def score(self, df: DataFrame) -> DataFrame:
        return SCORERS[self.kind](self.state, df)


@scorer("mllib classifier")
def score_ml_classifier(state: dict, df: DataFrame) -> DataFrame:
    out = state["model"].transform(df.drop("probability", "prediction", "rawPrediction"))
    return out.withColumn("probability", vector_to_array("probability")).drop("rawPrediction")


@scorer("mllib regressor")
def score_ml_regressor(state: dict, df: DataFrame) -> DataFrame:
    return state["model"].transform(df.drop("prediction"))


def ml_classifier(model) -> Scored:
    return Scored("mllib classifier", model=model)


def ml_regressor(model) -> Scored:
    return Scored("mllib regressor", model=model)


def class_count(df: DataFrame) -> int:
    return int(df.agg(F.max(LABEL)).first()[0]) + 1


def class_moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, mean, sample variance) per class: one map-side combined aggregate, k rows out."""
    rows = df.groupBy(LABEL).agg(
        F.count(F.lit(1)).alias("n"), Summarizer.metrics("mean", "variance").summary(F.col(FEATURES)).alias("s")
    ).orderBy(LABEL).collect()
    return np.array([r["n"] for r in rows], float), np.array([r["s"]["mean"].toArray() for r in rows]), np.array([r["s"]["variance"].toArray() for r in rows])


def within_scatter(df: DataFrame, means: np.ndarray) -> np.ndarray:
    """Pooled within-class scatter matrix (p x p).

    Each task reduces its rows to one p x p block; the blocks are then added by position,
    so the driver receives p*p numbers whatever the number of rows or tasks.
    """
    p = means.shape[1]

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block = np.zeros((p, p))
        for batch in batches:
            if len(batch):
                gap = np.stack(batch["_x"].to_numpy()) - means[batch[LABEL].astype(int).to_numpy()]
                block += gap.T @ gap
        yield pd.DataFrame({"v": [block.ravel()]})

    cells = with_array(df).select(LABEL, "_x").mapInPandas(blocks, "v array<double>").select(F.posexplode("v").alias("i", "v"))
    flat = np.zeros(p * p)
    for r in cells.groupBy("i").agg(F.sum("v").alias("v")).collect():
        flat[r["i"]] = r["v"]
    return flat.reshape(p, p)
