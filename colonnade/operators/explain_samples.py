"""Which rows are easy and which are difficult for the models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colonnade.columns import col
from colonnade.operators.ordering import with_average_rank


def mean_model_rank(rows: DataFrame, id_col: str, score: str, within: Sequence[str]) -> DataFrame:
    """(id, within..., mean_rank): tie-averaged rank of `score` (low first) per model and
    group, averaged over the models."""
    ranked = with_average_rank(rows.select(id_col, "model", *within, score), score, ["model", *within])
    return ranked.groupBy(col(id_col), *[col(w) for w in within]).agg(F.avg("rank").alias("mean_rank"))


def easy_difficult_classification(scores: DataFrame, id_col: str) -> DataFrame:
    """Rank by P(true class), highest first, inside each class; low mean rank = easy."""
    own = scores.where(F.col("class") == F.col("actual")).withColumn("_down", -F.col("proba"))
    return mean_model_rank(own, id_col, "_down", ["actual"])


def easy_difficult_regression(preds: DataFrame, id_col: str) -> DataFrame:
    """Rank by absolute error, smallest first; low mean rank = easy."""
    return mean_model_rank(preds.withColumn("_error", F.abs(F.col("pred") - F.col("actual"))), id_col, "_error", [])


def extremes(ranked: DataFrame, k: int, easy: bool = True) -> DataFrame:
    """The k easiest or most difficult rows (a top-k report)."""
    return ranked.orderBy("mean_rank" if easy else F.desc("mean_rank")).limit(k)
