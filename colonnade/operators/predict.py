"""Ensembling and evaluation of scored rows (id, model, fold, class, proba)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from colonnade.columns import col
from colonnade.operators.metrics import classification_metrics, regression_metrics
from colonnade.operators.univariate import box_statistics, compare_value_counts, kde_curves
from colonnade.session import more_partitions, stored

TOTAL = "Ensembled"
ROWS_OF_ID = 8  # scored rows that an id is taken to have when tasks are counted


def top_class(proba: str = "proba"):
    """Aggregate: the class with the highest probability, ties to the first class."""
    return F.min(F.struct((-F.col(proba)).alias("p"), F.col("class").alias("c")))["c"]


def soft_ensemble(scores: DataFrame, id_col: str, overall: bool = False) -> DataFrame:
    """(id, model, class, proba, pred): mean probability over the folds of a model, or over
    all models and folds (`Ensembled`).

    Rows are placed by id once; the class means and the argmax are aggregates on top of
    that same placement, which the ensembles of models and the overall one share.
    """
    group = [id_col] if overall else [id_col, "model"]
    placed = scores.select(id_col, "model", "class", "proba").repartition(col(id_col))
    sums = placed.groupBy(id_col, "model", "class").agg(F.sum("proba").alias("_s"), F.count("proba").alias("_n"))
    mean = F.sum("_s") / F.nullif(F.sum("_n"), F.lit(0))
    means = sums.groupBy(id_col, "class").agg(mean.alias("proba")) if overall else sums.select(id_col, "model", "class", (F.col("_s") / F.nullif(F.col("_n"), F.lit(0))).alias("proba"))
    per_row = means.groupBy(*[col(g) for g in group]).agg(
        F.collect_list(F.struct("class", "proba")).alias("_c"), top_class().alias("pred")
    )
    model = F.lit(TOTAL) if overall else F.col("model")
    return per_row.select(col(id_col), model.alias("model"), F.inline("_c"), "pred").select(id_col, "model", "class", "proba", "pred")


def full_ensemble(scores: DataFrame, id_col: str) -> DataFrame:
    """Per-model ensembles and the overall one, stacked."""
    return soft_ensemble(scores, id_col).unionByName(soft_ensemble(scores, id_col, overall=True))


def mean_ensemble(preds: DataFrame, id_col: str) -> DataFrame:
    """(id, model, pred) of regression predictions: mean over folds, and over everything."""
    cube = preds.select(id_col, "model", "pred").groupingSets(
        [[F.col(id_col), F.col("model")], [F.col(id_col)]], F.col(id_col), F.col("model")
    )
    return cube.agg(F.avg("pred").alias("pred")).withColumn("model", F.coalesce("model", F.lit(TOTAL)))


def with_actuals(ensembled: DataFrame, test: DataFrame, id_col: str, target: str) -> DataFrame:
    return ensembled.join(test.select(col(id_col), col(target).cast("string").alias("actual")), id_col)


def wide_predictions(ensembled: DataFrame, id_col: str, models: Sequence[str], classes: Sequence[str], target: str, test: DataFrame | None = None) -> DataFrame:
    """One row per id: `{model}_{target}_{class}`, `{model}_{target}_pred`, and the actual
    value when the test data is labelled."""
    pick = lambda m, value, c=None: F.max(F.when((F.col("model") == m) & (F.lit(True) if c is None else F.col("class") == c), value))
    made = []
    for m in models:
        made += [pick(m, F.col("proba"), c).alias(f"{m}_{target}_{c}") for c in classes]
        made.append(pick(m, F.col("pred")).alias(f"{m}_{target}_pred"))
    wide = ensembled.groupBy(col(id_col)).agg(*made)
    if test is not None and target in test.columns:
        wide = wide.join(test.select(col(id_col), col(target).alias(f"{target}_actual")), id_col)
    return wide


def evaluate_ensembles(ensembled: DataFrame, test: DataFrame, id_col: str, target: str, task: str = "classification", positive: str | None = None, n_features: int = 1) -> DataFrame:
    """Metrics of every ensemble on labelled test data. The labelled rows are stored, as several
    metrics read them and ensembling them is most of the work."""
    if task == "classification":
        rows = with_actuals(ensembled, test, id_col, target).drop(id_col)
        with more_partitions(test.sparkSession, ROWS_OF_ID * test.count()):
            kept = stored(rows, "ensembles")
        return classification_metrics(kept, ["model"], positive)
    labelled = ensembled.join(test.select(col(id_col), col(target).cast("double").alias("actual")), id_col)
    return regression_metrics(labelled, ["model"], n_features)


def data_comparison(train: DataFrame, test: DataFrame, min_rows: int = 0) -> dict[str, DataFrame] | None:
    """Value counts, box statistics and densities of train against test; None if a least
    number of test rows is asked for and not exceeded."""
    if min_rows and test.count() <= min_rows:
        return None
    frames = {"train": train, "test": test}
    return {"value_counts": compare_value_counts(frames), "box": box_statistics(frames), "kde": kde_curves(frames)}
