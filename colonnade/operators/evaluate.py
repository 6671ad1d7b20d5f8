"""Evaluation views over out-of-fold predictions and metric tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colonnade.columns import categorical_columns, col, numeric_columns
from colonnade.functions.normal import inverse_normal
from colonnade.operators.metrics import classification_metrics, regression_metrics
from colonnade.operators.ordering import average_ranks
from colonnade.operators.quality import cardinalities
from colonnade.operators.splitting import bin_label, cut_expression, quantile_edges
from colonnade.operators.univariate import kde_from_cells
from colonnade.session import broadcast_checked


def metric_summary(metrics: DataFrame, best: str, ascending: bool = False) -> DataFrame:
    """(fold, model, metric, value, position): every fold and, by rollup, the average over
    folds as 'All'; models ranked by the best metric."""
    totals = metrics.where("class is null")
    cube = totals.rollup("model", "metric", "fold").agg(F.avg("value").alias("value"), F.grouping("fold").alias("_g"))
    tall = cube.where("metric is not null and (_g = 1 or fold is not null)").select(
        F.when(F.col("_g") == 1, F.lit("All")).otherwise(F.col("fold").cast("string")).alias("fold"), "model", "metric", "value"
    )
    score = F.max(F.when(F.col("metric") == best, F.col("value"))).over(W.partitionBy("fold", "model"))
    scored = tall.withColumn("_best", score)
    order = W.partitionBy("fold", "metric").orderBy(F.asc("_best") if ascending else F.desc("_best"), "model")
    return scored.withColumn("position", F.row_number().over(order)).drop("_best")


def class_metric_table(metrics: DataFrame, models: Sequence[str]) -> DataFrame:
    """(metric, class) x model: class scores averaged over folds."""
    return metrics.where("class is not null").groupBy("metric", "class").pivot("model", list(models)).agg(F.avg("value"))


def confusion_matrix(hard: DataFrame, fold: int | None = None) -> DataFrame:
    """(model, actual, pred, n) on the dense class grid of each model, zeros included."""
    rows = hard if fold is None else hard.where(F.col("fold") == fold)
    counts = rows.groupBy("model", "actual", "pred").agg(F.count(F.lit(1)).alias("n"))
    seen = counts.groupBy("model").agg(F.array_union(F.collect_set("actual"), F.collect_set("pred")).alias("c"))
    grid = seen.select("model", F.explode("c").alias("actual"), "c").select("model", "actual", F.explode("c").alias("pred"))
    return grid.join(counts, ["model", "actual", "pred"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def slice_columns(cleaned: DataFrame, skip: Sequence[str], max_unique: int) -> list[str]:
    names = [c for c in categorical_columns(cleaned) if c not in skip]
    few = cardinalities(cleaned, names, max_unique)
    return [c for c in names if c in few]


def sliced(predictions: DataFrame, slices: DataFrame, id_col: str, columns: dict[str, Column]) -> DataFrame:
    """Join predictions to slice labels on the id and stack them as (column, category).

    The stack is a narrow generator; the metric aggregates combine before they shuffle.
    """
    labels = F.array(*[F.struct(F.lit(name).alias("column"), expr.cast("string").alias("category")) for name, expr in columns.items()])
    stacked = slices.select(col(id_col), labels.alias("_labels"))
    return predictions.join(stacked, id_col).select(*[col(c) for c in predictions.columns], F.inline("_labels")).where("category is not null")


def category_metrics(scores: DataFrame, cleaned: DataFrame, id_col: str, target: str, max_unique: int = 4, task: str = "classification", metrics: Sequence[str] | None = None, **options) -> DataFrame:
    """Metrics per low-cardinality column x category x model, all in one grouped job."""
    names = slice_columns(cleaned, [target, id_col], max_unique)
    rows = sliced(scores, cleaned, id_col, {c: col(c) for c in names})
    return metrics_by(rows, ["column", "category", "model"], task, metrics, **options)


def numeric_slice_metrics(scores: DataFrame, cleaned: DataFrame, id_col: str, target: str, bins: int = 4, task: str = "classification", metrics: Sequence[str] | None = None, columns: Sequence[str] | None = None, **options) -> DataFrame:
    """The same over quantile bins of the numeric columns (`{column}_binned`)."""
    names = list(columns or [c for c in numeric_columns(cleaned) if c not in (id_col, target)])
    labels: dict[str, Column] = {}
    frame = cleaned
    for c in names:
        edges = quantile_edges(cleaned, c, bins)
        if len(edges) < 2:
            continue
        frame = frame.withColumn(f"_bin_{c}", cut_expression(c, edges))
        labels[f"{c}_binned"] = bin_label(f"_bin_{c}", edges)
    return metrics_by(sliced(scores, frame, id_col, labels), ["column", "category", "model"], task, metrics, **options)


def metrics_by(rows: DataFrame, by: list[str], task: str, metrics: Sequence[str] | None, **options) -> DataFrame:
    chosen = {"metrics": metrics} if metrics else {}
    return (classification_metrics if task == "classification" else regression_metrics)(rows, by, **chosen, **options)


def runtime_summary(runtimes: DataFrame) -> DataFrame:
    """(model, fit_seconds, predict_seconds): average over folds, slowest fit first."""
    return runtimes.groupBy("model").agg(
        F.avg("fit_seconds").alias("fit_seconds"), F.avg("predict_seconds").alias("predict_seconds")
    ).orderBy(F.desc("fit_seconds"), "model")


def residuals(preds: DataFrame) -> DataFrame:
    """Adds residual and standardised residual (sample std) per model: the per-model
    statistics are one row per model."""
    r = F.col("actual") - F.col("pred")
    stats = preds.groupBy("model").agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    return preds.join(broadcast_checked(stats), "model").withColumns({"residual": r, "std_residual": (r - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0))}).drop("_m", "_s")


def qq_points(preds: DataFrame) -> DataFrame:
    """(model, std_residual, n, theoretical) of the standardised residuals."""
    return qq_of(residuals(preds), "std_residual")


def qq_of(rows: DataFrame, value: str) -> DataFrame:
    """Normal quantile i/(n+1) of the (tie-averaged) rank of every distinct value."""
    ranked = average_ranks(rows.where(col(value).isNotNull()), value, ["model"])
    sizes = ranked.groupBy("model").agg(F.sum("n").alias("_total"))
    return ranked.join(broadcast_checked(sizes), "model").select(
        "model", col(value), "n", inverse_normal(F.col("rank") / (F.col("_total") + 1)).alias("theoretical")
    )


def proba_histogram(scores: DataFrame, bins: int = 20) -> DataFrame:
    """(model, class, bin, lo, hi, n): P(class) among the rows of that class, in equal bins
    between its smallest and largest value; empty bins included."""
    own = scores.where(F.col("actual") == F.col("class")).select("model", "class", "proba")
    ends = own.groupBy("model", "class").agg(F.min("proba").alias("a"), F.max("proba").alias("b"))
    width = F.when(F.col("b") > F.col("a"), (F.col("b") - F.col("a")) / bins).otherwise(F.lit(1.0))
    at = F.least(F.floor((F.col("proba") - F.col("a")) / width), F.lit(bins - 1)).cast("int")
    counts = own.join(broadcast_checked(ends), ["model", "class"]).groupBy("model", "class", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = ends.select("model", "class", "a", width.alias("w"), F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counts, ["model", "class", "bin"], "left").select(
        "model", "class", "bin", (F.col("a") + F.col("bin") * F.col("w")).alias("lo"), (F.col("a") + (F.col("bin") + 1) * F.col("w")).alias("hi"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def prediction_density(preds: DataFrame, models: Sequence[str], points: int = 200) -> DataFrame:
    """(label, column, i, x, density): actual against predicted values of each model.

    `label` is 'actual' or 'predicted', `column` the model."""
    sides = F.array(F.struct(F.lit("actual").alias("label"), F.col("actual").cast("double").alias("value")),
                    F.struct(F.lit("predicted").alias("label"), F.col("pred").cast("double").alias("value")))
    cells = preds.where(F.col("model").isin(list(models))).select(F.col("model").alias("column"), F.inline(sides))
    return kde_from_cells(cells, points=points)
