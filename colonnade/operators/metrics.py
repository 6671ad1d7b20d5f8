"""Metrics as grouped aggregates: every model, fold, split and data slice in one job.

Frames: `scores` has one row per (id, model, fold, class): `actual`, `class`, `proba`;
`hard` has one row per (id, model, fold): `actual`, `pred`. `by` names the grouping
columns. Results are long: (by..., metric, class, value), class null for totals.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from colonnade.columns import col
from colonnade.operators.ordering import prefix_sum, quantiles, range_edges
from colonnade.session import checkpoint, more_partitions, shuffled_tasks, stored


def keys(by: Sequence[str]) -> list[Column]:
    return [col(b) for b in by]


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 when there is nothing to divide by."""
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def confusion_counts(hard: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., actual, pred, n): all hard-label metrics derive from this small table."""
    return hard.groupBy(*keys(by), "actual", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., class, precision, recall, f1, support) for every class seen on either side."""
    hit = F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0)
    sides = F.array(
        F.struct(F.col("actual").alias("class"), hit.alias("tp"), F.col("n").alias("rows"), F.lit(0).cast("long").alias("called")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("rows"), F.col("n").alias("called")),
    )
    tall = confusion.select(*keys(by), F.inline(sides))
    sums = tall.groupBy(*keys(by), "class").agg(*[F.sum(c).alias(c) for c in ("tp", "rows", "called")])
    return sums.select(
        *keys(by), "class", ratio(F.col("tp"), F.col("called")).alias("precision"), ratio(F.col("tp"), F.col("rows")).alias("recall"),
        ratio(2 * F.col("tp"), F.col("called") + F.col("rows")).alias("f1"), F.col("rows").alias("support"),
    )


HARD_NAMES = (("precision", "Precision"), ("recall", "Recall"), ("f1", "F1 Score"))


def accuracy(confusion: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    right = F.sum(F.when(F.col("actual") == F.col("pred"), F.col("n")).otherwise(0))
    return confusion.groupBy(*keys(by)).agg((right / F.sum("n")).alias("value")).select(
        *keys(by), F.lit("Accuracy").alias("metric"), F.lit(None).cast("string").alias("class"), "value"
    )


def hard_metrics(confusion: DataFrame, by: Sequence[str] = (), positive: str | None = None, names: Sequence[str] = ("Precision", "Recall", "F1 Score")) -> DataFrame:
    """Precision, recall and F1: of the positive class (binary), else macro and per class."""
    none = F.lit(None).cast("string")
    listed = F.array(*[F.struct(F.lit(label).alias("metric"), F.col(c).alias("value")) for c, label in HARD_NAMES if label in names])
    if positive is not None:
        hit, truth = F.col("pred") == positive, F.col("actual") == positive
        rows = lambda rule: F.sum(F.when(rule, F.col("n")).otherwise(0))
        tp, called, support = rows(hit & truth), rows(hit), rows(truth)
        table = confusion.groupBy(*keys(by)).agg(
            ratio(tp, called).alias("precision"), ratio(tp, support).alias("recall"), ratio(2 * tp, called + support).alias("f1")
        )
        return table.select(*keys(by), F.inline(listed)).select(*keys(by), "metric", none.alias("class"), "value")
    per_class = class_scores(confusion, by)
    stacked = per_class.select(*keys(by), F.col("class").cast("string").alias("class"), F.inline(listed)).select(*keys(by), "metric", "class", "value")
    macro = stacked.groupBy(*keys(by), "metric").agg(F.avg("value").alias("value")).select(
        *keys(by), "metric", none.alias("class"), "value"
    )
    return macro.unionByName(stacked)


def score_counts(scored: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by..., score, pos, neg): rows with equal scores merged before anything is ordered."""
    return scored.groupBy(*keys(by), "score").agg(
        F.count_if(F.col("hit")).alias("pos"), F.count_if(~F.col("hit")).alias("neg")
    )


def binary_scores(scores: DataFrame, by: Sequence[str], positive: str) -> DataFrame:
    """Score of the positive class and whether it is the truth."""
    return scores.where(F.col("class") == positive).select(
        *keys(by), F.col("proba").alias("score"), (F.col("actual") == F.col("class")).alias("hit")
    )


def class_vs_rest(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    return scores.select(
        *keys(by), "class", F.col("proba").alias("score"), (F.col("actual") == F.col("class")).alias("hit")
    )


RANKING = ("ROC AUC", "Avg Precision")


def ranking_scores(scored: DataFrame, by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """(by..., "ROC AUC", "Avg Precision") from one ordered pass over the distinct scores.

    AUC is the Mann-Whitney share of (positive, negative) pairs in the right order, ties
    one half; average precision is the sum of (R_n - R_n-1) P_n over distinct thresholds,
    highest first. Both are null where a class is absent. More scores than the set number of
    tasks should take are counted once, by more tasks, and stored; the distinct scores that this
    leaves are ranked at once, by as many tasks as they need.
    """
    spark, rows = scored.sparkSession, scored.count()
    if shuffled_tasks(spark, rows) == shuffled_tasks(spark, 0):
        return _ranking_scores(score_counts(scored, by), range_edges(scored, "score", buckets), by)
    with more_partitions(spark, rows):
        counts = stored(score_counts(scored, by), "score_counts")
    with more_partitions(spark, counts.count()):
        return checkpoint(_ranking_scores(counts, range_edges(counts, "score", buckets), by))


def _ranking_scores(counts: DataFrame, edges: list[float], by: Sequence[str]) -> DataFrame:
    counts = counts.withColumn("n", F.col("pos") + F.col("neg"))
    walked = prefix_sum(
        counts, "score", {"pos": "pos_below", "n": "n_below"}, by, edges=edges,
        totals={"pos": "all_pos", "n": "all_n"},
    )
    neg_below = F.col("n_below") - F.col("pos_below")
    wins = F.sum(F.col("pos") * (neg_below + F.col("neg") / 2))
    precision = (F.col("all_pos") - F.col("pos_below")) / (F.col("all_n") - F.col("n_below"))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return walked.groupBy(*keys(by)).agg(
        (wins / F.nullif(pairs, F.lit(0.0))).alias("ROC AUC"),
        (F.sum(F.col("pos") * precision) / F.nullif(F.sum("pos").cast("double"), F.lit(0.0))).alias("Avg Precision"),
    )


def ranking_metrics(scores: DataFrame, names: Sequence[str] = RANKING, by: Sequence[str] = (), positive: str | None = None) -> DataFrame:
    """Of the positive class, else one-vs-rest macro and per class, long form."""
    none = F.lit(None).cast("string")
    listed = F.array(*[F.struct(F.lit(m).alias("metric"), col(m).alias("value")) for m in names])
    if positive is not None:
        table = ranking_scores(binary_scores(scores, by, positive), by)
        return table.select(*keys(by), F.inline(listed)).select(*keys(by), "metric", none.alias("class"), "value")
    table = ranking_scores(class_vs_rest(scores, by), [*by, "class"])
    tall = table.select(*keys(by), F.col("class").cast("string").alias("class"), F.inline(listed))
    # a macro row next to the class rows, in one aggregate
    both = tall.groupingSets([[*keys(by), F.col("metric"), F.col("class")], [*keys(by), F.col("metric")]], *keys(by), F.col("metric"), F.col("class"))
    return both.agg(F.avg("value").alias("value")).select(*keys(by), "metric", "class", "value")


CLASSIFICATION_METRICS = ("Accuracy", "Precision", "Recall", "F1 Score", "ROC AUC", "Avg Precision")
REGRESSION_METRICS = ("MSE", "RMSE", "MAE", "MedAE", "R2", "Adj R2")


def hard_labels(scores: DataFrame, by: Sequence[str]) -> DataFrame:
    """One row per prediction out of the per-class rows, when `pred` travels with them."""
    return scores.where(F.col("class") == F.col("pred")).select(*keys(by), "actual", "pred")


def classification_metrics(
    scores: DataFrame, by: Sequence[str] = ("model", "fold"), positive: str | None = None,
    metrics: Sequence[str] = CLASSIFICATION_METRICS,
) -> DataFrame:
    """All chosen metrics, long form. `scores` carries `pred` on each of its class rows."""
    parts = []
    confusion = confusion_counts(hard_labels(scores, by), by)
    if "Accuracy" in metrics:
        parts.append(accuracy(confusion, by))
    hard = [m for m in ("Precision", "Recall", "F1 Score") if m in metrics]
    if hard:
        parts.append(hard_metrics(confusion, by, positive, hard))
    ranking = [m for m in RANKING if m in metrics]
    if ranking:
        parts.append(ranking_metrics(scores, ranking, by, positive))
    return reduce(DataFrame.unionByName, parts)


def regression_metrics(preds: DataFrame, by: Sequence[str] = ("model", "fold"), n_features: int = 1, metrics: Sequence[str] = REGRESSION_METRICS) -> DataFrame:
    """(by..., metric, class, value). R2 is 1 - SSE/SST in the same pass as the errors;
    adjusted R2 uses the evaluated rows and the number of features. Needs actual, pred."""
    e = F.col("pred").cast("double") - F.col("actual").cast("double")
    n = F.count(F.lit(1)).cast("double")
    sse, sst = F.sum(e * e), F.var_pop(F.col("actual").cast("double")) * n
    r2 = 1 - sse / F.nullif(sst, F.lit(0.0))
    table = preds.groupBy(*keys(by)).agg(
        F.avg(e * e).alias("MSE"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.avg(F.abs(e)).alias("MAE"), r2.alias("R2"),
        (1 - (1 - r2) * (n - 1) / F.nullif(n - n_features - 1, F.lit(0.0))).alias("Adj R2"),
    )
    simple = [m for m in metrics if m != "MedAE"]
    none = F.lit(None).cast("string")
    parts = []
    if simple:
        listed = F.array(*[F.struct(F.lit(m).alias("metric"), none.alias("class"), col(m).alias("value")) for m in simple])
        parts.append(table.select(*keys(by), F.inline(listed)))
    if "MedAE" in metrics:
        errors = preds.select(*keys(by), F.abs(e).alias("error"))
        medians = quantiles(errors, ["error"], [0.5], by)
        parts.append(medians.select(*keys(by), F.lit("MedAE").alias("metric"), none.alias("class"), F.col("q")[0].alias("value")))
    return reduce(DataFrame.unionByName, parts)


def metric_table(long: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Wide view: one row per group, a column per metric and `metric-class`."""
    named = long.withColumn("_name", F.when(F.col("class").isNull(), F.col("metric")).otherwise(F.concat("metric", F.lit("-"), "class")))
    return named.groupBy(*keys(by)).pivot("_name", list(columns)).agg(F.first("value"))
