"""Quantile bins, cross-validation folds and train / valid splits."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from colonnade.columns import col
from colonnade.operators.ordering import hash_digits, hash_rank, quantiles
from colonnade.session import broadcast_checked, stored


def quantile_edges(df: DataFrame, column: str, q: int) -> list[float]:
    """The q+1 exact quantile edges without repeats (a bounded fit result)."""
    row = quantiles(df, [column], [i / q for i in range(q + 1)]).first()
    return sorted(set(row["q"])) if row else []


def cut_expression(column: str, edges: Sequence[float]) -> Column:
    """0-based right-closed bin of a value; the first bin includes its lower edge."""
    c = col(column).cast("double")
    inside = (c >= F.lit(edges[0])) & (c <= F.lit(edges[-1]))
    above = reduce(lambda a, b: a + b, [(c > F.lit(e)).cast("int") for e in edges[1:-1]], F.lit(0))
    return F.when(inside, above)


def quantile_bins(df: DataFrame, column: str, q: int, out: str = "bin", edges: Sequence[float] | None = None) -> DataFrame:
    """Equal-frequency bins by exact quantiles; repeated edges are merged. Fitted edges
    can be passed in to replay the bins on other data."""
    edges = quantile_edges(df, column, q) if edges is None else edges
    if len(edges) < 2:
        return df.withColumn(out, F.when(col(column).isNotNull(), F.lit(0)))
    return df.withColumn(out, cut_expression(column, edges))


def bin_label(bin_col: str, edges: Sequence[float]) -> Column:
    """Interval text '(lo, hi]' of a bin number."""
    labels = [f"({a!r}, {b!r}]" for a, b in zip(edges, edges[1:])]
    return F.element_at(F.array(*[F.lit(x) for x in labels]), col(bin_col) + 1)


def stratified_folds(df: DataFrame, id_col: str, target: str, folds: int = 5, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold per row: rows of a class are dealt out in md5 order, and each class starts
    where the previous one stopped, so class counts and fold sizes differ by at most 1."""
    classes = stored(df.groupBy(col(target).alias("_class")).agg(F.count(F.lit(1)).alias("_n")), "strata")
    rows = classes.agg(F.sum("_n")).first()[0] or 0
    # one row per class: the prefix runs over the class table, not over the data
    before = W.partitionBy(F.lit(0)).orderBy("_class").rowsBetween(W.unboundedPreceding, -1)
    starts = classes.select("_class", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    ranked = hash_rank(df, id_col, [target], seed, hash_digits(rows), "_rank")
    return (
        ranked.join(broadcast_checked(starts), col(target).eqNullSafe(F.col("_class")))
        .withColumn(out, F.pmod(F.col("_start") + F.col("_rank") - 1, F.lit(folds)).cast("int"))
        .select(*[col(c) for c in df.columns], out)
    )


def cross_validation_folds(df: DataFrame, id_col: str, target: str, folds: int = 5, bins: int = 10, seed: int = 42) -> DataFrame:
    """Stratified folds; a numeric target is stratified by its quantile bins."""
    if isinstance(df.schema[target].dataType, T.NumericType):
        return stratified_folds(quantile_bins(df, target, bins, out="_bin"), id_col, "_bin", folds, seed).drop("_bin")
    return stratified_folds(df, id_col, target, folds, seed)


def split_fold(df: DataFrame, fold: int, column: str = "fold") -> tuple[DataFrame, DataFrame]:
    """(train, valid) of one fold: two filters on the same (persisted) frame."""
    return df.where(col(column) != fold), df.where(col(column) == fold)
