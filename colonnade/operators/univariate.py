"""Univariate statistics: value counts, moments, quantiles, box-plot and density data."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from colonnade.columns import categorical_columns, col, long_values, numeric_columns, present
from colonnade.operators.ordering import quantiles
from colonnade.operators.quality import cardinalities, value_profile


def value_columns(df: DataFrame, just_category: bool = False, max_numeric_uniques: int = 8) -> list[str]:
    """All string / bool columns, plus the numerics with few distinct values."""
    categorical = categorical_columns(df)
    if just_category:
        return categorical
    few = cardinalities(df, numeric_columns(df), max_numeric_uniques)
    return categorical + [c for c in numeric_columns(df) if c in few]


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, count, pct): categories most frequent first, numbers in value order.
    The share is over all rows, nulls included. Sorted by range, not in one task, as a text
    column may hold any number of values."""
    n_rows = df.count()
    numeric = [c for c in columns if c in numeric_columns(df)]
    in_value_order = F.col("column").isin(numeric) if numeric else F.lit(False)
    counts = value_profile(df, columns).select(
        "column", "value", F.col("n").alias("count"), F.round(F.col("n") / n_rows * 100, 3).alias("pct")
    )
    return counts.orderBy("column", F.when(in_value_order, F.expr("try_cast(value as double)")), F.desc("count"), "value")


def compare_value_counts(frames: dict[str, DataFrame], just_category: bool = False, max_numeric_uniques: int = 8) -> DataFrame:
    """Value counts per labelled frame, on the value columns that all frames share."""
    lists = [value_columns(df, just_category, max_numeric_uniques) for df in frames.values()]
    shared = [c for c in lists[0] if all(c in other for other in lists[1:])]
    parts = [value_counts(df, shared).withColumn("label", F.lit(label)) for label, df in frames.items()]
    return reduce(DataFrame.unionByName, parts)


def top_categories(df: DataFrame, columns: Sequence[str], k: int = 10) -> DataFrame:
    """The k most frequent values of each column, ties to the smaller value."""
    order = W.partitionBy("column").orderBy(F.desc("count"), "value")
    counts = value_counts(df, columns).select("column", "value", "count", "pct")
    return counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def sample_skewness(c: Column) -> Column:
    """Bias-corrected skewness (null below three values or without spread)."""
    n = F.count(c).cast("double")
    return F.when((n > 2) & (F.stddev_pop(c) > 0), F.skewness(c) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0)))


def sample_kurtosis(c: Column) -> Column:
    """Bias-corrected excess kurtosis (null below four values or without spread)."""
    n = F.count(c).cast("double")
    scale = F.nullif((n - 2) * (n - 3), F.lit(0.0))
    return F.when((n > 3) & (F.stddev_pop(c) > 0), (n - 1) / scale * ((n + 1) * F.kurtosis(c) + 6))


COLUMNS_PER_JOB = 40  # columns whose aggregates share one generated stage


def descriptive_statistics(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n, mean, sum, var, std, skew, kurt), one row per column even without rows.

    Plain aggregates of one scan: nothing is unpivoted, and the shuffle carries one
    partial row per task.
    """
    names = list(columns or numeric_columns(df))
    parts = []
    for start in range(0, len(names), COLUMNS_PER_JOB):
        block = names[start:start + COLUMNS_PER_JOB]
        measures, rows = [], []
        for i, name in enumerate(block):
            v = present(df, name).cast("double")
            made = {
                "n": F.count(v), "mean": F.avg(v), "sum": F.sum(v), "var": F.var_samp(v), "std": F.stddev_samp(v),
                "skew": sample_skewness(v), "kurt": sample_kurtosis(v),
            }
            measures += [expr.alias(f"{key}{i}") for key, expr in made.items()]
            rows.append(F.struct(F.lit(name).alias("column"), *[F.col(f"{key}{i}").alias(key) for key in made]))
        parts.append(df.agg(*measures).select(F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, parts)


QUANTILE_POINTS = (0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0)


def quantile_statistics(df: DataFrame, columns: Sequence[str] | None = None, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    names = list(columns or numeric_columns(df))
    q = lambda i: F.col("q")[i]
    return quantiles(df, names, QUANTILE_POINTS, by, exact).select(
        *[col(b) for b in by], "column", q(0).alias("min"), q(1).alias("p05"), q(2).alias("q1"), q(3).alias("median"),
        q(4).alias("q3"), q(5).alias("p95"), q(6).alias("max"), (q(6) - q(0)).alias("range"), (q(4) - q(2)).alias("iqr"),
    )


def label_union(frames: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    parts = [
        df.select(F.lit(label).alias("label"), *[present(df, c).cast("double").alias(c) for c in columns])
        for label, df in frames.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def shared_numeric(frames: dict[str, DataFrame]) -> list[str]:
    lists = [numeric_columns(df) for df in frames.values()]
    return [c for c in lists[0] if all(c in other for other in lists[1:])]


def box_statistics(frames: dict[str, DataFrame], columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(label, column, n, q1, median, q3, whisker_low, whisker_high, n_fliers).

    Whiskers end at the last value within 1.5 IQR of the box. Quartiles are one row per
    (label, column), so the second pass joins a table bounded by the schema.
    """
    names = list(columns or shared_numeric(frames))
    stacked = label_union(frames, names)
    box = quantiles(stacked, names, (0.25, 0.5, 0.75), ["label"], exact).select(
        "label", "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = F.col("value").between(F.col("q1") - reach, F.col("q3") + reach)
    cells = long_values(stacked, names, ["label"], "double").where("value is not null")
    return (
        cells.join(F.broadcast(box), ["label", "column"]).groupBy("label", "column", "q1", "median", "q3").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
            F.max(F.when(inside, F.col("value"))).alias("whisker_high"), F.count_if(~inside).alias("n_fliers"),
        )
    )


def box_fliers(frames: dict[str, DataFrame], columns: Sequence[str] | None = None) -> DataFrame:
    """(label, column, value): the outlying points themselves; a narrow filter after the fit."""
    names = list(columns or shared_numeric(frames))
    stacked = label_union(frames, names)
    box = quantiles(stacked, names, (0.25, 0.75), ["label"]).select(
        "label", "column", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3")
    )
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    cells = long_values(stacked, names, ["label"], "double").where("value is not null")
    return cells.join(F.broadcast(box), ["label", "column"]).where(
        (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    ).select("label", "column", "value")


KDE_POINTS = 200   # fixed values: points of the density grid and the bandwidths it
KDE_CUT = 3        # extends beyond the data on either side
MAX_CURVES = 10_000  # curves that a task keeps a vector of


def kde_curves(
    frames: dict[str, DataFrame], columns: Sequence[str] | None = None, bins: int | None = None, points: int = KDE_POINTS
) -> DataFrame:
    """(label, column, i, x, density): Gaussian KDE with Scott's bandwidth.

    Every task adds its values' kernels to one vector per curve, and the vectors are summed by
    position, so what is shuffled depends on tasks and curves but not on rows. With `bins` the
    values are first counted in that many equal-width cells (linear error in the cell width),
    for data whose distinct values are too many for an exact curve.
    """
    names = list(columns or shared_numeric(frames))
    cells = long_values(label_union(frames, names), names, ["label"], "double").where("value is not null")
    return kde_from_cells(cells, bins, points)


def kde_from_cells(cells: DataFrame, bins: int | None = None, points: int = KDE_POINTS) -> DataFrame:
    """The density curves of a long frame (label, column, value)."""
    base = cells.groupBy("label", "column").agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("lo"), F.max("value").alias("hi"),
    ).where("n > 1 and std > 0").withColumn("h", F.col("std") * F.pow("n", F.lit(-0.2)))
    keys = ["label", "column"]
    start, step = F.col("lo") - KDE_CUT * F.col("h"), (F.col("hi") - F.col("lo") + 2 * KDE_CUT * F.col("h")) / (points - 1)
    curves = base.select(*keys, "n", "h", "lo", "hi", start.alias("start"), step.alias("step")).limit(MAX_CURVES + 1).collect()
    weighed = cells.withColumn("value", F.col("value").cast("double")).withColumn("w", F.lit(1.0))
    if bins:
        width = (F.col("hi") - F.col("lo")) / bins
        cell = F.least(F.floor((F.col("value") - F.col("lo")) / width), F.lit(bins - 1))
        placed = cells.join(F.broadcast(base) if len(curves) <= MAX_CURVES else base, keys).withColumn("value", F.col("lo") + (cell + 0.5) * width)
        weighed = placed.groupBy(*keys, "value").agg(F.count(F.lit(1)).cast("double").alias("w"))
    if len(curves) > MAX_CURVES:
        return kde_by_join(weighed, base, points)
    known = {(r["label"], r["column"]): (r["start"], r["step"], r["h"], r["n"]) for r in curves}
    label_type = cells.schema["label"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One density vector per curve that the task has values of."""
        total: dict[tuple, np.ndarray] = {}
        for batch in batches:
            label, column = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
            labels, columns, values, w = label.dictionary.to_pylist(), column.dictionary.to_pylist(), batch.column(2).to_numpy(zero_copy_only=False), batch.column(3).to_numpy()
            code = np.where(label.indices.is_null().to_numpy(zero_copy_only=False) | np.isnan(values), -1, label.indices.fill_null(0).to_numpy() * len(columns) + column.indices.to_numpy())
            for g in np.unique(code[code >= 0]):
                key = (labels[g // len(columns)], columns[g % len(columns)])
                if key in known:
                    begin, gap, h, n = known[key]
                    held, at = np.unique(values[code == g], return_inverse=True)
                    weight = np.bincount(at, w[code == g])
                    sums = total.setdefault(key, np.zeros(points))
                    for i in range(0, len(held), 4_096):
                        u = (begin + gap * np.arange(points)[:, None] - held[i:i + 4_096]) / h
                        sums += np.exp(-0.5 * u * u) @ weight[i:i + 4_096] / (math.sqrt(2 * math.pi) * h * n)
        if total:
            names = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in names], batch.schema.field(0).type), pa.array([k[1] for k in names]), pa.array([v for v in total.values()])], names=["label", "column", "d"])

    vectors = weighed.select("label", "column", "value", "w").mapInArrow(add, f"label {label_type}, column string, d array<double>")
    summed = vectors.select(*keys, F.posexplode("d").alias("i", "d")).groupBy(*keys, "i").agg(F.sum("d").alias("density"))
    return summed.join(F.broadcast(base), keys).select(*keys, "i", (start + F.col("i") * step).alias("x"), "density")  # base: at most MAX_CURVES rows


def kde_by_join(weighed: DataFrame, base: DataFrame, points: int) -> DataFrame:
    """The same for more curves than a task should hold vectors of: rows meet their curve by a join."""
    keys = ["label", "column"]
    x = F.col("lo") - KDE_CUT * F.col("h") + F.col("i") * (F.col("hi") - F.col("lo") + 2 * KDE_CUT * F.col("h")) / (points - 1)
    u = (F.col("x") - F.col("value")) / F.col("h")
    kernel = F.col("w") * F.exp(-0.5 * u * u) / (F.lit(math.sqrt(2 * math.pi)) * F.col("h") * F.col("n"))
    merged = weighed.groupBy(*keys, "value").agg(F.sum("w").alias("w"))
    return (
        merged.join(base.select(*keys, "n", "h", "lo", "hi"), keys)
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
        .withColumn("x", x).groupBy(*keys, "i", "x").agg(F.sum(kernel).alias("density"))
    )
