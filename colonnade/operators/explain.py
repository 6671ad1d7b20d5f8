"""Model explanation: importance of attributions, partial dependence."""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from colonnade.columns import col
from colonnade.operators.models.common import FEATURES, Scored
from colonnade.operators.ordering import quantiles
from colonnade.operators.quality import cardinalities
from colonnade.operators.shapley import explained_output, node_table, tree_shap  # noqa: F401  (part of this module's interface)


def importance(attributions: DataFrame, threshold: float = 0.0, top: int | None = None) -> DataFrame:
    """(class, feature, importance, min_phi, max_phi, position): mean |phi| per feature."""
    table = attributions.groupBy("class", "feature").agg(
        F.avg(F.abs("phi")).alias("importance"), F.min("phi").alias("min_phi"), F.max("phi").alias("max_phi")
    ).where(F.col("importance") >= threshold)
    order = W.partitionBy("class").orderBy(F.desc("importance"), "feature")
    ranked = table.withColumn("position", F.row_number().over(order))
    return ranked if top is None else ranked.where(F.col("position") <= top)


def beeswarm(attributions: DataFrame, top: int = 20) -> DataFrame:
    """(class, feature, value, phi, n): points of the most important features, equal points merged."""
    best = importance(attributions, top=top).select(F.col("class").alias("_c"), F.col("feature").alias("_f"))
    on = F.col("class").eqNullSafe(F.col("_c")) & (F.col("feature") == F.col("_f"))
    return attributions.join(best, on, "left_semi").groupBy("class", "feature", "value", "phi").agg(F.count(F.lit(1)).alias("n"))


def local_explanations(attributions: DataFrame, id_col: str, top: int = 15) -> DataFrame:
    """The `top` largest contributions of every row; filter by id for one row."""
    order = W.partitionBy(id_col, "class").orderBy(F.desc(F.abs("phi")), "feature")
    return attributions.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top)


GRID_POINTS = 50  # fixed values: grid size and percentile range of partial dependence
GRID_RANGE = (0.05, 0.95)


def dependence_grids(df: DataFrame, features: Sequence[str], points: int = GRID_POINTS) -> dict[str, list]:
    """Grid per feature: its distinct values if there are at most two (or it is a flag or a
    string, however many there are), else equal steps between its 5th and 95th percentiles."""
    few = cardinalities(df, list(features), 2)
    flags = [f for f in features if f in few or isinstance(df.schema[f].dataType, (T.StringType, T.BooleanType))]
    grids: dict[str, list] = {f: [] for f in features}
    for f in flags:
        grids[f] = [r[0] for r in df.where(col(f).isNotNull()).select(col(f)).distinct().orderBy(col(f)).collect()]
    rest = [f for f in features if f not in flags]
    if rest:
        for r in quantiles(df, rest, GRID_RANGE).collect():
            grids[r["column"]] = [float(v) for v in np.linspace(r["q"][0], r["q"][1], points)]
    return grids


GRID_TYPES = {bool: "boolean", int: "bigint", float: "double", str: "string"}


def grid_array(grid: Sequence) -> Column:
    """The grid as one literal, which the optimizer folds: a long one does not lengthen the plan."""
    kinds = {type(g) for g in grid} or {float}
    kind = GRID_TYPES[kinds.pop()] if len(kinds) == 1 else "double"
    return F.from_json(F.lit(json.dumps(list(grid))), f"array<{kind}>")


def over_grid(df: DataFrame, feature: str, grid: Sequence, position: int) -> DataFrame:
    """Every row once per grid value, that feature overwritten: a generator that is pipelined into
    the scoring that follows. A string stands in the vector as its place in the grid, which
    is its ordinal code."""
    text = bool(grid) and isinstance(grid[0], str)
    wide = df.withColumn("_x", vector_to_array(FEATURES)).select("*", F.posexplode(grid_array(grid)).alias("_place", "grid"))
    code = F.col("_place" if text else "grid").cast("double")
    replaced = F.transform("_x", lambda v, i: F.when(i == position, code).otherwise(v))
    return wide.withColumn(FEATURES, array_to_vector(replaced)).drop("_x", "_place")


def model_output(scored: DataFrame, target: int | None) -> Column:
    return F.col("prediction") if target is None else F.col("probability")[target]


def partial_dependence(df: DataFrame, fitted: Scored, feature_names: Sequence[str], grids: dict[str, list], target: int | None = None) -> DataFrame:
    """(feature, grid, mean): average output with the feature set to each grid value. The
    averages combine map-side, so only grid-sized partial sums are shuffled."""
    parts = []
    for feature, grid in grids.items():
        scored = fitted.score(over_grid(df, feature, grid, list(feature_names).index(feature)))
        parts.append(scored.groupBy(F.col("grid").cast("string").alias("grid")).agg(F.avg(model_output(scored, target)).alias("mean")).withColumn("feature", F.lit(feature)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("feature", "grid", "mean")


def individual_curves(df: DataFrame, fitted: Scored, id_col: str, feature_names: Sequence[str], grids: dict[str, list], target: int | None = None) -> DataFrame:
    """(id, feature, grid, output): the same without averaging, for the rows of `df`; numeric features."""
    parts = []
    for feature, grid in grids.items():
        scored = fitted.score(over_grid(df, feature, grid, list(feature_names).index(feature)))
        parts.append(scored.select(col(id_col), F.lit(feature).alias("feature"), F.col("grid").cast("double").alias("grid"), model_output(scored, target).alias("output")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
