"""Tree families on MLlib: single trees, forests, randomised trees, boosting."""

from __future__ import annotations

import math
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, RandomForestClassifier
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from colonnade.operators.models.common import FEATURES, LABEL, Scored, argmax, class_count, ml_classifier, ml_regressor, scorer, total, with_array, with_class_scores
from colonnade.session import checkpoint, stored

MAX_BINS = 256
MERGED_ROWS = 1_000_000  # rows of a training set from which rows that trees cannot tell apart are merged
MERGED_WIDTH = 32  # features up to which many such rows can be expected
ROWS = "_rows"
CHECKPOINT_EVERY = 10  # rounds of a boosting loop between lineage cuts


def options_of(weight: str | None, **more) -> dict:
    return {**({"weightCol": weight} if weight else {}), **more}


def cut_points(df: DataFrame, columns: Sequence[str], points: int = MAX_BINS - 1) -> dict[str, list[float]]:
    """Per column its distinct finite numbers, or as many quantiles where there are more than `points`."""
    if not columns:
        return {}
    value = lambda c: F.when(~F.isnan(c), F.col(c) + F.lit(0.0))  # -0.0 and 0.0 are one value
    told = df.agg(*[F.approx_count_distinct(value(c)).alias(c) for c in columns]).first()
    few = {c for c in columns if told[c] <= 2 * points}
    probs = F.array(*[F.lit((i + 0.5) / points) for i in range(points)])
    quantile = lambda c: F.percentile_approx(value(c), probs, 10 * points)
    found = df.agg(*[(F.collect_set(value(c)) if c in few else quantile(c)).alias(c) for c in columns]).first().asDict()
    long = [c for c in few if len(found[c]) > points]
    found |= df.agg(*[quantile(c).alias(c) for c in long]).first().asDict() if long else {}
    out = {}
    for c in columns:
        kept: list[float] = []
        for v in sorted({v for v in found[c] or [] if math.isfinite(v)}):
            if not kept or kept[-1] < (kept[-1] + v) / 2 < v:
                kept.append(v)
        out[c] = kept
    return out


def merged_rows(df: DataFrame, columns: Sequence[str], nominal: Sequence[str], keys: Sequence[str], weights: Sequence[str]) -> DataFrame | None:
    """(columns..., keys..., weights..., ROWS): rows that a tree cannot tell apart as one row, weights and
    rows summed; nothing where that leaves too many rows, or there are many columns.

    A tree cuts a number half way between the values that it is shown, MAX_BINS of them at most.
    Here every number goes to the nearest of these values, one half way between two of them to
    the lower one, as in a tree. So the cuts of a tree fitted to the merged rows divide all rows just
    as they divide the merged ones, and each of its sums is the sum over all rows. `nominal` columns
    hold category numbers, which stay.
    """
    if not 0 < len(columns) <= MERGED_WIDTH:
        return None
    points = cut_points(df, [c for c in columns if c not in nominal])
    cut = [c for c in points if len(points[c]) > 1]
    # an interval of the Bucketizer has its lower end, one of a tree its upper end; what is not finite stays NaN, which MLlib refuses
    turned = lambda c: F.when(F.abs(c) < float("inf"), -F.col(c)).otherwise(float("nan"))
    flat = df.select(*keys, *weights, *[(turned(c) if c in cut else F.col(c) + F.lit(0.0)).alias(c) for c in columns])
    if cut:
        ends = [[(a + b) / 2 for a, b in zip(points[c], points[c][1:])] for c in cut]
        splits = [[float("-inf"), *[-e for e in reversed(e)], float("inf")] for e in ends]
        flat = Bucketizer(splitsArray=splits, inputCols=cut, outputCols=[f"{c}_place" for c in cut], handleInvalid="keep").transform(flat)
    places = [f"{c}_place" if c in cut else c for c in columns]
    cells = stored(flat.groupBy(*keys, *places).agg(F.count(F.lit(1)).cast("double").alias(ROWS), *[F.sum(w).alias(w) for w in weights]), "cells")
    n, rows = cells.agg(F.count(F.lit(1)), F.sum(ROWS)).first()
    if n * 4 > (rows or 0):
        return None
    # MLlib has no more bins than rows, so very few rows come in several equal parts
    parts = -(-2 * MAX_BINS // n)
    if parts > 1:
        cells = cells.crossJoin(F.broadcast(df.sparkSession.range(parts).select(F.col("id").alias("_part"))))

    def value(c: str) -> Column:
        if c not in cut:
            return F.col(c)
        place = F.lit(len(points[c]) - 1) - F.col(f"{c}_place").cast("int")
        return F.when(place >= 0, F.get(F.array(*[F.lit(v) for v in points[c]]), place)).otherwise(float("nan")).alias(c)

    return cells.select(*[value(c) for c in columns], *keys, *[(F.col(w) / parts).alias(w) for w in (*weights, ROWS)])


def decision_tree(df: DataFrame, max_depth: int = 5, weight: str | None = None) -> Scored:
    return ml_classifier(DecisionTreeClassifier(maxDepth=max_depth, maxBins=MAX_BINS, seed=42, **options_of(weight)).fit(df))


def random_forest(df: DataFrame, max_depth: int = 5, trees: int = 100, weight: str | None = None) -> Scored:
    return ml_classifier(RandomForestClassifier(numTrees=trees, maxDepth=max_depth, maxBins=64, featureSubsetStrategy="sqrt", seed=42, **options_of(weight)).fit(df))


def decision_tree_regressor(df: DataFrame, max_depth: int = 5) -> Scored:
    return ml_regressor(DecisionTreeRegressor(maxDepth=max_depth, maxBins=MAX_BINS, seed=42).fit(df))


def random_forest_regressor(df: DataFrame, max_depth: int = 5, trees: int = 100) -> Scored:
    return ml_regressor(RandomForestRegressor(numTrees=trees, maxDepth=max_depth, maxBins=64, featureSubsetStrategy="all", seed=42).fit(df))


def random_cuts(low: np.ndarray, high: np.ndarray, cuts: int, seed: int) -> list[list[float]]:
    draw = np.random.RandomState(seed)
    out = []
    for a, b in zip(low, high):
        points = sorted(set(draw.uniform(a, b, cuts))) if b > a else []
        out.append([float("-inf"), *[float(p) for p in points], float("inf")])
    return out


def cut_features(df: DataFrame, splits: list[list[float]]) -> DataFrame:
    """Replace every feature by the number of its random interval."""
    usable = [i for i, s in enumerate(splits) if len(s) > 2]
    flat = with_array(df).select(*[F.col(c) for c in df.columns if c != FEATURES], *[F.col("_x")[i].alias(f"_f{i}") for i in usable])
    cut = Bucketizer(splitsArray=[splits[i] for i in usable], inputCols=[f"_f{i}" for i in usable], outputCols=[f"_c{i}" for i in usable])
    join = VectorAssembler(inputCols=[f"_c{i}" for i in usable], outputCol=FEATURES)
    return join.transform(cut.transform(flat)).drop(*[f"_f{i}" for i in usable], *[f"_c{i}" for i in usable])


def extra_trees(df: DataFrame, task: str = "classification", max_depth: int = 5, trees: int = 100, groups: int = 10, cuts: int = 15, weight: str | None = None, parallelism: int = 4) -> Scored:
    """Randomised trees: no bootstrap, and every group of trees may only cut at its own
    randomly drawn points. Groups are independent fits, run a few at a time."""
    ends = with_array(df).select(F.posexplode("_x").alias("i", "v")).groupBy("i").agg(F.min("v").alias("a"), F.max("v").alias("b")).orderBy("i").collect()
    low, high = np.array([r["a"] for r in ends]), np.array([r["b"] for r in ends])
    plans = [random_cuts(low, high, cuts, 42 + g) for g in range(groups)]
    kind = RandomForestClassifier if task == "classification" else RandomForestRegressor
    subset = "sqrt" if task == "classification" else "all"

    def fit(g: int):
        estimator = kind(numTrees=max(1, trees // groups), maxDepth=max_depth, maxBins=max(32, cuts + 2), bootstrap=False, featureSubsetStrategy=subset, seed=42 + g, **options_of(weight))
        return estimator.fit(cut_features(df, plans[g]))

    with ThreadPoolExecutor(parallelism) as pool:
        models = list(pool.map(fit, range(groups)))
    return Scored("extra trees", models=models, plans=plans, task=task)


@scorer("extra trees")
def score_extra_trees(state: dict, rows: DataFrame) -> DataFrame:
    models, groups = state["models"], len(state["models"])
    classify = state["task"] == "classification"
    out = rows.withColumn("_features", F.col(FEATURES))
    for g, model in enumerate(models):
        model.setPredictionCol(f"_p{g}")
        if classify:
            model.setProbabilityCol(f"_q{g}").setRawPredictionCol(f"_r{g}")
        restored = out.withColumn(FEATURES, F.col("_features"))
        out = model.transform(cut_features(restored, [[float(v) for v in s] for s in state["plans"][g]])).drop(FEATURES, f"_r{g}")
    if classify:
        arrays = [vector_to_array(f"_q{g}") for g in range(groups)]
        p = F.array(*[total([a[c] for a in arrays]) / groups for c in range(models[0].numClasses)])
        out = out.withColumn("probability", p).withColumn("prediction", argmax(F.col("probability")))
    else:
        out = out.withColumn("prediction", total([F.col(f"_p{g}") for g in range(groups)]) / groups)
    return out.drop(*[f"_{a}{g}" for a in "pq" for g in range(groups)]).withColumnRenamed("_features", FEATURES)


def gradient_boosting(df: DataFrame, max_depth: int = 3, rounds: int = 100, rate: float = 0.1, weight: str | None = None, subsample: float = 1.0) -> Scored:
    """Gradient-boosted trees; more than two classes are fitted one against the rest."""
    k = class_count(df)
    make = lambda: GBTClassifier(maxIter=rounds, stepSize=rate, maxDepth=max_depth, maxBins=MAX_BINS, subsamplingRate=subsample, seed=42, **options_of(weight))
    if k == 2:
        return ml_classifier(make().fit(df))
    models = [make().fit(df.withColumn(LABEL, (F.col(LABEL) == c).cast("double"))) for c in range(k)]
    return Scored("one against the rest", models=models)


@scorer("one against the rest")
def score_one_against_rest(state: dict, rows: DataFrame) -> DataFrame:
    out, k = rows, len(state["models"])
    for c, model in enumerate(state["models"]):
        model.setPredictionCol(f"_p{c}").setProbabilityCol(f"_q{c}").setRawPredictionCol(f"_r{c}")
        out = model.transform(out)
    hits = [vector_to_array(f"_q{c}")[1] for c in range(k)]
    return with_class_scores(out, hits, softmax=False).drop(*[f"_{a}{c}" for a in "pqr" for c in range(k)])


def gradient_boosting_regressor(df: DataFrame, max_depth: int = 3, rounds: int = 100, rate: float = 0.1) -> Scored:
    return ml_regressor(GBTRegressor(maxIter=rounds, stepSize=rate, maxDepth=max_depth, maxBins=MAX_BINS, seed=42).fit(df))


# Depth, learning rate and rounds that stand in for three boosting libraries.
PRESETS = {
    "XGBoost": {"max_depth": 6, "rate": 0.3, "rounds": 100},
    "LightGBM": {"max_depth": 5, "rate": 0.1, "rounds": 100},
    "CatBoost": {"max_depth": 6, "rate": 0.1, "rounds": 100},
}
PRESETS_REGRESSION = {**PRESETS, "CatBoost": {"max_depth": 6, "rate": 0.03, "rounds": 1000}}


def boosted_preset(df: DataFrame, name: str, weight: str | None = None, **changes) -> Scored:
    return gradient_boosting(df, weight=weight, **{**PRESETS[name], **changes})


def boosted_preset_regressor(df: DataFrame, name: str, **changes) -> Scored:
    return gradient_boosting_regressor(df, **{**PRESETS_REGRESSION[name], **changes})


def adaboost(df: DataFrame, rounds: int = 50, max_depth: int = 1) -> Scored:
    """SAMME: reweighted stumps. The weight update is a column expression; the frame is
    checkpointed every few rounds so that plans stay short and lost tasks can be redone."""
    k = class_count(df)
    frame = df.select(FEATURES, LABEL, F.lit(1.0).alias("_w"))
    models, alphas = [], []
    for i in range(rounds):
        model = DecisionTreeClassifier(maxDepth=max_depth, maxBins=MAX_BINS, weightCol="_w", seed=42 + i, predictionCol="_h", rawPredictionCol="_hr", probabilityCol="_hp").fit(frame)
        judged = model.transform(frame).withColumn("_miss", (F.col("_h") != F.col(LABEL)).cast("double"))
        row = judged.agg(F.sum(F.col("_w") * F.col("_miss")), F.sum("_w")).first()
        error = row[0] / row[1]
        if error <= 0:
            models, alphas = [*models, model], [*alphas, 1.0]
            break
        if error >= 1 - 1 / k:
            break
        alpha = float(np.log((1 - error) / error) + np.log(k - 1))
        models.append(model)
        alphas.append(alpha)
        # rescaled to a mean weight of 1, which no error rate depends on
        grown = F.col("_w") * F.exp(F.lit(alpha) * F.col("_miss"))
        norm = (row[1] - row[0] + row[0] * float(np.exp(alpha))) / max(row[1], 1e-300)
        frame = judged.select(FEATURES, LABEL, (grown / norm).alias("_w"))
        if (i + 1) % CHECKPOINT_EVERY == 0:
            frame = checkpoint(frame)
    if not models:
        raise ValueError("no round was better than chance")
    return Scored("samme", models=models, alphas=alphas, k=k)


@scorer("samme")
def score_samme(state: dict, rows: DataFrame) -> DataFrame:
    out, names, alphas, k = rows, [], state["alphas"], state["k"]
    for i, model in enumerate(state["models"]):
        model.setPredictionCol(f"_h{i}").setRawPredictionCol(f"_r{i}").setProbabilityCol(f"_q{i}")
        out = model.transform(out).drop(f"_r{i}", f"_q{i}")
        names.append(f"_h{i}")
    mass = sum(alphas) * (k - 1)
    vote = lambda c: total([F.when(F.col(h) == c, a).otherwise(-a / (k - 1)) for h, a in zip(names, alphas)]) / mass
    return with_class_scores(out, [vote(c) for c in range(k)]).drop(*names)


def weighted_median(values: list[Column], weights: list[float]) -> Column:
    """Smallest value at which the running weight reaches half of the total."""
    pairs = F.array_sort(F.array(*[F.struct(v.alias("v"), F.lit(float(w)).alias("w")) for v, w in zip(values, weights)]))
    start = F.struct(F.lit(0.0).alias("s"), F.lit(None).cast("double").alias("v"))
    half = sum(weights) / 2
    step = lambda acc, p: F.struct(
        (acc["s"] + p["w"]).alias("s"), F.when(acc["v"].isNotNull(), acc["v"]).when(acc["s"] + p["w"] >= half - 1e-12, p["v"]).alias("v")
    )
    return F.aggregate(pairs, start, step, lambda acc: acc["v"])


def adaboost_r2(df: DataFrame, rounds: int = 50, max_depth: int = 3) -> Scored:
    """AdaBoost.R2 with linear loss (Drucker 1997): reweighted regression trees combined by
    their weighted median."""
    frame = df.select(FEATURES, LABEL, F.lit(1.0).alias("_w"))
    models, strengths = [], []
    for i in range(rounds):
        model = DecisionTreeRegressor(maxDepth=max_depth, maxBins=MAX_BINS, weightCol="_w", seed=42 + i, predictionCol="_h").fit(frame)
        judged = model.transform(frame).withColumn("_e", F.abs(F.col("_h") - F.col(LABEL)))
        row = judged.agg(F.max("_e"), F.sum(F.col("_w") * F.col("_e")), F.sum("_w")).first()
        loss = row[1] / (row[2] * row[0]) if row[0] else 0.0
        if loss <= 0 or loss >= 0.5:
            if loss <= 0 or not models:
                models, strengths = [*models, model], [*strengths, 1.0]
            break
        beta = loss / (1 - loss)
        models.append(model)
        strengths.append(float(np.log(1 / beta)))
        shrunk = F.col("_w") * F.pow(F.lit(beta), 1 - F.col("_e") / F.lit(float(row[0])))
        frame = judged.select(FEATURES, LABEL, (shrunk / (beta ** (1 - loss))).alias("_w"))
        if (i + 1) % CHECKPOINT_EVERY == 0:
            frame = checkpoint(frame)
    return Scored("boosted median", models=models, strengths=strengths)


@scorer("boosted median")
def score_boosted_median(state: dict, rows: DataFrame) -> DataFrame:
    out, names = rows, [f"_h{i}" for i in range(len(state["models"]))]
    for name, model in zip(names, state["models"]):
        out = model.setPredictionCol(name).transform(out)
    return out.withColumn("prediction", weighted_median([F.col(h) for h in names], state["strengths"])).drop(*names)
