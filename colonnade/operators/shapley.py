"""Shapley values of every tree family: single trees, forests, randomised trees, boosting.

A fitted model becomes a list of parts. A part is a set of leaves with the coordinates its trees
cut in (the features themselves, or the random intervals of extra trees), and every leaf carries
the vector that it adds to the explained outputs. All families are then one computation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from colonnade.columns import col
from colonnade.operators.models.common import FEATURES, Scored, argmax
from colonnade.session import scratch_path

TABLE_FEATURES = 10  # leaves with more features on their path are not tabulated by branch pattern
KEPT_CELLS = 8_000_000  # numbers of known patterns that a task keeps


def node_table(df: DataFrame, model) -> pd.DataFrame:
    """The nodes of a fitted MLlib tree or forest, from its saved form: (tree, id,
    prediction, stats, left, right, feature, cut, categories). Bounded by trees x 2^depth."""
    path = scratch_path(df.sparkSession, "trees")
    model.write().overwrite().save(path)
    saved = df.sparkSession.read.parquet(f"{path}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID").alias("tree"), "nodeData.*")
    else:
        saved = saved.withColumn("tree", F.lit(0))
    return saved.select(
        "tree", "id", "prediction", F.col("impurityStats").alias("stats"), F.col("leftChild").alias("left"), F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"), F.col("split.leftCategoriesOrThreshold").alias("cut"), F.col("split.numCategories").alias("categories"),
    ).toPandas()


def node_tables(df: DataFrame, models: Sequence, parallelism: int = 4) -> list[pd.DataFrame]:
    """The node tables of several models, read a few at a time."""
    with ThreadPoolExecutor(parallelism) as pool:
        return list(pool.map(lambda m: node_table(df, m), models))


@dataclass
class Part:
    """Leaves of trees that cut in the same coordinates.

    `leaves`: (output vector, coordinates, branch conditions, cover ratios) per leaf. `usable` and
    `splits` say which features became interval numbers, and by which bounds; without them
    the coordinates are the features.
    """

    leaves: list[tuple]
    usable: list[int] | None = None
    splits: list[list[float]] | None = None

    def coordinates(self, x: np.ndarray) -> np.ndarray:
        if self.usable is None:
            return x
        return np.stack([np.searchsorted(self.splits[f][1:-1], x[:, f], "right") for f in self.usable], 1).astype(float)

    def feature(self, coordinate: int) -> int:
        return coordinate if self.usable is None else self.usable[coordinate]

    def bounds(self) -> dict[int, np.ndarray | None]:
        """Per coordinate that the trees cut in, all its bounds in order; None where they cut by categories."""
        cuts: dict[int, set | None] = {}
        for _, coordinates, conditions, _ in self.leaves:
            for f, steps in zip(coordinates, conditions):
                for cut, categories, _ in steps:
                    if categories != -1:
                        cuts[f] = None
                    elif cuts.setdefault(f, set()) is not None:
                        cuts[f].add(cut[0])
        return {f: None if c is None else np.array(sorted(c)) for f, c in sorted(cuts.items())}


def class_shares(node) -> np.ndarray:
    stats = np.array(node.stats, float)
    return stats / stats.sum()


def leaf_paths(nodes: pd.DataFrame, value, weights: Sequence[float], counted: bool) -> list[tuple]:
    """Per leaf: (output vector scaled by tree weight, coordinates, branch conditions, cover ratios).

    Conditions and ratios on the same coordinate are merged, as a coalition either follows
    the row on all of them or on none. `value` gives a leaf's vector; `counted` says that node
    statistics are weights per class (else their first entry is the node's weight).
    """
    cover = lambda n: float(np.sum(n.stats)) if counted else float(n.stats[0])
    out = []
    for tree, part in nodes.groupby("tree"):
        table = {n.id: n for n in part.itertuples()}
        stack = [(table[0], {})]
        while stack:
            node, path = stack.pop()
            if node.left < 0:
                features = list(path)
                out.append((weights[tree] * value(node), features, [path[f][0] for f in features], [path[f][1] for f in features]))
                continue
            for child_id, goes_left in ((node.left, True), (node.right, False)):
                child = table[child_id]
                conditions, ratio = path.get(node.feature, ((), 1.0))
                step = (tuple(node.cut), node.categories, goes_left)
                stack.append((child, {**path, node.feature: ((*conditions, step), ratio * cover(child) / max(cover(node), 1e-300))}))
    return out


def follows(x: np.ndarray, conditions) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for cut, categories, goes_left in conditions:
        left = x <= cut[0] if categories == -1 else np.isin(x, cut)
        ok &= left if goes_left else ~left
    return ok


def codes(at: np.ndarray, bounds: dict[int, np.ndarray | None]) -> np.ndarray:
    """Per row and bounded coordinate the interval that it falls into (the value itself for categories)."""
    return np.stack([at[:, f] if b is None else np.searchsorted(b, at[:, f]).astype(float) for f, b in bounds.items()], 1) if bounds else np.zeros((len(at), 0))


def patterns(at: np.ndarray, bounds: dict[int, np.ndarray | None]) -> tuple[np.ndarray, np.ndarray]:
    """(first row of every pattern of intervals, pattern of every row)."""
    number = np.zeros(len(at), np.int64)
    for column in codes(at, bounds).T:
        values, code = np.unique(column, return_inverse=True)
        number = np.unique(number * len(values) + code, return_inverse=True)[1]
    return np.unique(number, return_index=True, return_inverse=True)[1:]


def shares_of_leaf(hits: list[np.ndarray], ratios: Sequence[float]) -> list[np.ndarray]:
    """The share of a leaf's value that each of its features gets, per row of branch hits.

    For a leaf with m features, the value of a coalition is the product of row indicators
    (in it) and cover ratios (out of it), so feature f receives (o_f - z_f) times the
    Shapley-weighted coefficients of prod_{j != f} (z_j + o_j t) (Lundberg et al. 2018).
    """
    m, n = len(ratios), len(hits[0])
    weight = [math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m) for s in range(m)]
    out = []
    for i in range(m):
        poly = [np.ones(n)] + [np.zeros(n) for _ in range(m - 1)]
        for j in range(m):
            if j != i:
                for s in range(m - 1, -1, -1):
                    poly[s] = poly[s] * ratios[j] + (poly[s - 1] * hits[j] if s else 0.0)
        out.append((hits[i] - ratios[i]) * sum(w * p for w, p in zip(weight, poly)))
    return out


def branch_table(ratios: Sequence[float]) -> np.ndarray:
    """The same for all 2^m branch patterns: pattern x feature."""
    m = len(ratios)
    patterns = np.arange(2 ** m)
    return np.stack(shares_of_leaf([(patterns >> j & 1).astype(float) for j in range(m)], ratios), 1)


class Explainer:
    """Path-dependent tree Shapley values of batches of rows (rows x features x outputs).

    Rows that fall into the same intervals between the bounds of a part's trees follow the same
    branches, so values are computed per pattern of intervals and kept for later batches.
    """

    def __init__(self, parts: list[Part], outputs: int):
        self.parts, self.outputs = parts, outputs
        self.tables = [[branch_table(r) if 0 < len(r) <= TABLE_FEATURES else None for _, _, _, r in part.leaves] for part in parts]
        self.bounds = [part.bounds() for part in parts]
        self.known: list[tuple[dict[bytes, int], np.ndarray]] = []

    def __call__(self, x: np.ndarray) -> np.ndarray:
        phi = np.zeros((len(x), x.shape[1], self.outputs))
        if not self.known:
            self.known = [({}, np.zeros((0, *phi.shape[1:]))) for _ in self.parts]
        for i, part in enumerate(self.parts):
            at = part.coordinates(x)
            first, pattern = patterns(at, self.bounds[i])
            names, held = self.known[i]
            keys = [row.tobytes() for row in codes(at[first], self.bounds[i])]
            new = [j for j, key in enumerate(keys) if key not in names]
            if new and (len(names) + len(new)) * phi[0].size * len(self.parts) > KEPT_CELLS:  # start afresh
                names, held, new = {}, held[:0], range(len(keys))
            if len(new):
                names.update((keys[j], len(held) + n) for n, j in enumerate(new))
                self.known[i] = names, held = names, np.concatenate([held, self.explain(i, at[first[np.array(new)]], x.shape[1])])
            phi += held[np.array([names[key] for key in keys], np.int64)][pattern]
        return phi

    def explain(self, number: int, at: np.ndarray, features: int) -> np.ndarray:
        """Of one part, for rows of its coordinates."""
        part, phi = self.parts[number], np.zeros((len(at), features, self.outputs))
        seen: dict[tuple, np.ndarray] = {}
        for (value, coordinates, conditions, ratios), table in zip(part.leaves, self.tables[number]):
            if not coordinates:
                continue
            hits = []
            for f, c in zip(coordinates, conditions):
                if (f, c) not in seen:
                    seen[f, c] = follows(at[:, f], c)
                hits.append(seen[f, c])
            if table is None:
                shares = shares_of_leaf([h.astype(float) for h in hits], ratios)
            else:
                pattern = np.zeros(len(at), np.int64)
                for j, h in enumerate(hits):
                    pattern |= h.astype(np.int64) << j
                shares = table[pattern].T
            for f, share in zip(coordinates, shares):
                target = phi[:, part.feature(f), :]
                for c in np.flatnonzero(value):
                    target[:, c] += share * value[c]
        return phi


def tree_parts(df: DataFrame, fitted: Scored) -> tuple[list[Part], int, str]:
    """(parts, outputs, link): what is explained of each family, and how it becomes predictions.

    "probability": class probabilities of trees, forests and extra trees. "margin": the margin of
    a two-class boosted model. "margins": one margin per class of models fitted one against the
    rest. "votes": the weighted votes per class of AdaBoost. "prediction": the value of
    regressors; of a boosted median the mean of its trees, weighted by their strengths.
    """
    state, number = fitted.state, lambda n: np.array([float(n.prediction)])
    if fitted.kind == "one against the rest":
        k, models = len(state["models"]), state["models"]
        place = lambda c: lambda n: float(n.prediction) * np.eye(k)[c]
        return [Part(leaf_paths(nodes, place(c), list(m.treeWeights), False)) for c, (m, nodes) in enumerate(zip(models, node_tables(df, models)))], k, "margins"
    if fitted.kind == "extra trees":
        classify, groups, parts = state["task"] == "classification", len(state["models"]), []
        for nodes, splits in zip(node_tables(df, state["models"]), state["plans"]):
            trees = int(nodes["tree"].max()) + 1
            usable = [i for i, s in enumerate(splits) if len(s) > 2]
            parts.append(Part(leaf_paths(nodes, class_shares if classify else number, [1.0 / (trees * groups)] * trees, classify), usable, splits))
        return parts, state["models"][0].numClasses if classify else 1, "probability" if classify else "prediction"
    if fitted.kind == "samme":
        k, alphas = state["k"], state["alphas"]
        mass = sum(alphas) * (k - 1)
        vote = lambda n: (np.eye(k)[int(n.prediction)] * k / (k - 1) - 1 / (k - 1)) / mass
        return [Part(leaf_paths(nodes, vote, [a], True)) for a, nodes in zip(alphas, node_tables(df, state["models"]))], k, "votes"
    if fitted.kind == "boosted median":
        strengths = state["strengths"]
        return [Part(leaf_paths(nodes, number, [w / sum(strengths)], False)) for w, nodes in zip(strengths, node_tables(df, state["models"]))], 1, "prediction"
    model = state.get("model")
    name = type(model).__name__
    if not name.startswith(("GBT", "DecisionTree", "RandomForest")):
        raise ValueError(f"not a tree model: {fitted.kind}")
    nodes = node_table(df, model)
    trees = int(nodes["tree"].max()) + 1
    if name.startswith("GBT"):
        return [Part(leaf_paths(nodes, number, list(model.treeWeights), False))], 1, "margin" if "Classification" in name else "prediction"
    classify = "Classification" in name
    return [Part(leaf_paths(nodes, class_shares if classify else number, [1.0 / trees] * trees, classify))], model.numClasses if classify else 1, "probability" if classify else "prediction"


def tree_shap(df: DataFrame, fitted: Scored, id_col: str, feature_names: Sequence[str], class_names: Sequence[str] | None = None) -> DataFrame:
    """(id, class, feature, value, phi, base) of every row. The leaves are small and
    travel with the task; rows stay where they are, in Arrow batches."""
    parts, outputs, link = tree_parts(df, fitted)
    base = np.sum([value * np.prod(ratios) for part in parts for value, _, _, ratios in part.leaves], 0)
    single = link in ("margin", "prediction")
    names = [None] if single else list(class_names or [str(i) for i in range(outputs)])
    features, explainer = list(feature_names), Explainer(parts, outputs)
    id_type = df.schema[id_col].dataType.simpleString()

    def explain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                n = part.num_rows
                x = part.column(1).flatten().to_numpy().reshape(n, -1)
                p, k = x.shape[1], len(names)
                row, column, of = (np.broadcast_to(np.arange(m).reshape(shape), (n, k, p)).ravel() for m, shape in ((n, (-1, 1, 1)), (p, (1, 1, -1)), (k, (1, -1, 1))))
                columns = [
                    part.column(0).take(pa.array(row)), pa.array(names, pa.string()).take(pa.array(of)), pa.array(features, pa.string()).take(pa.array(column)),
                    pa.array(x[row, column]), pa.array(explainer(x).transpose(0, 2, 1)[:, :k].ravel()), pa.array(base[of].astype(float)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "class", "feature", "value", "phi", "base"])

    rows = df.select(col(id_col).alias("id"), vector_to_array(FEATURES).alias("x"))
    out = rows.mapInArrow(explain, f"id {id_type}, class string, feature string, value double, phi double, base double")
    return out.withColumnRenamed("id", id_col)


def explained_output(attributions: DataFrame, id_col: str, link: str, classes: Sequence[str] = ()) -> DataFrame:
    """What the attributions add up to, as the model reports it: (id, prediction) or
    (id, probability, prediction). `link` is that of `tree_parts`."""
    whole = F.sum("phi") + F.first("base")
    if link == "prediction":
        return attributions.groupBy(col(id_col)).agg(whole.alias("prediction"))
    if link == "margin":
        hit = lambda m: 1 / (1 + F.exp(-2 * m))
        sums = attributions.groupBy(col(id_col)).agg(whole.alias("_m"))
        return sums.select(col(id_col), F.array(1 - hit(F.col("_m")), hit(F.col("_m"))).alias("probability")).withColumn("prediction", argmax(F.col("probability")))
    of = lambda c: F.col("class") == F.lit(c)
    sums = attributions.groupBy(col(id_col)).agg(*[(F.sum(F.when(of(c), F.col("phi"))) + F.first(F.when(of(c), F.col("base")), True)).alias(f"_s{i}") for i, c in enumerate(classes)])
    scores: list[Column] = [F.col(f"_s{i}") for i in range(len(classes))]
    if link == "margins":
        scores = [1 / (1 + F.exp(-2 * s)) for s in scores]
    elif link == "votes":
        scores = [F.exp(s) for s in scores]
    raw = sums.select(col(id_col), F.array(*scores).alias("_s"))
    mass = F.aggregate("_s", F.lit(0.0), lambda a, v: a + v)
    shares = F.col("_s") if link == "probability" else F.transform("_s", lambda v: v / mass)
    return raw.withColumn("probability", shares).withColumn("prediction", argmax(F.col("probability"))).drop("_s")
