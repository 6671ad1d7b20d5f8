"""Cross-validated training: folds x models, out-of-fold predictions, metrics, best model."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from colonnade.columns import col, literal_rows
from colonnade.operators import features as X
from colonnade.operators.metrics import classification_metrics, regression_metrics
from colonnade.operators.models import bayes, linear, trees
from colonnade.operators.models.common import LABEL, Scored
from colonnade.operators.models.neighbours_model import knn
from colonnade.operators.splitting import cross_validation_folds, split_fold
from colonnade.plans.features import FeatureOptions, FeaturePlan
from colonnade.sources.models import load_model, save_model

CLASSIFIERS: dict[str, Callable[..., Scored]] = {
    "Logistic Regression": linear.logistic_regression, "Linear Discriminant Analysis": linear.linear_discriminant,
    "Bernoulli Naive Bayes": bayes.bernoulli_nb, "Gaussian Naive Bayes": bayes.gaussian_nb,
    "SVC": linear.rbf_svc, "Linear SVC": linear.linear_svc, "KNN": knn,
    "Decision Tree": trees.decision_tree, "Extra Trees": trees.extra_trees, "Random Forest": trees.random_forest,
    "AdaBoost": trees.adaboost, "Gradient Boosting": trees.gradient_boosting,
    **{name: (lambda df, name=name, **o: trees.boosted_preset(df, name, **o)) for name in trees.PRESETS},
}
REGRESSORS: dict[str, Callable[..., Scored]] = {
    "Linear Regression": linear.least_squares, "Ridge": linear.ridge, "Lasso": linear.lasso, "Elastic Net": linear.elastic_net,
    "SVR": linear.rbf_svr, "Linear SVR": linear.linear_svr, "KNN": knn, "Decision Tree": trees.decision_tree_regressor,
    "Extra Trees": lambda df, **o: trees.extra_trees(df, "regression", **o), "Random Forest": trees.random_forest_regressor,
    "AdaBoost": trees.adaboost_r2, "Gradient Boosting": trees.gradient_boosting_regressor,
    **{name: (lambda df, name=name, **o: trees.boosted_preset_regressor(df, name, **o)) for name in trees.PRESETS},
}
WEIGHTED = {"Decision Tree", "Extra Trees", "Random Forest", *trees.PRESETS}  # classifiers that take balanced weights
MERGED = {"Decision Tree", "Gradient Boosting", *trees.PRESETS}  # classifiers that take merged rows


@dataclass
class ModelSpec:
    name: str
    family: str
    params: dict = field(default_factory=dict)


@dataclass
class TrainingConfig:
    id_col: str
    target: str
    task: str  # classification | regression
    models: list[ModelSpec]
    folds: int = 5
    metrics: list[str] | None = None
    best_metric: str = ""
    higher_is_better: bool = True
    features: FeatureOptions | None = None
    balanced: bool = False
    parallelism: int = 2


def define_models(families: list[str], counts: list[int] | None = None, params: list[list[dict]] | None = None) -> list[ModelSpec]:
    """Numbered variants per family: `{family} 1`, `{family} 2`, ..."""
    counts = counts or [1] * len(families)
    return [
        ModelSpec(f"{family} {i + 1}", family, dict(params[f][i]) if params else {})
        for f, family in enumerate(families) for i in range(counts[f])
    ]


def long_scores(scored: DataFrame, id_col: str, classes: list[str], extra: dict[str, Column]) -> DataFrame:
    """(id, extra..., class, proba, pred): one row per class out of the probability array."""
    rows = F.array(*[F.struct(F.lit(c).alias("class"), F.col("probability")[i].alias("proba")) for i, c in enumerate(classes)])
    pred = X.decode_label(F.col("prediction"), classes)
    return scored.select(col(id_col), *[e.alias(n) for n, e in extra.items()], pred.alias("pred"), F.inline(rows))


def takes_merged(spec: ModelSpec, config: TrainingConfig) -> bool:
    return config.task == "classification" and spec.family in MERGED and spec.params.get("subsample", 1.0) == 1.0


def fit_one(spec: ModelSpec, config: TrainingConfig, train: DataFrame, merged: DataFrame | None = None) -> tuple[Scored, float]:
    """`merged`: the rows of `train` as trees see them, for the families that take them."""
    start = time.perf_counter()
    families = CLASSIFIERS if config.task == "classification" else REGRESSORS
    options = dict(spec.params)
    if config.balanced and config.task == "classification" and spec.family in WEIGHTED:
        options["weight"] = "weight_int" if spec.family in trees.PRESETS else "weight"  # boosted models take whole numbers
    if spec.family == "KNN":
        options |= {"id_col": X.safe_name(config.id_col), "task": config.task}
    if merged is not None and takes_merged(spec, config):
        train, options["weight"] = merged, options.get("weight", trees.ROWS)
    return families[spec.family](train, **options), time.perf_counter() - start


@dataclass
class TrainingRun:
    """Where a finished run lives; everything is read back lazily from `path`."""

    spark: SparkSession
    path: str
    config: TrainingConfig
    classes: list[str]

    def predictions(self, split: str | None = None) -> DataFrame:
        """Long predictions; partition columns split, model and fold prune the files."""
        rows = self.spark.read.parquet(f"{self.path}/predictions")
        return rows if split is None else rows.where(F.col("split") == split)

    def oof(self) -> DataFrame:
        return self.predictions("Valid")

    def metrics(self) -> DataFrame:
        """(model, fold, split, metric, class, value) of all folds and models in one job."""
        by = ["model", "fold", "split"]
        chosen = {"metrics": self.config.metrics} if self.config.metrics else {}
        if self.config.task == "classification":
            positive = self.classes[1] if len(self.classes) == 2 else None
            return classification_metrics(self.predictions(), by, positive, **chosen)
        return regression_metrics(self.predictions(), by, self.plan(0).width, **chosen)

    def runtimes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/runtimes")

    def best(self) -> DataFrame:
        return best_models(self.metrics().where("split = 'Valid'"), self.config.best_metric, self.config.higher_is_better)

    def plan(self, fold: int) -> FeaturePlan:
        return FeaturePlan.load(self.spark, f"{self.path}/fold_{fold}/plan")

    def model(self, fold: int, name: str) -> Scored:
        return load_model(self.spark, f"{self.path}/fold_{fold}/{X.safe_name(name)}")

    def score(self, df: DataFrame, models: list[str] | None = None) -> DataFrame:
        """Score new rows with every (fold, model), each after its own fold's feature plan:
        (id, model, fold, class, proba, pred) or (id, model, fold, pred). Lazy and stateless,
        so `df` may be a stream (with nearest neighbours only up to their lookup size)."""
        chosen = [spec for spec in self.config.models if not models or spec.name in models]
        parts = [self._score_fold(df, fold, chosen) for fold in range(self.config.folds)]
        return reduce(DataFrame.unionByName, parts)

    def _score_fold(self, df: DataFrame, fold: int, chosen: list[ModelSpec]) -> DataFrame:
        """All models of a fold as columns of one pass over the input, then stacked."""
        out, rows = self.plan(fold).assembled(df), []
        for i, spec in enumerate(chosen):
            out = self.model(fold, spec.name).score(out).withColumnRenamed("prediction", f"_y{i}")
            name = F.lit(spec.name).alias("model")
            if self.config.task == "classification":
                out = out.withColumnRenamed("probability", f"_p{i}")
                label = X.decode_label(F.col(f"_y{i}"), self.classes).alias("pred")
                rows += [F.struct(name, F.lit(c).alias("class"), F.col(f"_p{i}")[k].alias("proba"), label) for k, c in enumerate(self.classes)]
            else:
                rows.append(F.struct(name, F.col(f"_y{i}").alias("pred")))
        return out.select(col(X.safe_name(self.config.id_col)).alias(self.config.id_col), F.lit(fold).alias("fold"), F.inline(F.array(*rows)))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TrainingRun:
        state = json.loads(spark.read.schema("config string").json(f"{path}/config").first()["config"])
        classes = state.pop("classes")
        options = state.pop("features")
        models = [ModelSpec(**m) for m in state.pop("models")]
        return cls(spark, path, TrainingConfig(models=models, features=FeatureOptions(**options) if options else None, **state), classes)


def best_models(metrics: DataFrame, metric: str, higher_is_better: bool = True) -> DataFrame:
    """(fold, model, value): the best model of every fold, ties to the first name."""
    score = F.col("value") if not higher_is_better else -F.col("value")
    totals = metrics.where((F.col("metric") == metric) & F.col("class").isNull())
    best = totals.groupBy("fold").agg(F.min(F.struct(score.alias("s"), F.col("model").alias("m"), F.col("value").alias("v"))).alias("b"))
    return best.select("fold", F.col("b.m").alias("model"), F.col("b.v").alias("value"))


def train(df: DataFrame, config: TrainingConfig, path: str) -> TrainingRun:
    """Fit every model on every fold. The driver only loops; each fit is a distributed job
    on the fold's persisted feature frame (trees of a large one: on its rows merged as they see
    them, once for all models), models of a fold run a few at a time, and
    predictions are written out by (split, model, fold) as soon as they exist, so a lost
    executor costs one fit at most."""
    spark = df.sparkSession
    names = [X.safe_name(spec.name) for spec in config.models]
    if len(set(names)) < len(names):
        raise ValueError(f"models share a folder name: {sorted(n for n in set(names) if names.count(n) > 1)}")
    id_name, target = X.safe_name(config.id_col), X.safe_name(config.target)  # as the feature plan names them
    options = config.features or FeatureOptions()
    options.id_col, options.target = config.id_col, config.target
    classify = config.task == "classification"
    folded_path = f"{path}/folds"
    cross_validation_folds(df, config.id_col, config.target, config.folds).write.mode("overwrite").partitionBy("fold").parquet(folded_path)
    folded = spark.read.parquet(folded_path)
    classes = X.fit_labels(folded, config.target) if classify else []
    runtimes = []
    for fold in range(config.folds):
        train_rows, valid_rows = split_fold(folded, fold)
        plan = FeaturePlan.fit(train_rows, options)
        plan.save(spark, f"{path}/fold_{fold}/plan")
        counts = X.class_counts(train_rows, config.target) if classify and config.balanced else {}
        weights = {n: X.fit_class_weights(train_rows, config.target, n == "weight_int", counts) for n in ("weight", "weight_int")} if counts else {}

        def told(ready: DataFrame) -> DataFrame:
            ready = X.encode_label(ready, target, classes, LABEL) if classify else ready.withColumn(LABEL, col(target).cast("double"))
            for name, of_class in weights.items():
                ready = X.with_class_weight(ready, target, of_class, name)
            return ready

        def prepare(rows: DataFrame) -> DataFrame:
            return told(plan.assembled(rows))

        def merge() -> DataFrame | None:
            """The rows as trees see them, assembled."""
            wide = plan.transform(train_rows)
            names = {c: f"_f{i}" for i, c in enumerate(plan.features)}
            if any(kind == "vector" for c, kind in wide.dtypes if c in names):
                return None
            flat = told(wide.select(col(target), *[col(c).cast("double").alias(n) for c, n in names.items()]))
            sizes = {names[c]: k for c, k in plan.nominal.items()}
            cells = trees.merged_rows(flat, list(names.values()), list(sizes), [LABEL], list(weights))
            return None if cells is None else X.assemble(X.as_nominal(cells, sizes), [LABEL, *weights, trees.ROWS])

        train_set, merged, merge_seconds = prepare(train_rows), None, 0.0
        merging = {spec.name for spec in config.models if takes_merged(spec, config)}
        if merging and train_rows.count() >= trees.MERGED_ROWS:
            start = time.perf_counter()
            merged = merge()
            merge_seconds = time.perf_counter() - start
        read_often = merged is None or len(merging) < len(config.models)
        if read_often:
            train_set.persist()
        splits = {"Train": train_set, "Valid": prepare(valid_rows)}

        def run(spec: ModelSpec) -> tuple:
            model, fit_seconds = fit_one(spec, config, train_set, merged)
            fit_seconds += merge_seconds if spec.name in merging else 0.0
            start = time.perf_counter()
            for split, rows in splits.items():
                extra = {"actual": col(target).cast("string") if classify else F.col(LABEL)}
                scored = model.score(rows)
                out = long_scores(scored, id_name, classes, extra) if classify else scored.select(
                    col(id_name), *[e.alias(n) for n, e in extra.items()], F.col("prediction").alias("pred"))
                out = out.withColumnRenamed(id_name, config.id_col)
                out.write.mode("overwrite").parquet(f"{path}/predictions/split={split}/model={spec.name}/fold={fold}")
            save_model(spark, model, f"{path}/fold_{fold}/{X.safe_name(spec.name)}")
            return spec.name, fold, fit_seconds, time.perf_counter() - start

        with ThreadPoolExecutor(config.parallelism) as pool:
            runtimes += list(pool.map(run, config.models))
        if read_often:
            train_set.unpersist()
    literal_rows(spark, runtimes, "model string, fold int, fit_seconds double, predict_seconds double").coalesce(1).write.mode("overwrite").parquet(f"{path}/runtimes")
    state = {**asdict(config), "classes": classes}
    literal_rows(spark, [(json.dumps(state),)], "config string").coalesce(1).write.mode("overwrite").json(f"{path}/config")
    return TrainingRun(spark, path, config, classes)
