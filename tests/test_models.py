"""Models: invariants, brute-force checks, persistence, training runs, explanation."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from colonnade.operators import explain as E, features as X, predict as P, shapley as S
from colonnade.operators.models import bayes, linear, neighbours as N, trees
from colonnade.operators.models.neighbours_model import knn
from colonnade.plans.features import FeatureOptions
from colonnade.plans.training import TrainingConfig, TrainingRun, define_models, train
from colonnade.session import scratch_path
from colonnade.sources.models import load_model, save_model
from colonnade.streaming.scoring import score_stream

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def raw(spark):
    draw = np.random.RandomState(1)
    x = draw.uniform(-1, 1, (600, 3))
    y = 2 * x[:, 0] - x[:, 1] + 0.1 * draw.normal(size=600)
    rows = [(i, *map(float, x[i]), float(y[i]), "yes" if y[i] > 0 else "no", float(np.digitize(y[i], [-0.7, 0.7]))) for i in range(600)]
    return spark.createDataFrame(rows, "id int, a double, b double, c double, y double, two string, three double").cache()


@pytest.fixture(scope="module")
def sets(raw):
    vec = VectorAssembler(inputCols=XS, outputCol="features").transform(raw)
    return {
        "two": vec.select("id", "features", (F.col("two") == "yes").cast("double").alias("label")).cache(),
        "three": vec.select("id", "features", F.col("three").alias("label")).cache(),
        "y": vec.select("id", "features", F.col("y").alias("label")).cache(),
    }


CLASSIFIERS = {
    "logistic": linear.logistic_regression, "lda": linear.linear_discriminant, "bernoulli": bayes.bernoulli_nb, "gaussian": bayes.gaussian_nb,
    "svc": lambda d: linear.linear_svc(d, max_iter=20), "rbf": lambda d: linear.rbf_svc(d, dimensions=32), "tree": trees.decision_tree,
    "forest": lambda d: trees.random_forest(d, trees=5), "extra": lambda d: trees.extra_trees(d, trees=4, groups=2),
    "ada": lambda d: trees.adaboost(d, rounds=12), "gbt": lambda d: trees.gradient_boosting(d, rounds=3), "knn": lambda d: knn(d, "id"),
}
REGRESSORS = {
    "ols": linear.least_squares, "ridge": linear.ridge, "lasso": lambda d: linear.lasso(d, 0.01), "net": lambda d: linear.elastic_net(d, 0.01),
    "svr": linear.linear_svr, "rbf": lambda d: linear.rbf_svr(d, dimensions=64), "tree": trees.decision_tree_regressor,
    "forest": lambda d: trees.random_forest_regressor(d, trees=5), "extra": lambda d: trees.extra_trees(d, "regression", trees=4, groups=2),
    "ada": lambda d: trees.adaboost_r2(d, rounds=12), "gbt": lambda d: trees.gradient_boosting_regressor(d, rounds=20), "knn": lambda d: knn(d, "id", task="regression"),
}


BOTH = [(name, "two") for name in sorted(CLASSIFIERS)] + [(name, "three") for name in ("lda", "svc", "ada", "gbt")]


@pytest.mark.parametrize(("name", "target"), BOTH)
def test_classifier(spark, sets, name, target):
    df = sets[target]
    fitted = CLASSIFIERS[name](df)
    out = fitted.score(df).select("id", "label", "probability", "prediction").toPandas()
    p = np.stack(out["probability"])
    assert np.allclose(p.sum(1), 1) and (p >= 0).all() and len(out) == 600
    assert (out["prediction"] == p.argmax(1)).all()
    assert (out["prediction"] == out["label"]).mean() > 0.6
    path = scratch_path(spark, "model")
    save_model(spark, fitted, path)
    again = load_model(spark, path).score(df).select("id", "probability").toPandas()
    assert np.allclose(np.stack(again.sort_values("id")["probability"]), np.stack(out.sort_values("id")["probability"]))


@pytest.mark.parametrize("name", sorted(REGRESSORS))
def test_regressor(spark, sets, name):
    df = sets["y"]
    fitted = REGRESSORS[name](df)
    out = fitted.score(df).select("id", "label", "prediction").toPandas().sort_values("id")
    assert np.corrcoef(out["label"], out["prediction"])[0, 1] > 0.8
    path = scratch_path(spark, "model")
    save_model(spark, fitted, path)
    again = load_model(spark, path).score(df).select("id", "prediction").toPandas().sort_values("id")
    assert np.allclose(again["prediction"], out["prediction"])


def test_logistic_is_at_the_penalised_optimum(sets):
    model = linear.logistic_regression(sets["two"]).state["model"]
    rows = sets["two"].toPandas()
    x, y = np.stack([v.toArray() for v in rows["features"]]), rows["label"].to_numpy()
    w = model.coefficients.toArray()
    p = 1 / (1 + np.exp(-(x @ w + model.intercept)))
    assert np.abs(x.T @ (p - y) + w).max() < 0.05


def test_linear_svr_minimises_absolute_error(sets):
    """The penalised absolute loss at the fit is not above that at nearby points."""
    fitted = linear.linear_svr(sets["y"]).state["model"]
    rows = sets["y"].toPandas()
    x, y = np.stack([v.toArray() for v in rows["features"]]), rows["label"].to_numpy()
    cost = lambda w, b: 0.5 * w @ w + np.abs(y - x @ w - b).sum()
    w, b = fitted.coefficients.toArray(), fitted.intercept
    draw = np.random.RandomState(0)
    assert all(cost(w, b) <= cost(w + 0.05 * draw.normal(size=3), b + 0.05 * draw.normal()) + 0.05 for _ in range(50))


def brute_neighbours(ids, x, qid, q, k):
    d = np.sqrt(((q - x) ** 2).sum(1))
    order = np.lexsort((ids, d))[:k]
    return [(qid, int(ids[i])) for i in order]


@pytest.mark.parametrize("path", ["small", "tiled"])
def test_neighbours_are_exact_with_a_hot_point(spark, path):
    """A third of the training rows are one and the same point."""
    draw = np.random.RandomState(2)
    x = draw.normal(size=(900, 4))
    x[:300] = 0.25
    q = draw.normal(size=(120, 4))
    frame = lambda m, start: spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(m)], "id bigint, x array<double>")
    options = {} if path == "small" else {"small_cells": 0, "pivots": 12, "tile": 50}
    got = N.nearest_neighbours(frame(x, 0), frame(q, 10_000), "id", "x", 5, **options).collect()
    want = [pair for i, v in enumerate(q) for pair in brute_neighbours(np.arange(900), x, 10_000 + i, v, 5)]
    assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == sorted(want)


def point_frame(spark, m, start=0):
    return spark.createDataFrame([(start + i, [float(v) for v in r]) for i, r in enumerate(m)], "id bigint, x array<double>").repartition(4)


def test_copies_do_not_grow_with_both_sides(spark, monkeypatch):
    """Four times the rows and queries: as many copies of each, on the whole, and still exact."""
    seen, search = [], N.search_tiles

    def watched(placed, wanted, k, tile):
        t, q = (dict(df.groupBy("cell").count().collect()) for df in (placed, wanted))
        tiles = lambda n: -(-n // tile)
        seen.append((sum(n * tiles(q.get(c, 0)) for c, n in t.items()) / sum(t.values()), sum(n * tiles(t.get(c, 0)) for c, n in q.items()), len(t)))
        return search(placed, wanted, k, tile)

    monkeypatch.setattr(N, "search_tiles", watched)
    draw = np.random.RandomState(4)
    for n in (2_000, 8_000):
        x, q = draw.normal(size=(n, 2)), draw.normal(size=(n // 2, 2))
        got = N.nearest_neighbours(point_frame(spark, x), point_frame(spark, q, 10**6), "id", "x", 3, small_cells=0, tile=40).collect()
        want = [pair for i, v in enumerate(q[:60]) for pair in brute_neighbours(np.arange(n), x, 10**6 + i, v, 3)]
        assert len(got) == 3 * len(q) and sorted((r["query_id"], r["neighbour_id"]) for r in got if r["query_id"] < 10**6 + 60) == sorted(want)
        seen[-1] = (*seen[-1], len(q))
    (t1, q1, c1, n1), (t2, q2, c2, n2) = seen
    assert c2 > 2 * c1 and t2 < 1.5 * t1 + 0.5 and q2 / n2 < 1.5 * q1 / n1 and q2 / n2 < 20


def test_wide_vectors_meet_few_merged_cells(spark, monkeypatch):
    """Where bounds exclude little, a query is copied to a few merged cells, in bounded batches; still exact."""
    seen, search = [], N.search_tiles

    def watched(placed, wanted, k, tile):
        seen.append((wanted.count(), placed.select("cell").distinct().count()))
        return search(placed, wanted, k, tile)

    monkeypatch.setattr(N, "search_tiles", watched)
    draw = np.random.RandomState(5)
    x, q = draw.normal(size=(4_000, 24)), draw.normal(size=(200, 24))
    x[500:900] = x[500]  # a hot point
    got = N.nearest_neighbours(point_frame(spark, x), point_frame(spark, q, 10**6), "id", "x", 4, small_cells=0, tile=40).collect()
    want = [pair for i, v in enumerate(q) for pair in brute_neighbours(np.arange(4_000), x, 10**6 + i, v, 4)]
    assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == sorted(want)
    assert seen[0][0] <= 1.2 * N.COPIES * len(q) and seen[0][1] > 1


def test_a_large_cell_has_few_tiles(spark, monkeypatch):
    """Copies within a cell do not grow with its rows; tiles do, up to what a task may hold."""
    draw = np.random.RandomState(6)
    x, q = draw.normal(size=(3_000, 3)), draw.normal(size=(1_500, 3))
    placed, wanted = (point_frame(spark, m, start).withColumn("cell", F.lit(7).cast("long")) for m, start in ((x, 0), (q, 10**6)))
    tables, store = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df, label: tables.append(store(df, label)) or tables[-1])
    for most, tiles in ((4_000_000, (4, 4)), (900, (10, 5))):
        monkeypatch.setattr(N, "TILE_CELLS", most)
        got = N.search_tiles(placed, wanted, 3, 10).where("query_id < 1000020").collect()
        assert tuple(tables[-1].select("t_tiles", "q_tiles").first()) == tiles
        want = [pair for i, v in enumerate(q[:20]) for pair in brute_neighbours(np.arange(3_000), x, 10**6 + i, v, 3)]
        assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == sorted(want)


def test_nearest_points_are_looked_at_in_pieces(monkeypatch):
    """No more distances at once than a piece has; ties across pieces go to the smaller id."""
    draw, held, plain = np.random.RandomState(7), [], N.distances
    x, q = draw.normal(size=(500, 3)), draw.normal(size=(50, 3))
    x[100:400] = x[100]
    ids = draw.permutation(500)
    monkeypatch.setattr(N, "POINT_ROWS", 64)
    monkeypatch.setattr(N, "distances", lambda a, b: held.append(len(a) * len(b)) or plain(a, b))
    for k in (1, 5, 600):
        got = N.best_k(np.arange(50), q, ids, x, k)
        want = [pair for i, v in enumerate(q) for pair in brute_neighbours(ids, x, i, v, k)]
        assert list(zip(got["query_id"], got["neighbour_id"])) == want
    assert max(held) <= 64 * 50


@pytest.mark.parametrize(("n", "k"), [(1, 5), (3, 5), (40, 7)])
def test_few_rows_in_cells(spark, n, k):
    draw = np.random.RandomState(n)
    x, q = draw.normal(size=(n, 3)), draw.normal(size=(30, 3))
    got = N.nearest_neighbours(point_frame(spark, x), point_frame(spark, q, 1_000), "id", "x", k, small_cells=0, tile=10).collect()
    want = [pair for i, v in enumerate(q) for pair in brute_neighbours(np.arange(n), x, 1_000 + i, v, k)]
    assert sorted((r["query_id"], r["neighbour_id"]) for r in got) == sorted(want)


def test_recall_of_random_projections(spark):
    draw = np.random.RandomState(9)
    centres = draw.normal(size=(40, 16)) * 4
    x, q = (centres[draw.randint(0, 40, n)] + draw.normal(size=(n, 16)) * 0.5 for n in (4_000, 400))
    rows, asked = point_frame(spark, x), point_frame(spark, q, 10**6)
    exact = N.nearest_neighbours(rows, asked, "id", "x", 5)
    found = N.approximate_neighbours(rows, asked, "id", "x", 5, tile=500).cache()
    assert N.recall(found, exact) >= 0.9 and N.recall(exact, exact) == 1.0
    assert found.groupBy("query_id").count().where("count > 5").count() == 0
    d = {(r["query_id"], r["neighbour_id"]): r["distance"] for r in exact.collect()}
    assert all(r["distance"] == pytest.approx(d.get((r["query_id"], r["neighbour_id"]), r["distance"])) for r in found.collect())


@pytest.mark.parametrize("joined", [False, True])
@pytest.mark.parametrize("target", ["two", "y"])
def test_neighbours_are_saved_with_their_rows(spark, sets, tmp_path, monkeypatch, target, joined):
    """The model scores after the folder it was fitted in is gone, by lookup and by join alike."""
    from colonnade.operators.models import neighbours_model

    df, task = sets[target], "regression" if target == "y" else "classification"
    fitted = knn(df, "id", 4, task, str(tmp_path / "fitted"))
    want = fitted.score(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy()
    save_model(spark, fitted, str(tmp_path / "saved"))
    for f in (tmp_path / "fitted").iterdir():
        f.unlink()
    monkeypatch.setattr(neighbours_model, "SMALL_CELLS", 0 if joined else 10**9)
    again = load_model(spark, str(tmp_path / "saved"))
    assert np.allclose(again.score(df).select("id", "prediction").toPandas().sort_values("id")["prediction"].to_numpy(), want)


def test_streams_of_neighbours(spark, raw, tmp_path, monkeypatch):
    from colonnade.operators.models import neighbours_model

    config = TrainingConfig("id", "two", "classification", define_models(["KNN"]), folds=2, best_metric="Accuracy", features=FeatureOptions(scale=True))
    run = train(raw.drop("y", "three"), config, str(tmp_path / "run"))
    new = raw.select("id", *XS)
    new.write.parquet(str(tmp_path / "incoming"))
    stream = spark.readStream.schema(new.schema).parquet(str(tmp_path / "incoming"))
    score_stream(stream, TrainingRun.load(spark, str(tmp_path / "run")), str(tmp_path / "out"), str(tmp_path / "state"), available_now=True).awaitTermination()
    told = spark.read.parquet(str(tmp_path / "out")).select("id", "fold", "class", "pred")
    batch = run.score(new).select("id", "fold", "class", "pred")
    assert told.count() == batch.count() and told.exceptAll(batch).count() == 0
    monkeypatch.setattr(neighbours_model, "SMALL_CELLS", 1)
    with pytest.raises(ValueError, match="stream"):
        run.score(stream)


@pytest.mark.parametrize("kind", ["tree", "forest", "gbt", "tree_r", "forest_r", "gbt_r"])
def test_tree_shap_adds_up(sets, kind):
    fit = {"tree": lambda d: trees.decision_tree(d, 4), "forest": lambda d: trees.random_forest(d, 3, 5), "gbt": lambda d: trees.gradient_boosting(d, rounds=4),
           "tree_r": lambda d: trees.decision_tree_regressor(d, 4), "forest_r": lambda d: trees.random_forest_regressor(d, 3, 5), "gbt_r": lambda d: trees.gradient_boosting_regressor(d, rounds=4)}[kind]
    df = sets["y"] if kind.endswith("_r") else sets["two"] if kind == "gbt" else sets["three"]
    fitted = fit(df)
    sums = E.tree_shap(df, fitted, "id", XS).groupBy("id", "class").agg((F.sum("phi") + F.first("base")).alias("f")).toPandas()
    scored = fitted.score(df).toPandas().set_index("id")
    for r in sums.itertuples():
        row = scored.loc[r.id]
        if kind == "gbt":
            want, got = row["probability"][1], 1 / (1 + np.exp(-2 * r.f))
        else:
            want, got = (row["prediction"] if r._2 is None else row["probability"][int(r._2)]), r.f
        assert got == pytest.approx(want, abs=1e-9)


def test_tree_shap_is_brute_force_shapley(spark, sets):
    df = sets["y"]
    fitted = trees.decision_tree_regressor(df, 3)
    nodes = {n.id: n for n in E.node_table(df, fitted.state["model"]).itertuples()}

    def value(x, known, i=0):
        n = nodes[i]
        if n.left < 0:
            return n.prediction
        if n.feature in known:
            return value(x, known, n.left if x[n.feature] <= n.cut[0] else n.right)
        a, b = nodes[n.left].stats[0], nodes[n.right].stats[0]
        return (a * value(x, known, n.left) + b * value(x, known, n.right)) / (a + b)

    rows = df.where("id < 20")
    got = {(r["id"], r["feature"]): r["phi"] for r in E.tree_shap(rows, fitted, "id", XS).collect()}
    for row in rows.collect():
        x = row["features"].toArray()
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            phi = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value(x, {*s, f}) - value(x, set(s))) for m in range(3) for s in combinations(rest, m))
            assert got[(row["id"], XS[f])] == pytest.approx(phi, abs=1e-9)


FAMILIES = {
    "extra trees": (lambda d: trees.extra_trees(d, trees=6, groups=3, max_depth=3), "three"),
    "extra trees, regression": (lambda d: trees.extra_trees(d, "regression", trees=4, groups=2, max_depth=3), "y"),
    "AdaBoost": (lambda d: trees.adaboost(d, rounds=5, max_depth=2), "three"),
    "AdaBoost.R2": (lambda d: trees.adaboost_r2(d, rounds=4), "y"),
    "boosting, three classes": (lambda d: trees.gradient_boosting(d, rounds=3), "three"),
    "boosting, two classes": (lambda d: trees.gradient_boosting(d, rounds=3), "two"),
    "forest": (lambda d: trees.random_forest(d, 4, 5), "three"),
    "preset": (lambda d: trees.boosted_preset(d, "XGBoost", rounds=2), "three"),
}


def part_value(part, outputs, x, known):
    """A part's expected output when the coordinates of the `known` features follow the row."""
    at, total = part.coordinates(x[None, :]), np.zeros(outputs)
    for value, features, conditions, ratios in part.leaves:
        share = 1.0
        for f, c, z in zip(features, conditions, ratios):
            share *= float(S.follows(at[:, f], c)[0]) if part.feature(f) in known else z
        total = total + share * value
    return total


@pytest.mark.parametrize("family", sorted(FAMILIES))
def test_shapley_values_of_every_family(sets, family):
    """Brute force over coalitions of the leaves, and the sums are what the model reports."""
    fit, target = FAMILIES[family]
    df = sets[target]
    fitted = fit(df)
    parts, outputs, link = S.tree_parts(df, fitted)
    names = [None] if link in ("margin", "prediction") else [str(c) for c in range(outputs)]
    found = E.tree_shap(df, fitted, "id", XS).cache()
    got = {(r["id"], r["class"], r["feature"]): r["phi"] for r in found.where("id < 8").collect()}
    for row in df.where("id < 8").collect():
        x = row["features"].toArray()
        value = lambda known: sum(part_value(p, outputs, x, known) for p in parts)
        for f in range(3):
            rest = [g for g in range(3) if g != f]
            phi = sum(factorial(len(s)) * factorial(2 - len(s)) / 6 * (value({*s, f}) - value(set(s))) for m in range(3) for s in combinations(rest, m))
            assert [got[row["id"], c, XS[f]] for c in names] == pytest.approx(phi.tolist(), abs=1e-9)
    told = E.explained_output(found, "id", link, names).toPandas().set_index("id")
    scored = fitted.score(df).toPandas().set_index("id")
    if family == "AdaBoost.R2":  # the median itself is not a sum; the weighted mean is
        columns = [m.setPredictionCol("_h").transform(df).select("id", "_h").toPandas().set_index("id")["_h"] for m in fitted.state["models"]]
        want = sum(w * c for w, c in zip(fitted.state["strengths"], columns)) / sum(fitted.state["strengths"])
        assert np.allclose(told["prediction"], want.loc[told.index])
    elif link == "prediction":
        assert np.allclose(told["prediction"], scored.loc[told.index, "prediction"])
    else:
        assert np.allclose(np.stack(told["probability"]), np.stack(scored.loc[told.index, "probability"]))
        assert (told["prediction"] == scored.loc[told.index, "prediction"]).all()


def test_leaves_with_many_features_are_not_tabulated(sets, monkeypatch):
    fitted = trees.random_forest_regressor(sets["y"], 4, 3)
    parts, outputs, _ = S.tree_parts(sets["y"], fitted)
    x = np.random.RandomState(0).uniform(-1, 1, (50, 3))
    tabled = S.Explainer(parts, outputs)(x)
    monkeypatch.setattr(S, "TABLE_FEATURES", 0)
    assert np.allclose(S.Explainer(parts, outputs)(x), tabled)


def test_beeswarm_keeps_every_point(sets):
    fitted = trees.decision_tree_regressor(sets["y"], 3)
    attributions = E.tree_shap(sets["y"], fitted, "id", XS)
    assert E.beeswarm(attributions).groupBy("feature").agg(F.sum("n").alias("n")).where("n <> 600").count() == 0
    assert [r["position"] for r in E.importance(attributions, top=2).collect()] == [1, 2]


def test_two_valued_feature_gets_its_values_as_grid(raw):
    grids = E.dependence_grids(raw.withColumn("flag", (F.col("id") % 2).cast("int")), ["flag", "a"], 5)
    assert grids["flag"] == [0, 1] and len(grids["a"]) == 5


def test_dependence_on_twenty_thousand_categories(spark):
    """A string with 20,000 values is asked at every one of them, by its ordinal code."""
    from colonnade.operators import features as X

    wide = spark.range(40_000).select("id", F.format_string("c%05d", F.col("id") % 20_000).alias("kind"), (F.col("id") % 7).cast("double").alias("z"))
    grids = E.dependence_grids(wide, ["kind"])
    assert len(grids["kind"]) == 20_000 and grids["kind"][:2] == ["c00000", "c00001"]
    coded = VectorAssembler(inputCols=["code", "z"], outputCol="features").transform(wide.withColumn("code", (F.col("id") % 20_000).cast("double")))
    df = coded.select("id", "features", (F.col("code") * 0.5 - F.col("z")).alias("label")).cache()
    fitted = linear.least_squares(df)
    out = E.partial_dependence(df.where("id < 14"), fitted, ["kind", "z"], grids).collect()
    assert len(out) == 20_000 and all(r["mean"] == pytest.approx(int(r["grid"][1:]) * 0.5 - 3.0, abs=1e-6) for r in out)


def test_training_run_end_to_end(spark, raw):
    """Fit, reload, score new rows, ensemble, evaluate; then the same rows as a stream."""
    config = TrainingConfig("id", "two", "classification", define_models(["Gaussian Naive Bayes", "Decision Tree", "KNN"], [1, 2, 1], [[{}], [{"max_depth": 2}, {"max_depth": 4}], [{"k": 7}]]),
                            folds=2, best_metric="Accuracy", features=FeatureOptions(scale=True), balanced=True)
    path = scratch_path(spark, "run")
    run = train(raw.drop("y", "three"), config, path)
    assert [m.name for m in config.models] == ["Gaussian Naive Bayes 1", "Decision Tree 1", "Decision Tree 2", "KNN 1"]
    assert run.oof().where("class = 'yes'").groupBy("model").count().where("count <> 600").count() == 0
    metrics = run.metrics()
    assert metrics.where("split = 'Valid' and metric = 'Accuracy' and value > 0.75").count() == 8
    assert run.best().count() == 2 and run.runtimes().count() == 8
    loaded = TrainingRun.load(spark, path)
    assert loaded.config == config and loaded.classes == ["no", "yes"]
    new = raw.select("id", *XS)
    picked = ["Gaussian Naive Bayes 1", "Decision Tree 2"]
    scored = loaded.score(new, picked)
    assert scored.count() == 600 * 2 * 2 * 2
    ensembles = P.full_ensemble(scored, "id")
    result = P.evaluate_ensembles(ensembles, raw.select("id", "two"), "id", "two", positive="yes")
    got = {(r["model"], r["metric"]): r["value"] for r in result.collect()}
    assert got[("Ensembled", "ROC AUC")] > 0.9 and got[("Decision Tree 2", "Accuracy")] > 0.85

    source = scratch_path(spark, "incoming")
    new.write.parquet(source)
    one = TrainingConfig(**{**loaded.config.__dict__, "models": config.models[:1]})
    stream = spark.readStream.schema(new.schema).parquet(source)
    out = scratch_path(spark, "scored")
    query = score_stream(stream, TrainingRun(spark, path, one, loaded.classes), out, scratch_path(spark, "state"), available_now=True)
    query.awaitTermination(120)
    streamed = spark.read.parquet(out)
    batch = loaded.score(new, picked[:1])
    assert streamed.count() == batch.count() and streamed.select("id", "fold", "class", "pred").exceptAll(batch.select("id", "fold", "class", "pred")).count() == 0


@pytest.fixture(scope="module")
def holed(spark):
    """Nulls and NaN in numbers, null and unseen strings; the class hangs on a string alone."""
    draw = np.random.RandomState(11)
    rows = [(i, None if i % 5 == 0 else float("nan") if i % 7 == 0 else float(draw.normal()), None if i % 11 == 0 else "abcdef"[i % 6], float(i % 13)) for i in range(900)]
    df = spark.createDataFrame(rows, "id int, x double, kind string, z double")
    hit = F.coalesce(F.col("kind").isin("a", "c", "e"), F.lit(True))
    return df.withColumns({"two": F.when(hit, "yes").otherwise("no"), "y": F.when(hit, 5.0).otherwise(1.0) + F.coalesce(F.nanvl("x", F.lit(3.0)), F.lit(3.0))}).cache()


@pytest.mark.parametrize("family", ["XGBoost", "LightGBM", "CatBoost", "Decision Tree", "Random Forest"])
@pytest.mark.parametrize("target", ["two", "y"])
def test_trees_take_nulls_and_categories(spark, holed, tmp_path, family, target):
    rounds = {} if family in ("Decision Tree", "Random Forest") else {"rounds": 8, "rate": 0.5}
    task = "classification" if target == "two" else "regression"
    config = TrainingConfig("id", target, task, define_models([family], params=[[rounds]]), folds=2, best_metric="Accuracy" if target == "two" else "RMSE",
                            higher_is_better=target == "two", features=FeatureOptions(encoding="nominal", fill_missing=True), balanced=True)
    run = train(holed.select("id", "x", "kind", "z", target), config, str(tmp_path / "run"))
    plan = run.plan(0)
    assert plan.nominal == {"kind": 7} and plan.flagged == ["x"] and set(plan.features) == {"x", "kind", "z", "x_missing"}
    best = [r["value"] for r in run.best().collect()]
    assert all(v > 0.95 if target == "two" else v < 1.0 for v in best), best
    if family == "Decision Tree":
        model = run.model(0, f"{family} 1").state["model"]
        assert " in {" in model.toDebugString  # the string is split by sets of its categories
    unseen = spark.createDataFrame([(1, None, "never", 2.0)], "id int, x double, kind string, z double")
    assert run.score(unseen).count() == (4 if target == "two" else 2)


def test_boosted_models_get_whole_weights(spark, holed, tmp_path, monkeypatch):
    seen = {}
    from colonnade.plans import training

    for family in ("XGBoost", "Decision Tree"):
        fit = training.CLASSIFIERS[family]
        monkeypatch.setitem(training.CLASSIFIERS, family, lambda df, fit=fit, family=family, **o: seen.update({family: (o["weight"], [r[0] for r in df.select(o["weight"]).distinct().collect()])}) or fit(df, **{**o, **({"rounds": 1} if family == "XGBoost" else {})}))
    config = TrainingConfig("id", "two", "classification", define_models(["XGBoost", "Decision Tree"]), folds=2, best_metric="Accuracy", features=FeatureOptions(encoding="nominal", fill_missing=True), balanced=True, parallelism=1)
    train(holed.select("id", "z", "kind", "two"), config, str(tmp_path / "run"))
    name, weights = seen["XGBoost"]
    assert name == "weight_int" and min(weights) == 100 and all(w == int(w) for w in weights) and seen["Decision Tree"][0] == "weight"


def test_ensembles_are_made_once_for_all_metrics(spark, monkeypatch):
    """Several metrics read the labelled ensembles from where they are stored; both levels share a placement."""
    from colonnade.operators import predict

    scores = spark.createDataFrame([(i, m, f, c, p if c == "a" else 1 - p) for i in range(40) for m in ("m1", "m2") for f in range(3) for p in [((i * 7 + f * 3 + len(m)) % 11) / 11] for c in "ab"],
                                   "id int, model string, fold int, class string, proba double")
    test = spark.range(40).select(F.col("id").cast("int"), F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("target"))
    seen, plain = [], predict.classification_metrics
    monkeypatch.setattr(predict, "classification_metrics", lambda df, *more: seen.append(df) or plain(df, *more))
    ensembles = P.full_ensemble(scores, "id")
    assert P.evaluate_ensembles(ensembles, test, "id", "target").count() == 3 * (1 + 3 * 3 + 2 * 3)
    assert seen[0].inputFiles()
    means = {(r["id"], r["model"], r["class"]): r["proba"] for r in ensembles.collect()}
    for row in scores.groupBy("id", "class").agg(F.avg("proba").alias("p")).collect():
        assert means[row["id"], "Ensembled", row["class"]] == pytest.approx(row["p"])
    for row in scores.groupBy("id", "model", "class").agg(F.avg("proba").alias("p")).collect():
        assert means[row["id"], row["model"], row["class"]] == pytest.approx(row["p"])


def test_shapley_values_are_computed_per_pattern(sets, monkeypatch):
    """Rows in the same intervals are explained once, in later batches too, and like rows on their own."""
    from colonnade.operators import shapley

    df = sets["three"]
    parts, outputs, _ = shapley.tree_parts(df, trees.extra_trees(df, trees=6, groups=3))
    x = np.stack([v.toArray() for v in df.select("features").toPandas()["features"]])
    explainer, asked, plain = shapley.Explainer(parts, outputs), [], shapley.Explainer.explain
    monkeypatch.setattr(shapley.Explainer, "explain", lambda self, i, at, n: asked.append(len(at)) or plain(self, i, at, n))
    first, again = explainer(x), explainer(x[::-1])
    assert (first == again[::-1]).all() and sum(asked) < len(parts) * len(x) and len(asked) == len(parts)
    alone = sum(plain(explainer, i, part.coordinates(x), x.shape[1]) for i, part in enumerate(parts))
    assert np.allclose(first, alone, atol=1e-12)
    monkeypatch.setattr(shapley, "KEPT_CELLS", 1)
    assert np.allclose(shapley.Explainer(parts, outputs)(x), alone, atol=1e-12)


@pytest.fixture(scope="module")
def many(spark):
    """20,000 rows: a number of 700 values on a grid, two of few values (one with -0.0), a category; two kinds of weights."""
    draw = np.random.RandomState(21)
    a, b, c, k = draw.randint(0, 700, 20_000) / 100, draw.randint(0, 6, 20_000) - 2.0, draw.randint(0, 3, 20_000) * 1.0, draw.randint(0, 5, 20_000) * 1.0
    label = np.digitize(a - b + 2 * (k % 2) + draw.normal(size=20_000) / 2, [1.5, 5.0]) * 1.0
    rows = [(i, float(a[i]), -0.0 if b[i] == 0 and i % 2 else float(b[i]), float(c[i]), float(k[i]), float(label[i]), [1.5, 2.0, 3.25][int(label[i])]) for i in range(20_000)]
    return spark.createDataFrame(rows, "id int, _f0 double, _f1 double, _f2 double, _f3 double, label double, weight double").cache()


def vectors(df):
    return X.assemble(X.as_nominal(df, {"_f3": 5}), [c for c in df.columns if not c.startswith("_f")])


def nodes(model):
    """Per node: what it cuts by, and its sums."""
    table = S.node_table(model[0], model[1]).sort_values("id")
    return [(n.feature, n.categories, tuple(np.round(n.cut, 9)), tuple(np.round(n.stats, 6))) for n in table.itertuples()]


def test_trees_of_merged_rows_are_trees_of_all_rows(spark, many):
    """Few distinct values: the same cuts and sums at every node, from fewer rows than a quarter."""
    few = many.withColumn("_f0", F.floor("_f0").cast("double"))
    merged = trees.merged_rows(few, ["_f0", "_f1", "_f2", "_f3"], ["_f3"], ["label"], ["weight"])
    assert merged.count() * 4 <= 20_000 and merged.agg(F.sum(trees.ROWS)).first()[0] == 20_000
    assert merged.agg(F.sum("weight")).first()[0] == pytest.approx(few.agg(F.sum("weight")).first()[0])
    whole, part = (trees.decision_tree(vectors(df), 4, "weight").state["model"] for df in (few, merged))
    assert nodes((few, whole)) == nodes((few, part)) and " in {" in part.toDebugString
    told = [trees.gradient_boosting(vectors(df), 3, 3, 0.3, "weight").score(vectors(few)) for df in (few, merged)]
    a, b = ({r["id"]: r["probability"] for r in t.select("id", "probability").collect()} for t in told)
    assert max(abs(p - q) for i in a for p, q in zip(a[i], b[i])) < 1e-9


def test_merged_rows_divide_as_all_rows(spark, many, monkeypatch):
    """More values than bins: the weight that a leaf saw is that of the rows which reach it, also of those at its cut."""
    monkeypatch.setattr(trees, "MAX_BINS", 24)
    points = trees.cut_points(many, ["_f0", "_f1"], 23)
    assert len(points["_f0"]) <= 23 and points["_f1"] == [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0]
    monkeypatch.setattr(trees, "cut_points", lambda df, columns: {c: points[c] if c in points else [0.0, 1.0, 2.0] for c in columns})
    merged = trees.merged_rows(many, ["_f0", "_f1", "_f2", "_f3"], ["_f3"], ["label"], ["weight"])
    halves = {(a + b) / 2 for a, b in zip(points["_f0"], points["_f0"][1:])}
    assert merged.select("_f0").distinct().count() == len(points["_f0"]) and many.where(F.col("_f0").isin(halves)).count()
    model = trees.decision_tree(vectors(merged), 5, "weight").state["model"]
    leaves = {tuple(np.round(np.array(n.stats) / np.sum(n.stats), 9)): np.round(n.stats, 4) for n in S.node_table(many, model).itertuples() if n.left < 0}
    seen = vectors(many).withColumn("_w", F.col("weight"))
    sums = {}
    for r in model.transform(seen).select("label", "_w", "probability").collect():
        sums.setdefault(tuple(np.round(r["probability"].toArray(), 9)), np.zeros(3))[int(r["label"])] += r["_w"]
    assert len(leaves) > 10 and sums.keys() == leaves.keys() and all(np.allclose(sums[p], leaves[p]) for p in leaves)


def test_few_merged_rows_keep_their_categories(spark):
    """MLlib has as many bins as rows at most: forty categories of one row each are fitted all the same."""
    df = spark.range(2000).select((F.col("id") % 40).cast("double").alias("_f0"), F.lit(3.0).alias("_f1"), (F.col("id") % 2).cast("double").alias("label"))
    merged = trees.merged_rows(df, ["_f0", "_f1"], ["_f0"], ["label"], [])
    assert merged.agg(F.sum(trees.ROWS)).first()[0] == pytest.approx(2000) and merged.count() >= 2 * trees.MAX_BINS
    ready = X.assemble(X.as_nominal(merged, {"_f0": 40}), ["label", trees.ROWS])
    assert trees.decision_tree(ready, 2, trees.ROWS).score(ready).where("prediction <> label").count() == 0


def test_merged_rows_stay_refused(spark):
    """NaN and infinities, which MLlib refuses, are not merged with numbers."""
    df = spark.range(1000).select(F.when(F.col("id") % 4 == 0, float("inf")).when(F.col("id") % 4 == 1, float("nan")).otherwise((F.col("id") % 4).cast("double")).alias("_f0"), F.lit(float("nan")).alias("_f1"), F.lit(1.0).alias("label"))
    merged = trees.merged_rows(df, ["_f0", "_f1"], [], ["label"], [])
    assert {(str(r[0]), str(r[1]), r[2]) for r in merged.groupBy("_f0", "_f1").agg(F.round(F.sum(trees.ROWS), 6)).collect()} == {("2.0", "nan", 250), ("3.0", "nan", 250), ("nan", "nan", 500)}


def test_rows_are_merged_only_where_that_leaves_few(spark, many, monkeypatch):
    merge = lambda *draws: trees.merged_rows(many.withColumns({f"_f{i}": F.rand(i) for i in draws}), ["_f0", "_f1", "_f2"], [], ["label"], [])
    assert merge(0, 1, 2) is None and trees.merged_rows(many, ["_f1", "_f2"], [], ["label"], []).count() >= 2 * trees.MAX_BINS
    monkeypatch.setattr(trees, "MERGED_WIDTH", 1)
    assert trees.merged_rows(many, ["_f1", "_f2"], [], ["label"], []) is None


def test_large_runs_fit_trees_to_merged_rows(spark, many, tmp_path, monkeypatch):
    """Trees of a run get the merged rows of a fold, boosting with subsamples and other families all rows; predictions are of all rows."""
    from colonnade.plans import training

    seen = {}
    for family in ("XGBoost", "Gradient Boosting", "Decision Tree", "Gaussian Naive Bayes"):
        fit = training.CLASSIFIERS[family]
        monkeypatch.setitem(training.CLASSIFIERS, family, lambda df, fit=fit, family=family, **o: seen.setdefault((family, o.get("subsample")), (df.count(), o.get("weight"))) and fit(df, **o))
    df = many.select("id", F.when(F.col("id") % 7 > 0, F.floor("_f0")).cast("double").alias("number"), F.when(F.col("id") % 9 > 0, F.concat(F.lit("k"), F.col("_f3").cast("int"))).alias("kind"), F.element_at(F.array(F.lit("low"), F.lit("mid"), F.lit("high")), F.col("label").cast("int") + 1).alias("level"))
    models = define_models(["XGBoost", "Gradient Boosting", "Decision Tree", "Gaussian Naive Bayes"], [1, 2, 1, 1], [[{"rounds": 1, "max_depth": 3}], [{"rounds": 1, "max_depth": 2}, {"rounds": 1, "max_depth": 2, "subsample": 0.5}], [{}], [{}]])
    runs = []
    for rows in (1_000, 10**9):
        monkeypatch.setattr(trees, "MERGED_ROWS", rows)
        config = TrainingConfig("id", "level", "classification", models, folds=2, best_metric="Accuracy", features=FeatureOptions(encoding="nominal", fill_missing=True), balanced=True)
        runs.append((train(df, config, str(tmp_path / str(rows))), dict(seen)))
        seen.clear()
    (merged, few), (whole, all_rows) = runs
    assert all(9_900 < n < 10_100 for n, _ in all_rows.values()) and {k for k, (n, _) in few.items() if n > 1000} == {("Gradient Boosting", 0.5), ("Gaussian Naive Bayes", None)}
    assert few["XGBoost", None][1] == "weight_int" and few["Decision Tree", None][1] == "weight" and few["Gradient Boosting", None][1] == trees.ROWS
    by = ["id", "model", "split", "class"]
    both = merged.predictions().alias("a").join(whole.predictions().alias("b"), [*by, "fold"])
    assert both.count() == merged.predictions().count() == whole.predictions().count() == 20_000 * 2 * 3 * 5
    assert both.where(F.abs(F.col("a.proba") - F.col("b.proba")) > 1e-9).count() == 0
