"""Queries: model families, training runs, explanation, sources and sinks.

Features and targets derive from the whole orders table in both engines; targets are a
known function of the features plus md5 noise, because the table's own columns are unrelated.
"""

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.catalog.cleaning import folds_sql, qcut_sql
from colonnade.catalog.predictions import OOF, oof, unit, unit_sql
from colonnade.operators import explain as E, features as X, metrics as M
from colonnade.operators.models import bayes, linear, neighbours as N, trees
from colonnade.operators.models.neighbours_model import knn
from colonnade.plans.cleaning import CleaningOptions, CleaningPlan
from colonnade.plans.features import FeatureOptions, FeaturePlan
from colonnade.plans.training import ModelSpec, TrainingConfig, TrainingRun, best_models, train
from colonnade.operators.shapley import tree_parts as explained_parts
from colonnade.session import scratch_path, spread
from colonnade.sources import tables as S
from colonnade.sources.models import load_model, save_model

XS = ["x1", "x2", "x3"]


def frame(spark, d):
    u = unit("id", F.lit("u"))
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"), fill=False, rows=250_000)
    base = orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_totalprice") / 100000).alias("x1"), (F.month("o_orderdate") / 12).alias("x2"),
        ((F.col("o_custkey") % 10) / 10).alias("x3"))
    y = 3 * F.col("x1") - 4 * F.col("x2") + F.col("x3") + 0.5 * u
    return base.withColumn("y", y).withColumns({
        "two": F.when(F.col("y") > 5, 1.0).otherwise(0.0), "three": F.when(F.col("y") < 3, 0.0).when(F.col("y") < 8, 1.0).otherwise(2.0)})


FRAME = f"""(select *, case when y > 5 then 1.0::double else 0 end as two, case when y < 3 then 0.0::double when y < 8 then 1 else 2 end as three from
 (select *, 3 * x1 - 4 * x2 + x3 + 0.5::double * {unit_sql('id', "'u'")} as y from
  (select o_orderkey as id, o_totalprice / 100000 as x1, month(o_orderdate)::double / 12 as x2, (o_custkey % 10)::double / 10 as x3 from orders)))"""


def assembled(df, label, columns=XS):
    return VectorAssembler(inputCols=list(columns), outputCol="features").transform(df.withColumn("label", F.col(label))).select("id", "features", "label")


def probabilities(scored, digits, k):
    return scored.select("id", F.col("prediction").cast("int").alias("pred"), *[F.round(F.col("probability")[c], digits).alias(f"p{c}") for c in range(k)])


def classify(spark, d, fit, label="two", columns=XS, digits=4, k=2, **options):
    df = assembled(frame(spark, d), label, columns)
    train_set = df.persist()
    try:
        fitted = fit(train_set, **options)
    finally:
        train_set.unpersist()
    return probabilities(fitted.score(df), digits, k)


def regress(spark, d, fit, columns=("x1",), digits=5, **options):
    df = assembled(frame(spark, d), "y", columns)
    train_set = df.persist()
    try:
        fitted = fit(train_set, **options)
    finally:
        train_set.unpersist()
    return fitted.score(df).select("id", F.round("prediction", digits).alias("pred"))


@query("ml_logistic")
def ml_logistic(spark, d):
    return classify(spark, d, linear.logistic_regression, "three", k=3)


@query("ml_lda", f"""
with f as {FRAME}, n as (select count(*) filter (where two = 0)::double as n0, count(*) filter (where two = 1)::double as n1,
 avg(x1) filter (where two = 0) as a0, avg(x2) filter (where two = 0) as b0, avg(x1) filter (where two = 1) as a1, avg(x2) filter (where two = 1) as b1 from f),
s as (select sum((x1 - m1) * (x1 - m1)) / (count(*) - 2) as s11, sum((x1 - m1) * (x2 - m2)) / (count(*) - 2) as s12, sum((x2 - m2) * (x2 - m2)) / (count(*) - 2) as s22
 from (select x1, x2, avg(x1) over (partition by two) as m1, avg(x2) over (partition by two) as m2 from f)),
i as (select s22 / (s11 * s22 - s12 * s12) as i11, -s12 / (s11 * s22 - s12 * s12) as i12, s11 / (s11 * s22 - s12 * s12) as i22 from s),
w as (select a0 * i11 + b0 * i12 as w01, a0 * i12 + b0 * i22 as w02, a1 * i11 + b1 * i12 as w11, a1 * i12 + b1 * i22 as w12, * from n, i),
z as (select id, (x1 * w11 + x2 * w12 - 0.5 * (w11 * a1 + w12 * b1) + ln(n1)) - (x1 * w01 + x2 * w02 - 0.5 * (w01 * a0 + w02 * b0) + ln(n0)) as z from f, w)
select id, cast(z > 0 as int) as pred, round(1 - 1 / (1 + exp(-z)), 4) as p0, round(1 / (1 + exp(-z)), 4) as p1 from z""")
def ml_lda(spark, d):
    return classify(spark, d, linear.linear_discriminant, columns=["x1", "x2"])


def normal_log(c, k):
    return f"-0.5 * ln(2 * pi() * v{c}{k}) - 0.5 * ({c} - m{c}{k}) * ({c} - m{c}{k}) / v{c}{k}"


@query("ml_gaussian_nb", f"""
with f as {FRAME}, e as (select 1e-9 * greatest({', '.join(f'var_pop({c})' for c in XS)}) as eps from f),
s as (select {', '.join(f"avg({c}) filter (where three = {k}) as m{c}{k}, var_pop({c}) filter (where three = {k}) + max(eps) as v{c}{k}" for c in XS for k in range(3))},
 {', '.join(f"ln(count(*) filter (where three = {k}) / count(*)::double) as l{k}" for k in range(3))} from f, e),
z as (select id, {', '.join(f"l{k} + " + ' + '.join('(' + normal_log(c, k) + ')' for c in XS) + f" as z{k}" for k in range(3))} from f, s),
p as (select *, exp(z0 - greatest(z0, z1, z2)) as e0, exp(z1 - greatest(z0, z1, z2)) as e1, exp(z2 - greatest(z0, z1, z2)) as e2 from z)
select id, case when e0 >= e1 and e0 >= e2 then 0 when e1 >= e2 then 1 else 2 end as pred, round(e0 / (e0 + e1 + e2), 4) as p0, round(e1 / (e0 + e1 + e2), 4) as p1, round(e2 / (e0 + e1 + e2), 4) as p2 from p""")
def ml_gaussian_nb(spark, d):
    return classify(spark, d, bayes.gaussian_nb, "three", k=3)


def rate(c, k):
    return f"((count(*) filter (where {c} > 0 and two = {k}) + 1) / (count(*) filter (where two = {k}) + 2)::double)"


@query("ml_bernoulli_nb", f"""
with f as (select id, two, x1 - 2.5 as c1, x2 - 0.5 as c2, x3 - 0.45 as c3 from {FRAME}),
s as (select {', '.join(f'{rate(c, k)} as {c}_{k}' for c in ('c1', 'c2', 'c3') for k in (0, 1))}, {', '.join(f"ln(count(*) filter (where two = {k}) / count(*)::double) as l{k}" for k in (0, 1))} from f),
z as (select id, {', '.join(f"l{k} + " + ' + '.join(f"ln(case when {c} > 0 then {c}_{k} else 1 - {c}_{k} end)" for c in ('c1', 'c2', 'c3')) + f' as z{k}' for k in (0, 1))} from f, s)
select id, cast(z1 > z0 as int) as pred, round(1 / (1 + exp(z1 - z0)), 4) as p0, round(1 / (1 + exp(z0 - z1)), 4) as p1 from z""")
def ml_bernoulli_nb(spark, d):
    centred = frame(spark, d).withColumns({"x1": F.col("x1") - 2.5, "x2": F.col("x2") - 0.5, "x3": F.col("x3") - 0.45})
    df = assembled(centred, "two")
    return probabilities(bayes.bernoulli_nb(df).score(df), 4, 2)


@query("ml_rbf_svc")
def ml_rbf_svc(spark, d):
    return classify(spark, d, linear.rbf_svc, dimensions=64)


@query("ml_linear_svc")
def ml_linear_svc(spark, d):
    return classify(spark, d, linear.linear_svc, "three", k=3, max_iter=30)


NEAREST = """(select q.vec_id as query_id, q.label as actual, t.vec_id as neighbour_id, t.label, row_number() over (partition by q.vec_id
 order by list_distance(q.embedding::double[], t.embedding::double[]), t.vec_id) as r
 from (select * from embeddings where vec_id % 2 = 1) q, (select * from embeddings where vec_id % 2 = 0) t qualify r <= 5)"""


def halves(spark, d):
    e = table(spark, d, "embeddings")
    return e.where("vec_id % 2 = 0"), e.where("vec_id % 2 = 1")


@query("ml_knn_classify", f"""
with v as (select query_id, label as class, count(*) as votes from {NEAREST} group by all)
select query_id, class, votes, votes / 5.0::double as proba, first_value(class) over (partition by query_id order by votes desc, class) as pred from v""")
def ml_knn_classify(spark, d):
    train_rows, asked = halves(spark, d)
    return N.knn_classify(train_rows, asked, "vec_id", "embedding", "label", 5)


@query("ml_knn_regress", f"select query_id, round(avg(label), 6) as pred from {NEAREST} group by query_id")
def ml_knn_regress(spark, d):
    """The tiled path: no training set in any one task."""
    train_rows, asked = halves(spark, d)
    return N.knn_regress(train_rows, asked, "vec_id", "embedding", "label", 5, small_cells=0, pivots=8, tile=1000).withColumn("pred", F.round("pred", 6))


@query("ml_knn_tiled", f"select query_id, neighbour_id from {NEAREST}")
def ml_knn_tiled(spark, d):
    """As many cells as the rows need, cut into tiles by their own counts."""
    train_rows, asked = halves(spark, d)
    return N.nearest_neighbours(train_rows, asked, "vec_id", "embedding", 5, small_cells=0, tile=200).select("query_id", "neighbour_id")


@query("ml_knn_save_load_score", f"""
with v as (select query_id, label as class, count(*) as votes from {NEAREST} group by all)
select query_id as id, first(class order by votes desc, class) as pred from v group by query_id""")
def ml_knn_save_load_score(spark, d):
    shape = lambda df: df.select(F.col("vec_id").alias("id"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"), F.col("label").cast("double").alias("label"))
    train_rows, asked = (shape(df) for df in halves(spark, d))
    path = scratch_path(spark, "neighbours")
    save_model(spark, knn(train_rows, "id"), path)
    return load_model(spark, path).score(asked).select("id", F.col("prediction").cast("int").alias("pred"))


@query("ml_knn_hashed", f"select true as enough, (select count(*) from embeddings where vec_id % 2 = 1) as queries")
def ml_knn_hashed(spark, d):
    """Random projections over all rows: nine in ten of the exact neighbours at least."""
    train_rows, asked = halves(spark, d)
    found = N.approximate_neighbours(train_rows, asked, "vec_id", "embedding", 5)
    exact = N.nearest_neighbours(train_rows, asked, "vec_id", "embedding", 5)
    return asked.agg(F.lit(N.recall(found, exact) >= 0.9).alias("enough"), F.count(F.lit(1)).alias("queries"))


def balanced(df, label):
    weights = X.fit_class_weights(df, label)
    return X.with_class_weight(df, label, weights)


@query("ml_decision_tree")
def ml_decision_tree(spark, d):
    df = balanced(assembled(frame(spark, d), "three"), "label")
    return probabilities(trees.decision_tree(df, 5, "weight").score(df), 4, 3)


@query("ml_random_forest")
def ml_random_forest(spark, d):
    df = balanced(assembled(frame(spark, d), "three"), "label")
    return probabilities(trees.random_forest(df, 5, 20, "weight").score(df), 4, 3)


@query("ml_extra_trees")
def ml_extra_trees(spark, d):
    return classify(spark, d, trees.extra_trees, "three", k=3, trees=10, groups=5)


@query("ml_adaboost")
def ml_adaboost(spark, d):
    return classify(spark, d, trees.adaboost, rounds=6)


@query("ml_gbt")
def ml_gbt(spark, d):
    return classify(spark, d, trees.gradient_boosting, rounds=5)


@query("ml_boosted_presets")
def ml_boosted_presets(spark, d):
    parts = [classify(spark, d, trees.boosted_preset, name=name, rounds=2).withColumn("model", F.lit(name)) for name in trees.PRESETS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def line_sql(slope):
    return f"""with f as {FRAME}, s as (select avg(x1) as mx, avg(y) as my, covar_pop(x1, y) * count(*) as sxy, var_pop(x1) * count(*) as sxx, count(*) as n from f),
 b as (select {slope} as b, mx, my from s) select id, round(my + b * (x1 - mx), 5) as pred from f, b"""


@query("ml_ols", line_sql("sxy / sxx"))
def ml_ols(spark, d):
    return regress(spark, d, linear.least_squares)


@query("ml_ridge", line_sql("sxy / (sxx + 50)"))
def ml_ridge(spark, d):
    return regress(spark, d, linear.ridge, alpha=50.0)


@query("ml_lasso", line_sql("sign(sxy) * greatest(abs(sxy) / n - 0.3, 0) / (sxx / n)"))
def ml_lasso(spark, d):
    return regress(spark, d, linear.lasso, alpha=0.3)


@query("ml_elastic_net", line_sql("sign(sxy) * greatest(abs(sxy) / n - 0.3 * 0.5, 0) / (sxx / n + 0.3 * 0.5)"))
def ml_elastic_net(spark, d):
    return regress(spark, d, linear.elastic_net, alpha=0.3)


@query("ml_linear_svr")
def ml_linear_svr(spark, d):
    return regress(spark, d, linear.linear_svr, XS, 4, rounds=4)


@query("ml_rbf_svr")
def ml_rbf_svr(spark, d):
    return regress(spark, d, linear.rbf_svr, XS, 4, dimensions=32)


@query("ml_tree_regressors")
def ml_tree_regressors(spark, d):
    fits = {"Decision Tree": (trees.decision_tree_regressor, {}), "Random Forest": (trees.random_forest_regressor, {"trees": 10}),
            "Extra Trees": (trees.extra_trees, {"task": "regression", "trees": 6, "groups": 3})}
    parts = [regress(spark, d, fit, XS, 4, **o).withColumn("model", F.lit(name)) for name, (fit, o) in fits.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ml_adaboost_r2")
def ml_adaboost_r2(spark, d):
    return regress(spark, d, trees.adaboost_r2, XS, 4, rounds=4)


@query("ml_gbt_regress")
def ml_gbt_regress(spark, d):
    return regress(spark, d, trees.gradient_boosting_regressor, XS, 4, rounds=5)


@query("ml_boosted_regress_presets")
def ml_boosted_regress_presets(spark, d):
    parts = [regress(spark, d, trees.boosted_preset_regressor, XS, 4, name=name, rounds=2).withColumn("model", F.lit(name)) for name in trees.PRESETS]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("ml_save_load_score", line_sql("sxy / sxx"))
def ml_save_load_score(spark, d):
    df = assembled(frame(spark, d), "y", ["x1"])
    path = scratch_path(spark, "model")
    save_model(spark, linear.least_squares(df), path)
    return load_model(spark, path).score(df).select("id", F.round("prediction", 5).alias("pred"))


FOLDED = folds_sql("bin", qcut_sql("y", f"(select id, x1, y from {FRAME})", 10), 3, key="id")
FOLD_LINES = f"""(select k.fold, regr_slope(y, x1) as b, regr_intercept(y, x1) as a from {FOLDED} f join (select unnest([0, 1, 2]) as fold) k on f.fold <> k.fold group by k.fold)"""


def line_config():
    return TrainingConfig("id", "y", "regression", [ModelSpec("Linear Regression 1", "Linear Regression")], folds=3, best_metric="RMSE", higher_is_better=False, features=FeatureOptions())


@query("cv_oof_frame", f"select id, f.fold, 'Linear Regression 1' as model, round(y, 5) as actual, round(a + b * x1, 5) as pred from {FOLDED} f join {FOLD_LINES} l on f.fold = l.fold")
def cv_oof_frame(spark, d):
    run = train(frame(spark, d).select("id", "x1", "y"), line_config(), scratch_path(spark, "run"))
    return run.oof().select("id", "fold", "model", F.round("actual", 5).alias("actual"), F.round("pred", 5).alias("pred"))


def holed(spark, d):
    """Numbers with nulls, strings and a target of three classes."""
    df = frame(spark, d).withColumn("kind", F.when(F.col("id") % 9 != 0, F.concat(F.lit("k"), (F.col("id") % 5).cast("string"))))
    target = F.element_at(F.array(*[F.lit(c) for c in ("low", "middle", "high")]), F.col("three").cast("int") + 1)
    return df.select("id", F.when(F.col("id") % 4 != 0, F.col("x1")).alias("x1"), "x2", "kind", target.alias("level"))


HOLED_FRAME = f"""(select id, case when id % 4 <> 0 then x1 end as x1, x2, case when id % 9 <> 0 then 'k' || (id % 5) end as kind, case three when 0 then 'low' when 1 then 'middle' else 'high' end as level from {FRAME})"""


@query("fe_fill_nominal", f"""
select id, level, round(coalesce(x1, (select median(x1) from {HOLED_FRAME} where id % 2 = 0)), 8) as x1, round(x2, 8) as x2, cast(x1 is null as double) as x1_missing,
 case when kind is null or kind = 'k4' then 4.0::double else cast(substr(kind, 2) as double) end as kind from {HOLED_FRAME}""")
def fe_fill_nominal(spark, d):
    """Medians and flags for missing numbers, category numbers for strings; fitted without 'k4'."""
    df = holed(spark, d)
    plan = FeaturePlan.fit(df.where("id % 2 = 0 and (kind is null or kind <> 'k4')").unionByName(df.where("id % 2 = 0 and kind = 'k4'").withColumn("kind", F.lit(None).cast("string"))),
                           FeatureOptions("id", "level", encoding="nominal", fill_missing=True))
    return plan.transform(df).withColumns({c: F.round(c, 8) for c in ("x1", "x2")})


@query("cv_classification_run", f"""
select id, fold, model, 1.0::double as mass, true as listed from {folds_sql('level', HOLED_FRAME, 5, key='id')}, (select unnest(['Decision Tree 1', 'XGBoost 1']) as model)""")
def cv_classification_run(spark, d):
    """Folds, feature plans, balanced models, predictions and metrics of a table with nulls and strings."""
    models = [ModelSpec("Decision Tree 1", "Decision Tree"), ModelSpec("XGBoost 1", "XGBoost", {"rounds": 3})]
    config = TrainingConfig("id", "level", "classification", models, best_metric="F1-Score", features=FeatureOptions(encoding="nominal", fill_missing=True), balanced=True)
    run = train(holed(spark, d), config, scratch_path(spark, "run"))
    good = run.metrics().where("split = 'Valid' and metric = 'Accuracy'").agg(F.count(F.lit(1)), F.min("value")).first()
    told = F.max(F.when(F.col("class") == F.col("pred"), F.col("proba")))  # numbers only: a maximum of strings is found by sorting all rows
    listed = F.lit(good[0] == 10 and good[1] > 0.7) & (told == F.max("proba"))
    return run.oof().groupBy("id", "fold", "model").agg(F.round(F.sum("proba"), 6).alias("mass"), listed.alias("listed"))


@query("cv_best_model", f"""
with m as (select model, fold, avg(cast(actual = pred as int)) as value from (select * from {OOF} where class = pred) group by model, fold)
select fold, first(model order by value desc, model) as model, round(max(value), 6) as value from m group by fold""")
def cv_best_model(spark, d):
    best = best_models(M.classification_metrics(oof(spark, d), ["model", "fold"], metrics=["Accuracy"]), "Accuracy")
    return best.withColumn("value", F.round("value", 6))


@query("pred_inference", f"select id, fold, 'Linear Regression 1' as model, round(a + b * x1, 5) as pred from {FRAME} f, {FOLD_LINES} l")
def pred_inference(spark, d):
    path = scratch_path(spark, "run")
    train(frame(spark, d).select("id", "x1", "y"), line_config(), path)
    run = TrainingRun.load(spark, path)
    return run.score(frame(spark, d).select("id", "x1")).withColumn("pred", F.round("pred", 5))


PLANE = f"""(with s as (select avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as t1, covar_pop(x2, y) as t2 from {FRAME})
 select m1, m2, my, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as b2 from s)"""
GRID = f"""(select i, q[1] + i * (q[2] - q[1]) / 9 as g from (select quantile_cont(x1, [0.05, 0.95]) as q from {FRAME}), range(10) t(i))"""


def plane(spark, d):
    wide = frame(spark, d)
    df = assembled(wide, "y", ["x1", "x2"])
    grids = E.dependence_grids(wide, ["x1"], 10)
    return df, linear.least_squares(df), grids


@query("ex_partial_dependence", f"select 'x1' as feature, round(g, 4) as grid, round(my + b1 * (g - m1), 4) as mean from {PLANE}, {GRID}")
def ex_partial_dependence(spark, d):
    df, fitted, grids = plane(spark, d)
    out = E.partial_dependence(df, fitted, ["x1", "x2"], grids)
    return out.select("feature", F.round(F.col("grid").cast("double"), 4).alias("grid"), F.round("mean", 4).alias("mean"))


@query("ex_ice", f"select id, 'x1' as feature, round(g, 4) as grid, round(my + b1 * (g - m1) + b2 * (x2 - m2), 4) as output from {FRAME} f, {PLANE}, {GRID}")
def ex_ice(spark, d):
    df, fitted, grids = plane(spark, d)
    out = E.individual_curves(df, fitted, "id", ["x1", "x2"], grids)
    return out.select("id", "feature", F.round("grid", 4).alias("grid"), F.round("output", 4).alias("output"))


FLAGGED = f"(select id, x1, y + 2 * (id % 2) as y, (id % 2)::double as flag from {FRAME})"


@query("ex_dependence_flag", f"""
with s as (select avg(x1) as m1, avg(flag) as m2, avg(y) as my, var_pop(x1) as s11, var_pop(flag) as s22, covar_pop(x1, flag) as s12, covar_pop(x1, y) as t1, covar_pop(flag, y) as t2 from {FLAGGED})
select 'flag' as feature, unnest(['0', '1']) as grid, round(my + (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) * (unnest([0.0::double, 1.0]) - m2), 4) as mean from s""")
def ex_dependence_flag(spark, d):
    """A two-valued number is asked at its two values, not over a range."""
    wide = frame(spark, d).withColumn("flag", (F.col("id") % 2).cast("int")).withColumn("y", F.col("y") + 2 * F.col("flag"))
    df = assembled(wide, "y", ["x1", "flag"])
    out = E.partial_dependence(df, linear.least_squares(df), ["x1", "flag"], E.dependence_grids(wide, ["flag"]))
    return out.withColumn("mean", F.round("mean", 4))


@query("ex_tree_shap")
def ex_tree_shap(spark, d):
    df = assembled(frame(spark, d), "y")
    fitted = trees.decision_tree_regressor(df, 4)
    out = E.tree_shap(df, fitted, "id", XS)
    return out.withColumns({"phi": F.round("phi", 6), "base": F.round("base", 6), "value": F.round("value", 6)})


def shap_gaps(df, fitted, k):
    """Per row and class: what the attributions add up to, less what the model reports."""
    _, _, link = explained_parts(df, fitted)
    told = E.explained_output(E.tree_shap(df, fitted, "id", XS), "id", link, [str(c) for c in range(k)]).select("id", F.col("probability").alias("_told"))
    both = fitted.score(df).select("id", "probability").join(told, "id")
    rows = F.array(*[F.struct(F.lit(str(c)).alias("class"), F.round(F.abs(F.col("probability")[c] - F.col("_told")[c]), 6).alias("gap")) for c in range(k)])
    return both.select("id", F.inline(rows))


def gaps_sql(k):
    return f"select o_orderkey as id, unnest([{', '.join(f"'{c}'" for c in range(k))}]) as class, 0.0::double as gap from orders"


@query("ex_shap_extra_trees", gaps_sql(3))
def ex_shap_extra_trees(spark, d):
    df = assembled(frame(spark, d), "three").persist()
    return shap_gaps(df, trees.extra_trees(df), 3)


@query("ex_shap_adaboost", gaps_sql(2))
def ex_shap_adaboost(spark, d):
    df = assembled(frame(spark, d), "two").persist()
    return shap_gaps(df, trees.adaboost(df, rounds=10), 2)


@query("ex_shap_boosting", gaps_sql(3))
def ex_shap_boosting(spark, d):
    """Three classes, one boosted model against the rest each."""
    df = assembled(frame(spark, d), "three").persist()
    return shap_gaps(df, trees.gradient_boosting(df, rounds=10), 3)


def stump_sql(target, impurity, columns=("x2", "x3")):
    """The best single cut over features with few values, by sums of n, y and y^2 on either side."""
    cells = " union all ".join(f"select '{c}' as feature, {c} as v, {target} as t from f" for c in columns)
    value = impurity  # of (n, s, q)
    return f"""f as {FRAME}, c as (select feature, v, count(*)::double as n, sum(t) as s, sum(t * t) as q from ({cells}) group by all),
 cum as (select feature, v, lead(v) over w as nxt, sum(n) over w as nl, sum(s) over w as sl, sum(q) over w as ql from c window w as (partition by feature order by v rows unbounded preceding)),
 whole as (select count(*)::double as n, sum({target}) as s, sum({target} * {target}) as q from f),
 cut as (select feature, (v + nxt) / 2 as bound, sl / nl as below, (s - sl) / (n - nl) as above,
  nl * ({value('nl', 'sl', 'ql')}) + (n - nl) * ({value('(n - nl)', '(s - sl)', '(q - ql)')}) as rest from cum, whole where nxt is not null qualify row_number() over (order by rest, feature, bound) = 1),
 told as (select id, case when case feature when 'x2' then x2 else x3 end <= bound then below else above end as y from f, cut)"""


GINI = lambda n, s, q: f"2 * ({s} / {n}) * (1 - {s} / {n})"
SPREAD = lambda n, s, q: f"{q} / {n} - ({s} / {n}) * ({s} / {n})"


@query("ml_stump", f"with {stump_sql('two', GINI)} select id, cast(y > 0.5 as int) as pred, round(1 - y, 4) as p0, round(y, 4) as p1 from told")
def ml_stump(spark, d):
    """A tree of one cut, which SQL can search: every value of two features as a bound."""
    return classify(spark, d, trees.decision_tree, columns=["x2", "x3"], max_depth=1)


@query("ml_stump_regress", f"with {stump_sql('y', SPREAD)} select id, round(y, 5) as pred from told")
def ml_stump_regress(spark, d):
    return regress(spark, d, trees.decision_tree_regressor, ["x2", "x3"], max_depth=1)


@query("ml_adaboost_round", f"""with {stump_sql('two', GINI)}
select id, cast(y > 0.5 as int) as pred, round(1 / (1 + exp(case when y > 0.5 then 2.0 else -2.0 end)), 4) as p0, round(1 / (1 + exp(case when y > 0.5 then -2.0 else 2.0 end)), 4) as p1 from told""")
def ml_adaboost_round(spark, d):
    """One round: the stump's votes, +1 and -1 whatever its strength."""
    return classify(spark, d, trees.adaboost, columns=["x2", "x3"], rounds=1)


@query("ml_gbt_round", f"with {stump_sql('y', SPREAD)} select id, round(y, 5) as pred from told")
def ml_gbt_round(spark, d):
    """The first tree of a boosted regression is the tree of the target."""
    return regress(spark, d, trees.gradient_boosting_regressor, ["x2", "x3"], rounds=1, max_depth=1)


@query("ml_logistic_optimum", "select class, feature, 0.0::double as slope from (select unnest([0, 1]) as class), (select unnest(['x1', 'x2', 'x3']) as feature)")
def ml_logistic_optimum(spark, d):
    """The gradient of the penalised likelihood at the fit, per row: zero for every feature and class."""
    df = assembled(frame(spark, d), "two").persist()
    fitted = linear.logistic_regression(df)
    w = fitted.state["model"].coefficients.toArray()
    x = vector_to_array("features")
    scored = fitted.score(df).withColumn("x", x)
    sums = scored.agg(F.count(F.lit(1)).alias("n"), *[F.sum((F.col("probability")[1] - F.col("label")) * F.col("x")[i]).alias(f"g{i}") for i in range(3)])
    rows = F.array(*[F.struct(F.lit(k).alias("class"), F.lit(c).alias("feature"), (F.abs(F.round((2 * k - 1) * (F.col(f"g{i}") + F.lit(float(w[i]))) / F.col("n"), 4)) + 0.0).alias("slope")) for k in (0, 1) for i, c in enumerate(XS)])
    return sums.select(F.inline(rows))


@query("ex_shap_forest", gaps_sql(3))
def ex_shap_forest(spark, d):
    df = assembled(frame(spark, d), "three").persist()
    return shap_gaps(df, trees.random_forest(df), 3)


TWO_FOLDED = folds_sql("bin", qcut_sql("y", f"(select id, x1, x2, y from {FRAME})", 10), 5, key="id")
FOLD_PLANES = f"""(select fold, m1, m2, my, (t1 * s22 - t2 * s12) / (s11 * s22 - s12 * s12) as b1, (t2 * s11 - t1 * s12) / (s11 * s22 - s12 * s12) as b2 from
 (select k.fold, avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) as s11, var_pop(x2) as s22, covar_pop(x1, x2) as s12, covar_pop(x1, y) as t1, covar_pop(x2, y) as t2
  from {TWO_FOLDED} f join (select unnest([0, 1, 2, 3, 4]) as fold) k on f.fold <> k.fold group by k.fold))"""


@query("cv_oof_five_folds", f"select id, f.fold, 'Linear Regression 1' as model, round(y, 5) as actual, round(my + b1 * (x1 - m1) + b2 * (x2 - m2), 5) as pred from {TWO_FOLDED} f join {FOLD_PLANES} l on f.fold = l.fold")
def cv_oof_five_folds(spark, d):
    config = TrainingConfig("id", "y", "regression", [ModelSpec("Linear Regression 1", "Linear Regression")], best_metric="RMSE", higher_is_better=False, features=FeatureOptions())
    run = train(frame(spark, d).select("id", "x1", "x2", "y"), config, scratch_path(spark, "run"))
    return run.oof().select("id", "fold", "model", F.round("actual", 5).alias("actual"), F.round("pred", 5).alias("pred"))


@query("ex_beeswarm", f"""
with f as {FRAME}, m as (select {', '.join(f'avg({c}) as m{i}' for i, c in enumerate(XS))} from f),
a as (select unnest(['x1', 'x2', 'x3']) as feature, unnest([x1, x2, x3]) as value, unnest([3.0::double * (x1 - m0), -4.0::double * (x2 - m1), 1.0::double * (x3 - m2)]) as phi from f, m),
top as (select feature from a group by feature order by avg(abs(phi)) desc, feature limit 2)
select feature, round(value, 8) as value, round(phi, 6) as phi, count(*) as n from a where feature in (select feature from top) group by all""")
def ex_beeswarm(spark, d):
    points = E.beeswarm(attributions(spark, d), top=2)
    return points.groupBy("feature", F.round("value", 8).alias("value"), F.round("phi", 6).alias("phi")).agg(F.sum("n").alias("n"))


COEF = {"x1": 3.0, "x2": -4.0, "x3": 1.0}


def attributions(spark, d):
    """Exact attributions of the known linear score: coefficient x distance to the mean."""
    df = frame(spark, d)
    means = df.agg(*[F.avg(c).alias(c) for c in XS]).first()
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value"), (F.lit(b) * (F.col(c) - F.lit(means[c]))).alias("phi")) for c, b in COEF.items()])
    return df.select("id", F.lit(None).cast("string").alias("class"), F.inline(rows))


ATTR = "(" + " union all ".join(f"select id, '{c}' as feature, {c} as value, {b}::double * ({c} - (select avg({c}) from {FRAME})) as phi from {FRAME} f" for c, b in COEF.items()) + ")"


@query("ex_importance", f"""
with t as (select feature, avg(abs(phi)) as v, min(phi) as lo, max(phi) as hi from {ATTR} group by feature)
select null as class, feature, round(v, 6) as importance, round(lo, 6) as min_phi, round(hi, 6) as max_phi, cast(row_number() over (order by v desc, feature) as int) as position from t where v >= 0.3""")
def ex_importance(spark, d):
    out = E.importance(attributions(spark, d), 0.3)
    return out.withColumns({c: F.round(c, 6) for c in ("importance", "min_phi", "max_phi")})


@query("ex_local", f"""
select id, null as class, feature, round(value, 8) as value, round(phi, 6) as phi, position from
 (select *, cast(row_number() over (partition by id order by abs(phi) desc, feature) as int) as position from {ATTR}) where position <= 2""")
def ex_local(spark, d):
    return E.local_explanations(attributions(spark, d), "id", 2).withColumns({"phi": F.round("phi", 6), "value": F.round("value", 8)})


@query("scan_csv", "select * from customer")
def scan_csv(spark, d):
    path = scratch_path(spark, "customer.csv")
    df = table(spark, d, "customer")
    df.write.option("header", True).csv(path)
    return S.read_csv(spark, path, df.schema)


@query("scan_csv_inferred", "select * from part")
def scan_csv_inferred(spark, d):
    path = scratch_path(spark, "part.csv")
    table(spark, d, "part").write.option("header", True).csv(path)
    return S.read_table(spark, path)


@query("scan_parquet", "select o_orderkey, o_totalprice from orders where o_totalprice > 400000")
def scan_parquet(spark, d):
    return S.read_table(spark, f"{d}/orders.parquet").where("o_totalprice > 400000").select("o_orderkey", "o_totalprice")


@query("scan_feather", "select * from supplier")
def scan_feather(spark, d):
    path = scratch_path(spark, "supplier")
    df = table(spark, d, "supplier")
    S.write_feather(df, path)
    return S.read_feather(spark, path, df.schema)


@query("sink_roundtrip", "select * from documents")
def sink_roundtrip(spark, d):
    return S.write_table(table(spark, d, "documents"), scratch_path(spark, "cleaned"))


@query("sink_plan_replay", """
select p_partkey, p_name, cast(p_size as varchar) as p_size, p_partkey % 5 > 2 as "level_7", coalesce(case when p_partkey % 3 > 0 then p_type end,
 (select p_type from part where p_partkey % 2 = 0 and p_partkey % 3 > 0 group by 1 order by count(*) desc, p_type limit 1)) as p_type from part where p_partkey % 2 = 1""")
def sink_plan_replay(spark, d):
    raw = table(spark, d, "part").select(
        "p_partkey", "p_name", "p_size", F.when(F.col("p_partkey") % 5 > 2, 7).otherwise(3).alias("level"), F.when(F.col("p_partkey") % 3 > 0, F.col("p_type")).alias("p_type"), F.lit(1).alias("flat"))
    options = CleaningOptions(id_col="p_partkey", number_to_category=["p_size"], missing="mean")
    path = scratch_path(spark, "plan")
    CleaningPlan.fit(raw.where("p_partkey % 2 = 0"), options).save(spark, path)
    return CleaningPlan.load(spark, path).transform(raw.where("p_partkey % 2 = 1"))


@query("sink_oof_partitioned", f"select id, fold, model, class, round(proba, 8) as proba from {OOF} where model = 'm2' and fold = 3")
def sink_oof_partitioned(spark, d):
    path = scratch_path(spark, "oof")
    S.write_partitioned(oof(spark, d), path, ["model", "fold"])
    return S.read_partitioned(spark, path, model="m2", fold=3).select("id", "fold", "model", "class", F.round("proba", 8).alias("proba"))
