"""Queries: metrics, evaluation views, ensembling. They run on pseudo-predictions that both
engines derive from the whole `orders` table with md5, so no trained model is needed."""

from pyspark.sql import Window as W, functions as F

from colonnade.catalog import query, table
from colonnade.catalog.univariate import counts_sql, kde_sql
from colonnade.functions import normal as N
from colonnade.session import spread
from colonnade.operators import evaluate as V, explain_samples as ES, metrics as M, predict as P

CLASSES = ["F", "O", "P"]
MODELS = ["m1", "m2"]


def unit(*parts):
    """Uniform number in [0, 1) from the md5 of the joined parts."""
    text = F.concat_ws("-", *parts)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def unit_sql(*parts):
    return f"(('0x' || substring(md5(concat_ws('-', {', '.join(parts)})), 1, 8))::bigint / 4294967296.0::double)"


def score_rows(spark, d, folds):
    """(id, fold, model, actual, class, proba, pred, total): one row per class."""
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"))
    base = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("actual"), F.explode(folds).alias("fold"))
    base = base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    raw = {c: unit("id", F.lit(c), "model", "fold") + F.when(F.col("actual") == c, 0.35).otherwise(0.0) for c in CLASSES}
    base = base.withColumns({f"s_{c}": e for c, e in raw.items()})
    total = F.col("s_F") + F.col("s_O") + F.col("s_P")
    pred = F.when((F.col("s_F") >= F.col("s_O")) & (F.col("s_F") >= F.col("s_P")), "F").when(F.col("s_O") >= F.col("s_P"), "O").otherwise("P")
    rows = F.array(*[F.struct(F.lit(c).alias("class"), (F.col(f"s_{c}") / total).alias("proba")) for c in CLASSES])
    return base.select("id", "fold", "model", "actual", pred.alias("pred"), F.inline(rows))


def oof(spark, d):
    return score_rows(spark, d, F.array(F.pmod("o_orderkey", F.lit(5)).cast("int")))


def scored(spark, d):
    return score_rows(spark, d, F.array(*[F.lit(k) for k in range(3)]))


def scores_sql(folds):
    inner = f"""select o_orderkey as id, o_orderstatus as actual, fold, model from (select *, {folds} as fold from orders), (values ('m1'), ('m2')) m(model)"""
    s = ", ".join(f"{unit_sql('id', chr(39) + c + chr(39), 'model', 'fold')} + case when actual = '{c}' then 0.35::double else 0 end as s_{c}" for c in CLASSES)
    pred = "case when s_F >= s_O and s_F >= s_P then 'F' when s_O >= s_P then 'O' else 'P' end as pred"
    return "(" + " union all ".join(f"select id, fold, model, actual, {pred}, '{c}' as class, s_{c} / (s_F + s_O + s_P) as proba from (select *, {s} from ({inner}))" for c in CLASSES) + ")"


OOF = scores_sql("cast(o_orderkey % 5 as int)")
SCORED = scores_sql("unnest([0, 1, 2])")


def oof_binary(spark, d):
    """Is the order finished ('F')? Two classes, scores rounded so that ties occur."""
    rows = oof(spark, d).where("class = 'F'")
    p = F.round("proba", 3)
    both = F.array(F.struct(F.lit("no").alias("class"), (1 - p).alias("proba")), F.struct(F.lit("yes").alias("class"), p.alias("proba")))
    return rows.select("id", "fold", "model", F.when(F.col("actual") == "F", "yes").otherwise("no").alias("actual"),
                       F.when(p >= 0.4, "yes").otherwise("no").alias("pred"), F.inline(both))


BINARY = f"""(select id, fold, model, case when actual = 'F' then 'yes' else 'no' end as actual, case when round(proba, 3) >= 0.4 then 'yes' else 'no' end as pred,
 round(proba, 3) as score from {OOF} where class = 'F')"""


def regression(spark, d, folds=None):
    orders = spread(table(spark, d, "orders").select("o_orderkey", "o_totalprice"))
    base = orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("actual"),
        F.explode(folds if folds is not None else F.array(F.pmod("o_orderkey", F.lit(5)).cast("int"))).alias("fold"))
    base = base.withColumn("model", F.explode(F.array(*[F.lit(m) for m in MODELS])))
    return base.withColumn("pred", F.col("actual") * (0.8 + 0.4 * unit("id", F.lit("r"), "model", "fold")))


def regression_sql(folds="cast(o_orderkey % 5 as int)"):
    return f"""(select id, actual, fold, model, actual * (0.8 + 0.4 * {unit_sql('id', "'r'", 'model', 'fold')}) as pred from
 (select o_orderkey as id, o_totalprice as actual, {folds} as fold from orders), (values ('m1'), ('m2')) m(model))"""


REG = regression_sql()
HARD = f"(select * from {OOF} where class = pred)"
BY = ["model", "fold"]


def six(df):
    return df.withColumn("value", F.round("value", 6))


@query("metric_accuracy", f"select model, fold, 'Accuracy' as metric, null as class, round(avg(cast(actual = pred as int)), 6) as value from {HARD} group by model, fold")
def metric_accuracy(spark, d):
    return six(M.accuracy(M.confusion_counts(M.hard_labels(oof(spark, d), BY), BY), BY))


def per_class_sql(by="model, fold"):
    return f"""(select {by}, c.class, count(*) filter (where actual = c.class and pred = c.class) as tp, count(*) filter (where pred = c.class) as called,
 count(*) filter (where actual = c.class) as support from {HARD} h, (values ('F'), ('O'), ('P')) c(class) group by {by}, c.class)"""


FORMULAS = {"Precision": "case when called = 0 then 0 else tp / called end", "Recall": "case when support = 0 then 0 else tp / support end",
            "F1 Score": "case when called + support = 0 then 0 else 2.0 * tp / (called + support) end"}


def hard_sql(name):
    f = FORMULAS[name].replace("tp /", "tp::double /")
    return f"""select model, fold, '{name}' as metric, class, round({f}, 6) as value from {per_class_sql()} union all
 select model, fold, '{name}', null, round(avg({f}), 6) from {per_class_sql()} group by model, fold
 union all select model, fold, '{name} yes', null, round({f}, 6) from (select model, fold, count(*) filter (where actual = 'yes' and pred = 'yes') as tp,
  count(*) filter (where pred = 'yes') as called, count(*) filter (where actual = 'yes') as support from {BINARY} group by model, fold)"""


def hard_query(spark, d, name):
    multi = M.hard_metrics(M.confusion_counts(M.hard_labels(oof(spark, d), BY), BY), BY, names=[name])
    two = M.hard_metrics(M.confusion_counts(M.hard_labels(oof_binary(spark, d), BY), BY), BY, positive="yes", names=[name])
    return six(multi.unionByName(two.withColumn("metric", F.lit(f"{name} yes"))))


for key, metric in (("metric_precision", "Precision"), ("metric_recall", "Recall"), ("metric_f1", "F1 Score")):
    query(key, hard_sql(metric))(lambda spark, d, m=metric: hard_query(spark, d, m))


def auc_sql(source, by, hit, score):
    """AUC from tie-averaged ranks."""
    return f"""(select {by}, (sum(rk) filter (where hit) - count(*) filter (where hit) * (count(*) filter (where hit) + 1) / 2.0)
 / (count(*) filter (where hit) * count(*) filter (where not hit)) as value from
 (select {by}, {hit} as hit, rank() over (partition by {by} order by {score}) + (count(*) over (partition by {by}, {score}) - 1) / 2.0 as rk from {source}) group by {by})"""


def ap_sql(source, by, hit, score):
    return f"""(select {by}, sum(pos * cp / cn) / sum(pos) as value from (select {by}, pos, sum(pos) over w as cp, sum(n) over w as cn from
 (select {by}, {score} as s, count(*) filter (where {hit}) as pos, count(*)::double as n from {source} group by {by}, {score}) window w as (partition by {by} order by s desc)) group by {by})"""


def ovr_sql(builder, name):
    per = builder(OOF, "model, fold, class", "actual = class", "proba")
    return f"""select model, fold, '{name}' as metric, class, round(value, 6) as value from {per}
 union all select model, fold, '{name}', null, round(avg(value), 6) from {per} group by model, fold"""


@query("metric_roc_auc", f"select model, fold, 'ROC AUC' as metric, null as class, round(value, 6) as value from {auc_sql(BINARY, 'model, fold', chr(39) + 'yes' + chr(39) + ' = actual', 'score')}")
def metric_roc_auc(spark, d):
    return six(M.ranking_metrics(oof_binary(spark, d), ["ROC AUC"], BY, positive="yes"))


@query("metric_roc_auc_ovr", ovr_sql(auc_sql, "ROC AUC"))
def metric_roc_auc_ovr(spark, d):
    return six(M.ranking_metrics(oof(spark, d), ["ROC AUC"], BY))


@query("metric_avg_precision", f"select model, fold, 'Avg Precision' as metric, null as class, round(value, 6) as value from {ap_sql(BINARY, 'model, fold', chr(39) + 'yes' + chr(39) + ' = actual', 'score')}")
def metric_avg_precision(spark, d):
    return six(M.ranking_metrics(oof_binary(spark, d), ["Avg Precision"], BY, positive="yes"))


@query("metric_avg_precision_ovr", ovr_sql(ap_sql, "Avg Precision"))
def metric_avg_precision_ovr(spark, d):
    return six(M.ranking_metrics(oof(spark, d), ["Avg Precision"], BY))


E2 = "(pred - actual) * (pred - actual)"
R2 = f"1 - sum({E2}) / (var_pop(actual) * count(*))"
REG_SQL = {
    "MSE": f"avg({E2})", "RMSE": f"sqrt(avg({E2}))", "MAE": "avg(abs(pred - actual))", "MedAE": "quantile_cont(abs(pred - actual), 0.5)",
    "R2": R2, "Adj R2": f"1 - (1 - ({R2})) * (count(*) - 1) / (count(*) - 4 - 1)",
}


def regression_metric_sql(names, digits, source=REG, by="model, fold"):
    return " union all ".join(f"select {by}, '{n}' as metric, null as class, round({REG_SQL[n]}, {digits}) as value from {source} group by {by}" for n in names)


def regression_query(spark, d, names, digits):
    return M.regression_metrics(regression(spark, d), BY, 4, names).withColumn("value", F.round("value", digits))


for key, chosen, places in (("metric_mse_rmse_mae", ["MSE", "RMSE", "MAE"], 2), ("metric_medae", ["MedAE"], 4), ("metric_r2", ["R2"], 8), ("metric_adj_r2", ["Adj R2"], 8)):
    query(key, regression_metric_sql(chosen, places))(lambda spark, d, n=chosen, p=places: regression_query(spark, d, n, p))


@query("metric_table", f"""
with c as {per_class_sql()}
select model, fold, round(avg(cast(actual = pred as int)), 6) as "Accuracy",
 (select round(avg({FORMULAS['F1 Score']}), 6) from c where c.model = h.model and c.fold = h.fold) as "F1 Score",
 """ + ", ".join(f"(select round({FORMULAS['F1 Score']}, 6) from c where c.model = h.model and c.fold = h.fold and c.class = '{k}') as \"F1 Score-{k}\"" for k in CLASSES)
       + f" from {HARD} h group by model, fold")
def metric_table(spark, d):
    long = six(M.classification_metrics(oof(spark, d), BY, metrics=["Accuracy", "F1 Score"]))
    return M.metric_table(long, BY, ["Accuracy", "F1 Score", *[f"F1 Score-{c}" for c in CLASSES]])


FOLD_METRICS = f"""(select model, fold, 'Accuracy' as metric, avg(cast(actual = pred as int)) as value from {HARD} group by model, fold
 union all select model, fold, 'F1 Score', avg({FORMULAS['F1 Score']}) from {per_class_sql()} group by model, fold)"""


@query("eval_metric_summary", f"""
with t as (select cast(fold as varchar) as fold, model, metric, value from {FOLD_METRICS} union all select 'All', model, metric, avg(value) from {FOLD_METRICS} group by model, metric),
b as (select *, max(value) filter (where metric = 'F1 Score') over (partition by fold, model) as best from t)
select fold, model, metric, round(value, 6) as value, cast(row_number() over (partition by fold, metric order by best desc, model) as int) as position from b""")
def eval_metric_summary(spark, d):
    return six(V.metric_summary(M.classification_metrics(oof(spark, d), BY, metrics=["Accuracy", "F1 Score"]), "F1 Score"))


CLASS_FOLD = f"(select model, fold, class, {FORMULAS['Precision'].replace('tp /', 'tp::double /')} as \"Precision\", {FORMULAS['Recall'].replace('tp /', 'tp::double /')} as \"Recall\" from {per_class_sql()})"


@query("eval_class_metrics", " union all ".join(
    f"select '{m}' as metric, class, round(avg(\"{m}\") filter (where model = 'm1'), 6) as m1, round(avg(\"{m}\") filter (where model = 'm2'), 6) as m2 from {CLASS_FOLD} group by class" for m in ("Precision", "Recall")))
def eval_class_metrics(spark, d):
    long = M.classification_metrics(oof(spark, d), BY, metrics=["Precision", "Recall"])
    return V.class_metric_table(long, MODELS).withColumns({m: F.round(m, 6) for m in MODELS})


@query("eval_confusion", f"""
select m.model, a.c as actual, p.c as pred, count(h.id) as n from (values ('m1'), ('m2')) m(model), (values ('F'), ('O'), ('P')) a(c), (values ('F'), ('O'), ('P')) p(c)
left join (select * from {HARD} where fold = 1) h on h.model = m.model and h.actual = a.c and h.pred = p.c group by all""")
def eval_confusion(spark, d):
    return V.confusion_matrix(M.hard_labels(oof(spark, d), ["id", "model", "fold"]), fold=1)


def slice_frame(spark, d):
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice", F.when(F.col("o_totalprice") > 250000, "big").otherwise("small").alias("size"),
        (F.col("o_custkey") % 2 == 1).alias("odd"), "o_orderpriority")


SLICES = f"""(select o_orderkey as id, 'size' as "column", case when o_totalprice > 250000 then 'big' else 'small' end as category from orders
 union all select o_orderkey, 'odd', cast(o_custkey % 2 = 1 as varchar) from orders)"""


def slice_metric_sql(slices):
    j = f"(select h.*, s.\"column\", s.category from {{}} h join {slices} s on h.id = s.id)"
    hard, soft = j.format(HARD), j.format(OOF)
    by = '"column", category, model'
    auc = auc_sql(soft, by + ", class", "actual = class", "proba")
    return f"""select {by}, 'Accuracy' as metric, null as class, round(avg(cast(actual = pred as int)), 6) as value from {hard} group by all
 union all select {by}, 'ROC AUC', class, round(value, 6) from {auc} union all select {by}, 'ROC AUC', null, round(avg(value), 6) from {auc} group by {by}"""


@query("eval_category_metrics", slice_metric_sql(SLICES))
def eval_category_metrics(spark, d):
    return six(V.category_metrics(oof(spark, d), slice_frame(spark, d), "id", "o_orderstatus", 4, metrics=["Accuracy", "ROC AUC"]))


@query("eval_numeric_slices", f"""
with e as (select quantile_cont(o_totalprice, [0.25, 0.5, 0.75]) as q from orders),
s as (select o_orderkey as id, 1 + len(list_filter((select q from e), lambda x: o_totalprice > x)) as bin from orders)
select 'o_totalprice_binned' as "column", cast(bin as int) as bin, model, 'RMSE' as metric, round(sqrt(avg({E2})), 4) as value from {REG} r join s on r.id = s.id group by all""")
def eval_numeric_slices(spark, d):
    frame = slice_frame(spark, d)
    out = V.numeric_slice_metrics(regression(spark, d), frame, "id", "none", 4, "regression", ["RMSE"], ["o_totalprice"])
    order = F.expr("try_cast(regexp_extract(category, '[(](.*),', 1) as double)")
    return out.select("column", F.dense_rank().over(W.partitionBy("model").orderBy(order)).alias("bin"), "model", "metric", F.round("value", 4).alias("value"))


@query("eval_numeric_slices_two", f"""
with v as (select o_orderkey as id, unnest(['o_totalprice_binned', 'o_custkey_binned']) as "column", unnest([o_totalprice, o_custkey::double]) as v from orders),
e as (select "column", quantile_cont(v, [0.25, 0.5, 0.75]) as q from v group by 1),
s as (select id, v."column", 1 + len(list_filter(q, lambda x: v > x)) as bin from v join e on v."column" = e."column")
select s."column", cast(bin as int) as bin, model, 'MAE' as metric, round(avg(sqrt({E2})), 4) as value from {REG} r join s on r.id = s.id group by all""")
def eval_numeric_slices_two(spark, d):
    """Two numeric columns sliced side by side, each at its own quartiles."""
    frame = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", F.col("o_custkey").cast("double").alias("o_custkey"))
    out = V.numeric_slice_metrics(regression(spark, d), frame, "id", "none", 4, "regression", ["MAE"], ["o_totalprice", "o_custkey"])
    order = F.expr("try_cast(regexp_extract(category, '[(](.*),', 1) as double)")
    return out.select("column", F.dense_rank().over(W.partitionBy("column", "model").orderBy(order)).alias("bin"), "model", "metric", F.round("value", 4).alias("value"))


@query("eval_runtime", """
select model, round(avg(fit_seconds), 6) as fit_seconds, round(avg(predict_seconds), 6) as predict_seconds from
 (select o_orderpriority as model, o_totalprice / 100000 as fit_seconds, o_custkey / 1000.0::double as predict_seconds from orders) group by model""")
def eval_runtime(spark, d):
    runs = table(spark, d, "orders").select(F.col("o_orderpriority").alias("model"), (F.col("o_totalprice") / 100000).alias("fit_seconds"), (F.col("o_custkey") / 1000).alias("predict_seconds"))
    return V.runtime_summary(runs).select("model", F.round("fit_seconds", 6).alias("fit_seconds"), F.round("predict_seconds", 6).alias("predict_seconds"))


RESID = f"""(select r.*, actual - pred as residual, (actual - pred - m) / s as std_residual from {REG} r join
 (select model, avg(actual - pred) as m, stddev_samp(actual - pred) as s from {REG} group by model) t on r.model = t.model)"""


@query("eval_residuals", f"select id, model, fold, round(residual, 4) as residual, round(std_residual, 6) as std_residual from {RESID}")
def eval_residuals(spark, d):
    return V.residuals(regression(spark, d)).select("id", "model", "fold", F.round("residual", 4).alias("residual"), F.round("std_residual", 6).alias("std_residual"))


def horner(coefficients, x):
    total = repr(float(coefficients[0]))
    for c in coefficients[1:]:
        total = f"({total} * {x} + ({float(c)!r}))"
    return total


def inverse_normal_sql(p):
    q, r = f"sqrt(-2 * ln(least({p}, 1 - {p})))", f"(({p} - 0.5) * ({p} - 0.5))"
    tail = f"({horner(N.TAIL_TOP, q)} / {horner(N.TAIL_BOTTOM, q)})"
    return f"case when least({p}, 1 - {p}) >= 0.02425 then {horner(N.CENTRE_TOP, r)} * ({p} - 0.5) / {horner(N.CENTRE_BOTTOM, r)} when {p} < 0.5 then {tail} else -{tail} end"


@query("eval_qq", f"""
with z as (select model, round(std_residual, 3) as z from {RESID}),
c as (select model, z, count(*) as n from z group by all),
p as (select model, z, n, (sum(n) over (partition by model order by z) - n + (n + 1) / 2.0) / (sum(n) over (partition by model) + 1)::double as p from c)
select model, z as std_residual, n, round({inverse_normal_sql('p')}, 6) as theoretical from p""")
def eval_qq(spark, d):
    z = V.residuals(regression(spark, d)).withColumn("std_residual", F.round("std_residual", 3))
    return V.qq_of(z, "std_residual").withColumn("theoretical", F.round("theoretical", 6))


@query("eval_pred_density", kde_sql(f"(select 'actual' as label, model as \"column\", actual as value from {REG} union all select 'predicted', model, pred from {REG})")
       .replace("round(x, 4) as x", "round(x, 2) as x").replace(", 9) as density", ", 12) as density"))
def eval_pred_density(spark, d):
    return V.prediction_density(regression(spark, d), MODELS).select("label", "column", "i", F.round("x", 2).alias("x"), F.round("density", 12).alias("density"))


@query("eval_proba_hist", f"""
with o as (select model, class, proba from {OOF} where actual = class), e as (select model, class, min(proba) as a, (max(proba) - min(proba)) / 20 as w from o group by all),
c as (select o.model, o.class, least(floor((proba - a) / w), 19) as bin, count(*) as n from o join e on o.model = e.model and o.class = e.class group by all)
select e.model, e.class, cast(t.bin as int) as bin, round(a + t.bin * w, 6) as lo, round(a + (t.bin + 1) * w, 6) as hi, coalesce(n, 0) as n
from e cross join range(20) t(bin) left join c on c.model = e.model and c.class = e.class and c.bin = t.bin""")
def eval_proba_hist(spark, d):
    return V.proba_histogram(oof(spark, d)).withColumns({"lo": F.round("lo", 6), "hi": F.round("hi", 6)})


MEANS = f"(select id, model, class, avg(proba) as proba from {SCORED} group by id, model, class)"
MEANS_ALL = f"(select id, 'Ensembled' as model, class, avg(proba) as proba from {SCORED} group by id, class)"


def ensemble_sql(means):
    return f"(select id, model, class, proba, first_value(class) over (partition by id, model order by proba desc, class) as pred from {means})"


BOTH = f"(select * from {ensemble_sql(MEANS)} union all select * from {ensemble_sql(MEANS_ALL)})"


def ensembled(df):
    return df.withColumn("proba", F.round("proba", 8))


@query("pred_soft_ensemble", f"select id, model, class, round(proba, 8) as proba, pred from {ensemble_sql(MEANS)}")
def pred_soft_ensemble(spark, d):
    return ensembled(P.soft_ensemble(scored(spark, d), "id"))


@query("pred_ensemble_all", f"select id, model, class, round(proba, 8) as proba, pred from {ensemble_sql(MEANS_ALL)}")
def pred_ensemble_all(spark, d):
    return ensembled(P.soft_ensemble(scored(spark, d), "id", overall=True))


REG3 = regression_sql("unnest([0, 1, 2])")


@query("pred_mean_ensemble", f"select id, model, round(avg(pred), 4) as pred from {REG3} group by id, model union all select id, 'Ensembled', round(avg(pred), 4) from {REG3} group by id")
def pred_mean_ensemble(spark, d):
    preds = regression(spark, d, F.array(*[F.lit(k) for k in range(3)]))
    return P.mean_ensemble(preds, "id").withColumn("pred", F.round("pred", 4))


@query("pred_wide", "select id, " + ", ".join(
    [f"round(max(proba) filter (where model = '{m}' and class = '{c}'), 8) as {m}_status_{c}" for m in [*MODELS, "Ensembled"] for c in CLASSES]
    + [f"max(pred) filter (where model = '{m}') as {m}_status_pred" for m in [*MODELS, "Ensembled"]])
       + f", max(o_orderstatus) as status_actual from {BOTH} b join orders on id = o_orderkey group by id")
def pred_wide(spark, d):
    test = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    wide = P.wide_predictions(P.full_ensemble(scored(spark, d), "id"), "id", [*MODELS, "Ensembled"], CLASSES, "status", test)
    return wide.withColumns({f"{m}_status_{c}": F.round(f"{m}_status_{c}", 8) for m in [*MODELS, "Ensembled"] for c in CLASSES})


ENS = f"(select b.*, o_orderstatus as actual from {BOTH} b join orders on id = o_orderkey)"
ENS_AUC = auc_sql(ENS, "model, class", "actual = class", "proba")
ENS_AP = ap_sql(ENS, "model, class", "actual = class", "proba")


@query("pred_eval", f"""
select model, 'Accuracy' as metric, null as class, round(avg(cast(actual = pred as int)), 6) as value from {ENS} where class = pred group by model
union all select model, 'ROC AUC', class, round(value, 6) from {ENS_AUC} union all select model, 'ROC AUC', null, round(avg(value), 6) from {ENS_AUC} group by model
union all select model, 'Avg Precision', class, round(value, 6) from {ENS_AP} union all select model, 'Avg Precision', null, round(avg(value), 6) from {ENS_AP} group by model""")
def pred_eval(spark, d):
    test = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    out = P.evaluate_ensembles(P.full_ensemble(scored(spark, d), "id"), test, "id", "status")
    return six(out.where(F.col("metric").isin("Accuracy", "ROC AUC", "Avg Precision")))


HALF = "(select o_orderstatus, o_orderpriority, o_orderkey from orders where o_orderkey % 2 = {})"


@query("pred_data_comparison", " union all ".join(
    counts_sql(HALF.format(k), ["o_orderstatus", "o_orderpriority"], label=f"'{label}' as label, ") for k, label in ((0, "train"), (1, "test"))))
def pred_data_comparison(spark, d):
    o = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return P.data_comparison(o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 2 = 1"), min_rows=100)["value_counts"]


PRICES = " union all ".join(f"select '{label}' as label, 'o_totalprice' as \"column\", o_totalprice as value from orders where o_orderkey % 2 = {k}" for k, label in ((0, "train"), (1, "test")))


def prices(spark, d):
    o = table(spark, d, "orders").select("o_totalprice", "o_orderkey")
    return P.data_comparison(o.where("o_orderkey % 2 = 0").drop("o_orderkey"), o.where("o_orderkey % 2 = 1").drop("o_orderkey"))


@query("pred_comparison_box", f"""
with s as ({PRICES}), b as (select label, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from s group by label),
j as (select s.*, q1, median, q3, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from s join b using (label))
select label, "column", round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, count(*) as n, min(value) filter (where inside) as whisker_low,
 max(value) filter (where inside) as whisker_high, count(*) filter (where not inside) as n_fliers from j group by label, "column", j.q1, j.median, j.q3""")
def pred_comparison_box(spark, d):
    return prices(spark, d)["box"].withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("pred_comparison_density", kde_sql(f"({PRICES})").replace("round(x, 4)", "round(x, 2)"))
def pred_comparison_density(spark, d):
    return prices(spark, d)["kde"].select("label", "column", "i", F.round("x", 2).alias("x"), F.round("density", 9).alias("density"))


RANKED = f"""(select id, model, actual, rank() over (partition by model, actual order by proba desc) + (count(*) over (partition by model, actual, proba) - 1) / 2.0 as rk
 from (select id, model, actual, round(proba, 3) as proba from {OOF} where class = actual))"""


@query("ex_easy_difficult", f"""
with m as (select id, actual, avg(rk) as mean_rank from {RANKED} group by id, actual)
select id, actual, mean_rank, cast(row_number() over (partition by actual order by mean_rank, id) as bigint) as easy_position from m""")
def ex_easy_difficult(spark, d):
    out = ES.easy_difficult_classification(oof(spark, d).withColumn("proba", F.round("proba", 3)), "id")
    return out.withColumn("easy_position", F.row_number().over(W.partitionBy("actual").orderBy("mean_rank", "id")).cast("long"))


@query("ex_easy_difficult_regression", f"""
with e as (select id, model, round(abs(pred - actual), 1) as e from {REG}),
r as (select id, rank() over (partition by model order by e) + (count(*) over (partition by model, e) - 1) / 2.0 as rk from e)
select id, avg(rk) as mean_rank from r group by id""")
def ex_easy_difficult_regression(spark, d):
    preds = regression(spark, d).withColumn("error", F.round(F.abs(F.col("pred") - F.col("actual")), 1))
    return ES.mean_model_rank(preds, "id", "error", [])
