"""Queries: bivariate analysis."""

from itertools import combinations

from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.catalog.features import CONTEXT, PRIORITIES, order_context, parts_sql
from colonnade.catalog.predictions import inverse_normal_sql
from colonnade.catalog.univariate import kde_sql
from colonnade.functions.distributions import chi2_sf, f_sf
from colonnade.operators import association as A, correlation as K, features as X
from colonnade.operators.univariate import kde_from_cells

NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
PAIRS = list(combinations(NUMS, 2))


def lineitem(spark, d):
    return table(spark, d, "lineitem").select(*NUMS)


def digits(df, n, *names):
    return df.withColumns({c: F.round(c, n) for c in names})


@query("ba_binary_to_numeric", "select l_quantity, l_returnflag, cast(l_linestatus = 'O' as int) as l_linestatus_O from lineitem")
def ba_binary_to_numeric(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_returnflag", "l_linestatus")
    return K.binary_to_numeric(df, K.fit_binary_categories(df))


DAY_NAMES = "['Mon', 'Tues', 'Wed', 'Thurs', 'Fri', 'Sat', 'Sun'][isodow(ts)]"


@query("ba_datetime_parts", "select event_id, ts, " + parts_sql("ts", True).replace("cast(isodow(ts) - 1 as int) as ts_Weekday", DAY_NAMES + " as ts_Weekday") + " from events")
def ba_datetime_parts(spark, d):
    df = table(spark, d, "events").select("event_id", "ts")
    return X.datetime_parts(df, ["ts"], X.fit_time_columns(df, ["ts"]), weekday_names=True)


MATRIX = [("o_totalprice", "o_totalprice"), ("o_orderstatus_O", "cast(o_orderstatus = 'O' as int)"), ("o_orderstatus_P", "cast(o_orderstatus = 'P' as int)")] + [
    (f"o_orderpriority_{p}", f"cast(o_orderpriority = '{p}' as int)") for p in PRIORITIES[1:]]


@query("ba_prepare_matrix", "with m as (select " + ", ".join(f'{e} as "{n}"' for n, e in MATRIX) + " from orders), s as (select "
       + ", ".join(f'avg("{n}") as m{i}, stddev_pop("{n}") as s{i}' for i, (n, _) in enumerate(MATRIX)) + " from m) select "
       + ", ".join(f'round(("{n}" - m{i}) / s{i}, 5) as "{n}"' for i, (n, _) in enumerate(MATRIX)) + " from m, s")
def ba_prepare_matrix(spark, d):
    out = K.prepare_matrix(table(spark, d, "orders").select("o_totalprice", "o_orderstatus", "o_orderpriority"))
    return out.select(*[F.round(f"`{c}`", 5).alias(c) for c in out.columns])


def corr_sql(pairs, source, name, x="{}"):
    return " union all ".join(f"select '{a}' as column_1, '{b}' as column_2, round(corr({x.format(a)}, {x.format(b)}), 6) as {name} from {source} t" for a, b in pairs)


def ranks_sql(columns, source):
    return "(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c}) - 1) / 2.0 as {c}" for c in columns) + f" from {source})"


HOLED = "(select l_quantity, l_discount, case when l_quantity > 45 then null else l_tax end as l_tax, l_extendedprice from lineitem)"


@query("ba_pearson", corr_sql(PAIRS, HOLED, "pearson"))
def ba_pearson(spark, d):
    df = lineitem(spark, d).withColumn("l_tax", F.when(F.col("l_quantity") <= 45, F.col("l_tax")))
    return digits(K.correlation_long(df, ["pearson"]), 6, "pearson")


@query("ba_spearman", corr_sql(PAIRS, ranks_sql(NUMS, "lineitem"), "spearman"))
def ba_spearman(spark, d):
    return digits(K.correlation_long(lineitem(spark, d), ["spearman"]), 6, "spearman")


def tau_sql(a, b, source):
    return f"""select '{a}' as column_1, '{b}' as column_2, round(s / sqrt((n0 - tx) * (n0 - ty)), 6) as kendall from
 (select sum(p.n::double * q.n * sign(p.x - q.x) * sign(p.y - q.y)) / 2 as s from (select {a} as x, {b} as y, count(*) as n from {source} group by all) p,
   (select {a} as x, {b} as y, count(*) as n from {source} group by all) q),
 (select count(*) * (count(*) - 1) / 2.0 as n0 from {source}),
 (select sum(n * (n - 1) / 2.0) as tx from (select count(*) as n from {source} group by {a})), (select sum(n * (n - 1) / 2.0) as ty from (select count(*) as n from {source} group by {b}))"""


LOW = ["l_quantity", "l_discount", "l_tax"]


@query("ba_kendall", " union all ".join(tau_sql(a, b, "lineitem") for a, b in combinations(LOW, 2)))
def ba_kendall(spark, d):
    return digits(K.correlation_long(table(spark, d, "lineitem").select(*LOW), ["kendall"]), 6, "kendall")


@query("ba_kendall_continuous", tau_sql("value", "user_id", "events"))
def ba_kendall_continuous(spark, d):
    return digits(K.correlation_long(table(spark, d, "events").select("value", "user_id"), ["kendall"]), 6, "kendall")


LONG = f"""(select p.column_1, p.column_2, pearson, spearman, kendall from ({corr_sql(list(combinations(LOW, 2)), 'lineitem', 'pearson')}) p
 join ({corr_sql(list(combinations(LOW, 2)), ranks_sql(LOW, 'lineitem'), 'spearman')}) s on p.column_1 = s.column_1 and p.column_2 = s.column_2
 join ({' union all '.join(tau_sql(a, b, 'lineitem') for a, b in combinations(LOW, 2))}) k on p.column_1 = k.column_1 and p.column_2 = k.column_2)"""


@query("ba_corr_long", f"select * from {LONG}")
def ba_corr_long(spark, d):
    long, _ = K.correlation_analysis(table(spark, d, "lineitem").select(*LOW))
    return digits(long, 6, "pearson", "spearman", "kendall")


ONE_HOT = [("l_quantity", "l_quantity"), ("gross", "l_quantity * 3 - l_discount"), ("minus", "l_tax - l_quantity"), ("l_discount", "l_discount")]
ONE_HOT_SOURCE = "(select " + ", ".join(f"{e} as {n}" for n, e in ONE_HOT) + " from lineitem)"


@query("ba_strong_weak", f"""
with c as ({corr_sql(list(combinations([n for n, _ in ONE_HOT], 2)), ONE_HOT_SOURCE, 'value')}),
k as (select 'positive' as kind, * from c where value >= 0.6 union all select 'negative', * from c where value <= -0.6 union all select 'weak', * from c where value between -0.1 and 0.1)
select kind, column_1, column_2, value, cast(row_number() over (partition by kind order by case when kind = 'weak' then abs(value) else -abs(value) end, column_1, column_2) as int) as position from k""")
def ba_strong_weak(spark, d):
    li = table(spark, d, "lineitem")
    df = li.select("l_quantity", (F.col("l_quantity") * 3 - F.col("l_discount")).alias("gross"), (F.col("l_tax") - F.col("l_quantity")).alias("minus"), "l_discount", "l_returnflag")
    long, generated = K.correlation_analysis(df, ["pearson"])
    return K.strong_weak(digits(long, 6, "pearson"), generated)


@query("ba_corr_series", f"""
with s as ({corr_sql([('l_quantity', c) for c in NUMS[1:]], 'lineitem', 'pearson')}), r as ({corr_sql([('l_quantity', c) for c in NUMS[1:]], ranks_sql(NUMS, 'lineitem'), 'spearman')})
select s.column_1, s.column_2, pearson, spearman from s join r on s.column_2 = r.column_2""")
def ba_corr_series(spark, d):
    return digits(K.correlation_series(lineitem(spark, d), "l_quantity", methods=["pearson", "spearman"]), 6, "pearson", "spearman")


@query("ba_scatter_sample", """
select 'l_discount' as column_1, 'l_tax' as column_2, l_discount as x, l_tax as y, count(*) as n from lineitem group by all
union all select 'l_quantity', 'l_discount', l_quantity, l_discount, count(*) from lineitem group by all""")
def ba_scatter_sample(spark, d):
    return K.scatter_points(lineitem(spark, d), [("l_discount", "l_tax"), ("l_quantity", "l_discount")])


@query("ba_eligible_groups", """
with c as (select 'o_orderpriority' as cat_column, o_orderpriority as "group", count(*) as n from orders group by 2 having count(*) >= 1000 order by n desc, "group" limit 5)
select * from c where (select count(*) from c) >= 2""")
def ba_eligible_groups(spark, d):
    return A.eligible_groups(table(spark, d, "orders"), "o_orderpriority", sample_size=50)


SAMPLE_NUMS = ["o_totalprice", "o_custkey"]
BATCHES = """(select "group", batch, avg(o_totalprice) as o_totalprice, avg(o_custkey) as o_custkey from
 (select o_orderpriority as "group", o_totalprice, o_custkey, (row_number() over (partition by o_orderpriority order by md5(concat(o_orderkey, '-42')), o_orderkey) - 1) // 50 as batch,
   count(*) over (partition by o_orderpriority) as n from orders) where batch < n // 50 and n >= 1000 group by all)"""
MEANS = "(" + " union all ".join(f"select 'o_orderpriority' as cat_column, '{c}' as num_column, \"group\", batch, {c} as mean from {BATCHES}" for c in SAMPLE_NUMS) + ")"
BY = "cat_column, num_column"


def means(spark, d):
    return A.sample_means(table(spark, d, "orders"), "o_orderkey", "o_orderpriority", SAMPLE_NUMS, sample_size=50)


@query("ba_sample_means", f"select {BY}, \"group\", cast(batch as bigint) as batch, round(mean, 4) as mean from {MEANS}")
def ba_sample_means(spark, d):
    return digits(means(spark, d), 4, "mean")


def poly_sql(coefficients, x):
    total = repr(float(coefficients[-1]))
    for c in reversed(coefficients[:-1]):
        total = f"({total} * {x} + ({float(c)!r}))"
    return total


SHAPIRO = f"""
with o as (select {BY}, "group", mean as x, row_number() over (partition by {BY}, "group" order by mean) as i, count(*) over (partition by {BY}, "group") as n from {MEANS}),
p as (select *, (i - 0.375) / (n + 0.25) as p from o), m as (select *, {inverse_normal_sql('p')} as m from p),
g as (select {BY}, "group", max(n) as n, sum(m * m) as mm, max(m) filter (where i = n) as m1, max(m) filter (where i = n - 1) as m2, var_pop(x) * count(*) as ss, 1 / sqrt(max(n)) as r from m group by all),
a as (select *, {poly_sql(A.LAST_WEIGHT, 'r')} + m1 / sqrt(mm) as a1, {poly_sql(A.NEXT_WEIGHT, 'r')} + m2 / sqrt(mm) as a2 from g),
f as (select *, sqrt((mm - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)) as fac from a)
select m.cat_column, m.num_column, m."group", f.n, round(pow(sum(x * case when i = m.n then a1 when i = 1 then -a1 when i = m.n - 1 then a2 when i = 2 then -a2 else m / fac end), 2) / max(ss), 6) as w
from m join f on m.num_column = f.num_column and m."group" = f."group" group by all"""


@query("ba_shapiro", SHAPIRO)
def ba_shapiro(spark, d):
    return A.shapiro_wilk(means(spark, d)).select(*A.PAIR, "group", "n", F.round("w", 6).alias("w"))


def one_way_sql(source, value):
    return f"""(with s as (select {BY}, "group", count({value}) as n, avg({value}) as m, var_pop({value}) as v from {source} group by all),
 t as (select *, sum(n * m) over (partition by {BY}) / sum(n) over (partition by {BY}) as g from s)
 select {BY}, count(*) as k, sum(n) as n, sum(n * (m - g) * (m - g)) as ssb, sum(n * v) as ssw from t group by all)"""


DEVIATIONS = f'(select *, abs(mean - avg(mean) over (partition by {BY}, "group")) as dev from {MEANS})'


@query("ba_levene_stat", f"select {BY}, round((ssb / (k - 1)) / (ssw / (n - k)), 5) as levene, cast(k - 1 as double) as df1, cast(n - k as double) as df2 from {one_way_sql(DEVIATIONS, 'dev')}")
def ba_levene_stat(spark, d):
    return digits(A.levene(means(spark, d)), 5, "levene")


@query("ba_anova", f"select {BY}, round((ssb / (k - 1)) / (ssw / (n - k)), 5) as f, round(ssb / (ssb + ssw), 6) as eta2 from {one_way_sql(MEANS, 'mean')}")
def ba_anova(spark, d):
    return A.one_way(means(spark, d), "mean").select(*A.PAIR, F.round("f", 5).alias("f"), F.round("eta2", 6).alias("eta2"))


@query("ba_welch_anova", f"""
with s as (select {BY}, "group", count(*) as n, avg(mean) as m, count(*) / var_samp(mean) as w from {MEANS} group by all),
t as (select *, sum(w) over (partition by {BY}) as ws, sum(w * m) over (partition by {BY}) / sum(w) over (partition by {BY}) as g from s),
u as (select {BY}, count(*)::double as k, sum(w * (m - g) * (m - g)) as b, sum((1 - w / ws) * (1 - w / ws) / (n - 1)) as lam from t group by all)
select {BY}, round((b / (k - 1)) / (1 + 2 * (k - 2) / (k * k - 1) * lam), 5) as welch_f, k - 1 as df1, round((k * k - 1) / (3 * lam), 4) as df2 from u""")
def ba_welch_anova(spark, d):
    return A.welch_anova(means(spark, d)).withColumns({"welch_f": F.round("welch_f", 5), "df2": F.round("df2", 4)})


@query("ba_group_density", kde_sql(f'(select "group" as label, num_column as "column", mean as value from {MEANS})').replace("round(x, 4) as x", "round(x, 3) as x"))
def ba_group_density(spark, d):
    cells = means(spark, d).select(F.col("group").alias("label"), F.col("num_column").alias("column"), F.col("mean").alias("value"))
    return kde_from_cells(cells).select("label", "column", "i", F.round("x", 3).alias("x"), F.round("density", 9).alias("density"))


@query("ba_num_cat_summary")
def ba_num_cat_summary(spark, d):
    return A.numeric_by_category(table(spark, d, "orders"), "o_orderkey", ["o_orderpriority", "o_orderstatus"], SAMPLE_NUMS, sample_size=50)


CROSS = "(select 'l_returnflag' as column_1, 'l_linestatus' as column_2, l_returnflag as a, l_linestatus as b, count(*) as n from lineitem group by all)"


@query("ba_crosstab", f"select column_1, column_2, a, b, n from {CROSS}")
def ba_crosstab(spark, d):
    return A.crosstab(table(spark, d, "lineitem"), [("l_returnflag", "l_linestatus")]).drop("pct")


@query("ba_crosstab_pct", f"select column_1, column_2, a, b, round(n * 100.0 / sum(n) over (partition by a), 6) as pct from {CROSS}")
def ba_crosstab_pct(spark, d):
    return digits(A.crosstab(table(spark, d, "lineitem"), [("l_returnflag", "l_linestatus")]).drop("n"), 6, "pct")


def binary_labels(spark, d):
    return table(spark, d, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))


LABELS = "(select cast(quality as varchar) as quality, cast(toxic as varchar) as toxic from labels)"
CAT_PAIRS = [("o_orderstatus", "o_orderpriority"), ("o_orderstatus", "c_mktsegment"), ("o_orderpriority", "r_name")]


def grid_sql(a, b, source):
    return f"""(with c as (select {a} as a, {b} as b, count(*) as n from {source} group by all), x as (select a, sum(n) as na from c group by a), y as (select b, sum(n) as nb from c group by b),
 t as (select sum(n) as t, count(distinct a) as r, count(distinct b) as k from c)
 select '{a}' as column_1, '{b}' as column_2, x.a, y.b, coalesce(n, 0) as n, na * nb / t::double as e, r, k, t from x cross join y cross join t left join c on c.a = x.a and c.b = y.b)"""


GRIDS = "(" + " union all ".join([f"select * from {grid_sql(a, b, CONTEXT)}" for a, b in CAT_PAIRS] + [f"select * from {grid_sql('quality', 'toxic', LABELS)}"]) + ")"


def both(spark, d, fn):
    ctx = order_context(spark, d)
    return fn(ctx, CAT_PAIRS).unionByName(fn(binary_labels(spark, d), [("quality", "toxic")]))


@query("ba_chi_square", f"""
select column_1, column_2, round(sum(case when (r - 1) * (k - 1) = 1 then (abs(n - e) - least(0.5, abs(n - e))) ** 2 else (n - e) ** 2 end / e), 5) as chi2, cast((r - 1) * (k - 1) as int) as dof
from {GRIDS} group by column_1, column_2, r, k""")
def ba_chi_square(spark, d):
    return both(spark, d, A.chi_square).select(*A.CATS, F.round("chi2", 5).alias("chi2"), "dof")


@query("ba_expected_cells", f"select column_1, column_2, round(avg(cast(e >= 5 as int)) * 100, 4) as expected_pct, count(*) filter (where e < 1) as below_one from {GRIDS} group by column_1, column_2")
def ba_expected_cells(spark, d):
    return both(spark, d, A.chi_square).select(*A.CATS, F.round("expected_pct", 4).alias("expected_pct"), "below_one")


@query("ba_phi", f"""
with c as (select count(*) filter (where quality = '0' and toxic = '0')::double as p, count(*) filter (where quality = '0' and toxic = '1')::double as q,
 count(*) filter (where quality = '1' and toxic = '0')::double as s, count(*) filter (where quality = '1' and toxic = '1')::double as t from {LABELS})
select 'quality' as column_1, 'toxic' as column_2, round((p * t - q * s) / sqrt((p + q) * (s + t) * (p + s) * (q + t)), 6) as phi from c""")
def ba_phi(spark, d):
    return digits(A.phi_coefficient(binary_labels(spark, d), [("quality", "toxic")]), 6, "phi")


V_SQL = " union all ".join(
    f"select column_1, column_2, round(sqrt(sum((n - e) ** 2 / e) / (select count(*) from orders) / (least(max(r), max(k)) - 1)), 6) as {{}} from {grid_sql(a, b, CONTEXT)} group by all"
    for a, b in combinations(["o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"], 2))


@query("ba_cramers_v", V_SQL.replace("{}", "cramers_v"))
def ba_cramers_v(spark, d):
    df = order_context(spark, d).drop("n_name")
    return A.category_by_category(df).select(*A.CATS, F.round("cramers_v", 6).alias("cramers_v"))


@query("ba_top_associations", f"""
select *, cast(row_number() over (order by abs(value) desc, column_1, column_2) as int) as position from ({V_SQL.replace('{}', 'value')}) qualify position <= 4""")
def ba_top_associations(spark, d):
    verdicts = A.category_by_category(order_context(spark, d).drop("n_name")).withColumn("cramers_v", F.round("cramers_v", 6))
    return A.top_associations(verdicts, "cramers_v", 4)


# Tails that have a closed form: chi-squared with 2 and 4 degrees of freedom, F with 2 above or 2 below.
TAIL = "(select o_orderkey, o_totalprice / 50000 as x, (o_orderkey % 60 + 1)::double as k from orders)"


@query("fn_tail_probabilities", f"""
select o_orderkey, round(exp(-x / 2), 9) as chi2_two, round(exp(-x / 2) * (1 + x / 2), 9) as chi2_four, round(pow(1 + 2 * x / k, -k / 2), 9) as f_two_k, round(1 - sqrt(x / (x + 2)), 9) as f_one_two from {TAIL}""")
def fn_tail_probabilities(spark, d):
    """The p-values that the tests of association report, over many statistics and degrees of freedom."""
    rows = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 50000).alias("x"), (F.col("o_orderkey") % 60 + 1).cast("double").alias("k"))
    two, four, one, x = F.lit(2.0), F.lit(4.0), F.lit(1.0), F.col("x")
    tails = {"chi2_two": chi2_sf(x, two), "chi2_four": chi2_sf(x, four), "f_two_k": f_sf(x, two, F.col("k")), "f_one_two": f_sf(x, one, two)}
    return rows.select("o_orderkey", *[F.round(e, 9).alias(n) for n, e in tails.items()])
