"""Queries: univariate analysis."""

from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.catalog.quality import LINEITEM_NUM
from colonnade.columns import literal_rows
from colonnade.operators import univariate as U

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df, digits, *names):
    return df.withColumns({n: F.round(n, digits) for n in names})


def cells(source, columns, extra=""):
    """SQL long form (column, value) of numeric columns."""
    return "(" + " union all ".join(f"select {extra}'{c}' as \"column\", cast({c} as double) as value from {source} x" for c in columns) + ")"


LI_VALUES = ["l_returnflag", "l_linestatus", "l_linenumber"]


def counts_sql(source, columns, label=""):
    return " union all ".join(
        f"""select {label}'{c}' as "column", cast({c} as varchar) as value, count(*) as "count",
        round(count(*) * 100.0 / (select count(*) from {source} t), 3) as pct from {source} x where {c} is not null group by {c}""" for c in columns)


@query("ua_value_columns", """
select 'l_returnflag' as "column" union all select 'l_linestatus'
union all (select 'l_linenumber' from lineitem having count(distinct l_linenumber) <= 8)
union all (select 'l_tax' from lineitem having count(distinct l_tax) <= 8)
union all (select 'l_discount' from lineitem having count(distinct l_discount) <= 8)
union all (select 'l_quantity' from lineitem having count(distinct l_quantity) <= 8)""")
def ua_value_columns(spark, d):
    names = U.value_columns(table(spark, d, "lineitem"))
    return literal_rows(spark, [(n,) for n in names], "column string")


@query("ua_value_counts", counts_sql("lineitem", LI_VALUES))
def ua_value_counts(spark, d):
    li = table(spark, d, "lineitem")
    return U.value_counts(li, U.value_columns(li))


@query("ua_value_counts_compare",
       counts_sql("(select * from lineitem where l_quantity <= 25)", LI_VALUES, label="'small' as label, ")
       + " union all " + counts_sql("(select * from lineitem where l_quantity > 25)", LI_VALUES, label="'large' as label, "))
def ua_value_counts_compare(spark, d):
    li = table(spark, d, "lineitem")
    return U.compare_value_counts({"small": li.where("l_quantity <= 25"), "large": li.where("l_quantity > 25")})


@query("ua_top_categories", """
with c as (select 'p_brand' as "column", p_brand as value, count(*) as "count" from part group by 2
 union all select 'p_name', p_name, count(*) from part group by 2
 union all select 'p_type', p_type, count(*) from part group by 2)
select * from (select *, round("count" * 100.0 / (select count(*) from part), 3) as pct,
 cast(row_number() over (partition by "column" order by "count" desc, value) as int) as rank from c) where rank <= 10""")
def ua_top_categories(spark, d):
    return U.top_categories(table(spark, d, "part"), ["p_brand", "p_name", "p_type"], 10)


@query("ua_descriptive", f"""
select "column", count(value) as n, round(avg(value), 6) as mean, round(sum(value), 2) as sum, round(var_samp(value), 4) as var, round(stddev_samp(value), 6) as std,
round(skewness(value), 6) as skew, round(kurtosis(value), 6) as kurt from {cells("lineitem", MEASURES)} group by 1""")
def ua_descriptive(spark, d):
    out = U.descriptive_statistics(table(spark, d, "lineitem"), MEASURES)
    return out.select("column", "n", F.round("mean", 6).alias("mean"), F.round("sum", 2).alias("sum"), F.round("var", 4).alias("var"),
                      *[F.round(c, 6).alias(c) for c in ("std", "skew", "kurt")])


@query("ua_quantiles", f"""
with q as (select "column", min(value) as min, quantile_cont(value, 0.05) as p05, quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median,
 quantile_cont(value, 0.75) as q3, quantile_cont(value, 0.95) as p95, max(value) as max from {cells("lineitem", LINEITEM_NUM)} group by 1)
select "column", round(min, 4) as min, round(p05, 4) as p05, round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, round(p95, 4) as p95,
 round(max, 4) as max, round(max - min, 4) as range, round(q3 - q1, 4) as iqr from q""")
def ua_quantiles(spark, d):
    return rounded(U.quantile_statistics(table(spark, d, "lineitem")), 4, "min", "p05", "q1", "median", "q3", "p95", "max", "range", "iqr")


SPLIT = f"""(select 'click' as label, * from {cells("(select * from events where event_type = 'click')", ["value", "user_id"])}
 union all select 'other' as label, * from {cells("(select * from events where event_type <> 'click')", ["value", "user_id"])})"""


def split_events(spark, d):
    ev = table(spark, d, "events")
    return {"click": ev.where("event_type = 'click'"), "other": ev.where("event_type <> 'click'")}


@query("ua_box_stats", f"""
with b as (select label, "column", quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.5) as median, quantile_cont(value, 0.75) as q3 from {SPLIT} group by 1, 2),
j as (select s.*, q1, median, q3, value between q1 - 1.5 * (q3 - q1) and q3 + 1.5 * (q3 - q1) as inside from {SPLIT} s join b on s.label = b.label and s."column" = b."column")
select label, "column", round(q1, 4) as q1, round(median, 4) as median, round(q3, 4) as q3, count(*) as n, min(value) filter (where inside) as whisker_low,
 max(value) filter (where inside) as whisker_high, count(*) filter (where not inside) as n_fliers from j group by 1, 2, j.q1, j.median, j.q3""")
def ua_box_stats(spark, d):
    return rounded(U.box_statistics(split_events(spark, d), ["value", "user_id"]), 4, "q1", "median", "q3")


def kde_sql(source, points=200):
    return f"""
with c as (select * from {source} where value is not null),
b as (select label, "column", count(*) as n, stddev_samp(value) as std, min(value) as lo, max(value) as hi, stddev_samp(value) * pow(count(*), -0.2) as h from c group by 1, 2),
g as (select b.*, i, lo - 3 * h + i * (hi - lo + 6 * h) / {points - 1} as x from b, range({points}) t(i)),
m as (select label, "column", value, count(*) as w from c group by 1, 2, 3)
select g.label, g."column", cast(i as int) as i, round(x, 4) as x, round(sum(w * exp(-0.5 * ((x - value) / h) * ((x - value) / h)) / (2.5066282746310002 * h * n)), 9) as density
from g join m on g.label = m.label and g."column" = m."column" group by 1, 2, 3, x"""


@query("ua_kde", kde_sql(SPLIT))
def ua_kde(spark, d):
    return U.kde_curves(split_events(spark, d), ["value", "user_id"]).select(
        "label", "column", "i", F.round("x", 4).alias("x"), F.round("density", 9).alias("density"))
