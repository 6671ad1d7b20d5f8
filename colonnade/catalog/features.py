"""Queries: feature engineering."""

from itertools import combinations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.operators import dictionaries as D, features as X
from colonnade.plans.features import FeatureOptions, FeaturePlan


def order_context(spark, d):
    """orders with the customer's segment and region (dimension joins)."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    return (o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select("o_orderkey", "o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name", "n_name", "o_totalprice", "c_acctbal", "o_orderdate"))


CONTEXT = """(select o_orderkey, o_orderstatus, o_orderpriority, c_mktsegment, r_name, n_name, o_totalprice, c_acctbal, o_orderdate
 from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey)"""

MATH = ["l_quantity", "l_discount", "l_tax"]


def floordiv_sql(a, b):
    rest = f"(case when {a} % {b} <> 0 and (({a} % {b} < 0) <> ({b} < 0)) then {a} % {b} + {b} else {a} % {b} end)"
    return f"floor(({a} - {rest}) / {b} + 0.5)"


def math_sql(columns):
    out = []
    for c in columns[:-1]:
        out += [(f"{c}_pow2", f"{c} * {c}"), (f"{c}_pow3", f"{c} * {c} * {c}"), (f"{c}_mul10", f"{c} * 10"), (f"{c}_mul100", f"{c} * 100")]
    for a, b in combinations(columns, 2):
        out += [(f"{a}_add_{b}", f"{a} + {b}"), (f"{a}_sub_{b}", f"{a} - {b}"), (f"{a}_subabs_{b}", f"abs({a} - {b})"), (f"{a}_mul_{b}", f"{a} * {b}")]
        for x, y in ((a, b), (b, a)):
            out += [(f"{x}_truediv_{y}", f"case when {y} <> 0 then {x} / {y} else 0::double end"), (f"{x}_floordiv_{y}", f"case when {y} <> 0 then {floordiv_sql(x, y)} else 0::double end")]
    return out


@query("fe_math", "select l_orderkey, l_linenumber, " + ", ".join(MATH) + ", " + ", ".join(f"{e} as {n}" for n, e in math_sql(MATH)) + " from lineitem")
def fe_math(spark, d):
    base = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *MATH)
    return X.math_features(base, MATH)


CATS = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "r_name"]


@query("fe_cat_pairs", f"select o_orderkey, {', '.join(CATS)}, " + ", ".join(f"{a} || '_' || {b} as {a}_data_{b}" for a, b in combinations(CATS, 2)) + f" from {CONTEXT}")
def fe_cat_pairs(spark, d):
    return X.category_pairs(order_context(spark, d).select("o_orderkey", *CATS))


def parts_sql(c, time):
    day = f"isodow({c}) - 1"
    out = (f"cast(year({c}) as int) as {c}_Year, cast(quarter({c}) as int) as {c}_Quarter, cast(month({c}) as int) as {c}_Month, cast(day({c}) as int) as {c}_Day, "
           f"cast({day} as int) as {c}_Weekday, cast({day} >= 5 as int) as {c}_IsWeekend")
    if time:
        out += f", cast(hour({c}) as int) as {c}_Hour, cast(minute({c}) as int) as {c}_Minute, cast(hour({c}) <= 6 or hour({c}) >= 18 as int) as {c}_IsNight"
    return out


@query("fe_datetime", f"select event_id, ts, {parts_sql('ts', True)} from events")
def fe_datetime(spark, d):
    df = table(spark, d, "events").select("event_id", "ts")
    return X.datetime_parts(df, ["ts"], X.fit_time_columns(df, ["ts"]))


@query("fe_datetime_constant_time", f"select o_orderkey, o_orderdate, {parts_sql('o_orderdate', False)} from orders")
def fe_datetime_constant_time(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return X.datetime_parts(df, ["o_orderdate"], X.fit_time_columns(df, ["o_orderdate"]))


@query("fe_drop_high_card", "select p_partkey, p_type, p_size, p_retailprice from part")
def fe_drop_high_card(spark, d):
    df = table(spark, d, "part")
    return df.drop(*X.fit_high_cardinality(df, 10))


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def split_orders(spark, d):
    """Fit on 'F' and 'O' orders, replay on all: status 'P' is unseen, and one priority is null."""
    df = table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", F.when(F.col("o_orderpriority") != "3-MEDIUM", F.col("o_orderpriority")).alias("o_orderpriority"))
    return df.where("o_orderstatus <> 'P'"), df


@query("fe_one_hot", """
select o_orderkey, cast(o_orderstatus = 'O' as double) as "o_orderstatus_O",
 cast(o_orderpriority = '2-HIGH' as double) as "o_orderpriority_2-HIGH", cast(o_orderpriority = '4-NOT SPECIFIED' as double) as "o_orderpriority_4-NOT SPECIFIED",
 cast(o_orderpriority = '5-LOW' as double) as "o_orderpriority_5-LOW", cast(o_orderpriority = '3-MEDIUM' as double) as "o_orderpriority_nan" from orders""")
def fe_one_hot(spark, d):
    train, full = split_orders(spark, d)
    return X.one_hot(full, X.fit_categories(train, ["o_orderstatus", "o_orderpriority"]))


@query("fe_ordinal", """
select o_orderkey, case o_orderstatus when 'F' then 0.0 when 'O' then 1.0 else -1.0 end::double as o_orderstatus,
 case o_orderpriority when '1-URGENT' then 0.0 when '2-HIGH' then 1.0 when '4-NOT SPECIFIED' then 2.0 when '5-LOW' then 3.0 else -1.0 end::double as o_orderpriority from orders""")
def fe_ordinal(spark, d):
    train, full = split_orders(spark, d)
    return X.ordinal(full, X.fit_categories(train, ["o_orderstatus", "o_orderpriority"]))


def long_keys(spark, d):
    """Up to 20,000 keys, a third of all rows under one of them, some null; fitted on 'F' and 'O' orders."""
    number = F.col("o_orderkey") % 20000
    key = F.when(F.col("o_orderkey") % 3 == 0, "hot").when(number % 7 != 0, F.concat(F.lit("K"), number.cast("string")))
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus", key.alias("key"))
    return df.where("o_orderstatus <> 'P'").drop("o_orderstatus"), df.drop("o_orderstatus")


LONG_KEYS = """orders_keyed as (select o_orderkey, o_orderstatus, case when o_orderkey % 3 = 0 then 'hot' when o_orderkey % 20000 % 7 <> 0 then 'K' || (o_orderkey % 20000) end as key from orders),
 fitted as (select * from orders_keyed where o_orderstatus <> 'P'), places as (select key, row_number() over (order by key) - 1 as place from (select distinct key from fitted where key is not null)),
 size as (select (select count(*) from places) as known, (select cast(count(*) > 0 as int) from fitted where key is null) as holes),
 placed as (select o_orderkey, o.key, case when o.key is null and holes = 1 then known else place end as place, known, known + holes as total from orders_keyed o cross join size left join places p on o.key = p.key)"""


def sparse_entries(vector):
    """What a sparse vector holds, without making it dense."""
    held = F.udf(lambda v: (int(v.size), [int(i) for i in v.indices], float(v.values.sum())), "size long, entries array<long>, total double")
    return held(vector)


@query("fe_one_hot_long", f"""with {LONG_KEYS}
select o_orderkey, total - 1 as size, case when place >= 1 then [place - 1] else [] end::bigint[] as entries, case when place >= 1 then 1.0::double else 0 end as total from placed""")
def fe_one_hot_long(spark, d):
    train, full = long_keys(spark, d)
    coded = D.one_hot_vectors(full, D.fit_dictionary(train, ["key"]), ["key"])
    return coded.select("o_orderkey", sparse_entries("key_onehot").alias("v")).select("o_orderkey", "v.*")


@query("fe_ordinal_long", f"with {LONG_KEYS} select o_orderkey, case when key is null then -1.0 else coalesce(place, -1) end::double as key from placed")
def fe_ordinal_long(spark, d):
    train, full = long_keys(spark, d)
    return D.ordinal_codes(full, D.fit_dictionary(train, ["key"]), ["key"])


@query("fe_label_long", f"with {LONG_KEYS} select o_orderkey, key, case when key is not null then place end::double as label, case when place is not null then key end as decoded from placed")
def fe_label_long(spark, d):
    train, full = long_keys(spark, d)
    known = D.fit_dictionary(train, ["key"], null_category=False)
    return D.label_names(D.label_codes(full, known, "key"), known, "key", "label", "decoded")


@query("fe_missing_category", "select o_orderkey, o_orderstatus, case when o_orderpriority = '3-MEDIUM' then 'Missing' else o_orderpriority end as o_orderpriority from orders")
def fe_missing_category(spark, d):
    return X.missing_category(split_orders(spark, d)[1], ["o_orderstatus", "o_orderpriority"])


@query("fe_rename", "select o_orderkey as order_key, o_totalprice as total_price_USD_, o_orderstatus as o_status from orders")
def fe_rename(spark, d):
    df = table(spark, d, "orders")
    return X.rename_safe(df.select(F.col("o_orderkey").alias("order key"), F.col("o_totalprice").alias("total price (USD)"), F.col("o_orderstatus").alias("o/status")))


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("fe_standard_scale", "select l_orderkey, l_linenumber, " + ", ".join(
    f"round(({c} - (select avg({c}) from lineitem)) / (select stddev_pop({c}) from lineitem), 5) as {c}" for c in NUMS) + " from lineitem")
def fe_standard_scale(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", *NUMS)
    return X.standard_scale(df, X.fit_scaler(df, NUMS)).withColumns({c: F.round(c, 5) for c in NUMS})


@query("fe_label_encode", """
select o_orderkey, o_orderstatus, case o_orderstatus when 'F' then 0 when 'O' then 1 else 2 end::double as label, o_orderstatus as decoded from orders""")
def fe_label_encode(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    classes = X.fit_labels(df, "o_orderstatus")
    return X.encode_label(df, "o_orderstatus", classes).withColumn("decoded", X.decode_label(F.col("label"), classes))


@query("fe_balanced_weight", """
with c as (select event_type, count(*) as k from events group by 1), w as (select event_type, (select count(*) from events) / (5.0 * k) as w from c)
select e.event_id, e.event_type, round(w, 6) as weight, cast(floor(w / (select min(w) from w) * 100) as double) as weight_int from events e join w using (event_type)""")
def fe_balanced_weight(spark, d):
    df = table(spark, d, "events").select("event_id", "event_type")
    out = X.with_class_weight(df, "event_type", X.fit_class_weights(df, "event_type"))
    out = X.with_class_weight(out, "event_type", X.fit_class_weights(df, "event_type", integer=True), "weight_int")
    return out.withColumn("weight", F.round("weight", 6))


PIPE = ["o_orderpriority_2_HIGH", "o_orderpriority_3_MEDIUM", "o_orderpriority_4_NOT_SPECIFIED", "o_orderpriority_5_LOW",
        "c_mktsegment_BUILDING", "c_mktsegment_FURNITURE", "c_mktsegment_HOUSEHOLD", "c_mktsegment_MACHINERY"]


def pipe_sql():
    raw = f"""(select o_orderkey, o_orderstatus, o_totalprice, c_acctbal, year(o_orderdate) as o_orderdate_Year, quarter(o_orderdate) as o_orderdate_Quarter,
 month(o_orderdate) as o_orderdate_Month, day(o_orderdate) as o_orderdate_Day, isodow(o_orderdate) - 1 as o_orderdate_Weekday, cast(isodow(o_orderdate) >= 6 as int) as o_orderdate_IsWeekend,
 """ + ", ".join([f"cast(o_orderpriority = '{p}' as double) as {X.safe_name('o_orderpriority_' + p)}" for p in PRIORITIES[1:]]
                 + [f"cast(c_mktsegment = '{s}' as double) as c_mktsegment_{s}" for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")]) + f" from {CONTEXT})"
    names = ["o_totalprice", "c_acctbal"] + [f"o_orderdate_{p}" for p in ("Year", "Quarter", "Month", "Day", "Weekday", "IsWeekend")] + PIPE
    fit = "(select " + ", ".join(f"avg({c}) as m{i}, stddev_pop({c}) as s{i}" for i, c in enumerate(names)) + f" from {raw} where o_orderkey % 5 <> 0)"
    return names, f"select o_orderkey, o_orderstatus, " + ", ".join(f"round(({c} - m{i}) / (case when s{i} = 0 then 1 else s{i} end), 5) as {c}" for i, c in enumerate(names)) + f" from {raw} r, {fit} f where o_orderkey % 5 = 0"


PIPE_NAMES, PIPE_SQL = pipe_sql()


@query("fe_pipeline_replay", PIPE_SQL)
def fe_pipeline_replay(spark, d):
    df = order_context(spark, d).drop("r_name")
    plan = FeaturePlan.fit(df.where("o_orderkey % 5 <> 0"), FeatureOptions("o_orderkey", "o_orderstatus", max_cat_unique=10, scale=True))
    out = plan.transform(df.where("o_orderkey % 5 = 0"))
    return out.withColumns({c: F.round(c, 5) for c in plan.features})


@query("fe_assemble", "select o_orderkey, o_orderstatus, [o_totalprice, c_acctbal] as features from " + CONTEXT)
def fe_assemble(spark, d):
    df = order_context(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice", "c_acctbal")
    return X.assemble(df, ["o_orderkey", "o_orderstatus"]).withColumn("features", vector_to_array("features"))
