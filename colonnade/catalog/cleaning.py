"""Queries: cleaning, sampling and fold assignment."""

from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.catalog.quality import LINE, REPEATED, repeated_lines
from colonnade.catalog.quality import DOCS_LABELLED, docs_labelled
from colonnade.columns import literal_rows
from colonnade.operators import cleaning as C, splitting as S
from colonnade.plans.cleaning import CleaningOptions, CleaningPlan


def orders(spark, d):
    return table(spark, d, "orders")


def wide_orders(spark, d):
    return orders(spark, d).withColumn("flat", F.lit(1))


WIDE_ORDERS = "(select *, 1 as flat from orders)"


@query("clean_drop_unique", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, flat from " + WIDE_ORDERS)
def clean_drop_unique(spark, d):
    df = wide_orders(spark, d).withColumn("copy_key", F.col("o_orderkey") * 2)
    return df.drop(*C.fit_unique_columns(df, ["o_orderkey", "o_totalprice"]))


@query("clean_drop_constant", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders")
def clean_drop_constant(spark, d):
    df = wide_orders(spark, d)
    return df.drop(*C.fit_constant_columns(df, ["o_orderkey"]))


@query("clean_drop_dups", "select distinct l_quantity, l_discount, l_tax, l_returnflag from lineitem")
def clean_drop_dups(spark, d):
    return C.drop_duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("clean_drop_dups_all", f"select distinct {LINE} from {REPEATED}")
def clean_drop_dups_all(spark, d):
    return C.drop_duplicate_rows(repeated_lines(spark, d))


@query("clean_merge_dups", "select max(doc_id) as doc_id, text, lang, source, round(avg(n_chars), 6) as n_chars from documents group by text, lang, source")
def clean_merge_dups(spark, d):
    return C.merge_duplicates(table(spark, d, "documents"), "doc_id", "n_chars").withColumn("n_chars", F.round("n_chars", 6))


@query("clean_merge_dups_mode", """
with c as (select l_quantity, l_discount, l_returnflag, count(*) as n, max(l_orderkey) as k from lineitem group by all),
r as (select *, row_number() over (partition by l_quantity, l_discount order by n desc, l_returnflag) as rn, max(k) over (partition by l_quantity, l_discount) as mk from c)
select mk as l_orderkey, l_quantity, l_discount, l_returnflag from r where rn = 1""")
def clean_merge_dups_mode(spark, d):
    df = table(spark, d, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_returnflag")
    return C.merge_duplicates(df, "l_orderkey", "l_returnflag")


def labels_37(spark, d):
    return table(spark, d, "labels").withColumn("score", F.when(F.col("quality") == 1, 7).otherwise(3))


@query("clean_num_to_bin", "select doc_id, quality = 1 as quality, toxic = 1 as toxic, quality = 1 as score_7 from labels")
def clean_num_to_bin(spark, d):
    df = labels_37(spark, d)
    return C.numbers_to_binary(df, C.fit_binary_numbers(df, ["doc_id"]))


@query("clean_num_to_bin_replay", "select doc_id, quality = 1 as quality, toxic = 1 as toxic, quality = 1 as score_7 from labels where doc_id % 2 = 1")
def clean_num_to_bin_replay(spark, d):
    df = labels_37(spark, d)
    fitted = C.fit_binary_numbers(df.where("doc_id % 2 = 0"), ["doc_id"])
    return C.numbers_to_binary(df.where("doc_id % 2 = 1"), fitted)


@query("clean_num_to_cat", "select p_partkey, cast(p_size as varchar) as p_size, p_type from part")
def clean_num_to_cat(spark, d):
    return C.numbers_to_category(table(spark, d, "part").select("p_partkey", "p_size", "p_type"), ["p_size"])


@query("clean_str_to_datetime", "select o_orderkey, o_orderdate as day_text, o_orderpriority from orders")
def clean_str_to_datetime(spark, d):
    df = orders(spark, d).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day_text"), "o_orderpriority")
    return C.strings_to_datetime(df, C.fit_date_strings(df))


@query("clean_drop_null_cols", f"select doc_id, lang, source, n_chars from {DOCS_LABELLED}")
def clean_drop_null_cols(spark, d):
    df = docs_labelled(spark, d)
    return df.drop(*C.fit_null_columns(df))


@query("clean_drop_null_rows", f"select * from {DOCS_LABELLED} where quality is not null and toxic is not null")
def clean_drop_null_rows(spark, d):
    return C.drop_null_rows(docs_labelled(spark, d))


HOLES = """(select doc_id, case when n_chars % 7 = 0 then null else n_chars end as n_chars, case when quality is null then null when quality = 1 then 'good' else 'bad' end as grade,
 toxic = 1 as toxic from """ + DOCS_LABELLED + ")"


def holes(spark, d):
    return docs_labelled(spark, d).select(
        "doc_id", F.when(F.col("n_chars") % 7 != 0, F.col("n_chars")).alias("n_chars"),
        F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "bad").alias("grade"), (F.col("toxic") == 1).alias("toxic"))


def impute_sql(how, train="1=1", test="1=1"):
    mode = lambda c: f"(select {c} from {HOLES} where {c} is not null and {train} group by {c} order by count(*) desc, {c} limit 1)"
    return f"""select doc_id, round(coalesce(n_chars, (select {how}(n_chars) from {HOLES} where {train})), 6) as n_chars,
 coalesce(grade, {mode('grade')}) as grade, coalesce(toxic, {mode('toxic')}) as toxic from {HOLES} where {test}"""


@query("clean_impute_mean", impute_sql("avg"))
def clean_impute_mean(spark, d):
    df = holes(spark, d)
    return C.impute(df, C.fit_imputation(df, "mean")).withColumn("n_chars", F.round("n_chars", 6))


@query("clean_impute_median", impute_sql("median"))
def clean_impute_median(spark, d):
    df = holes(spark, d)
    return C.impute(df, C.fit_imputation(df, "median")).withColumn("n_chars", F.round("n_chars", 6))


@query("clean_impute_mode", f"""
select * from (select 'grade' as "column", grade as fill from {HOLES} where grade is not null group by grade order by count(*) desc, grade limit 1)
union all select * from (select 'toxic', cast(toxic as varchar) from {HOLES} where toxic is not null group by toxic order by count(*) desc, toxic limit 1)""")
def clean_impute_mode(spark, d):
    fills = C.fit_imputation(holes(spark, d).select("grade", "toxic"))
    return literal_rows(spark, [(c, str(v).lower() if isinstance(v, bool) else v) for c, v in fills.items()], "column string, fill string")


@query("clean_impute_replay", impute_sql("avg", "doc_id % 2 = 0", "doc_id % 2 = 1"))
def clean_impute_replay(spark, d):
    df = holes(spark, d)
    fills = C.fit_imputation(df.where("doc_id % 2 = 0"), "mean")
    return C.impute(df.where("doc_id % 2 = 1"), fills).withColumn("n_chars", F.round("n_chars", 6))


@query("clean_align_columns", "select c_custkey, c_mktsegment, c_acctbal from customer")
def clean_align_columns(spark, d):
    return C.align_columns(table(spark, d, "customer"), ["c_custkey", "c_mktsegment", "c_acctbal", "label"], optional=["label"])


def md5_rank(by, source="orders", key="o_orderkey"):
    part = f"partition by {by} " if by else ""
    return f"row_number() over ({part}order by md5(concat({key}, '-42')), {key})"


@query("sample_random", f"""
select o_orderkey, o_totalprice from (select *, {md5_rank('')} as r, count(*) over () as n from orders) where r <= round(least(1.0, 3000.0 / n) * n)""")
def sample_random(spark, d):
    return C.random_sample(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_orderkey", 3000)


@query("sample_stratified", f"""
select o_orderkey, o_orderstatus, o_totalprice from (select *, {md5_rank('o_orderstatus')} as r, count(*) over (partition by o_orderstatus) as g, count(*) over () as n from orders)
where r <= round(least(1.0, 3000.0 / n) * g)""")
def sample_stratified(spark, d):
    return C.stratified_sample(orders(spark, d).select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 3000, "o_orderstatus")


def qcut_sql(column, source, q):
    edges = f"(select list_sort(list_distinct(quantile_cont({column}, [{', '.join(str(i / q) for i in range(q + 1))}]))) from {source})"
    return f"(select *, cast(len(list_filter(({edges})[2:-2], lambda e: {column} > e)) as int) as bin from {source})"


ORDERS_BINNED = qcut_sql("o_totalprice", "orders", 10)


@query("sample_stratified_numeric", f"""
select o_orderkey, o_totalprice from (select *, {md5_rank('bin')} as r, count(*) over (partition by bin) as g, count(*) over () as n from {ORDERS_BINNED})
where r <= round(least(1.0, 3000.0 / n) * g)""")
def sample_stratified_numeric(spark, d):
    return C.stratified_sample(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_orderkey", 3000, "o_totalprice")


@query("assign_row_id", "select row_number() over (order by ts, event_id) - 1 as id, event_id, user_id from events")
def assign_row_id(spark, d):
    return C.row_index(table(spark, d, "events"), ["ts", "event_id"]).select("id", "event_id", "user_id")


@query("qcut_bins", f"select o_orderkey, o_totalprice, bin from {ORDERS_BINNED}")
def qcut_bins(spark, d):
    return S.quantile_bins(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_totalprice", 10)


def folds_sql(target, source, k=5, key="o_orderkey"):
    return f"""(with c as (select {target} as cls, count(*) as n from {source} group by 1),
 s as (select cls, coalesce(sum(n) over (order by cls rows between unbounded preceding and 1 preceding), 0) as start from c)
 select o.*, cast((start + {md5_rank(target, key=key)} - 1) % {k} as int) as fold from {source} o join s on o.{target} = s.cls)"""


@query("cv_stratified_folds", f"select o_orderkey, o_orderstatus, fold from {folds_sql('o_orderstatus', 'orders')}")
def cv_stratified_folds(spark, d):
    return S.cross_validation_folds(orders(spark, d).select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")


@query("cv_quantile_folds", f"select o_orderkey, o_totalprice, fold from {folds_sql('bin', ORDERS_BINNED)}")
def cv_quantile_folds(spark, d):
    return S.cross_validation_folds(orders(spark, d).select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@query("cv_split", f"""
select 'train' as split, o_orderstatus, count(*) as n, cast(sum(o_orderkey) as bigint) as keys from {folds_sql('o_orderstatus', 'orders')} where fold <> 2 group by 2
union all select 'valid', o_orderstatus, count(*), cast(sum(o_orderkey) as bigint) from {folds_sql('o_orderstatus', 'orders')} where fold = 2 group by 2""")
def cv_split(spark, d):
    folded = S.cross_validation_folds(orders(spark, d).select("o_orderkey", "o_orderstatus"), "o_orderkey", "o_orderstatus")
    train, valid = S.split_fold(folded, 2)
    count = lambda df, name: df.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys")).withColumn("split", F.lit(name))
    return count(train, "train").unionByName(count(valid, "valid"))


RAW = f"""(select doc_id, lang, source, n_chars, toxic, cast(quality as int) as quality, 'x' as flat from {DOCS_LABELLED})"""


@query("clean_pipeline", f"""
with m as (select max(doc_id) as doc_id, lang, source, n_chars, quality = 1 as quality, arg_min(toxic, k) as toxic
 from (select max(doc_id) as doc_id, lang, source, n_chars, quality, toxic, struct_pack(n := -count(toxic), v := toxic) as k
       from (select doc_id, lang, source, n_chars, quality, case when toxic = 1 then 'yes' else 'no' end as toxic from {RAW}) group by lang, source, n_chars, quality, toxic)
 group by lang, source, n_chars, quality),
f as (select quality from m where quality is not null group by 1 order by count(*) desc, quality limit 1)
select doc_id, lang, source, cast(n_chars as varchar) as n_chars, coalesce(quality, (select quality from f)) as quality, toxic from m""")
def clean_pipeline(spark, d):
    raw = docs_labelled(spark, d).withColumn("toxic", F.when(F.col("toxic") == 1, "yes").otherwise("no")).withColumn("flat", F.lit("x"))
    plan = CleaningPlan.fit(raw, CleaningOptions(id_col="doc_id", target="toxic", merge_duplicates=True, number_to_category=["n_chars"], missing="mean"))
    return plan.transform_train(raw)
