"""Queries: data-quality profiling."""

from pyspark.sql import functions as F

from colonnade.catalog import query, table
from colonnade.operators import quality as Q

LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_NUM = LINEITEM[:8]


def docs_labelled(spark, d):
    return table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").select(
        "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


DOCS_LABELLED = "(select d.doc_id, lang, source, n_chars, quality, toxic from documents d left join labels l on d.doc_id = l.doc_id)"


def count_rows(source, columns, predicate, total=None):
    """SQL of (column, n, pct) for one predicate over several columns."""
    parts = " union all ".join(
        f"select '{c}' as \"column\", count(*) filter ({predicate.format(c=c)}) as n, count(*) as t from {source} x" for c in columns
    )
    return f"select \"column\", n, round(n * 100.0 / t, 3) as pct from ({parts}) where n > 0"


def distinct_counts(source, columns, having="1=1"):
    parts = " union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_unique from {source} x" for c in columns)
    return f"select * from ({parts}) where {having}"


@query("dq_unique_counts", distinct_counts("orders", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"], "n_unique <= 20"))
def dq_unique_counts(spark, d):
    return Q.unique_counts(table(spark, d, "orders"), 20, drop_features=["o_orderkey"])


@query("dq_missing", count_rows(DOCS_LABELLED, ["doc_id", "lang", "source", "n_chars", "quality", "toxic"], "where {c} is null"))
def dq_missing(spark, d):
    return Q.special_values(docs_labelled(spark, d), "missing")


INFINITE = "(select l_quantity, case when l_quantity = 50 then 'infinity'::double when l_quantity = 49 then '-infinity'::double else l_discount end as l_discount, l_tax, l_returnflag from lineitem)"


@query("dq_infinite", count_rows(INFINITE, ["l_quantity", "l_discount", "l_tax"], "where isinf({c})"))
def dq_infinite(spark, d):
    df = table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag")
    inf = F.lit(float("inf"))
    bent = F.when(F.col("l_quantity") == 50, inf).when(F.col("l_quantity") == 49, -inf).otherwise(F.col("l_discount"))
    return Q.special_values(df.withColumn("l_discount", bent), "infinite")


@query("dq_zero", count_rows("lineitem", LINEITEM_NUM, "where {c} = 0"))
def dq_zero(spark, d):
    return Q.special_values(table(spark, d, "lineitem"), "zero")


@query("dq_negative", count_rows("customer", ["c_custkey", "c_nationkey", "c_acctbal"], "where {c} < 0"))
def dq_negative(spark, d):
    return Q.special_values(table(spark, d, "customer"), "negative")


DUP_COLS = "l_quantity, l_discount, l_tax, l_returnflag"


@query("dq_duplicate_rows", f"""
select * from (select {DUP_COLS}, count(*) over (partition by {DUP_COLS}) as n from lineitem) where n > 1""")
def dq_duplicate_rows(spark, d):
    return Q.duplicate_rows(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
REPEATED = f"(select {LINE} from lineitem union all select {LINE} from lineitem where l_orderkey % 7 = 0)"


def repeated_lines(spark, d):
    """The whole table with all its columns, a seventh of it twice."""
    lines = table(spark, d, "lineitem")
    return lines.unionByName(lines.where("l_orderkey % 7 = 0"))


@query("dq_duplicate_rows_all", f"select * from (select {LINE}, count(*) over (partition by {LINE}) as n from {REPEATED}) where n > 1")
def dq_duplicate_rows_all(spark, d):
    return Q.duplicate_rows(repeated_lines(spark, d))


@query("dq_duplicate_summary_all", f"""
select count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as n_rows, cast(coalesce(sum(n - 1), 0) as bigint) as n_redundant
from (select {LINE}, count(*) as n from {REPEATED} group by all having count(*) > 1)""")
def dq_duplicate_summary_all(spark, d):
    return Q.duplicate_summary(repeated_lines(spark, d))


@query("dq_duplicate_features", """
select * from (select *, count(*) over (partition by text, lang, source) as n from documents) where n > 1""")
def dq_duplicate_features(spark, d):
    return Q.duplicate_rows(table(spark, d, "documents"), ignore=["doc_id", "n_chars"])


@query("dq_duplicate_summary", f"""
select count(*) as n_groups, cast(coalesce(sum(n), 0) as bigint) as n_rows, cast(coalesce(sum(n - 1), 0) as bigint) as n_redundant
from (select {DUP_COLS}, count(*) as n from lineitem group by all having count(*) > 1)""")
def dq_duplicate_summary(spark, d):
    return Q.duplicate_summary(table(spark, d, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@query("dq_compare_frames", f"""
with q as (
 select 'early' as label, * from ({count_rows("(select * from lineitem where l_shipdate < timestamp '1998-01-01')", LINEITEM_NUM, "where {c} = 0")})
 union all
 select 'late' as label, * from ({count_rows("(select * from lineitem where l_shipdate >= timestamp '1998-01-01')", LINEITEM_NUM, "where {c} = 0")}))
select label, "column", n, pct, count(*) over (partition by label) as n_features from q""")
def dq_compare_frames(spark, d):
    li = table(spark, d, "lineitem")
    cut = F.lit("1998-01-01").cast("timestamp_ntz")
    return Q.compare_quality({"early": li.where(F.col("l_shipdate") < cut), "late": li.where(F.col("l_shipdate") >= cut)}, "zero")


@query("dq_schema_profile", """
with c as (select count(*) as n_rows, count(distinct l_partkey) > 2 as a, count(distinct l_suppkey) > 2 as b, count(distinct l_linenumber) > 2 as c,
  count(distinct l_quantity) > 2 as q, count(distinct l_discount) > 2 as e, count(distinct l_tax) > 2 as f from lineitem)
select v."column", v.dtype_class, 11 as n_columns, v.castable, n_rows from c, (values
  ('l_orderkey', 'number', false), ('l_partkey', 'number', true), ('l_suppkey', 'number', true), ('l_linenumber', 'number', true), ('l_quantity', 'number', true),
  ('l_extendedprice', 'number', false), ('l_discount', 'number', true), ('l_tax', 'number', true), ('l_returnflag', 'string', false),
  ('l_linestatus', 'string', false), ('l_shipdate', 'datetime', false)) v("column", dtype_class, castable)""")
def dq_schema_profile(spark, d):
    return Q.schema_profile(table(spark, d, "lineitem"), persisted=["l_orderkey", "l_extendedprice"])
