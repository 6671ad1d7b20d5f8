"""Ranks, prefix sums, samples and quantiles against plain definitions, on skewed data."""

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from colonnade.operators import cleaning as C, ordering as O, splitting as S


@pytest.fixture(scope="module")
def skewed(spark):
    """9,990 : 10 strata and one value that a third of all rows share."""
    return spark.range(10_000).select(
        "id", F.when(F.col("id") < 9_990, "big").otherwise("small").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.0).otherwise((F.col("id") * 7919 % 1000) / 10).alias("v"),
    ).cache()


@pytest.mark.parametrize("parts", [1, 16])
def test_hash_rank_is_row_number(skewed, parts):
    plain = skewed.withColumn("want", F.row_number().over(W.partitionBy("g").orderBy(O.shuffle_hash("id"), "id")))
    ranked = O.hash_rank(skewed.repartition(parts), "id", ["g"]).join(plain.select("id", "want"), "id")
    assert ranked.where("rank <> want").count() == 0 and ranked.count() == 10_000


def test_hash_sample_is_exact(skewed):
    got = O.hash_sample(skewed, "id", 0.25, ["g"])
    assert {r["g"]: r["count"] for r in got.groupBy("g").count().collect()} == {"big": 2498, "small": 3}
    ranked = O.hash_rank(skewed, "id", ["g"])
    want = ranked.where("(g = 'big' and rank <= 2498) or (g = 'small' and rank <= 3)").select("id")
    assert got.select("id").exceptAll(want).count() == 0


def test_null_stratum_is_a_stratum(spark):
    df = spark.range(100).withColumn("g", F.when(F.col("id") < 50, "a"))
    assert O.hash_rank(df, "id", ["g"]).where("rank = 50").count() == 2
    assert O.hash_sample(df, "id", 0.1, ["g"]).count() == 10


@pytest.mark.parametrize("buckets", [1, 5, 64])
def test_prefix_sum(skewed, buckets):
    counts = skewed.groupBy("g", "v").agg(F.count("*").alias("n"))
    got = O.prefix_sum(counts, "v", {"n": "before"}, ["g"], buckets, totals={"n": "all"})
    want = F.coalesce(F.sum("n").over(W.partitionBy("g").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    joined = got.join(counts.withColumn("want", want).select("g", "v", "want"), ["g", "v"])
    assert joined.where("before <> want").count() == 0 and joined.count() == counts.count()
    assert {r["all"] for r in got.collect()} == {9_990, 10}


def test_average_rank_of_rows_keeps_every_row(skewed):
    ranked = O.with_average_rank(skewed, "v", ["g"])
    want = F.rank().over(W.partitionBy("g").orderBy("v")) + (F.count("*").over(W.partitionBy("g", "v")) - 1) / 2
    plain = skewed.select("id", want.alias("want"))
    both = ranked.join(plain, "id")
    assert both.count() == 10_000 and both.where("abs(rank - want) > 1e-9").count() == 0


def test_skew_join_is_an_inner_join(spark, skewed):
    table = skewed.groupBy("v").agg(F.count("*").alias("n")).where("v < 50")
    got = O.skew_join(skewed, table, ["v"], "n", 10_000)
    want = skewed.join(table, "v")
    assert got.select("id", "v", "n").exceptAll(want.select("id", "v", "n")).count() == 0 and got.count() == want.count()


def test_quantile_selection_equals_percentile(skewed):
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    frame = skewed.withColumn("w", F.sin("id") * 100)
    small = {(r["g"], r["column"]): r["q"] for r in O.quantiles(frame, ["v", "w"], probs, ["g"]).collect()}
    large = {(r["g"], r["column"]): r["q"] for r in O.quantiles(frame, ["v", "w"], probs, ["g"], small_rows=0, buckets=16).collect()}
    assert small.keys() == large.keys()
    for k in small:
        assert np.allclose(small[k], large[k])


def test_quantiles_ignore_missing(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "v double")
    for limit in (0, 100):
        row = O.quantiles(df, ["v"], [0.5], small_rows=limit).first()
        assert row["n"] == 2 and row["q"] == [2.0]


def test_row_index_with_a_hot_leading_key(spark):
    df = spark.range(3_000).select(F.when(F.col("id") < 2_000, 5).otherwise(F.col("id")).alias("a"), ((F.col("id") * 7) % 3_000).alias("b"))
    got = C.row_index(df, ["a", "b"])
    want = df.withColumn("want", F.row_number().over(W.orderBy("a", "b")) - 1)
    assert got.join(want, ["a", "b"]).where("id <> want").count() == 0 and got.count() == 3_000


def test_folds_partition_the_rows_evenly(skewed):
    folded = S.stratified_folds(skewed, "id", "g", 5)
    sizes = [r["count"] for r in folded.groupBy("fold").count().collect()]
    assert sum(sizes) == 10_000 and max(sizes) - min(sizes) <= 1
    per_class = [r["count"] for r in folded.where("g = 'small'").groupBy("fold").count().collect()]
    assert per_class == [2] * 5
    again = S.stratified_folds(skewed.repartition(13), "id", "g", 5)
    assert folded.exceptAll(again).count() == 0


def test_one_class_is_still_split(spark):
    folded = S.stratified_folds(spark.range(10).withColumn("t", F.lit("x")), "id", "t", 5)
    assert [r["count"] for r in folded.groupBy("fold").count().collect()] == [2] * 5


def test_bins_are_right_closed_and_merged(spark):
    df = spark.createDataFrame([(float(v),) for v in (1, 2, 3, 4)], "v double")
    assert {r["v"]: r["bin"] for r in S.quantile_bins(df, "v", 2).collect()} == {1.0: 0, 2.0: 0, 3.0: 1, 4.0: 1}
    flat = spark.createDataFrame([(1.0,)] * 8 + [(2.0,)] * 2, "v double")
    assert {r["v"]: r["bin"] for r in S.quantile_bins(flat, "v", 4).collect()} == {1.0: 0, 2.0: 0}


@pytest.mark.parametrize("groups", [100_000, 1])
def test_samples_refine_their_cut_off(spark, monkeypatch, groups):
    """Prefixes grow until few rows are at the cut-off; a hot group, repeated ids, null groups."""
    monkeypatch.setattr(O, "BUCKET_ROWS", 5)
    monkeypatch.setattr(O, "MANY_GROUPS", groups)
    rows = [(i if i % 50 else 7, None if i % 11 == 0 else "hot" if i % 3 else f"g{i % 5}") for i in range(6_000)]
    df = spark.createDataFrame(rows, "id int, g string").repartition(4)
    edges = O.hash_cutoffs(df.withColumns({"_g": F.coalesce("g", F.lit("-")), "_h": O.shuffle_hash("id")}).select("_g", "_h"), 0.3).collect()
    assert len(edges) == 7 and max(len(r["_edge"]) for r in edges) >= 4
    got = O.hash_sample(df, "id", 0.3, ["g"])
    sizes = {r["g"]: (r["n"], r["k"]) for r in df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).join(got.groupBy("g").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("g", "_g2"), F.col("g").eqNullSafe(F.col("_g2"))).collect()}
    assert len(sizes) == 7 and all(k == int(0.3 * n + 0.5) for n, k in sizes.values())
    ranked = O.hash_rank(df, "id", ["g"]).join(df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("g", "_g2"), F.col("g").eqNullSafe(F.col("_g2")))
    want = ranked.where("rank <= round(0.3 * n)").select("id", "g")
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_digits_follow_the_rows():
    for rows in (0, 1, 10**6, 10**8, 10**10, 10**12):
        assert rows / 16 ** O.hash_digits(rows) <= O.BUCKET_ROWS


def test_large_tables_are_dealt_out(spark, tmp_path):
    """By rows, whatever the splits are: here one file that a single task would read."""
    from colonnade.session import spread

    spark.range(5_000).coalesce(1).write.parquet(str(tmp_path / "one"))
    one = spark.read.parquet(str(tmp_path / "one"))
    sizes = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes(spread(one, fill=False, rows=5_000))) == 1
    cut = sizes(spread(one, rows=100))
    assert sum(cut) == 5_000 and len(cut) == 50 and max(cut) < 200
    assert len(sizes(spread(one))) == spark.sparkContext.defaultParallelism
    assert sizes(spread(one.where("id < 0"))) == []


def test_many_scores_are_ranked_by_more_tasks(spark, monkeypatch):
    from colonnade import session
    from colonnade.operators import metrics as M

    rows = spark.range(4_000).select((F.col("id") % 2).alias("model"), (F.pmod(F.xxhash64("id"), F.lit(997)) / 997).alias("score"), (F.col("id") % 3 == 0).alias("hit"))
    told = lambda: {r["model"]: (round(r["ROC AUC"], 12), round(r["Avg Precision"], 12)) for r in M.ranking_scores(rows, ["model"]).collect()}
    seen, store = [], M.stored
    monkeypatch.setattr(M, "stored", lambda df, label: seen.append(int(spark.conf.get(session.SHUFFLE))) or store(df, label))
    few, before = told(), spark.conf.get(session.SHUFFLE)
    assert not seen
    monkeypatch.setattr(session, "SHUFFLED_ROWS", 100)
    assert told() == few and seen == [40] and spark.conf.get(session.SHUFFLE) == before and spark.conf.get(session.COALESCE) == "true"


def test_scores_are_counted_before_they_are_ranked(spark, monkeypatch):
    """Many rows of few distinct scores: tasks for the rows count them, tasks for the distinct scores rank them."""
    from colonnade import session
    from colonnade.operators import metrics as M

    draw = np.random.RandomState(17)
    rows = spark.createDataFrame([(f"m{i % 2}", float(s) / 10, bool(h)) for i, (s, h) in enumerate(zip(draw.randint(0, 10, 4_000), draw.rand(4_000) < 0.4))], "model string, score double, hit boolean")
    told = lambda: {r["model"]: (round(r["ROC AUC"], 12), round(r["Avg Precision"], 12)) for r in M.ranking_scores(rows, ["model"]).collect()}
    few, asked, plain = told(), [], M.more_partitions
    monkeypatch.setattr(session, "SHUFFLED_ROWS", 100)
    monkeypatch.setattr(M, "more_partitions", lambda s, n: asked.append(n) or plain(s, n))
    assert told() == few and asked == [4_000, 20]
